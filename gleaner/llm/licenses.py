"""License scan by diagonal voting. DataFrame functions only.

All k-grams of words of a text, as rolling hashes, meet the places where license templates hold them. A meeting votes
for the diagonal text position - template place. Diagonals next to each other (words put in or left out) are merged to
a span, and the span's votes are verified word by word. A span that holds enough of its template's words carries the
template's label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import attach, sized, text_key
from gleaner.llm.decontaminate import words_of

GRAM = 3  # words of a k-gram; a template of fewer words is one gram
SHIFT = 3  # diagonals that differ by up to so many words belong to one span
LEAST_SHARE = 0.75  # of a template's words that a span holds to carry its label


@dataclass(frozen=True)
class Template:
    """A text to look for. exact: all of its words in a row, no others between them."""

    label: str
    text: str
    exact: bool = False


# Phrases that name a license, and the wording of published license notices.
PHRASES = [
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
]
NOTICES = [
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4.0"),
    Template("cc-by-sa", "licensed under cc by sa 4.0"),
    Template("mit", "released under the mit license"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_grams(spark: SparkSession, templates: list[Template], gram: int) -> DataFrame:
    """(h, size, template, place, exact, n): the k-grams of the templates, by hash; templates are numbered from 0."""
    rows = [(k, t.text, t.exact) for k, t in enumerate(templates)]
    made = spark.createDataFrame(rows, "template int, text string, exact boolean").withColumn("words", words_of(F.col("text")))
    made = made.filter(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(gram)))
    made = made.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))))
    h = F.lit(None).cast("bigint")
    for size in range(1, gram + 1):
        h = F.when(F.col("size") == size, gram_hash(F.col("words"), F.col("place"), size)).otherwise(h)
    return made.select(h.alias("h"), "size", "template", "place", "exact", F.size("words").alias("n"))


def gram_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def rolling(words: Column, size: int) -> Column:
    """The hashes of all grams of size words, in order."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda at: gram_hash(words, at, size))
    return F.when(F.size(words) >= size, every).otherwise(F.array().cast("array<bigint>"))


def votes(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, template, exact, n, size, diagonal, places): template places that a text holds on one diagonal.

    A text that occurs several times has one key, so its votes fall together.
    """
    own = docs.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    listed = own.select("key", F.size("words").alias("own"), F.concat(*[rolling(F.col("words"), s) for s in sizes]).alias("hs"))
    # outer: the filter that a plain explode brings would be moved below, and cut the text anew for every gram
    placed = listed.select("key", "own", F.posexplode_outer("hs").alias("p", "h"))
    stored, size = sized(grams, 64)
    met = attach(placed, stored, size, ["h"], "inner")
    before, position = F.lit(0), F.lit(None).cast("int")
    for s in sizes:  # grams of the sizes follow each other in the list
        position = F.when(F.col("size") == s, F.col("p") - before).otherwise(position)
        before = before + F.greatest(F.col("own") - (s - 1), F.lit(0))
    diagonal = (position - F.col("place")).alias("diagonal")
    return met.groupBy("key", "template", "exact", "n", "size", diagonal).agg(F.collect_set("place").alias("places"))


def spans(voted: DataFrame, shift: int) -> DataFrame:
    """(key, template, n, size, exact, held): neighbouring diagonals of a template merged; held: (diagonal, places).

    Diagonals that differ by a template's length or more are places of their own, however large shift is.
    """
    w = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("exact"), F.lit(0)).otherwise(F.least(F.lit(shift), F.col("n") - 1))
    opened = voted.withColumn("opens", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(w))
    return opened.groupBy("key", "template", "n", "size", "exact", "span").agg(
        F.sort_array(F.collect_list(F.struct("diagonal", "places"))).alias("held")
    )


def found_licenses(
    docs: DataFrame, templates: list[Template], gram: int = GRAM, shift: int = SHIFT, id_col: str = "doc_id"
) -> DataFrame:
    """Per row of docs: doc_id, n_words, found: (template, start, stop, share) of every span with a verified vote.

    template is the index in templates, start and stop are word positions (stop exclusive), share the part of the
    template's words that the span holds in place. Words are runs of ASCII letters and digits and of all characters
    beyond ASCII, A-Z in lower case. found is sorted by template, start and stop.

    Only id_col and text are read. A null or empty text has no words and no spans; a very long one is a row among
    others, whose spans grow with its length. Rows with repeated texts, equal or null ids each get a row; their votes
    are counted once. Templates without words are never found; empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    grams = template_grams(spark, templates, gram)
    voted = votes(docs, grams, list(range(1, gram + 1)) if not templates else sorted(_sizes(templates, gram)))
    merged = spans(voted, shift)
    per_text = merged.groupBy("key").agg(F.collect_list(F.struct("template", "n", "size", "held")).alias("spans"))
    stored, size = sized(per_text, F.size("spans") * 24 + F.length(F.to_json("spans")))
    rows = attach(docs.withColumn("key", text_key(F.col("text"))), stored, size, ["key"])
    rows = rows.select("doc_id", "spans", words_of(F.col("text")).alias("own"))
    listed = F.array(*[F.array(*[F.lit(w) for w in _words(t.text)]).cast("array<string>") for t in templates]) if templates else F.array(F.array().cast("array<string>"))
    return rows.select(
        "doc_id", F.size("own").cast("bigint").alias("n_words"), _verified(F.col("spans"), F.col("own"), listed).alias("found")
    )


def _words(text: str) -> list[str]:
    """words_of for the ASCII wording of templates."""
    return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split()


def _sizes(templates: list[Template], gram: int) -> set[int]:
    return {min(gram, len(_words(t.text))) for t in templates} - {0}


def _verified(spans: Column, own: Column, listed: Column) -> Column:
    """Spans whose votes are compared word by word: what stays of each, as (template, start, stop, share)."""

    def of_span(s):
        words = F.element_at(listed, s["template"] + 1)

        def of_diagonal(x):
            same = F.filter(
                x["places"],
                lambda p: F.slice(own, x["diagonal"] + p + 1, s["size"]) == F.slice(words, p + 1, s["size"]),
            )
            return F.transform(same, lambda p: F.struct(p.alias("place"), (x["diagonal"] + p).alias("at")))

        held = F.flatten(F.transform(s["held"], of_diagonal))
        covered = F.array_distinct(F.flatten(F.transform(held, lambda v: F.sequence(v["place"], v["place"] + s["size"] - 1))))
        return F.struct(
            s["template"].alias("template"),
            F.array_min(F.transform(held, lambda v: v["at"])).cast("bigint").alias("start"),
            (F.array_max(F.transform(held, lambda v: v["at"])) + s["size"]).cast("bigint").alias("stop"),
            F.round(F.size(covered) / s["n"], 6).alias("share"),
        )

    every = F.transform(F.coalesce(spans, F.array()), of_span)
    return F.array_sort(F.filter(every, lambda s: s["start"].isNotNull()))


def report(
    docs: DataFrame,
    phrases: list[Template] = PHRASES,
    notices: list[Template] = NOTICES,
    least_share: float = LEAST_SHARE,
    id_col: str = "doc_id",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a phrase stands whole; first_word and last_word are the smallest and largest of
    their starts, null without any. base_labels are the labels of these phrases; labels adds those of notices of which
    a span holds least_share of the words. Both are distinct, sorted and joined by commas. score is the largest share
    of a template that any span holds: 1 with a whole phrase, 0 without a vote. Ties change nothing: labels are sets,
    and positions are a minimum and a maximum. For nulls, empty and very long texts, repeated rows, empty tables and
    other columns see found_licenses.
    """
    templates = [*phrases, *notices]
    labels = F.array(*[F.lit(t.label) for t in templates])
    made = found_licenses(docs, templates, id_col=id_col)
    whole = F.filter("found", lambda s: (s["template"] < len(phrases)) & (s["share"] == 1))
    more = F.filter("found", lambda s: (s["template"] >= len(phrases)) & (s["share"] >= least_share))
    named = lambda spans: F.transform(spans, lambda s: F.element_at(labels, s["template"] + 1))
    starts = F.transform(F.col("whole"), lambda s: s["start"])
    made = made.withColumn("whole", whole).withColumn("more", more)
    return made.select(
        "doc_id",
        "n_words",
        F.size("whole").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named(F.col("whole")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(named(F.concat("whole", "more")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
