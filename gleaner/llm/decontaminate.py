"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

The index holds postings (term, text key, position). Every window of a benchmark item is looked up from its
two rarest terms in the corpus: their posting lists are shifted by the term's place in the item and
intersected; what both lists share is compared with the text word by word, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ascii_lower, attach, sized, text_key
from gleaner.plans.tables import written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # all that is no word: ASCII other than letters and digits
WINDOW = 10


def words_of(text: Column) -> Column:
    """Words in order. Cutting between them costs a quarter of what matching them does."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, item_id, words, at, n): one row per window; an item of fewer words, but not none, is one window.

    Repeated items count once; items with a null text or no words have no window.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0).distinct()
    items = items.withColumn("item", F.unhex(F.md5(F.to_json(F.struct("item_id", "words")))))
    n = F.least(F.size("words"), F.lit(window))
    return items.select("item", "item_id", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))


def corpus_counts(docs: DataFrame, terms: DataFrame, terms_size: int) -> DataFrame:
    """How often each benchmark term occurs in all texts; terms that never occur are absent."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return attach(tokens, terms, terms_size, ["term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


def anchors_of(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows whose words all occur in the corpus, with the places in the item of their two rarest terms.

    Terms that occur nowhere rule their windows out. A window of one word has one anchor, given twice.
    """
    placed = windows.select("item", "at", "n", F.posexplode(F.slice("words", F.col("at") + 1, F.col("n"))).alias("i", "term"))
    seen = placed.join(counts, "term").groupBy("item", "at", "n").agg(
        F.sort_array(F.collect_list(F.struct("uses", (F.col("at") + F.col("i")).alias("place"), "term"))).alias("rare")
    )
    second = F.coalesce(F.try_element_at("rare", F.lit(2)), F.element_at("rare", 1))
    return seen.filter(F.size("rare") == F.col("n")).select(
        "item", "at", "n", F.element_at("rare", 1).alias("first"), second.alias("second")
    )


def build_index(docs: DataFrame, terms: DataFrame, terms_size: int) -> DataFrame:
    """Postings (term, key, position from 0) of the given terms over all texts, written, sorted by term in each file.

    A text that occurs several times has one key, so its postings repeat; lookups group them again.
    """
    tokens = docs.select(text_key(F.col("text")).alias("key"), F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return written(attach(tokens, terms, terms_size, ["term"], "left_semi").sortWithinPartitions("term"))


def shifted(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, item, shift, places): anchor places of an item that a text holds at one offset."""
    both = anchors.select("item", F.explode(F.array("first", "second")).alias("a")).select("item", "a.place", "a.term").distinct()
    stored, size = sized(both, F.length("term") + 40)
    found = attach(index, stored, size, ["term"], "inner")
    return found.groupBy("key", "item", (F.col("position") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places")
    )


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, item, shift, spots): windows of an item whose two rarest terms stand in place in a text."""
    spots = anchors.groupBy("item").agg(
        F.collect_list(F.struct("at", "n", F.col("first.place").alias("a"), F.col("second.place").alias("b"))).alias("spots")
    )
    stored, size = sized(spots, F.size("spots") * 20 + 60)
    both = attach(shifted(index, anchors), stored, size, ["item"], "inner")
    held = F.filter(
        "spots",
        lambda w: F.array_contains(F.col("places"), w["a"])
        & F.array_contains(F.col("places"), w["b"])
        & (w["at"] + F.col("shift") >= 0),
    )
    return both.select("key", "item", "shift", held.alias("spots")).filter(F.size("spots") > 0)


def near_matches(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(key, item): texts that hold the two rarest terms of some window within slop words of their places.

    Slop 0 is the phrase candidate; a larger one also finds passages with words put in or left out.
    """
    shifts = shifted(index, anchors).select("key", "item", "shift", F.explode("places").alias("place"))
    by_place = shifts.groupBy("key", "item", "place").agg(F.collect_set("shift").alias("shifts"))
    per_text = by_place.groupBy("key", "item").agg(F.map_from_entries(F.collect_list(F.struct("place", "shifts"))).alias("m"))
    spots = anchors.select("item", F.col("first.place").alias("a"), F.col("second.place").alias("b")).distinct()
    spots = spots.groupBy("item").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    near = F.exists(
        "pairs",
        lambda p: F.coalesce(
            F.exists(
                F.try_element_at("m", p["a"]),
                lambda x: F.exists(F.try_element_at("m", p["b"]), lambda y: F.abs(x - y) <= slop),
            ),
            F.lit(False),
        ),
    )
    return per_text.join(spots, "item").filter(near).select("key", "item")


def found_windows(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(key, found) of texts with candidate windows of benchmark items, written, and its size in bytes."""
    windows = written(item_windows(benchmark, window))
    terms, terms_size = sized(windows.select(F.explode("words").alias("term")).distinct(), F.length("term") + 24)
    counts = written(corpus_counts(docs, terms, terms_size))
    anchors = written(anchors_of(windows, counts))
    rare, rare_size = sized(
        anchors.select(F.explode(F.array("first.term", "second.term")).alias("term")).distinct(), F.length("term") + 24
    )
    index = build_index(docs, rare, rare_size)
    items = windows.select("item", "item_id", "words").distinct()
    found = phrase_candidates(index, anchors).join(items, "item")
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("item_id", "words", "shift", "spots")).alias("found"))
    return sized(per_text, F.length(F.to_json("found")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs id_col and text, benchmark item_id and text; other columns are not looked at. A null text has no
    words and no hits. Rows with equal or null ids each get a row. Items without an id hit words but are not listed.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    stored, size = found_windows(docs, benchmark, window)
    rows = docs.withColumn("key", text_key(F.col("text")))
    own = attach(rows, stored, size, ["key"]).select("doc_id", "found", words_of(F.col("text")).alias("own"))
    return own.select(
        "doc_id", F.size("own").cast("bigint").alias("n_words"), _exact(F.col("found"), F.col("own")).alias("exact")
    ).select("doc_id", "n_words", *_summary(F.col("exact")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of a benchmark item stands."""
    stored, size = found_windows(docs.select("text"), benchmark, window)
    stored = stored.select(F.col("key").alias("__key"), F.col("found").alias("__found"))
    rows = attach(docs.withColumn("__key", text_key(F.col("text"))), stored, size, ["__key"])
    hit = F.size(_exact(F.col("__found"), words_of(F.col("text")))) > 0
    return rows.filter(F.col("__found").isNull() | ~hit).select(*[F.col(f"`{c}`") for c in docs.columns])


def _exact(found: Column, own: Column) -> Column:
    """The windows that really stand in the text: (item_id, start, n)."""

    def of_item(f):
        same = F.filter(
            f["spots"],
            lambda w: F.slice(own, f["shift"] + w["at"] + 1, w["n"]) == F.slice(f["words"], w["at"] + 1, w["n"]),
        )
        return F.transform(same, lambda w: F.struct(f["item_id"].alias("item_id"), (f["shift"] + w["at"]).alias("start"), w["n"].alias("n")))

    return F.flatten(F.transform(F.coalesce(found, F.array()), of_item))


def _summary(exact: Column) -> list[Column]:
    covered = F.flatten(F.transform(exact, lambda w: F.sequence(w["start"], w["start"] + w["n"] - 1)))
    items = F.array_distinct(F.array_compact(F.transform(exact, lambda w: w["item_id"])))
    n_hit = F.size(F.array_distinct(covered)).cast("bigint")
    return [
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]
