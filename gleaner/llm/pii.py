"""Personal data, and the words that give it away: information-theoretic sanitisation.

E-mail and network addresses, card and phone numbers are found by their form. Masking them is not enough where
other words still tell whom a text is about. How much a term t reveals of an entity e is the share of the
entity's information that their co-occurrence in the corpus carries: PMI(t, e) / IC(e), with probabilities from
distinct texts. In texts that mention e, terms above one threshold are generalised, above a second one removed.

Two ways of counting: beside a mention, in windows of words with a hard minimum (the default of the functions), and
over whole texts (whole=True), where every word of a text counts, entities met once or twice as well, and mail
domains, address and number prefixes as entities of their own. There a bound of confidence stands for the minimum.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import LOWER, UPPER, append, ascii_lower, attach, in_batches, sized, text_key
from gleaner.plans.tables import written

NEIGHBOURS = 8  # words on either side of a mention that count as its context
LEAST_CONTEXTS = 3  # different contexts in which a term must stand beside an entity before it can disclose it
GENERALISE, REMOVE = 0.6, 0.85  # shares of an entity's information
LONGEST_TERM = 40
Z = 1.0  # standard errors by which a joint probability counts as less than it was seen, over whole texts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "hint", "term")  # the first four by form; hints are generalised, terms removed
BASE = 4
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[WORD]", "")
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{3,}"  # letters, and whatever is not ASCII
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words, terms and shorter ones
_TERM = re.compile(TERM)
_WORD = re.compile(TERM.replace("{3,}", "+"))  # every run of letters
_LOWER = str.maketrans(UPPER, LOWER)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of what is personal by form, by start and then kind; values are normalised."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end(), m.group().translate(_LOWER)) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = _digits(m.group())
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def contexts(text: str) -> list[tuple[int, int, list[str]]]:
    """(entity, context, terms) of each mention: the distinct terms among the nearest words, outside of mentions."""
    found = find(text)
    if not found:
        return []
    low = text.translate(_LOWER)
    words = [(m.start(), m.end(), m.group()) for m in _TERM.finditer(low)]
    words = [w for w in words if not any(s < w[1] and w[0] < e for s, _, e, _ in found)]
    out = []
    for start, kind, end, value in found:
        before = [w for s, e, w in words if e <= start][-NEIGHBOURS:]
        after = [w for s, e, w in words if s >= end][:NEIGHBOURS]
        terms = sorted({w for w in before + after if len(w) <= LONGEST_TERM})
        out.append((_number(f"{KINDS[kind]}:{value}"), _number("\n".join(terms)), terms))
    return out


def _mentions():
    """A row for each mention, and for each text with mentions one without entity that holds all of its terms."""

    def rows(keys, texts):
        made = []
        for key, text in zip(keys, texts, strict=True):
            if found := contexts(text):
                made += [(key, *c) for c in found]
                made.append((key, None, None, sorted({w for w in _TERM.findall(text.translate(_LOWER)) if len(w) <= LONGEST_TERM})))
        return [[m[i] for m in made] for i in range(4)]

    return rows


def disclosing(docs: DataFrame, found: DataFrame, generalise: float, remove: float) -> DataFrame:
    """(entity, term, removed): terms whose co-occurrence carries at least `generalise` of the entity's information.

    Counts are over all texts, copies counting once: distinct contexts for entities and for pairs, distinct texts
    for terms. Only pairs with LEAST_CONTEXTS contexts are looked at.
    """
    mentions = found.filter(F.col("entity").isNotNull())
    seen = mentions.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = mentions.select("entity", "context", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_te")
    )
    pairs = pairs.filter(F.col("n_te") >= LEAST_CONTEXTS)
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").filter(F.col("text").isNotNull())
    total = texts.select("key").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    share = lambda n_t: F.round(
        F.log(F.col("n_te") * total / (n_t * F.col("n_e"))) / F.log(total / F.col("n_e")), 9
    )
    # a term stands in no fewer texts than those that mention somebody: most terms reveal too little by that bound
    # already, so only few are counted in all texts
    beside = found.filter(F.col("entity").isNull()).select("key", F.explode("terms").alias("term")).distinct()
    beside = beside.groupBy("term").agg(F.count(F.lit(1)).alias("n_m"))
    pairs = pairs.join(seen, "entity").join(beside, "term").filter(total > F.col("n_e"))
    pairs = written(pairs.filter(share(F.greatest("n_m", "n_te")) >= generalise))
    terms, terms_size = sized(pairs.select("term").distinct(), F.length("term") + 24)
    words = texts.select("key", F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), BETWEEN))).alias("term"))
    held = attach(words, terms, terms_size, ["term"], "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    counted = pairs.join(held, "term").withColumn("share", share(F.greatest("n_t", "n_te")))
    return counted.filter(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("removed"))


def coarse(kind: int, value: str) -> str:
    """What several entities share: the mail domain, three parts of an address, a card's issuer, a phone's prefix."""
    return (value.rpartition("@")[2], value.rpartition(".")[0], value[:6], value[:-4])[kind]


def _wholes():
    """A row for each text with mentions: its entities, coarse ones too, and all of its words."""

    def rows(keys, texts):
        made = []
        for key, text in zip(keys, texts, strict=True):
            if found := find(text):
                entities = {_number(f"{KINDS[k]}:{v}") for _, k, _, v in found} | {_number(f"{KINDS[k]} of:{coarse(k, v)}") for _, k, _, v in found}
                made.append((key, sorted(entities), sorted(set(_WORD.findall(text.translate(_LOWER))))))
        return [[m[i] for m in made] for i in range(3)]

    return rows


def bounded_share(n_te, n_t, n_e, total):
    """PMI of term and entity by the Wilson bound of their joint probability, as a share of the entity's information.

    One joint text counts as 0.38, two as 1.0, many as nearly what they are.
    """
    low = (n_te + Z * Z / 2 - Z * F.sqrt(n_te * (1 - n_te / total) + Z * Z / 4)) / (1 + Z * Z / total)
    return F.log(low * total / (n_t * n_e)) / F.log(total / n_e)


def whole_terms(texts: DataFrame, generalise: float, remove: float) -> DataFrame:
    """(key, term, removed) of each text with mentions: its terms that disclose an entity it mentions.

    texts: key and text, none null. Everything is counted in distinct texts. Entities of the same texts have the same
    counts, so they are one class, known by the number, sum and exclusive or of its texts' hashes; a text full of
    numbers of its own has one class for them all. No pair is left out but those that no count could make disclosing.
    """
    found = written(in_batches(texts, _wholes, "key binary, entities array<bigint>, terms array<string>").dropDuplicates(["key"]))
    copies, size = sized(texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), 40)
    total = texts.select("key").distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).first()[0] or 1.0
    # how many texts hold each word: texts without copies are counted as they come
    split = F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), BETWEEN))).alias("term")
    words = attach(texts, copies, size, ["key"]).select("key", "copies", split).filter("term != ''")
    once = words.filter("copies IS NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    again = words.filter("copies IS NOT NULL").select("key", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    held = once.union(again).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    h = F.xxhash64("key")
    per_entity = found.select(h.alias("h"), "key", F.explode("entities").alias("entity"))
    classes = per_entity.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_e"), F.sum(F.col("h").cast("decimal(20,0)")).alias("sum"), F.bit_xor("h").alias("xor")
    )
    classes = classes.select("entity", "n_e", F.xxhash64("n_e", "sum", "xor").alias("class"))
    of_text = per_entity.join(classes, "entity").filter(F.col("n_e") < total).select("key", "class", "n_e").distinct()
    of_text = of_text.groupBy("key").agg(F.collect_list(F.struct("class", "n_e")).alias("classes"))
    share = lambda n_te: F.round(bounded_share(n_te, F.col("n_t"), F.col("n_e"), total), 9)
    beside = found.select("key", F.explode("terms").alias("term")).join(held, "term").join(of_text, "key")
    beside = beside.select("key", "term", "n_t", F.inline("classes"))
    beside = written(beside.filter(share(F.least("n_t", "n_e")) >= generalise))
    pairs = beside.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pairs = pairs.select("class", "term", share(F.col("n_te")).alias("share")).filter(F.col("share") >= generalise)
    told = beside.select("key", "class", "term").join(pairs, ["class", "term"])
    return told.groupBy("key", "term").agg((F.max("share") >= remove).alias("removed"))


def _spans():
    def rows(doc_ids, texts, told):
        starts, ends, kinds = [], [], []
        for text, terms in zip(texts, told, strict=True):
            found = [f[:3] for f in find(text or "")]
            if terms:
                kind = {t["term"]: 5 if t["removed"] else 4 for t in terms}
                words = [(m.start(), kind.get(m.group()), m.end()) for m in _WORD.finditer(text.translate(_LOWER))]
                found += [w for w in words if w[1] and not any(s < w[2] and w[0] < e for s, _, e in found)]
            found.sort()
            starts.append([f[0] for f in found])
            ends.append([f[2] for f in found])
            kinds.append([f[1] for f in found])
        return doc_ids, starts, ends, kinds

    return rows


def _masked():
    spans = _spans()

    def rows(texts, told):
        out = []
        for text, starts, ends, kinds in zip(texts, *spans(texts, texts, told)[1:], strict=True):
            parts, at = [], 0
            for start, end, kind in zip(starts, ends, kinds, strict=True):
                if start >= at:
                    parts += [text[at:start], MASKS[kind]]
                at = max(at, end)
            out.append(text if text is None else "".join([*parts, text[at:]]))
        return out

    return rows


def with_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, whole: bool = False) -> DataFrame:
    """docs with the column told: the disclosing terms of the entities that the text mentions, or null."""
    texts = docs.filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    if whole:
        per_text = whole_terms(texts, generalise, remove)
    else:
        found = written(in_batches(texts, _mentions, "key binary, entity bigint, context bigint, terms array<string>"))
        told = written(disclosing(docs, found, generalise, remove))
        per_text = found.filter(F.col("entity").isNotNull()).select("key", "entity").distinct().join(told, "entity").groupBy("key", "term").agg(F.max("removed").alias("removed"))
    per_text = per_text.groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("told"))
    stored, size = sized(per_text.select(F.col("key").alias("__key"), F.col("told").alias("__told")), F.size("__told") * 40 + 40)
    return attach(docs.withColumn("__key", text_key(F.col("text"))), stored, size, ["__key"]).drop("__key")


def scan(docs: DataFrame, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id and the arrays start, end (code points, end exclusive) and kind (place in KINDS).

    A null text has no spans. Copies and repeated ids get a row each. Only id_col and text are read.
    """
    rows = with_terms(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text"), whole=whole).select("doc_id", "text", "__told")
    return in_batches(rows, _spans, "doc_id bigint, start array<int>, end array<int>, kind array<int>")


def report(docs: DataFrame, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined)."""
    names, zipped = F.array(*[F.lit(k) for k in KINDS]), F.arrays_zip("start", "end", "kind")
    label = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, label), ",")
    count = lambda k: F.size(F.filter("kind", lambda x: x == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return scan(docs, id_col, whole).select(
        "doc_id",
        *[count(k) for k in range(BASE)],
        F.sha2(joined(F.filter(zipped, lambda x: x["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(zipped).alias("spans"),
    )


def sanitise(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs with every span masked or removed in text; all other columns stay as they are.

    Where spans overlap, the first one's mask stands for all.
    """
    rows = with_terms(docs, whole=whole)

    def make():
        mask = _masked()
        return lambda texts, told: (mask(texts, told),)

    made = append(rows, ["text", "__told"], make, "__masked string")
    return made.select(*[F.col("__masked").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
