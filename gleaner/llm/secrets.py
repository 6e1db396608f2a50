"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From it follows a Boolean query over trigrams that any match must satisfy;
the index gives the texts that satisfy it, and only those are searched with the expression. A rule without
mandatory trigrams is searched in every text. The index covers all trigrams of all texts, so new rules need no
new index. It is cut into segments of texts, each with its own posting lists, and is never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import attach, in_batches, sized
from gleaner.plans.tables import written

SEGMENT_TEXTS, SEGMENT_CHARS = 1024, 4_000_000
KEYS = -1  # the row of a segment that holds the keys of its texts
MOST_STRINGS = 64  # alternatives of a literal that are followed before its trigrams are taken


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches, leftmost and not overlapping, whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


BASE_RULES = [
    Rule(
        "assign",
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        base=True,
    ),
    Rule("access", "AKIA[A-Z0-9]+", least=18, base=True),
    Rule("hex", "[0-9a-f]+", least=16, base=True),
]
# fixed values: published formats of further credentials
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
]
RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- trigram queries

Query = frozenset | tuple | None  # a set of trigrams that must all be there, ("and" | "or", queries), None: anything


def _and(queries: list) -> Query:
    queries = [q for q in queries if q is not None]
    return None if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _or(queries: list) -> Query:
    return None if not queries or None in queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold if it holds one of the strings."""
    return _or([frozenset(s[i : i + 3] for i in range(len(s) - 2)) or None for s in sorted(strings)])


def _walk(parsed) -> Query:
    """Literal runs are grown as sets of strings; whatever else stands between them ends a run."""
    from re import _constants as c

    found, run = [], {""}

    def end():
        nonlocal run
        found.append(_of_strings(run))
        run = {""}

    def grow(strings: set[str]):
        nonlocal run
        if len(run) * len(strings) > MOST_STRINGS:
            end()
        run = {a + b for a in run for b in strings}

    for op, value in parsed:
        exact = _exact(op, value)
        if exact is not None:
            grow(exact)
            continue
        end()
        if op is c.SUBPATTERN:
            found.append(_walk(value[3]))
        elif op is c.BRANCH:
            found.append(_or([_walk(p) for p in value[1]]))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0] > 0:
            found.append(_walk(value[2]))
    end()
    return _and(found)


def _exact(op, value) -> set[str] | None:
    """All strings, lower-cased, that a piece of a pattern can match; None if they are too many."""
    from re import _constants as c

    low = lambda code: chr(code + 32 if 65 <= code <= 90 else code)
    if op is c.LITERAL:
        return {low(value)}
    if op is c.IN:
        chars = set()
        for kind, v in value:
            if kind is c.LITERAL:
                chars.add(low(v))
            elif kind is c.RANGE and v[1] - v[0] < 8:
                chars |= {low(x) for x in range(v[0], v[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is c.AT:
        return {""}
    if op is c.SUBPATTERN:
        parts = [_exact(*p) for p in value[3]]
    elif op is c.BRANCH:
        ways = [_exact(c.SUBPATTERN, (None, 0, 0, p)) for p in value[1]]
        return None if None in ways else _few(set().union(*ways))
    elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[1] <= 4:
        once = _exact(c.SUBPATTERN, (None, 0, 0, value[2]))
        if once is None:
            return None
        ways = [{""}]
        for _ in range(value[1]):
            if len(ways[-1]) * len(once) > MOST_STRINGS:
                return None
            ways.append({a + b for a in ways[-1] for b in once})
        return _few(set().union(*ways[value[0] :]))
    else:
        return None
    if None in parts:
        return None
    out = {""}
    for p in parts:
        if len(out) * len(p) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in p}
    return out


def _few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= MOST_STRINGS else None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, over texts with A-Z in lower case; None if there is none."""
    from re import _parser

    return _walk(_parser.parse(pattern))


def trigrams_in(query: Query) -> set[str]:
    if query is None:
        return set()
    return set(query) if isinstance(query, frozenset) else set().union(*map(trigrams_in, query[1]))


# ---------------------------------------------------------------- the index


def _codes(text: str) -> np.ndarray:
    """A number below 256 per character: ASCII as it is with A-Z lowered, others folded onto 128 values."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(c < 128, c, 128 + c % 128)
    return np.where((folded >= 65) & (folded <= 90), folded + 32, folded).astype(np.int64)


def trigram_code(trigram: str) -> int:
    a, b, c = _codes(trigram).tolist()
    return a << 16 | b << 8 | c


def segment_postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram codes, offsets, bytes): for each trigram, the ordinals of the texts that hold it, as differences.

    A difference is a byte, or 255 and two bytes. Codes stand for few trigrams each; what is found is verified.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = _codes("".join(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.zeros(1, np.int32), np.empty(0, np.uint8)
    key = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) << 16 | owner[:-2]
    key = np.sort(key[owner[:-2] == owner[2:]])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    trigram, text = key >> 16, key & 0xFFFF
    starts = np.flatnonzero(np.concatenate([[True], trigram[1:] != trigram[:-1]])) if len(key) else np.empty(0, np.int64)
    step = np.diff(text, prepend=0)
    step[starts] = text[starts]
    width = np.where(step < 255, 1, 3)
    ends = np.cumsum(width)
    at = ends - width
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[at] = np.minimum(step, 255)
    long = step >= 255
    out[at[long] + 1], out[at[long] + 2] = step[long] & 255, step[long] >> 8
    offsets = np.concatenate([at[starts], [len(out)]]).astype(np.int32)
    return trigram[starts], offsets, out


def read_postings(raw: bytes) -> set[int]:
    out, at, i = set(), 0, 0
    while i < len(raw):
        step, i = raw[i], i + 1
        if step == 255:
            step, i = raw[i] | raw[i + 1] << 8, i + 2
        at += step
        out.add(at)
    return out


def build_index(docs: DataFrame) -> DataFrame:
    """(segment, trigram, postings) over all texts, written; keys of texts are their 64-bit hashes."""

    def run(batches):
        from pyspark import TaskContext

        task, made, keys, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def segment():
            trigrams, offsets, data = segment_postings(texts)
            lists = pa.Array.from_buffers(pa.binary(), len(trigrams), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            codes = pa.concat_arrays([pa.array([KEYS], pa.int32()), pa.array(trigrams, pa.int32())])
            held = pa.concat_arrays([pa.array([np.array(keys, np.int64).tobytes()], pa.binary()), lists])
            ids = pa.array(np.full(len(codes), task << 32 | made, np.int64))
            return pa.RecordBatch.from_arrays([ids, codes, held], ["segment", "trigram", "postings"])

        for batch in batches:
            for key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text is None:
                    continue
                keys.append(key)
                texts.append(text)
                chars += len(text)
                if len(texts) == SEGMENT_TEXTS or chars > SEGMENT_CHARS:
                    yield segment()
                    made, keys, texts, chars = made + 1, [], [], 0
        if texts:
            yield segment()

    return written(docs.select(F.xxhash64("text"), "text").mapInArrow(run, "segment bigint, trigram int, postings binary"))


def _evaluate(query: Query, held: dict[str, set]) -> set[int]:
    if isinstance(query, frozenset):  # the shortest list first
        return reduce(set.__and__, sorted((held.get(t, set()) for t in query), key=len))
    parts = [_evaluate(q, held) for q in query[1]]
    return reduce(set.__and__ if query[0] == "and" else set.__or__, parts)


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): texts, by key, whose trigrams satisfy the query of some rule, with the rules' numbers."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    codes: dict[int, list[str]] = {}
    for t in set().union(*map(trigrams_in, queries.values())) if queries else ():
        codes.setdefault(trigram_code(t), []).append(t)

    def look_up(part):
        import pandas as pd

        held, keys = {}, b""
        for code, raw in zip(part["trigram"], part["postings"], strict=True):
            if code == KEYS:
                keys = raw
            else:
                held |= dict.fromkeys(codes[code], read_postings(raw))
        by_text: dict[int, list[int]] = {}
        for k, q in queries.items():
            for text in _evaluate(q, held):
                by_text.setdefault(text, []).append(k)
        all_keys = np.frombuffer(keys, np.int64)
        return pd.DataFrame({"key": all_keys[np.array(list(by_text), np.int64)], "rules": pd.Series(list(by_text.values()), dtype=object)})

    wanted = index.filter(F.col("trigram").isin(KEYS, *codes))
    return wanted.groupBy("segment").applyInPandas(look_up, "key bigint, rules array<int>")


# ---------------------------------------------------------------- the scan


def find(text: str, rules: list[tuple[int, Rule, re.Pattern]]) -> list[tuple[int, int, int]]:
    """(start, rule number, end), by start and then rule."""
    return sorted(
        (m.start(), k, m.end()) for k, rule, pattern in rules for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least
    )


def _scanner(rules: list[Rule]):
    def make():
        compiled = [(k, r, re.compile(r.pattern)) for k, r in enumerate(rules)]
        always = {k for k, r in enumerate(rules) if trigram_query(r.pattern) is None}

        def scan(doc_ids, texts, numbers):
            starts, ends, kinds = [], [], []
            for text, some in zip(texts, numbers, strict=True):
                found = find(text or "", [x for x in compiled if x[0] in always or x[0] in (some or ())])
                starts.append([s for s, _, _ in found])
                ends.append([e for _, _, e in found])
                kinds.append([k for _, k, _ in found])
            return doc_ids, starts, ends, kinds

        return scan

    return make


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id and the arrays start, end (code points, end exclusive) and rule (its number).

    A null text has no spans. Copies and repeated ids get a row each. Only id_col and text are read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), "text")
    found = candidates(build_index(docs), rules).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules"))
    stored, size = sized(found, 60)
    rows = attach(docs.withColumn("key", F.xxhash64("text")), stored, size, ["key"]).select("doc_id", "text", "rules")
    return in_batches(rows, _scanner(rules), "doc_id bigint, start array<int>, end array<int>, rule array<int>")


def report(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.base]
    zipped = F.arrays_zip("start", "end", "rule")
    label = lambda x: F.concat_ws(":", F.get(names, x["rule"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, label), ",")
    count = lambda kind: F.size(F.filter("rule", lambda k: F.get(names, k) == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs, rules, id_col).select(
        "doc_id",
        *[count(r.kind) for r in rules if r.base],
        F.sha2(joined(F.filter(zipped, lambda x: x["rule"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(zipped).alias("spans"),
    )
