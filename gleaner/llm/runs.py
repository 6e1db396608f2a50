"""Periodic runs of words: suffix arrays, LCP intervals and the branching-tandem test.

Texts of an Arrow batch are laid one after another, words numbered per text and every text ended by a symbol of its
own, so that one suffix array by prefix doubling serves them all and no match crosses texts. An interval of suffixes
that share exactly depth words holds a branching tandem repeat where suffixes i and i + depth lie in it, in different
children. All children but the largest are tested, i + depth and i - depth, by the inverse suffix array. A branching
square is the last of its run: rotating it to the left while words match gives the whole run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_WORDS = 200_000  # words of the texts that one suffix array holds; a longer text has one alone
LEAST_LENGTH, LEAST_EXPONENT = 6, 4


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their places, LCP with the suffix before) of numbers whose suffixes all differ.

    Prefix doubling that sorts only suffixes which still tie; the ranks of each level give the LCPs.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    heads = np.empty(n, bool)
    heads[0] = True
    np.not_equal(s[order[1:]], s[order[:-1]], out=heads[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    parted = np.where(heads, 0, -1)  # the level that parts a suffix from the one before
    levels, width = [rank], 1
    while True:
        tied = ~heads
        tied[:-1] |= ~heads[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        rank = levels[-1].copy()
        held = order[slots]
        major, minor = levels[-1][held], levels[-1][held + width]
        by = np.argsort(major * n + minor, kind="stable")
        held, major, minor = held[by], major[by], minor[by]
        order[slots] = held
        fresh = np.ones(len(held), bool)
        fresh[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
        rank[held] = np.maximum.accumulate(np.where(fresh, slots, 0))
        opened = slots[fresh & ~heads[slots]]
        parted[opened] = len(levels)
        heads[opened] = True
        levels.append(rank)
        width *= 2
    lcp = np.where(parted > 0, 1 << np.maximum(parted - 1, 0), 0)
    for level in range(len(levels) - 3, -1, -1):
        at = np.flatnonzero(parted - 2 >= level)
        ranks, l = levels[level], lcp[at]
        lcp[at] += np.where(ranks[order[at] + l] == ranks[order[at - 1] + l], 1 << level, 0)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, lcp


def smaller_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest one before and after with a smaller LCP."""
    before, after, stack = [0] * len(lcp), [len(lcp)] * len(lcp), []
    push, pop, values = stack.append, stack.pop, lcp.tolist()
    for k, l in enumerate(values):
        while stack and values[stack[-1]] > l:
            after[pop()] = k
        before[k] = (stack[-1] if values[stack[-1]] < l else before[stack[-1]]) if stack else 0
        push(k)
    return np.array(before), np.array(after)


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat: words [start, start + period) come twice, and not once more
    shifted by one to the right."""
    order, place, lcp = suffix_array(s)
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return inner, inner
    # only places where suffixes share a word matter; a zero in between ends all intervals
    low, high = smaller_bounds(lcp)
    low, high, depth = low[inner], high[inner], lcp[inner]
    # children of an interval (low, depth) start at low and at each place with its depth
    by = np.lexsort((inner, depth, low))
    low, high, depth, inner = low[by], high[by], depth[by], inner[by]
    opens = np.ones(len(inner), bool)
    opens[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    node = np.cumsum(opens) - 1
    starts = np.concatenate([low[opens], inner])  # the first child of each, then those after its places
    of = np.concatenate([np.arange(opens.sum()), node])
    by = np.lexsort((starts, of))
    starts, of = starts[by], of[by]
    low, high, depth = low[opens], high[opens], depth[opens]
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    stops = np.where(last, high[of], np.append(starts[1:], 0))
    sizes = stops - starts
    largest = np.lexsort((sizes, of))[last]  # the last of each interval by size
    tested = np.ones(len(of), bool)
    tested[largest] = False
    starts, stops, sizes, of = starts[tested], stops[tested], sizes[tested], of[tested]
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    suffix = order[first + np.arange(len(first))]
    child = np.repeat(np.arange(len(of)), sizes)
    low, high, depth = low[of][child], high[of][child], depth[of][child]
    own_low, own_high = starts[child], stops[child]
    found = []
    for sign in (1, -1):
        other = suffix + sign * depth
        there = np.where((other >= 0) & (other < len(s)), place[np.clip(other, 0, len(s) - 1)], -1)
        hit = (there >= low) & (there < high) & ~((there >= own_low) & (there < own_high))
        found.append((np.minimum(suffix, other)[hit], depth[hit]))
    start, period = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.stack([start, period]), axis=1)  # a pair of small children finds its square twice
    return pairs[0], pairs[1]


def runs(s: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all maximal runs with their smallest period, by start, then period."""
    start, period = branching_squares(s)
    # rotate by whole steps at once; a run of enough repeats needs so many to the left of its last square
    for back in range(1, 3):
        need = np.maximum(least_length, least_exponent * period) - 2 * period >= back
        fits = start >= back
        same = s[np.maximum(start - back, 0)] == s[np.maximum(start - back, 0) + period]
        keep = ~need | (fits & same)
        start, period = start[keep], period[keep]
    made: dict[tuple[int, int], int] = {}
    for i, p in zip(start.tolist(), period.tolist()):
        stop, begin, step = i + 2 * p, i, 16
        while begin > 0:
            low = max(0, begin - step)
            differ = np.flatnonzero(s[low:begin] != s[low + p : begin + p])
            if len(differ):
                begin = low + int(differ[-1]) + 1
                break
            begin, step = low, step * 2
        known = made.get((begin, stop))
        if known is None or p < known:
            made[begin, stop] = p
    kept = [(b, e, p) for (b, e), p in made.items() if e - b >= max(least_length, least_exponent * p)]
    return sorted(kept, key=lambda r: (r[0], r[2]))


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words, ends of the texts among them, numbers of equal words), of texts cut at ASCII white space."""
    split = pc.ascii_split_whitespace(pc.cast(texts, pa.large_string()))
    flat = split.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    lengths = np.diff(split.offsets.to_numpy())
    ends = np.concatenate([[0], np.cumsum(filled)])[np.cumsum(lengths)] if len(lengths) else lengths
    words = flat.filter(pa.array(filled))
    return words, ends, pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _of_batch(texts: pa.Array) -> tuple[list, list]:
    """Per text its runs and its words without repeats, of texts that fit in one suffix array."""
    words, ends, ids = _numbered(texts)
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)
    n_words = int(ids.max()) + 1 if len(ids) else 0
    # the texts' end symbols come first in order and differ; words are numbered per text
    s = np.empty(len(ids) + len(ends), np.int64)
    s[np.arange(len(ids)) + text] = len(ends) + text * n_words + ids
    s[ends + np.arange(len(ends))] = np.arange(len(ends))
    found: list[list] = [[] for _ in ends]
    dropped = np.zeros(len(ids), bool)
    begins = ends - sizes
    for b, e, p in runs(s):
        k = int(np.searchsorted(ends + np.arange(len(ends)), b, side="right"))
        shift = int(begins[k]) + k
        found[k].append((b - shift, e - b, p))
        dropped[b - k + p : e - k] = True
    kept = words.filter(pa.array(~dropped))
    offsets = np.concatenate([[0], np.cumsum(~dropped)])[np.concatenate([[0], ends])]
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), kept)
    return found, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()


def _slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of texts of up to about BATCH_WORDS words, counted by their bytes; a longer text is a range alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, first, held = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > BATCH_WORDS * 6:
            out.append((first, k))
            first, held = k, 0
        held += size + 1
    return [*out, (first, len(sizes))] if len(sizes) else out


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length, period) and collapsed, the text without its repeats.

    Words are what ASCII white space parts, numbered from 0. A run is a maximal stretch with smallest period q and of
    at least max(6, 4 q) words; runs come by start, then period. collapsed joins by one space the words that no run
    contains after its first q words.

    Only id_col and text are read. A null text is an empty one: no runs, collapsed is empty. A very long text is worked
    on alone, in memory of some hundred bytes a word; texts are never cut. Repeated rows and null ids each get a row;
    an empty table gives none. Results do not depend on how rows fall into batches.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shape = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    )
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, stop in _slices(texts):
                part = texts.slice(first, stop - first)
                found, collapsed = _of_batch(part)
                n = pc.list_value_length(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(part)))
                n = pc.if_else(pc.equal(pc.binary_length(pc.ascii_trim_whitespace(part)), 0), 0, n)
                lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], run_type)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, stop - first), pc.cast(n, pa.int64()), lists, pa.array(collapsed, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(work, shape)
