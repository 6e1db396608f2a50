"""Best-fit packing of documents into sequences, after a dominance reduction.

A packing depends on lengths only, of which there are no more than a sequence has tokens. So Spark counts the
pieces of each length, the plan is made on that table of at most `capacity` rows, and every piece then finds its
place from its length and its rank among the pieces of that length, which is counted in slices.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import tokens
from gleaner.llm.common import in_batches
from gleaner.plans.tables import written

CAPACITY = 2048
END = 0  # the id put after each document
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all are full but the first."""
    first = length - (-(-length // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def _cutter(capacity: int):
    def make():
        encode = tokens.byte_ids()

        def pieces(doc_ids, texts):
            out = [[], [], [], [], []]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = array("I", encode(text or ""))
                ids.append(END)
                raw = memoryview(ids).cast("B")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    row = doc_id, k, start, n, zlib.crc32(raw[start * 4 : (start + n) * 4])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            return out

        return pieces

    return make


def reduce_by_dominance(left: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fix the sets that dominate every other set holding their longest piece; left loses their pieces.

    left[l] is the number of pieces of length l. Taking lengths from the longest down, a piece j is fixed
    - alone, if nothing else fits beside it;
    - with k, if j + k fill the sequence: whatever else would stand beside j fits where k is now;
    - with the longest k that fits, if no two pieces fit beside j together.
    Returns (pattern, copies), a pattern being (length, times) pairs.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while left[j]:
            room = capacity - j
            smallest = next((s for s in range(1, room + 1) if left[s] - (s == j) > 0), 0)
            if not smallest:
                fixed.append(([(j, 1)], left[j] if j > room else 1))
                left[j] -= fixed[-1][1]
                continue
            if left[room] - (room == j) > 0:
                k = room
            else:
                two = 2 * smallest if left[smallest] - (smallest == j) > 1 else None
                if two is None:
                    after = next((s for s in range(smallest + 1, room + 1) if left[s] - (s == j) > 0), None)
                    two = smallest + after if after else room + 1
                if two <= room:
                    break  # several pieces may fit: not decided by these rules
                k = next(s for s in range(room, 0, -1) if left[s] - (s == j) > 0)
            copies = left[j] // 2 if k == j else min(left[j], left[k])
            fixed.append(([(j, 2)] if k == j else [(j, 1), (k, 1)], copies))
            left[j] -= copies
            left[k] -= copies
    return fixed


def best_fit(left: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over lengths: each piece goes to the fullest sequence that has room for it.

    Sequences with the same content are handled together. Returns (pattern, copies); left is used up.
    """
    open_by_room: dict[int, list] = defaultdict(list)
    for length in range(capacity, 0, -1):
        while left[length]:
            room = next((r for r in range(length, capacity) if open_by_room.get(r)), None)
            if room is None:
                times = min(capacity // length, left[length])
                copies = left[length] // times
                open_by_room[capacity - times * length].append(([(length, times)], copies))
                left[length] -= copies * times
                continue
            pattern, copies = open_by_room[room].pop()
            times = min(room // length, left[length])
            used = min(copies, left[length] // times)
            if used < copies:
                open_by_room[room].append((pattern, copies - used))
            open_by_room[room - times * length].append((pattern + [(length, times)], used))
            left[length] -= used * times
    return [p for group in open_by_room.values() for p in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how often each is used, for the numbers of pieces by length."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _places(patterns) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, first offset), ordered: where ranks of a length go."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, copies in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, ranks[length], times, sequence, offset))
            ranks[length] += times * copies
            offset += length * times
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(places: np.ndarray):
    def make():
        firsts = (places[:, 0] << 46) + places[:, 1]

        def place(doc_ids, pieces, starts, lengths, crcs, ranks):
            length, rank = np.array(lengths, np.int64), np.array(ranks, np.int64)
            row = places[np.searchsorted(firsts, (length << 46) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 2]
            offset = row[:, 4] + nth % row[:, 2] * length
            return doc_ids, pieces, starts, lengths, crcs, sequence, offset

        return place

    return make


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0, among all of one length; pieces has `slice`, a bounded share of rows.

    Rows are numbered inside (slice, length) and moved on by the counts of earlier slices, so a length that
    most pieces have is still numbered by many tasks.
    """
    counts = pieces.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("slice", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("slice", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(moved, ["slice", "length"]).withColumn("rank", F.col("before") + F.col("nth"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing END; only one longer than capacity is cut, its first piece taking the
    rest. A null text is an empty one, a piece of one id. Rows with equal or null ids are packed each by itself;
    rows equal in all columns are interchangeable. Only id_col and text are read. The number of sequences
    depends on the lengths alone.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text"))
    pieces = written(in_batches(texts, _cutter(capacity), PIECES).withColumn("slice", F.spark_partition_id()))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    rows = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return in_batches(rows, _placer(_places(plan(histogram, capacity))), PIECES + ", sequence_id bigint, offset bigint")
