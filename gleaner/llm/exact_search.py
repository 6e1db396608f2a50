"""Exact top-k by inner product: branch and bound over vectors stored by dimension.

Queries and candidates are cut into blocks, and every pair of blocks is a task. There candidates lie by
dimension. A query adds up its products one block of dimensions after the other; the norms of what is still
missing bound each candidate's score from both sides (Cauchy-Schwarz), and candidates whose upper bound is below
the k-th best lower bound are dropped, the rest moved together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.tables import written

SCALE = 1024
DIMENSIONS = 16  # of a block
SLICE_NUMBERS = 2_000_000  # numbers in a block of candidates, about
QUERY_NUMBERS = 500_000  # numbers in a block of queries, about
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def as_integers(vector: Column) -> Column:
    """floor(1024 x) of each component; null for a vector that is null or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _matrix(vectors) -> np.ndarray:
    """Rows of one length; shorter vectors end in zeros. Python integers where 64-bit floats would not be exact."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class Vertical:
    """Candidates by dimension, the heavy dimensions first, with the norms of what follows each block."""

    def __init__(self, rows: np.ndarray, exact: bool):
        self.n, self.width = rows.shape
        squares = np.square(rows, dtype=np.float64)
        self.order = np.argsort(-squares.sum(axis=0), kind="stable")
        self.cuts = list(range(0, self.width, DIMENSIONS)) + [self.width]
        kind = np.float64 if exact else object
        self.blocks = [np.ascontiguousarray(rows[:, self.order[a:b]].T).astype(kind) for a, b in zip(self.cuts, self.cuts[1:])]
        left = np.cumsum(squares[:, self.order][:, ::-1], axis=1)[:, ::-1] if self.width else squares
        self.left = [np.sqrt(left[:, b]) if b < self.width else np.zeros(self.n) for b in self.cuts[1:]]

    def top(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, scores) among which are all of the k best, ties included; own is left out."""
        query = query[self.order]
        alive = np.arange(self.n)
        if own is not None:
            alive = np.delete(alive, own)
        score = np.zeros(len(alive), self.blocks[0].dtype if self.blocks else np.float64)
        for block, a, b, left in zip(self.blocks, self.cuts, self.cuts[1:], self.left):
            held = block if len(alive) == self.n else block[:, alive]
            score = score + query[a:b].astype(block.dtype) @ held
            if b < self.width and len(alive) > k:
                # rounding of the norms is allowed for, so no candidate is lost to it
                rest = left[alive] * np.sqrt(np.square(query[b:], dtype=np.float64).sum()) * (1 + 1e-9) + 1e-3
                known = score.astype(np.float64)
                slack = np.abs(known) * 1e-12
                worst = np.partition(known - rest - slack, len(alive) - k)[len(alive) - k]
                kept = known + rest + slack >= worst
                alive, score = alive[kept], score[kept]
        return alive, score


def _search(k: int):
    def search(queries, candidates):
        import pandas as pd

        found: list[tuple] = []
        if len(queries) and len(candidates):
            q, c = _matrix(list(queries["qv"])), _matrix(list(candidates["v"]))
            width = max(q.shape[1], c.shape[1])
            q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
            most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(width, 1)
            held = Vertical(c, most < EXACT)
            ids, rows = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy()
            place = {r: i for i, r in enumerate(rows.tolist())}
            for query, row, query_id in zip(q, queries["q_row"].tolist(), queries["query_id"].tolist(), strict=True):
                alive, score = held.top(query, k, place.get(row))
                best = sorted(zip((-int(s) for s in score.tolist()), ids[alive].tolist(), strict=True))[:k]
                found += [(row, query_id, i, min(max(-s, LOWEST), HIGHEST)) for s, i in best]
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query by integer inner product: query_id, rank (from 1), vec_id, score.

    Components are turned into floor(1024 x). Queries are the rows whose id is divisible by `every`, candidates
    all other rows; ties go to the smaller id. A query with fewer candidates gets all. Rows with a null id, a null
    vector, or null or non-finite components take no part. Rows that repeat are rows of their own: a repeated
    query is answered again, and its copies are candidates. A shorter vector counts as ending in zeros. A score
    beyond 64 bits is the nearest 64-bit number. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), as_integers(F.col(vector_col)).alias("v"))
    rows = written(rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.sum((F.col("vec_id") % every == 0).cast("bigint")).alias("queries")).first()
    width, queries = max(1, facts["width"] or 1), facts["queries"] or 0
    # rows are numbered within their task, so runs of numbers are blocks of bounded size, in every task
    bits = max(4, (SLICE_NUMBERS // width).bit_length() - 1)
    cuts = -(-queries // max(1, QUERY_NUMBERS // width)) or 1
    blocked = rows.withColumn("slice", F.shiftright("row", bits))
    cut = F.pmod(F.xxhash64("row"), F.lit(cuts)).cast("bigint")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), cut.alias("cut"))
    tasks = written(blocked.select("slice").distinct().select("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cuts - 1).cast("bigint"))).alias("cut")))
    here = tasks.select(F.col("slice").alias("q_slice"), F.col("cut").alias("q_cut"))
    left = asked.join(here, asked["cut"] == here["q_cut"]).drop("cut").groupBy("q_slice", "q_cut")
    right = blocked.join(tasks, "slice").groupBy("slice", "cut")
    found = left.cogroup(right).applyInPandas(_search(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
