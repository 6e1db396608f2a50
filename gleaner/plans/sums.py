"""Adding up equal-shaped blocks of numbers that tasks made, without bringing many of them to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

SUMS_BYTES = 64_000_000  # blocks that may come to the driver together; more are added up in tasks first


def tree_sum(sums: DataFrame, shape: tuple, dtype=np.float64, parts: int | None = None, most_bytes: int | None = None) -> np.ndarray:
    """The sum of all rows of sums (sums binary, each a block of the shape), by a tree of tasks where they are many.

    A task holds two blocks. The size of a block follows from columns or parameters, never from rows.
    """
    kind = np.dtype(dtype)

    def added(batches):
        total = None
        for batch in batches:
            for raw in batch.column("sums").to_pylist():
                part = np.frombuffer(raw, kind)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = sums.rdd.getNumPartitions() if parts is None else parts
    most = max(1, (most_bytes or SUMS_BYTES) // (kind.itemsize * max(1, int(np.prod(shape)))))
    while parts > most:
        parts = max(most, int(parts**0.5))
        sums = sums.repartition(parts).mapInArrow(added, "sums binary")
    out = np.zeros(shape, kind)
    for row in sums.toLocalIterator() if most == 1 else sums.collect():
        out += np.frombuffer(row["sums"], kind).reshape(shape)
    return out


def added_up(sums: RDD, shape: tuple, dtype, most_bytes: int) -> np.ndarray:
    """The sum of arrays of the shape that tasks made; those beyond most_bytes are added up by a tree of tasks first.

    For the many small jobs of an iteration: an RDD's job needs no plan, which takes longer than such a job's work.
    """
    parts, out = sums.getNumPartitions(), np.zeros(shape, dtype)
    most = max(1, most_bytes // max(1, out.nbytes))
    while parts > most:
        parts = max(most, int(parts**0.5))
        keyed = sums.mapPartitionsWithIndex(lambda i, found, n=parts: ((i % n, x) for x in found))
        sums = keyed.reduceByKey(np.add, parts).values()
    for part in sums.toLocalIterator() if most == 1 else sums.collect():
        out += part
    return out
