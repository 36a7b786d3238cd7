"""Vectors packed in blocks, for searches of a query set against all rows.

Vectors are packed at most `BLOCK` to a block. A search deals blocks of queries into groups and blocks of candidates into slots and
treats every group with every slot in a task of its own, in which a query's best so far prune the next block. Groups and slots are
as many as keep a task within `GROUP` blocks of queries and `SLOT` of candidates and all cores busy: memory is bounded by those, nothing is
broadcast that grows, and no pair of vectors becomes a row. A query's best are then the best of what every slot gave.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
QUERIES = 1024
#: Blocks of queries and of candidates that a task holds, on average, at most.
GROUP, SLOT = 16, 32
BLOCK_SCHEMA = "block string, dim int, cell long, n int, longest double, ids binary, data binary, extra binary"


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def batch_matrices(batch):
    """(dim, row numbers, float64 matrix) of a batch whose second column holds the vectors."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    sizes, values = np.diff(offsets), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, values[offsets[:-1][at][:, None] + np.arange(dim)]


def matrices(batches, limit: int = BLOCK):
    """(cell, ids, float64 matrix) of (vec_id, vector, cell) batches, by dimension and cell, at most `limit` rows each; order is kept.

    What is held is given out when its cell is past, so rows that are sorted by cell need the room of a few blocks."""
    held: dict[tuple, list] = {}

    def joined(key):
        parts = held.pop(key)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, cells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        for dim, at, x in batch_matrices(batch):
            for cell in np.unique(cells[at]):
                mine = cells[at] == cell
                key = (dim, int(cell))
                held.setdefault(key, []).append((ids[at[mine]], x[mine]))
                if sum(len(p[0]) for p in held[key]) >= limit:
                    i, y = joined(key)
                    whole = len(i) // limit * limit
                    for start in range(0, whole, limit):
                        yield key[1], i[start : start + limit], y[start : start + limit]
                    held[key] = [(i[whole:], y[whole:])]
        for key in [k for k in held if k[1] < cells[-1]]:
            i, y = joined(key)
            if len(i):
                yield key[1], i, y
    for key in list(held):
        i, y = joined(key)
        if len(i):
            yield key[1], i, y


def pack(rows: DataFrame, finish, limit: int = BLOCK) -> DataFrame:
    """Blocks of rows(vec_id, vector, cell), sorted by cell in their partitions. finish(ids, matrix) -> (ids, matrix, extra bytes)."""

    def run(batches):
        import uuid

        import pyarrow as pa

        for cell, ids, x in matrices(batches, limit):
            i, y, extra = finish(ids, x)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([uuid.uuid4().hex]), "dim": pa.array([y.shape[1]], pa.int32()), "cell": pa.array([cell], pa.int64()), "n": pa.array([len(i)], pa.int32()), "longest": pa.array([float(np.sqrt((y**2).sum(1)).max())]),
                "ids": pa.array([i.astype(np.int64).tobytes()], pa.binary()), "data": pa.array([y.astype(np.float64).tobytes()], pa.binary()), "extra": pa.array([extra], pa.binary()),
            })

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def unpack(row: dict):
    """ids, matrix and extra of a block."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"]).reshape(row["n"], row["dim"]), row["extra"]


def numbers(block: str, n: int) -> np.ndarray:
    """A number for every query of a block; two query rows of one vec_id have two."""
    return np.arange(n) + (int(block[:15], 16) & ~0xFFFF)


def grid(queries: DataFrame, blocks: DataFrame, run, schema: str) -> DataFrame:
    """run(blocks of queries, blocks of candidates), lists of dicts of one dimension, for every group with every slot."""
    spark = queries.sparkSession
    asked, known = queries.count(), blocks.count()
    if not asked or not known:
        return spark.createDataFrame([], schema)
    wanted = max(4 * spark.sparkContext.defaultParallelism, math.ceil(asked / GROUP) * math.ceil(known / SLOT))
    groups = max(1, math.ceil(asked / GROUP))
    slots = max(math.ceil(known / SLOT), min(known, math.ceil(wanted / groups)))
    q = queries.withColumn("group_", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("slot_", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    c = blocks.withColumn("slot_", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).withColumn("group_", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return together(q.groupBy("group_", "slot_"), c.groupBy("group_", "slot_"), run, schema)


def together(q, c, run, schema: str) -> DataFrame:
    """run for the blocks of every group of q and c, by dimension."""

    def both(left, right):
        import pyarrow as pa

        asks, rows = left.to_pylist(), right.to_pylist()
        found = []
        for dim in {a["dim"] for a in asks}:
            mine = [r for r in rows if r["dim"] == dim]
            if mine:
                found += run([a for a in asks if a["dim"] == dim], mine)
        return pa.Table.from_batches(found) if found else empty

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = pa.Table.from_batches([], to_arrow_schema(StructType.fromDDL(schema)))
    return q.cogroup(c).applyInArrow(both, schema)


def block_batch(row: dict, **changed):
    """A block as a batch."""
    import pyarrow as pa

    kinds = dict(zip(("block", "dim", "cell", "n", "longest", "ids", "data", "extra"), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())))
    return pa.RecordBatch.from_pydict({n: pa.array([changed.get(n, row[n])], kind) for n, kind in kinds.items()})


def found_batch(asks: list[tuple[np.ndarray, np.ndarray]], tops: list[list["Top"]], kind):
    """Numbers and ids of queries, and what each has found, as a batch."""
    import pyarrow as pa

    flat = [t for ts in tops for t in ts]
    sizes = [len(t.ids) for t in flat]
    number, query = (np.repeat(np.concatenate([a[i] for a in asks]), sizes) for i in range(2))
    ids, scores = np.concatenate([t.ids for t in flat]), np.concatenate([t.scores for t in flat])
    scores = scores.astype(np.int64) if kind == pa.int64() else scores
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], ["number", "query_id", "vec_id", "score"])


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, ranked from 1."""
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Top:
    """The k best (score, smaller id first) of candidates met so far."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])
