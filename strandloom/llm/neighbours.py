"""Approximate nearest neighbours by cosine, from a kd-tree over stable projections.

Vectors are brought to length 1, so the largest cosine is the least Euclidean distance, and projected to `PROJECTED` dimensions
by Gaussian (2-stable) vectors: over the draw, the squared projected distance of two points divided by their squared distance
is chi-square with as many degrees of freedom. The first splits of the kd-tree over the projected points are medians of a sample of
at most `SAMPLE` rows; they deal all rows into cells, a cell that the sample finds crowded into several parts. Each block of a cell's
rows goes on as a kd-tree of its own, whose leaves keep their boxes, so blocks have boxes as well. A query first meets a block of its own cell,
then in every task the blocks and their leaves by projected distance, and verifies the points of each leaf on the original vectors. It
stops when the chi-square test holds: when a point as near as its k-th best would, with probability `CONFIDENCE`, have been projected nearer
than the next box. Every row is indexed; fitted are only the splits, on the sample, and the draw, which a seed fixes.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with null vec_id; vectors of another
dimension than a query's are no candidates of it. Scores are cosines of the original vectors in double precision. A row is no
candidate of a query with its vec_id. Query rows alike in id and vector are one query; those of one id and different vectors are queries each,
with a list of their own under that id. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import BLOCK, QUERIES, Top, batch_matrices, best, block_batch, found_batch, grid, numbers, pack, together, unpack, usable

PROJECTED = 12
CONFIDENCE = 0.9
LEAF = 128
SEED = 20240229
#: Rows that the first splits are fitted on, at most, and cells that they make, at most.
SAMPLE, CELLS = 1 << 16, 1 << 12
FIELDS = "number long, query_id long, vec_id long, score double"


def projection(dim: int) -> np.ndarray:
    """The same for every block and run."""
    return np.random.default_rng(SEED + dim).standard_normal((dim, PROJECTED))


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors at length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function for PROJECTED, an even number of, degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(PROJECTED // 2))


#: The test's bound: squared projected over squared distance that a point exceeds with probability 1 - CONFIDENCE.
def bound(confidence: float = CONFIDENCE) -> float:
    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < confidence else (low, middle)
    return high


def tree(p: np.ndarray) -> list[np.ndarray]:
    """Leaves of a kd-tree: row numbers, split at the median of the widest dimension."""
    waiting, leaves = [np.arange(len(p))], []
    while waiting:
        at = waiting.pop()
        if len(at) <= LEAF:
            leaves.append(at)
            continue
        own = p[at]
        axis = np.argmax(own.max(0) - own.min(0))
        half = len(at) // 2
        order = np.argpartition(own[:, axis], half)
        waiting += [at[order[:half]], at[order[half:]]]
    return leaves


def index(ids: np.ndarray, x: np.ndarray):
    """A block in the order of its tree's leaves; extra: sizes and boxes of the leaves."""
    p = unit(x) @ projection(x.shape[1])
    leaves = tree(p)
    order = np.concatenate(leaves)
    boxes = np.array([np.concatenate([[len(a)], p[a].min(0), p[a].max(0)]) for a in leaves])
    return ids[order], x[order], boxes.tobytes()


def away(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distance of a point from boxes."""
    return (np.maximum(low - p, 0) ** 2 + np.maximum(p - high, 0) ** 2).sum(-1)


def search(q_id: int, qn: np.ndarray, qp: np.ndarray, top: Top, c_ids, cn, boxes, limit: float) -> None:
    """Adds to a query's Top what the test lets it meet of an indexed block."""
    ends = np.cumsum(boxes[:, 0].astype(int))
    starts = ends - boxes[:, 0].astype(int)
    distance = away(boxes[:, 1 : 1 + PROJECTED], boxes[:, 1 + PROJECTED :], qp)
    for leaf in np.argsort(distance, kind="stable"):
        if distance[leaf] >= limit * (2 - 2 * top.floor):
            break
        part = slice(starts[leaf], ends[leaf])
        scores = cn[part] @ qn
        at = np.flatnonzero((scores >= top.floor) & (c_ids[part] != q_id))
        if len(at):
            top.add(c_ids[part][at], scores[at])


class Splits:
    """The first levels of the tree of one dimension's vectors: a complete binary tree of medians, and into how many parts its cells are dealt."""

    def __init__(self, p: np.ndarray, cells: int, total: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        self.axis, self.at = np.zeros((1 << self.depth) - 1, int), np.zeros((1 << self.depth) - 1)
        held = {0: p}
        for node in range((1 << self.depth) - 1):
            own = held.pop(node)
            if len(own):
                self.axis[node] = np.argmax(own.max(0) - own.min(0))
                self.at[node] = np.median(own[:, self.axis[node]])
            over = own[:, self.axis[node]] > self.at[node] if len(own) else np.zeros(0, bool)
            held[2 * node + 1], held[2 * node + 2] = own[~over], own[over]
        share = np.array([len(held[node]) for node in range((1 << self.depth) - 1, (2 << self.depth) - 1)]) / max(1, len(p))
        self.parts = np.maximum(1, np.ceil(share * total / (8 * BLOCK))).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - ((1 << self.depth) - 1)

    def cell(self, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        leaf = self.leaf(p)
        return self.first[leaf] + np.abs(ids * 2654435761 >> 7) % self.parts[leaf]


def fitted(rows: DataFrame, total: int) -> dict[int, Splits]:
    """Splits by dimension, from the projections of at most SAMPLE rows picked by a hash of their id."""
    every = max(1, math.ceil(2 * total / SAMPLE))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, at, x in batch_matrices(batch):
                p = unit(x) @ projection(dim)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], ["dim", "p"])

    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(SAMPLE) if every > 1 else rows.limit(SAMPLE)
    found: dict[int, list] = {}
    for r in sample.select("vec_id", "v").mapInArrow(run, "dim int, p array<double>").collect():
        found.setdefault(r["dim"], []).append(r["p"])
    seen = sum(map(len, found.values()))
    return {dim: Splits(np.array(p), min(CELLS, math.ceil(total * len(p) / seen / BLOCK)), math.ceil(total * len(p) / seen)) for dim, p in found.items()}


def nearest(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of about the k nearest of each query."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0))
    splits = spark.sparkContext.broadcast(fitted(rows, rows.count()))

    def celled(batches):
        import pyarrow as pa

        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, at, x in batch_matrices(batch):
                if dim in splits.value:  # else the sample has none of this dimension: one cell
                    cell[at] = splits.value[dim].cell(unit(x) @ projection(dim), ids[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    indexed = rows.mapInArrow(celled, "vec_id long, v array<double>, asks boolean, cell long")
    dealt = indexed.repartition("cell").sortWithinPartitions("cell")
    blocks = checkpoint(pack(dealt.select("vec_id", "v", "cell"), index))
    no_floor = lambda ids, x: (ids, x, np.full(len(ids), -1.0).tobytes())
    asked = indexed.where("asks").select("vec_id", "v", "cell").distinct().repartition("cell").sortWithinPartitions("cell")
    queries = checkpoint(pack(asked, no_floor, QUERIES))
    limit = bound(confidence)

    def searched(asks, rows):
        """ids, numbers and Tops of all blocks of queries; each query meets the blocks by their boxes' distance."""
        read = [unpack(a) for a in asks]
        tops = [[Top(k, f) for f in np.frombuffer(extra)] for _, _, extra in read]
        held = []
        for row in rows:
            ids, c, boxes = unpack(row)
            held.append((ids, unit(c), np.frombuffer(boxes).reshape(-1, 1 + 2 * PROJECTED)))
        low = np.array([h[2][:, 1 : 1 + PROJECTED].min(0) for h in held])
        high = np.array([h[2][:, 1 + PROJECTED :].max(0) for h in held])
        for (ids, q, _), own in zip(read, tops):
            qn = unit(q)
            qp = qn @ projection(q.shape[1])
            for i, top in enumerate(own):
                distance = away(low, high, qp[i])
                for b in np.argsort(distance, kind="stable"):
                    if distance[b] >= limit * (2 - 2 * top.floor):
                        break
                    search(ids[i], qn[i], qp[i], top, *held[b], limit)
        return [(numbers(a["block"], len(r[0])), r[0]) for a, r in zip(asks, read)], tops

    def with_floor(asks, rows):
        if not rows:
            return [block_batch(a) for a in asks]
        _, tops = searched(asks, rows)
        # A little less, so that the seed's own neighbours are found again
        return [block_batch(a, extra=np.array([t.floor - 1e-12 for t in own]).tobytes()) for a, own in zip(asks, tops)]

    def scored(asks, rows):
        import pyarrow as pa

        return [found_batch(*searched(asks, rows), pa.float64())]

    # One block of each cell gives the cell's queries, which are rows of it themselves, their first floor
    first = blocks.groupBy("dim", "cell").agg(F.max_by("block", F.struct("n", "block")).alias("first")).select("first")
    first = blocks.join(first, F.col("block") == F.col("first"), "left_semi")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    seeded = checkpoint(together(queries.groupBy("dim", "cell"), first.groupBy("dim", "cell"), with_floor, fields))
    return best(grid(seeded, blocks, scored, FIELDS), k)
