"""Exact top-k inner products of integer vectors, processed by descending length.

Components are taken as floor(256 * x). Candidates are dealt by descending length into blocks. Both sides are rotated by the
eigenvectors of the candidates' Gram matrix (the right singular vectors of the whole table), so that the leading coordinates
carry most of a product. A task takes its blocks by descending length, and a query passes over a block, or the rest of one, where the product
of lengths cannot reach the k-th best score it has; of the candidates before that, those are scored whose product over the leading
coordinates, plus the product of the lengths of what remains (Cauchy-Schwarz), can reach it. Scores are sums of integers; bounds allow for
the rounding of doubles. Every query starts with the k-th best score of the block of longest candidates, an exact lower bound.

Vectors that are null, empty or hold null or non-finite components take no part; those of another dimension than a query's are no
candidates of it. Integer products must stay below 2 ** 53: longer vectors raise ValueError. A row is no candidate of a query with its
vec_id, so repeated ids are not found by each other; rows with null vec_id take no part. Query rows alike in id and vector are one query;
those of one id and different vectors are queries each, with a list of their own under that id. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .vectors import QUERIES, Top, batch_matrices, best, block_batch, found_batch, grid, numbers, pack, unpack, usable

SCALE = 256
LEADING = 16
CHUNK = 512
#: Squared length up to which sums of products are exact in doubles.
EXACT = 2.0**53
FIELDS = "number long, query_id long, vec_id long, score long"


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Orthogonal matrices by dimension, largest spread first, from the Gram matrix of all vectors."""

    def gram(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in batch_matrices(batch):
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, g in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * dim * dim, pa.int32()), "cell": pa.array(np.arange(dim * dim), pa.int32()), "g": pa.array(g.ravel())})

    cells = vectors.mapInArrow(gram, "dim int, cell int, g double").groupBy("dim", "cell").agg(F.sum("g").alias("g")).toPandas()
    out = {}
    for dim, rows in cells.groupby("dim"):
        g = rows.sort_values("cell")["g"].to_numpy().reshape(dim, dim)
        out[int(dim)] = np.linalg.eigh(g)[1][:, ::-1]
    return out


def lengths(data: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of vectors, and of what remains after the leading coordinates; both a little too large."""
    rest = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
    return np.sqrt((data**2).sum(1)) * (1 + 1e-9), rest * (1 + 1e-9) + 1e-6


def search(q_ids, q, tops, c_ids, c, v, longest: float) -> None:
    """Adds to each query's Top; c by descending length."""
    live = np.arange(len(q))
    q_all = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
    live = live[q_all * longest * (1 + 1e-9) >= np.array([t.floor for t in tops])]
    if not len(live):
        return  # no vector of the block can reach any query's best
    qr, cr = q @ v, c @ v
    (q_len, q_rest), (c_len, c_rest) = lengths(q, qr), lengths(c, cr)
    for start in range(0, len(c), CHUNK):
        part = slice(start, start + CHUNK)
        floor = np.array([tops[i].floor for i in live])
        live = live[q_len[live] * c_len[start] >= floor]
        if not len(live):
            break
        floor = np.array([tops[i].floor for i in live])
        bound = qr[live, :LEADING] @ cr[part, :LEADING].T + q_rest[live, None] * c_rest[None, part]
        bound += 1e-9 * q_len[live, None] * c_len[start] + 1e-3
        for i, mask in zip(live, bound >= floor[:, None]):
            at = start + np.flatnonzero(mask)
            at = at[c_ids[at] != q_ids[i]]
            if len(at):
                tops[i].add(c_ids[at], np.rint(c[at] @ q[i]))


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (long) of each query's k highest inner products."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    plain = lambda ids, x: (ids, x, b"")
    by_length = rows.withColumn("length", length).repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length"))
    blocks = checkpoint(pack(by_length.select("vec_id", "v", F.lit(0).cast("long").alias("cell")), plain))
    longest = blocks.agg(F.max("longest")).head()[0]
    if longest is not None and longest**2 >= EXACT:
        raise ValueError("vectors are too long for exact products: their integer squares must sum to less than 2 ** 53")
    turn = spark.sparkContext.broadcast(rotation(rows.select("vec_id", "v")))  # a d x d matrix
    no_floor = lambda ids, x: (ids, x, np.full(len(ids), -np.inf).tobytes())
    asked = rows.where("asks").select("vec_id", "v", F.lit(0).cast("long").alias("cell")).distinct()
    queries = checkpoint(pack(asked, no_floor, QUERIES))

    def searched(asks, rows):
        """ids, numbers and Tops of all blocks of queries after all blocks of candidates, by descending length."""
        read = [unpack(a) for a in asks]
        tops = [[Top(k, f) for f in np.frombuffer(extra)] for _, _, extra in read]
        for row in sorted(rows, key=lambda r: -r["longest"]):
            c_ids, c, _ = unpack(row)
            order = np.argsort(-(c**2).sum(1), kind="stable")
            for (ids, q, _), own in zip(read, tops):
                search(ids, q, own, c_ids[order], c[order], turn.value[row["dim"]], row["longest"])
        return [(numbers(a["block"], len(r[0])), r[0]) for a, r in zip(asks, read)], tops

    def with_floor(asks, rows):
        _, tops = searched(asks, rows)
        return [block_batch(a, extra=np.array([t.floor for t in own]).tobytes()) for a, own in zip(asks, tops)]

    def scored(asks, rows):
        import pyarrow as pa

        return [found_batch(*searched(asks, rows), pa.int64())]

    heads = blocks.groupBy("dim").agg(F.max_by("block", "longest").alias("block")).select("block")  # a name for each dimension
    first = blocks.join(F.broadcast(heads), "block", "left_semi")
    # Queries of a dimension without a candidate block have none later either
    seeded = checkpoint(grid(queries, first, with_floor, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)))
    return best(grid(seeded, blocks, scored, FIELDS), k)
