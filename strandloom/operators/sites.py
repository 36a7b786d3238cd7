"""Duplicated target sites: repeats of a few bases at both ends of inserted elements.

Windows of the genome at both ends of full-length instances are scored for every length and offset of a repeat; sums over the
windows pick one, and its letters are called from both flanks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alphabet
from strandloom.functions import text as X

BONUS = 6.9
LETTERS = alphabet.LETTERS[:12]


def flanks(rows: DataFrame, genome: DataFrame, width: int, tolerance: int = 0, reach: int = 10) -> DataFrame:
    """Instances with the reason they are left out, or the genome's `reach` bases on either side of both their ends.

    rows: name, seq (aligned, `width` columns), seq_start, seq_end. Reasons: partial, coordinates, sequence, edge. A name with
    an assembly before a colon is looked up without it if it isn't there as a whole."""
    g = genome.select(F.col("chrom"), F.col("length"), F.col("seq").alias("g_seq"))
    whole = rows.join(g, F.col("name") == F.col("chrom"), "left")
    short = g.select(F.col("chrom").alias("chrom2"), F.col("length").alias("length2"), F.col("g_seq").alias("g_seq2"))
    r = whole.join(short, F.col("chrom").isNull() & (F.element_at(F.split("name", ":"), -1) == F.col("chrom2")), "left")
    r = r.withColumn("g_seq", F.coalesce("g_seq", "g_seq2")).withColumn("length", F.coalesce("length", "length2"))
    return flanked(r, width, tolerance, reach)


def flanked(r: DataFrame, width: int, tolerance: int = 0, reach: int = 10) -> DataFrame:
    """As flanks, of instances that have their chromosome beside them, as g_seq and length."""
    code = lambda at: F.ascii(F.substring("seq", at, 1))
    letter = lambda at: code(at).between(65, 90) | code(at).between(97, 122)
    first = F.when(letter(1), 0).otherwise(F.length(F.regexp_extract("seq", r"^([^A-Za-z]*)", 1)))
    last = F.length("seq") - F.when(letter(-1), 0).otherwise(F.length(F.regexp_extract("seq", r"([^A-Za-z]*)$", 1))) - 1
    lb, rb = F.col("seq_start") - 1, F.col("seq_end")
    reason = (
        F.when((first > tolerance) | (last + tolerance + 1 < width) | ~F.col("seq").rlike("[A-Za-z]"), "partial")
        .when(~(F.col("seq_start") < F.col("seq_end")), "coordinates").when(F.col("g_seq").isNull(), "sequence")
        .when((lb < reach) | (rb < reach) | (lb + reach > F.col("length")) | (rb + reach > F.col("length")), "edge")
    )
    window = lambda at: F.when(F.col("reason").isNull(), F.substring(F.col("g_seq"), (at - reach + 1).cast("int"), F.lit(2 * reach)))
    r = r.withColumn("reason", reason).withColumn("left", window(lb)).withColumn("right", window(rb))
    return r.select("row_idx", "name", "seq", "seq_start", "seq_end", "orient", "reason", "left", "right")


def site_scores(windows: DataFrame, reach: int) -> DataFrame:
    """length, offset and the sum over windows(left, right) of pair scores and a bonus for each base.

    A repeat of `length` bases ends `offset` bases into the element on the left, and on the right begins as many before its end: letters
    reach - length + offset to reach + offset of the left window against reach - offset to reach - offset + length of the right one, from 0.
    Windows that are null take no part; without windows there are no rows."""
    both = windows.where("left is not null and right is not null").select("left", "right")
    table = pair_table()

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros((2 * reach, 2 * reach), np.int64), 0
        for batch in batches:
            left, right = (np.frombuffer("".join(batch.column(c).to_pylist()).encode("ascii", "replace"), np.uint8).reshape(-1, 2 * reach) for c in (0, 1))
            n += len(left)
            # How often two letters face each other at two places, by one product for all places; in parts of rows, so counts are exact
            seen = np.flatnonzero(np.bincount(left.ravel(), minlength=128) + np.bincount(right.ravel(), minlength=128))
            for at in range(0, len(left), 4096):
                l, r = ((x[at : at + 4096, :, None] == seen.astype(np.uint8)).astype(np.float32).reshape(-1, 2 * reach * len(seen)) for x in (left, right))
                met = (l.T @ r).reshape(2 * reach, len(seen), 2 * reach, len(seen))
                total += np.rint(np.einsum("iajb,ab->ij", met.astype(np.float64), table[np.ix_(seen, seen)].astype(np.float64))).astype(np.int64)
        if n:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel()), pa.array(np.full(total.size, n), pa.int64())], ["l", "r", "sum", "n"])

    # (2 * reach) ** 2 rows of a task, however many windows it has
    pairs = both.mapInArrow(sums, "l int, r int, sum long, n long").groupBy("l", "r").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    w = windows.sparkSession.range(1, reach + 1).select(F.col("id").cast("int").alias("length"))
    w = w.select("length", F.explode(F.sequence(F.lit(0), F.col("length"))).alias("offset"))
    w = w.select("length", "offset", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("at"))
    own = w.select("length", "offset", (reach - F.col("length") + F.col("offset") + F.col("at")).alias("l"), (reach - F.col("offset") + F.col("at")).alias("r"))
    summed = own.join(pairs, ["l", "r"]).groupBy("length", "offset").agg(F.sum("sum").alias("sum"), F.max("n").alias("n"))
    return summed.select("length", "offset", (F.col("sum") + F.round(F.col("n") * F.col("length") * BONUS, 1)).alias("score"))


def pair_table() -> np.ndarray:
    """Scores of two letters facing each other, by their codes, as functions.text.site_pair_score has them."""
    table = np.full((128, 128), -15, np.int16)
    np.fill_diagonal(table, 10)
    for pairs, score in (("AA TT", 9), ("AG GA CT TC", -6), ("AT TA", -17)):
        for a, b in pairs.split():
            table[ord(a), ord(b)] = score
    for unknown in "N-":
        table[ord(unknown)] = table[:, ord(unknown)] = 0
    upper = np.array([ord(chr(i).upper()) for i in range(128)])
    return table[np.ix_(upper, upper)]

def best_offsets(scores: DataFrame) -> DataFrame:
    """length, average and offset: for each length the offset of the best average, the last of equals."""
    shifted = F.col("score") / F.col("length") + 0.5
    rounded = F.when(shifted >= 0, F.floor(shifted)).otherwise(F.ceil(shifted)).cast("long")
    by_length = scores.withColumn("average", rounded).groupBy("length").agg(F.max(F.struct("average", "offset")).alias("best"))
    return by_length.select("length", "best.average", "best.offset")


def best_site(scores: DataFrame) -> DataFrame:
    """length, offset and average of the site picked: of the best averages the longest; no rows without scores."""
    picked = best_offsets(scores).agg(F.max(F.struct("average", "length", "offset")).alias("b"))
    return picked.where("b is not null").select("b.length", "b.offset", "b.average")


def site_consensus(letters: DataFrame) -> DataFrame:
    """pos and letter called from letters(pos, base): the letter of greatest score, the first of equals."""
    own = letters.groupBy("pos", F.upper("base").alias("obs")).count().join(F.broadcast(alphabet.scores(letters.sparkSession, LETTERS, alphabet.site_score)), "obs")
    summed = own.groupBy("pos", "cand", "idx").agg(F.sum(F.col("count") * F.col("score")).alias("total"))
    return summed.groupBy("pos").agg(F.max(F.struct("total", (-F.col("idx")).alias("i"), "cand"))["cand"].alias("letter"))


def site_at(length: Column, offset: Column, reach: int) -> tuple[Column, Column, Column]:
    """The sites in windows(left, right), and the score of their letters without the bonus."""
    left = F.substring(F.col("left"), F.lit(reach) - length + offset + 1, length)
    right = F.substring(F.col("right"), F.lit(reach) - offset + 1, length)
    pairs = F.arrays_zip(F.split(left, "").alias("l"), F.split(right, "").alias("r"))
    raw = F.aggregate(F.filter(pairs, lambda x: x["l"] != ""), F.lit(0), lambda s, x: s + X.site_pair_score(x["l"], x["r"]))
    return left, right, raw


def site_letters(windows: DataFrame, length: Column | int, offset: Column | int, reach: int) -> DataFrame:
    """pos and base of both flanks' sites in windows that score more than zero there."""
    length, offset = (x if isinstance(x, Column) else F.lit(x) for x in (length, offset))
    left, right, raw = site_at(length, offset, reach)
    pairs = F.arrays_zip(F.split(left, "").alias("l"), F.split(right, "").alias("r"))
    pairs = F.filter(pairs, lambda x: x["l"] != "")
    w = windows.where(raw > 0).select(F.posexplode(pairs).alias("pos", "x"))
    return w.select("pos", F.explode(F.array("x.l", "x.r")).alias("base"))
