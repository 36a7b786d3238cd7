"""Mixing sources to target weights.

Every document gets a key from a hash of its id and text, uniform and the same in every run. Within a source the documents
stand in the order of their keys, and the mix takes them from the start until the source's budget of words is met, beginning
again when all are taken. Order and sums are distributed: the leading digits of a key name its range, and there are so many ranges that one
holds about `RANGE_ROWS` rows of a source at most, whatever the number of rows; a document's place is the sum of its source's ranges before
its own plus the running sum inside the range. So a source of any size is spread over as many tasks as it has ranges. Targets take one row
for each source in one task.

The sum of all sizes is shared by weight; a source's target stops at `MOST` times its size, and the excess is shared among the
others by weight until none is above. The budget is the target, rounded down to whole words by the largest remainder of half.

Null and empty texts have size 0 and nothing is taken of them. The null source is a source of its own, which sorts last.
Rows that are alike in id and text stand in the order of a hash of their other columns, and rows alike in all are interchangeable.
Empty tables give empty ones. The input's other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, columns, fresh, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a range, at most and about; hexadecimal digits that name a range, at least.
RANGE_ROWS, LEAST_DIGITS = 250_000, 2


def range_digits(rows: int) -> int:
    """Digits of the ranges' names for so many rows, all of one source if need be."""
    digits = LEAST_DIGITS
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def key(doc_id: Column, text: Column) -> Column:
    """A document's place in its source's order."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> the same with target. sizes: a row for each source.

    The sources whose target stops are those of least size for their weight. With the sources in that order, `level` is the
    words for each unit of weight that remain if all before one are stopped; the first source that the level leaves below its
    stop ends them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(Window.partitionBy())
    room = sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most).withColumn("room", F.col("stop") / F.col("weight"))
    level = room.withColumn("level", (total - F.coalesce(F.sum("stop").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    first = F.min(F.when(F.col("level") <= F.col("room"), F.struct(F.row_number().over(by_room).alias("at"), "level"))).over(Window.partitionBy())
    level = level.withColumn("level", first["level"])
    return level.select("source", "source_size", F.least(F.col("stop").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop").cast("double"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, key, size, source_size, target, start (words of the source before the document) and taken (words the mix takes of it, repeats counted)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = checkpoint(rows)
    rows = rows.withColumn("range", F.conv(F.substring("key", 1, range_digits(rows.count())), 16, 10).cast("long"))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = checkpoint(ranges)  # a row for each range of each source
    offset = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    goal = goal.withColumnRenamed("source", "named")
    offsets = ranges.withColumn("offset", offset).join(goal, F.col("source").eqNullSafe(F.col("named"))).drop("named", "range_size")
    offsets = offsets.withColumnsRenamed({"source": "of", "range": "of_range"})
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    start = F.col("offset") + F.col("within")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", start.alias("start"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed documents: each as often as the mix takes it whole, and its first words once more where a budget ends within it.

    Columns are those of docs; a shortened text keeps the white space between its words, and n_chars, if there, is its length."""
    own, row, of_id, of, sizes, takes, take, words = fresh(docs, "key_", "row_", "id_", "of_", "size_", "takes_", "take_", "words_")
    chosen = plan(docs, weights, most).where("taken > 0").groupBy("doc_id", "key").agg(F.first("size").alias(sizes), F.sort_array(F.collect_list("taken"), asc=False).alias(takes))
    # Of rows alike in id and text each gets its own entry of the list
    named = docs.withColumn(own, key(F.col("doc_id"), F.col("text")))
    others = [c for c, f in zip(columns(docs), docs.schema.fields) if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    named = named.withColumn(row, F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*others) if others else F.lit(1))))
    chosen = chosen.select(F.col("doc_id").alias(of_id), F.col("key").alias(of), sizes, takes)
    both = named.join(chosen, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of)))
    both = both.withColumn(take, F.get(takes, F.col(row) - 1)).where(F.col(take) > 0)
    whole = F.floor(F.col(take) / F.col(sizes)).cast("int")
    rest = (F.col(take) - whole * F.col(sizes)).cast("int")
    parts = F.concat(F.array_repeat(F.col(sizes), whole), F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<long>")))
    both = both.withColumn(words, F.explode(parts))
    text = F.when(F.col(words) < F.col(sizes), first_words(F.col("text"), F.col(words))).otherwise(F.col("text"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns(docs))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, for n of at least 1."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")
