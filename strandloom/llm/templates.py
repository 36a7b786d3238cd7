"""Line deduplication by a tree of log templates, in DataFrame operations alone.

A line is its words, those with a digit in them masked as `<*>`. The tree has a fixed depth: the number of words, then the
leading `LEADING` words, lead to a leaf. In a leaf a word is constant at its place if lines of at least `MIN_DOCS` documents have
it there, else variable; lines of whose words after the leading ones at least `SIMILAR` percent are constant form the leaf's
template, its variable places generalised. A template whose lines come from at least `MIN_DOCS` documents recurs: its lines are
dropped from every document but the first, that with the least doc_id, so that nothing is lost altogether. For lines of more than
`LONG` words two documents are enough, both for a constant word and for a template. Documents are counted by line and summed over the lines of a
leaf, so a document counts once for each of the different lines that it has there.

Blank lines stay. Null texts stay null and have no lines; empty texts have none either. A line that a document repeats counts once.
Repeated rows count as a document each and share what is dropped from their doc_id; documents with null doc_id share theirs, and are
never first unless all are null, in which case nothing is dropped. Extra columns pass through, whatever their names. Lines are told
apart by 64-bit hashes of what is left after masking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, written

LEADING = 3
MIN_DOCS = 3
SIMILAR = 60
#: Words from which on a line is too long to recur by chance, and the documents that it then takes.
LONG, MIN_LONG = 50, 2
#: A word with a digit; it begins where no word goes on, and what it has matched it keeps, so that long words cost no more than their length.
#: Parts that the lines of one template are joined in, so that a line which all documents have is not one task's.
SALTS = 16
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
MASK = "<*>"


def holds(text: Column, *pieces: str) -> Column:
    """Whether a text holds any of some pieces."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in pieces])


def canonical(text: Column) -> Column:
    """A text's lines, masked, with single blanks between words and none around them. Each step only rewrites lines that need it."""
    masked = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, MASK)).otherwise(x))
    spaced = F.transform(masked, lambda x: F.when(holds(x, "  ", "\t", "\x0b", "\x0c", "\r"), F.regexp_replace(x, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(x))
    return F.transform(spaced, lambda x: F.trim(x))


def lines(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, leaf, line (a hash), long (of more than LONG words) and words (blank-separated) of the distinct lines of every document that aren't blank."""
    own = docs.select("doc_id", F.array_distinct(canonical(F.col(text))).alias("own"))
    own = own.select("doc_id", F.explode_outer("own").alias("words")).where("words <> ''")
    head = F.substring_index("words", " ", LEADING)
    blanks = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    return own.select("doc_id", F.xxhash64(blanks, head).alias("leaf"), F.xxhash64("words").alias("line"), (blanks >= LONG).alias("long"), "words")


def recurring(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, leaf, line) of all lines, and line, first (the document that keeps it) of those whose template recurs."""
    found = lines(docs, text)
    need = F.when(F.col("long"), min(min_docs, MIN_LONG)).otherwise(min_docs)
    all_lines = written(found.select("doc_id", "leaf", "line", "long"))
    distinct = written(all_lines.groupBy("leaf", "line").agg(F.max("long").alias("long"), F.min("doc_id").alias("first"), F.count("*").alias("docs")))
    leaves = distinct.groupBy("leaf").agg(F.max("long").alias("long"), F.sum("docs").alias("docs"), F.count("*").alias("kinds")).where(F.col("docs") >= need)
    # A leaf of one line needs no generalising
    plain = distinct.join(leaves.where("kinds = 1").select("leaf"), "leaf", "left_semi").select("leaf", "line", "long", "first", "docs")
    several = written(leaves.where("kinds > 1").select("leaf"))
    spelt = found.join(several, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("words").alias("words")).join(distinct.withColumnRenamed("leaf", "leaf_"), "line")
    spelt = written(spelt.where("leaf = leaf_").select("leaf", "line", "long", "first", "docs", F.split("words", " ").alias("words")))
    placed = spelt.select("leaf", "line", "long", "docs", F.posexplode("words").alias("place", "word"))
    constant = placed.groupBy("leaf", "place", "word").agg(F.max("long").alias("long"), F.sum("docs").alias("with")).where(F.col("with") >= need).drop("with", "long")
    shared = placed.join(constant, ["leaf", "place", "word"]).where(F.col("place") >= LEADING).groupBy("leaf", "line").agg(F.count("*").alias("constant"))
    rest = F.greatest(F.size("words") - LEADING, F.lit(0))
    member = spelt.join(shared, ["leaf", "line"], "left").where(100 * F.coalesce("constant", F.lit(0)) >= similar * rest).select("leaf", "line", "long", "first", "docs")
    templates = plain.unionByName(member)
    whole = templates.groupBy("leaf").agg(F.max("long").alias("long"), F.min("first").alias("first"), F.sum("docs").alias("docs")).where((F.col("docs") >= need) & F.col("first").isNotNull())
    return all_lines, written(templates.select("leaf", "line").join(whole.select("leaf", "first"), "leaf").select("leaf", "line", "first"))


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, similar: int = SIMILAR) -> DataFrame:
    """docs with the lines of recurring templates dropped from the text column, and two columns more: n_lines (not blank, before) and n_dropped."""
    all_lines, templates = recurring(docs, text, min_docs, similar)
    own, raw, kept, gone_id, gone_lines = fresh(docs, "own_", "raw_", "kept_", "gone_id", "gone_lines")
    salted = templates.select(F.col("leaf").alias("leaf_"), F.col("line").alias("line_"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    hits = all_lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, (F.col("line") == F.col("line_")) & (F.col("salt") == F.col("salt_")))
    hits = hits.where(F.col("leaf") == F.col("leaf_")).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = written(hits.groupBy(F.col("doc_id").alias(gone_id)).agg(F.collect_set("line").alias(gone_lines)))
    both = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)), "left")
    touched = F.when(F.col(gone_lines).isNotNull(), F.col(text))
    both = both.withColumn(own, canonical(touched)).withColumn(raw, F.split(touched, "\n", -1))
    stays = lambda x: (x[own] == "") | ~F.array_contains(F.col(gone_lines), F.xxhash64(x[own]))
    both = both.withColumn(kept, F.filter(F.arrays_zip(raw, own), stays))
    left = F.when(F.col(gone_lines).isNotNull(), F.array_join(F.transform(kept, lambda x: x[raw]), "\n")).otherwise(F.col(text))
    blank = F.lit(" \t\x0b\x0c\r")
    size = F.size(F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x, blank) != ""))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(size).cast("long")
    n_dropped = F.when(F.col(gone_lines).isNotNull(), F.size(raw) - F.size(kept)).otherwise(0).cast("long")
    others = [c if name != text else left.alias(text) for c, name in zip(columns(docs), docs.columns) if name not in ("n_lines", "n_dropped")]
    return both.select(*others, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
