"""Family records of another format as alignment records: fields mapped, classes looked up, rows joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import text as X

LAST_KEYWORD = "Transposable Element"


def class_key(keywords: Column) -> Column:
    """Keywords up to the general one, itself included, or all if it isn't there."""
    at = F.array_position(F.transform(keywords, F.lower), LAST_KEYWORD.lower())
    return F.array_join(F.slice(keywords, 1, F.when(at > 0, at).otherwise(F.size(keywords)).cast("int")), "; ")


def classified(families: DataFrame, classes: DataFrame) -> DataFrame:
    """families with `class`, the first entry of classes(key, class, place) that their keywords name, whatever the case."""
    first = classes.groupBy(F.lower("key").alias("low")).agg(F.min_by("class", "place").alias("class"))
    return families.join(first, F.lower(class_key(F.col("keywords"))) == F.col("low"), "left").drop("low")


def reports_submission(location: Column) -> Column:
    """Whether a publication is a submission to a reports journal."""
    return F.lower(location).contains("repbase reports") | location.rlike(r"(^|[^A-Za-z0-9])RR([^A-Za-z0-9]|$)")


def submission_date(location: Column) -> Column:
    """The last words in brackets."""
    return F.nullif(F.regexp_extract(location, r"^.*\(([^()]*)\)", 1), F.lit(""))


def to_records(families: DataFrame, rows: DataFrame) -> DataFrame:
    """gf, gc and sequences of families joined with their alignments: families(file, id, ...), rows(msa_id, ...) with msa_id the family's id.

    The record's consensus is the reference line; authors of submissions become AU and the rest publications."""
    pair = lambda tag, v: F.struct(F.lit(tag).alias("tag"), v.cast("string").alias("value"))
    label = F.when(F.col("seq_start") > 0, F.concat("name", F.lit(":"), "seq_start", F.lit("-"), "seq_end", F.lit("_"), "orient")).otherwise(F.col("name"))
    own = rows.where(~F.col("is_reference")).select("msa_id", "row_idx", F.struct(label.alias("original_id"), F.translate("seq", "-_~ ", "....").alias("aligned_seq")).alias("r"))
    own = own.groupBy("msa_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "r"))), lambda x: x["r"]).alias("sequences"))
    f = families.join(own, F.col("id") == F.col("msa_id"), "left")
    subs = F.filter("references", lambda r: reports_submission(r["location"]))
    pubs = F.filter("references", lambda r: ~reports_submission(r["location"]))
    authors = F.transform(F.filter(subs, lambda r: r["authors"] != ""), lambda r: pair("AU", r["authors"]))
    notes = F.transform(subs, lambda r: pair("**", F.concat(F.lit("submitted "), F.coalesce(submission_date(r["location"]), r["location"]))))
    cited = F.flatten(F.transform(pubs, lambda r: F.array(pair("RN", r["number"]), pair("RT", r["title"]), pair("RA", r["authors"]), pair("RL", r["location"]))))
    comments = F.transform("comments", lambda c: pair("CC", c))
    lead = F.filter(F.array(pair("ID", F.col("id")), pair("DE", F.col("description")), pair("TP", F.col("class")), pair("OC", F.col("organism"))), lambda g: F.coalesce(g["value"], F.lit("")) != "")
    size = F.array(pair("SQ", F.size(F.coalesce("sequences", F.array().cast("array<struct<original_id:string,aligned_seq:string>>")))))
    return f.select("file", "id", F.concat(lead, authors, notes, cited, comments, size).alias("gf"), F.map_from_arrays(F.array(F.lit("RF")), F.array(F.upper("consensus"))).alias("gc"), "sequences")


def consensus_warnings(families: DataFrame, called: DataFrame) -> DataFrame:
    """Families whose own consensus differs from that called(msa_id, consensus) of their rows, gaps aside."""
    both = families.select("file", "id", F.col("consensus").alias("own")).join(called.select(F.col("msa_id").alias("id"), "consensus"), "id")
    return both.where(X.ungapped_upper(F.col("own")) != X.ungapped_upper(F.col("consensus"))).select("file", "id", "own", "consensus")
