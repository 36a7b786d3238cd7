"""Alignment files turned into texts of another format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import text as X
from strandloom.operators import records as R
from strandloom.sources import files, writers

#: What each kind of file is, as a target that would leave it as it is.
SAME = {"stockholm": "stk", "clustal": "aln", "fasta": "msa"}
TARGETS = ("stk", "aln", "msa", "fa", "raw", "reference")


def convert(spark: SparkSession, path: str, to: str | None = None, choice: str | None = None, clean: bool = True) -> DataFrame:
    """msa_id and text of every alignment of a file: Stockholm (stk, the default), Clustal (aln), aligned FASTA (msa), ungapped FASTA (fa), instances
    with where they are from (raw), or the reference line without gaps (reference).

    Stockholm to Stockholm keeps whole records, cleaned unless told otherwise. A file that is in the target's format already must be asked for by
    name; references and a choice of a record need Stockholm. Records without a reference line have no reference. Raises ValueError where a rule is broken."""
    kinds = set(files.kinds(spark, path).values())
    if len(kinds) != 1:
        raise ValueError(f"{path}: one kind of file at a time, not {sorted(kinds)}")
    (kind,) = kinds
    if to is None and SAME.get(kind) == "stk":
        raise ValueError(f"{path} is Stockholm already; ask for stk to write it again, or for another format")
    to = to or "stk"
    if to not in TARGETS:
        raise ValueError(f"no target: {to}")
    if kind != "stockholm" and (to == "reference" or choice is not None):
        raise ValueError(f"{path}: references and choices need Stockholm")
    if kind == "stockholm":
        found = files.stockholm(spark, path)
        found = found if choice is None else R.select_one(found, choice)
        name = F.concat("file", F.lit("#"), "record_num").alias("msa_id")
        if to == "stk":
            return (R.clean(found) if clean else found).select(name, writers.stockholm_text().alias("text"))
        if to == "reference":
            bases = F.translate(F.element_at("gc", "RF"), "-. ", "")
            return found.where(F.element_at("gc", "RF").isNotNull()).select(name, F.concat(F.lit(">"), R.family_name(), F.lit("\n"), bases).alias("text"))
        # Names carry coordinates here, as in a file that is read as an alignment
        rows = R.rows(found).withColumn("p", X.simple_coordinates(F.col("name")))
        rows = rows.select("file", "msa_id", "row_idx", "is_reference", "p.name", "seq", F.col("p.start").alias("seq_start"), F.col("p.end").alias("seq_end"), "p.orient")
        origin = found.select(name, R.provenance().alias("origin"))
    else:
        rows = files.msa(spark, path)
        stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
        origin = rows.select("msa_id", F.concat(stem, F.lit(":1")).alias("origin")).distinct()
    if to == "raw":
        return writers.raw_text(rows, origin)
    make = {"stk": writers.msa_stockholm_text, "aln": writers.clustal_text, "msa": writers.fasta_text, "fa": lambda r: writers.fasta_text(r, ungapped=True)}[to]
    return make(rows).select("msa_id", "text")
