"""Editing and cleaning of whole records: fields, gaps, accessions and publication blocks.

Records are rows of sources.files.RECORD. Fields are an array, so all edits are array expressions and nothing is exploded or shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import text as X

#: The order of the fields of a publication.
PUBLICATION = ("RN", "RM", "RT", "RA", "RL")


def all_of(tag: str) -> Column:
    """Values of a tag, in order."""
    return F.transform(F.filter("gf", lambda g: g["tag"] == tag), lambda g: g["value"])


def first_of(tag: str) -> Column:
    """First value of a tag; null if there is none."""
    return F.get(all_of(tag), F.lit(0))


def has(tag: str) -> Column:
    return F.exists("gf", lambda g: g["tag"] == tag)


def label() -> Column:
    """record:N, with its ID if it has one."""
    name = X.trimmed(first_of("ID"))
    number = F.concat(F.lit("record:"), F.col("record_num"))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(number, F.lit("/"), name)).otherwise(number)


def selected(choice: str) -> Column:
    """By number if the choice is one, else by ID."""
    return F.col("record_num") == int(choice) if re.fullmatch(r"\+?\d+", choice) else X.trimmed(first_of("ID")) == choice


def select_one(records: DataFrame, choice: str) -> DataFrame:
    return records.where(selected(choice)).orderBy("file", "record_num").limit(1)


def family_name() -> Column:
    """Accession, else ID, else the file's stem with the record's number."""
    full = lambda tag: F.nullif(X.trimmed(first_of(tag)), F.lit(""))
    return F.coalesce(full("AC"), full("ID"), provenance(False))


def provenance(with_id: bool = True) -> Column:
    """The file's stem and the record's number, with its ID if asked for."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    name = F.concat(stem, F.lit(":"), F.col("record_num"))
    own = F.nullif(X.trimmed(first_of("ID")), F.lit(""))
    return F.when(own.isNotNull(), F.concat(name, F.lit(" id="), own)).otherwise(name) if with_id else name


@dataclass
class Edits:
    """What to do to fields: deletes, then sets (the first is replaced, later ones go, a missing one is added), appends and substitutions."""

    delete: list[str] = field(default_factory=list)
    set: list[tuple[str, str]] = field(default_factory=list)
    append: list[tuple[str, str]] = field(default_factory=list)
    sub: list[tuple[str, str]] = field(default_factory=list)


def substitution(expression: str) -> tuple[str, str, bool]:
    """Pattern, replacement and whether all matches count, of an expression whose first letter divides it."""
    parts = re.split(r"(?<!\\)" + re.escape(expression[0]), expression[1:]) if expression else []
    if len(parts) != 3 or parts[2] not in ("", "g"):
        raise ValueError(f"no substitution: {expression!r}")
    return parts[0], parts[1], parts[2] == "g"


def substituted(value: Column, expression: str) -> Column:
    """A value with the first or all matches replaced."""
    pattern, new, everywhere = substitution(expression)
    if everywhere:
        return F.regexp_replace(value, pattern, new)
    at = F.regexp_instr(value, F.lit(pattern))
    found = F.regexp_substr(value, F.lit(pattern))
    rest = F.substring(value, at + F.length(found), F.length(value))
    first = F.regexp_replace(found, pattern, new)
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at - 1), first, rest)).otherwise(value)


def pair(tag, value) -> Column:
    return F.struct(tag.alias("tag"), value.alias("value"))


def edited(edits: Edits) -> Column:
    """gf after the edits and with publications in order."""
    gf = F.filter("gf", lambda g: ~g["tag"].isin(edits.delete)) if edits.delete else F.col("gf")
    for tag, value in edits.set:
        new, first = pair(F.lit(tag), F.lit(value)), F.array_position(F.transform(gf, lambda g: g["tag"]), tag)
        own = F.transform(F.filter(F.transform(gf, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: (x["g"]["tag"] != tag) | (x["i"] == first - 1)), lambda x: x["g"])
        replaced = F.transform(own, lambda g: pair(g["tag"], F.when(g["tag"] == tag, F.lit(value)).otherwise(g["value"])))
        gf = F.when(first > 0, replaced).otherwise(F.concat(gf, F.array(new)))
    for tag, value in edits.append:
        gf = F.concat(gf, F.array(pair(F.lit(tag), F.lit(value))))
    for tag, expression in edits.sub:
        gf = F.transform(gf, lambda g: pair(g["tag"], F.when(g["tag"] == tag, substituted(g["value"], expression)).otherwise(g["value"])))
    return ordered_publications(gf)


def ordered_publications(gf: Column) -> Column:
    """Publication fields together where the first of them stands, each publication (from its RN) in the usual order; untouched if there are fewer than two."""
    own = lambda g: g["tag"].isin(*PUBLICATION)
    numbered = F.transform(gf, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    refs = F.filter(numbered, lambda x: own(x["g"]))
    rank = lambda t: F.array_position(F.array(*map(F.lit, PUBLICATION)), t)
    starts = F.transform(F.filter(refs, lambda x: x["g"]["tag"] == "RN"), lambda x: x["i"])
    keyed = F.transform(refs, lambda x: F.struct(F.size(F.filter(starts, lambda s: s <= x["i"])).alias("block"), rank(x["g"]["tag"]).alias("rank"), x["i"].alias("i"), x["g"].alias("g")))
    block = F.transform(F.array_sort(keyed), lambda x: x["g"])
    first = F.get(refs, F.lit(0))["i"]
    part = lambda test: F.transform(F.filter(numbered, test), lambda x: x["g"])
    out = F.concat(part(lambda x: ~own(x["g"]) & (x["i"] < first)), block, part(lambda x: ~own(x["g"]) & (x["i"] > first)))
    return F.when(F.size(refs) < 2, gf).otherwise(out)


def edit(records: DataFrame, edits: Edits, choice: str | None = None) -> DataFrame:
    """Records with the edits, all or the chosen; cleaning applies to all."""
    new = edited(edits)
    new = new if choice is None else F.when(F.coalesce(selected(choice), F.lit(False)), new).otherwise(F.col("gf"))
    return clean(records.withColumn("gf", new))


def clean(records: DataFrame) -> DataFrame:
    """Gaps as dots in rows and RF, accessions of nine digits, and counts of what changed."""
    dots = F.transform("sequences", lambda r: r.withField("aligned_seq", X.normalize_gaps(r["aligned_seq"])))
    changed = lambda old, new: F.size(F.filter(F.arrays_zip(old.alias("a"), new.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])))
    padded = F.transform("gf", lambda g: pair(g["tag"], F.when(g["tag"] == "AC", X.pad_accession(g["value"])).otherwise(g["value"])))
    rf = F.transform_values("gc", lambda k, v: F.when(k == "RF", X.normalize_gaps(v)).otherwise(v))
    out = records.withColumn("new_sequences", dots).withColumn("new_gf", padded).withColumn("new_gc", rf)
    seqs = lambda c: F.transform(c, lambda r: r["aligned_seq"])
    out = out.withColumn("rows_changed", changed(seqs("sequences"), seqs("new_sequences"))).withColumn("accessions_padded", changed(F.col("gf"), F.col("new_gf")))
    out = out.withColumn("rf_changed", (~F.element_at("gc", "RF").eqNullSafe(F.element_at("new_gc", "RF"))).cast("int"))
    return out.drop("sequences", "gf", "gc").withColumnsRenamed({"new_sequences": "sequences", "new_gf": "gf", "new_gc": "gc"}).select(*records.columns, "rows_changed", "accessions_padded", "rf_changed")


def clean_report(cleaned: DataFrame) -> DataFrame:
    """Sums of a cleaning's counts by file."""
    return cleaned.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("rows_changed", "accessions_padded", "rf_changed")])


def rows(records: DataFrame) -> DataFrame:
    """Alignment rows of records, the reference line first."""
    dashed = lambda c: F.translate(c, "._~", "---")
    rf = F.element_at("gc", "RF")
    name = F.coalesce(F.nullif(X.trimmed(first_of("ID")), F.lit("")), F.lit("consensus"))
    own = F.transform("sequences", lambda r: F.struct(r["original_id"].alias("name"), dashed(r["aligned_seq"]).alias("seq"), r["seq_start"].alias("seq_start"), r["seq_end"].alias("seq_end"), r["orient"].alias("orient")))
    none = lambda kind: F.lit(None).cast(kind)
    first = F.struct(name.alias("name"), dashed(rf).alias("seq"), none("long").alias("seq_start"), none("long").alias("seq_end"), none("string").alias("orient"))
    listed = F.when(rf.isNotNull(), F.concat(F.array(first), own)).otherwise(own)
    out = records.select("file", F.concat("file", F.lit("#"), "record_num").alias("msa_id"), F.posexplode(listed).alias("row_idx", "r"))
    return out.select("file", "msa_id", "row_idx", (F.col("row_idx") == 0).alias("is_reference"), "r.*")


def hand_curated() -> Column:
    """Whether a record says that its consensus was built by hand."""
    return F.coalesce(F.lower(X.trimmed(first_of("CT"))) == "handbuilt", F.lit(False))


def update_reference(records: DataFrame) -> DataFrame:
    """Records with the reference line called anew from their rows, gaps as dots; one built by hand loses its CT. Records without rows stay as they are."""
    from strandloom.operators import msa

    own = records.withColumn("msa_id", F.concat("file", F.lit("#"), "record_num"))
    listed = own.select("msa_id", F.posexplode("sequences").alias("row_idx", "r"))
    listed = listed.select("msa_id", "row_idx", F.lit(False).alias("is_reference"), F.translate(F.col("r.aligned_seq"), ".", "-").alias("seq"))
    called = msa.consensus(listed).select(F.col("msa_id").alias("of"), F.translate("consensus", "-", ".").alias("called"))
    out = own.join(called, F.col("msa_id") == F.col("of"), "left")
    rest = F.map_filter(F.coalesce("gc", F.create_map().cast("map<string,string>")), lambda k, _: k != "RF")
    gc = F.when(F.col("called").isNotNull(), F.map_concat(rest, F.create_map(F.lit("RF"), F.col("called")))).otherwise(F.col("gc"))
    gf = F.when(F.col("called").isNotNull() & hand_curated(), F.filter("gf", lambda g: g["tag"] != "CT")).otherwise(F.col("gf"))
    new = {"gc": gc, "gf": gf}
    return out.select(*[new[c].alias(c) if c in new else c for c in records.columns])
