"""Identifiers of sequence ranges: `[assembly:]sequence` with one range or nested ones, in three spellings.

V2 `seq:4-43_-`, V1 `seq:43-4` (falling order means the reverse strand) and V0 `seq_4_43_R`. Nested ranges count within the
range before them. Anything else is a bare name, with an assembly if a single colon divides it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "assembly_id string, sequence_id string, seq_start long, seq_end long, orient string, inferred_version string"
V2 = re.compile(r"(\d+)-(\d+)_([+-])")
V1 = re.compile(r"(\d+)-(\d+)")
V0 = re.compile(r"(.+?)((?:_\d+_\d+(?:_R)?)+)")
V0_RANGE = re.compile(r"_(\d+)_(\d+)(_R)?")
FIELDS = ("assembly_id", "sequence_id", "seq_start", "seq_end", "orient", "inferred_version")


def nested(ranges: list[tuple[int, int, str]]) -> tuple[int, int, str]:
    """One range in the coordinates of the sequence."""
    start, end, strand = ranges[0]
    for a, b, own in ranges[1:]:
        start, end = (start + a - 1, start + b - 1) if strand == "+" else (end - b + 1, end - a + 1)
        strand = "+" if strand == own else "-"
    return start, end, strand


def parse(name: str | None) -> tuple:
    """FIELDS of an identifier; all null for null and empty ones."""
    if not name:
        return (None,) * 6
    parts = name.split(":")
    for version, shape in (("V2", V2), ("V1", V1)):
        for head in (1, 2):
            found = [shape.fullmatch(p) for p in parts[head:]]
            if found and all(found) and not (head == 2 and V1.fullmatch(parts[1])):
                own = [(int(m[1]), int(m[2]), m[3] if version == "V2" else "-" if int(m[1]) > int(m[2]) else "+") for m in found]
                place = nested([(min(a, b), max(a, b), s) for a, b, s in own])
                return (parts[0] if head == 2 else None, parts[head - 1], *place, version)
    if len(parts) <= 2 and (m := V0.fullmatch(parts[-1])):
        own = [(int(a), int(b), "-" if r else "+") for a, b, r in V0_RANGE.findall(m[2])]
        place = nested([(min(a, b), max(a, b), s) for a, b, s in own])
        return (parts[0] if len(parts) == 2 else None, m[1], *place, "V0")
    if len(parts) == 2 and all(parts):
        return (parts[0], parts[1], None, None, None, "Undefined")
    return (None, name, None, None, None, "Undefined")


def parsed(name: Column) -> Column:
    """All spellings, in Arrow batches."""

    def rows(names: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([parse(n) for n in names], columns=FIELDS)
        return out.astype({"seq_start": "Int64", "seq_end": "Int64"})

    return F.pandas_udf(rows, SCHEMA)(name)


def parsed_single(name: Column) -> Column:
    """The same for identifiers of at most one range, as a built-in expression."""
    v2, v1, v0 = r"^(?:([^:]*):)?([^:]+):(\d+)-(\d+)_([+-])$", r"^(?:([^:]*):)?([^:]+):(\d+)-(\d+)$", r"^(?:([^:]*):)?([^:]+?)_(\d+)_(\d+)(_R)?$"
    two = r"^([^:]+):([^:]+)$"
    part = lambda shape, i: F.nullif(F.regexp_extract(name, shape, i), F.lit(""))

    def ranged(shape, version):
        a, b = F.regexp_extract(name, shape, 3).cast("long"), F.regexp_extract(name, shape, 4).cast("long")
        strand = F.regexp_extract(name, shape, 5) if version == "V2" else F.when(a > b, "-").otherwise("+") if version == "V1" else F.when(F.regexp_extract(name, shape, 5) == "_R", "-").otherwise("+")
        return F.struct(
            part(shape, 1).alias("assembly_id"), part(shape, 2).alias("sequence_id"), F.least(a, b).alias("seq_start"), F.greatest(a, b).alias("seq_end"),
            strand.alias("orient"), F.lit(version).alias("inferred_version"),
        )

    none = lambda kind: F.lit(None).cast(kind)
    bare = F.struct(
        F.when(name.rlike(two), F.regexp_extract(name, two, 1)).alias("assembly_id"), F.when(name.rlike(two), F.regexp_extract(name, two, 2)).otherwise(name).alias("sequence_id"),
        none("long").alias("seq_start"), none("long").alias("seq_end"), none("string").alias("orient"), F.lit("Undefined").alias("inferred_version"),
    )
    return F.when(name.rlike(v2), ranged(v2, "V2")).when(name.rlike(v1), ranged(v1, "V1")).when(name.rlike(v0), ranged(v0, "V0")).when(name != "", bare)
