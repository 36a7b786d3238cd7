"""Column functions on sequences, identifiers and field values. Nulls give null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def reverse_complement(c: Column) -> Column:
    """Of upper-case ACGT; other letters stay as they are."""
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def reverse_complement_iupac(c: Column) -> Column:
    """Of all codes, in upper case; unknown characters become N, gaps and blanks stay."""
    known = F.regexp_replace(F.upper(c), r"[^ACGTRYKMSWBDHVNX\- ]", "N")
    return F.translate(F.reverse(known), "ATGCRYKMBVDH", "TACGYRMKVBHD")


def normalize_gaps(c: Column) -> Column:
    """Every gap as a dot."""
    return F.translate(c, "-_~", "...")


def ungapped(c: Column) -> Column:
    """Without dots and dashes, as coordinates count."""
    return F.translate(c, ".-", "")


def ungapped_upper(c: Column) -> Column:
    """Without any gap or blank, in upper case."""
    return F.upper(F.translate(c, "-._~ ", ""))


def pad_accession(c: Column) -> Column:
    """Accessions of seven digits with nine."""
    t = trimmed(c)
    short = r"^(D[FR])(\d{7})(\.\d+)?$"
    return F.when(t.rlike(short), F.concat(F.regexp_extract(t, short, 1), F.lit("00"), F.regexp_extract(t, short, 2), F.regexp_extract(t, short, 3))).otherwise(c)


def valid_accession(c: Column) -> Column:
    return trimmed(c).rlike(r"^D[FR](\d{7}|\d{9})(\.\d*)?$")


def automated_name(c: Column) -> Column:
    """Names that a repeat finder gives."""
    return trimmed(c).rlike(r"(?i)^(rnd|ltr)-\d+_family-\d+")


def valid_orcid(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")


def normalize_doi(c: Column) -> Column:
    """A bare DOI; preprints lose their version."""
    bare = F.regexp_replace(trimmed(c), r"^https?://doi\.org/", "")
    return F.when(bare.startswith("10.1101/"), F.regexp_replace(bare, r"v\d+$", "")).otherwise(bare)


def assembly_name(path: Column) -> Column:
    """File name without its extensions."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)(\.(gz|2bit|fasta|fna|fa|fas|fsa))+$", "")


def substitution(cons: Column, obs: Column) -> Column:
    """ti, tv or null for two letters."""
    c, o = F.upper(cons), F.upper(obs)
    both = c.isin(*"ACGT") & o.isin(*"ACGT") & (c != o)
    return F.when(both & F.concat(c, o).isin("AG", "GA", "CT", "TC"), "ti").when(both, "tv")


def k2p(ti: Column, tv: Column, n: Column) -> Column:
    """Kimura's two-parameter divergence in percent, at least 0; 0 of no positions, NaN beyond saturation."""
    p, q = ti / n, tv / n
    a, b = 1 - 2 * p - q, 1 - 2 * q
    k = 100 * (-0.5 * F.ln(a) - 0.25 * F.ln(b))
    return F.when(n == 0, F.lit(0.0)).when((a <= 0) | (b <= 0), F.lit(float("nan"))).otherwise(F.greatest(k, F.lit(0.0)))


def site_pair_score(left: Column, right: Column) -> Column:
    """Score of two flanking letters as a duplicated site."""
    a, b = F.upper(left), F.upper(right)
    pair = F.concat(a, b)
    return (
        F.when(a.isin("N", "-") | b.isin("N", "-"), 0)
        .when(a == b, F.when(a.isin("A", "T"), 9).otherwise(10))
        .when(pair.isin("AG", "GA", "CT", "TC"), -6)
        .when(pair.isin("AT", "TA"), -17)
        .otherwise(-15)
    )


def difference(cons: Column, obs: Column) -> Column:
    """How an alignment view marks an observed letter: i, v, a dash for gaps, a question mark for codes, blank if equal."""
    c, o = F.upper(cons), F.upper(obs)
    kind = substitution(cons, obs)
    return F.when(c == o, " ").when((c == "-") | (o == "-"), "-").when(kind == "ti", "i").when(kind == "tv", "v").otherwise("?")


def simple_coordinates(name: Column) -> Column:
    """name, start, end and orient of `name:a-b` with an optional strand; 0, 0 and + where there are none."""
    shape = r"^(.*):(\d+)-(\d+)(?:_?([+-]))?$"
    a, b = F.regexp_extract(name, shape, 2).cast("long"), F.regexp_extract(name, shape, 3).cast("long")
    sign = F.regexp_extract(name, shape, 4)
    orient = F.when(sign != "", sign).when(a > b, "-").otherwise("+")
    found = F.struct(F.regexp_extract(name, shape, 1).alias("name"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), orient.alias("orient"))
    return F.when(name.rlike(shape), found).otherwise(F.struct(name.alias("name"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("+").alias("orient")))


def quoted(c: Column) -> Column:
    """In double quotes, with quotes, backslashes and control characters escaped."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))
