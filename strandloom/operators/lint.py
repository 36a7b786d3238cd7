"""Rules for records, files and reference tables; every finding is a row of file, record_num, label, severity, severity_rank, check and message.

Rules of one record are expressions that give findings or null, gathered in one array, so a file is linted in one pass without a shuffle.
Rules of a file aggregate; rules of reference tables are joins, left out where a table isn't given. Wording is this engine's own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import alphabet
from strandloom.functions import text as X
from strandloom.operators import records as R

RANK = {"INFO": 0, "WARN": 1, "ERROR": 2}
COLUMNS = ("file", "record_num", "label", "severity", "severity_rank", "check", "message")
FINDING = "array<struct<severity:string,check:string,message:string>>"


def finding(severity: str, check: str, *message) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.coalesce(text, F.lit("")).alias("message"))


def when(condition: Column, severity: str, check: str, *message) -> Column:
    return F.array(F.when(condition, finding(severity, check, *message)))


def each(values: Column, make) -> Column:
    """Findings or nulls that make(value) gives for every value."""
    return F.coalesce(F.transform(values, make), F.array().cast(FINDING))


def header_rules() -> list[Column]:
    out = [
        when(~F.col("header").rlike(r"^# STOCKHOLM \d+\.\d+$"), "ERROR", "invalid_header", "header is ", X.quoted(F.col("header"))),
        when(~F.col("terminated"), "ERROR", "missing_terminator", "the record doesn't end"),
        when(F.col("block_separator_line").isNotNull(), "ERROR", "block_format", "rows go on after the blank line ", F.col("block_separator_line").cast("string")),
    ]
    return out + [when(~R.has(tag), "ERROR", "missing_required_field", f"{tag} is missing") for tag in ("DE", "AU", "TP", "OC", "SQ")]


def field_rules() -> list[Column]:
    blank = lambda v: X.trimmed(v) == ""
    size = lambda v: F.octet_length(X.trimmed(v))
    count = lambda tag: F.size(R.all_of(tag))
    ident, de, se, td, ct, kd, sq, tp = (R.first_of(t) for t in ("ID", "DE", "SE", "TD", "CT", "KD", "SQ", "TP"))
    empty = lambda tag, v: when(blank(v), "ERROR", "empty_field", f"{tag} is empty")
    name = X.trimmed(ident)
    odd = F.regexp_extract(X.trimmed(td), f"[^{alphabet.IUB}{alphabet.IUB.lower()}]", 0)
    number = X.trimmed(sq)
    return [
        each(R.all_of("AC"), lambda v: F.when(blank(v), finding("ERROR", "empty_field", "AC is empty")).when(~X.valid_accession(v), finding("ERROR", "ac_format", "AC ", X.quoted(X.trimmed(v)), " is no accession"))),
        when(count("ID") > 1, "ERROR", "id_multi_line", "ID is given ", count("ID").cast("string"), " times"),
        empty("ID", ident),
        when(size(ident) > 45, "ERROR", "id_too_long", "ID has ", size(ident).cast("string"), " bytes, more than 45"),
        when((size(ident) <= 45) & name.rlike(r"^\d+$"), "ERROR", "id_numeric", "ID ", name, " is a number"),
        when(X.automated_name(ident), "WARN", "id_automated_name", "ID ", X.quoted(name), " was made by a program"),
        when(count("DE") > 1, "ERROR", "de_multi_line", "DE is given ", count("DE").cast("string"), " times"),
        empty("DE", de),
        when(size(de) > 80, "ERROR", "de_too_long", "DE has ", size(de).cast("string"), " bytes, more than 80"),
        when(size(se) > 80, "ERROR", "se_too_long", "SE has ", size(se).cast("string"), " bytes, more than 80"),
        empty("TP", tp),
        when(odd != "", "ERROR", "td_invalid_chars", "TD holds ", X.quoted(odd)),
        empty("CT", ct),
        when((X.trimmed(ct) != "") & (F.lower(X.trimmed(ct)) != "handbuilt"), "ERROR", "ct_unknown", "CT ", X.quoted(X.trimmed(ct)), " is unknown"),
        when(~X.trimmed(kd).rlike(r"(?i)^[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"), "ERROR", "kd_not_numeric", "KD ", X.quoted(X.trimmed(kd)), " is no number"),
        each(R.all_of("AU"), lambda v: F.when(blank(v), finding("ERROR", "empty_field", "AU is empty"))),
    ]


def author_rules() -> Column:
    """Of every author the first rule that fails; ill-formed and repeated ORCIDs besides."""
    tokens = F.filter(F.transform(F.flatten(F.transform(R.all_of("AU"), lambda v: F.split(v, ";"))), X.trimmed), lambda t: t != "")
    orcid = lambda t: F.when(~t.contains(",") & t.startswith("ORCID:"), F.regexp_extract(t, r"^ORCID:([^ ]*)", 1))
    name = lambda t: F.when(t.startswith("ORCID:"), X.trimmed(F.regexp_replace(t, r"^ORCID:[^ ]*", ""))).otherwise(t)
    valid = F.transform(tokens, lambda t: F.when(X.valid_orcid(orcid(t)), F.upper(orcid(t))))
    again = lambda t, i: F.array_position(valid, F.upper(orcid(t))) <= i

    def ids(t, i):
        return F.when(~X.valid_orcid(orcid(t)), finding("WARN", "au_format", "ORCID ", X.quoted(orcid(t)), " is ill-formed")).when(
            X.valid_orcid(orcid(t)) & again(t, i), finding("ERROR", "au_format", "ORCID ", X.quoted(orcid(t)), " is repeated")
        )

    def names(t):
        n = name(t)
        rule = lambda s, why: finding(s, "au_format", "author ", X.quoted(t), why)
        return (
            F.when(t.contains(","), rule("WARN", " holds a comma")).when(n == "", rule("WARN", " has no name")).when(n.contains(":"), rule("WARN", " holds a colon"))
            .when(~n.contains(" "), rule("WARN", " is one word")).when(n.contains("."), rule("WARN", " is abbreviated")).when(n.rlike(r"^[A-Za-z]\s"), rule("ERROR", " begins with an initial"))
            .when(n.rlike(r"\s[A-Z]$"), rule("ERROR", " ends with an initial"))
        )

    return F.concat(F.transform(tokens, ids), F.transform(tokens, names))


def publication_rules() -> list[Column]:
    tags = F.transform("gf", lambda g: g["tag"])
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    first = F.array_position(tags, "RN")
    early = F.get(F.filter(F.slice(tags, 1, F.greatest(first - 1, F.lit(0)).cast("int")), lambda t: t.isin("RM", "RD", "RT", "RA", "RL")), F.lit(0))
    bare = lambda v: F.regexp_replace(X.trimmed(v), r"^https?://doi\.org/", "")
    return [
        when(has("RN") & ~has("RM", "RD"), "WARN", "ref_block_incomplete", "RN without RM or RD"),
        when(has("RM", "RD") & ~has("RN"), "ERROR", "ref_block_incomplete", "RM or RD without RN"),
        when((first > 0) & early.isNotNull(), "ERROR", "ref_block_order", early, " stands before RN"),
        each(R.all_of("RD"), lambda v: F.when(~bare(v).startswith("10.") | (F.octet_length(bare(v)) < 8), finding("ERROR", "rd_format", "RD ", X.quoted(X.trimmed(v)), " is no DOI"))),
    ]


def annotation_rules() -> list[Column]:
    known = lambda t: t.isin(*alphabet.KNOWN_GF)
    mm = F.element_at("gc", "MM")
    odd = F.regexp_extract(mm, "[^m.]", 0)
    width = F.coalesce(F.length(F.element_at("gc", "RF")), F.length(F.get("sequences", F.lit(0))["aligned_seq"]))
    stray = lambda a: F.upper(F.regexp_extract(a, r"^#[=#\s]*(\w*)", 1))
    return [
        when(odd != "", "ERROR", "mm_invalid_chars", "MM holds ", X.quoted(odd)),
        when(F.length(mm) != width, "ERROR", "mm_length_mismatch", "MM has ", F.length(mm).cast("string"), " columns of ", width.cast("string")),
        each(F.filter("gf", lambda g: ~known(g["tag"])), lambda g: finding("INFO", "unknown_gf_tag", "field ", g["tag"], " is unknown")),
        each(F.array_sort(F.filter(F.map_keys("gc"), lambda k: ~k.isin(*alphabet.KNOWN_GC))), lambda k: finding("INFO", "unknown_gc_tag", "line ", k, " is unknown")),
        each(F.col("unknown_annotations"), lambda a: finding("ERROR", "unknown_annotation", "line ", X.quoted(a), F.when(known(stray(a)), F.concat(F.lit("; field "), stray(a), F.lit("?"))).otherwise(""))),
    ]


def alignment_rules() -> list[Column]:
    """Left out where rows come in blocks."""
    rf, rows, sq = F.element_at("gc", "RF"), F.col("sequences"), X.trimmed(R.first_of("SQ"))
    valid = alphabet.IUB + alphabet.IUB.lower()
    odd = F.regexp_extract(rf, f"[^{valid}Xx.]", 0)
    bad = lambda s: F.regexp_extract(s, f"[^{valid}._~-]", 0)
    head = lambda s: F.regexp_extract(s, f"^[{valid}._~-]*", 0)
    gap = lambda s: F.regexp_extract(head(s), "[._~-]", 0)
    width = F.length(F.get(rows, F.lit(0))["aligned_seq"])
    whole = sq.rlike(r"^\+?\d{1,18}$")
    return [
        when(~whole, "ERROR", "sq_not_numeric", "SQ ", X.quoted(sq), " is no number"),
        when(whole & (sq.try_cast("long") != F.size(rows)), "ERROR", "sq_mismatch", "SQ is ", sq, " of ", F.size(rows).cast("string"), " rows"),
        when(rf.isNull(), "ERROR", "rf_missing", "RF is missing"),
        when(odd != "", "ERROR", "rf_invalid_chars", "RF holds ", X.quoted(odd)),
        each(rows, lambda r: F.when(F.length(r["aligned_seq"]) != F.length(rf), finding("ERROR", "rf_length_mismatch", "row ", X.quoted(r["original_id"]), " has another length than RF"))),
        each(rows, lambda r: F.when(bad(r["aligned_seq"]) != "", finding("ERROR", "seq_invalid_chars", "row ", X.quoted(r["original_id"]), " holds ", X.quoted(bad(r["aligned_seq"])), " at ", (F.length(head(r["aligned_seq"])) + 1).cast("string")))),
        each(rows, lambda r: F.when((gap(r["aligned_seq"]) != "") & (gap(r["aligned_seq"]) != "."), finding("WARN", "seq_nonstandard_gap", "row ", X.quoted(r["original_id"]), " has gaps ", X.quoted(gap(r["aligned_seq"]))))),
        each(rows, lambda r: F.when(rf.isNull() & (F.length(r["aligned_seq"]) != width), finding("ERROR", "seq_length_mismatch", "row ", X.quoted(r["original_id"]), " has another length than the first"))),
    ]


def record_rules(records: DataFrame) -> DataFrame:
    """Findings of every record on its own."""
    plain = [*header_rules(), *field_rules(), author_rules(), *publication_rules(), *annotation_rules()]
    aligned = F.when(F.col("block_separator_line").isNull(), F.concat(*alignment_rules())).otherwise(F.array().cast(FINDING))
    found = F.filter(F.concat(*[F.coalesce(c.cast(FINDING), F.array().cast(FINDING)) for c in plain], F.coalesce(aligned.cast(FINDING), F.array().cast(FINDING))), lambda x: x.isNotNull())
    return ranked(records.select("file", "record_num", R.label().alias("label"), F.explode(found).alias("f")).select("file", "record_num", "label", "f.*"))


def ranked(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARN", 1).otherwise(0)
    return findings.withColumn("severity_rank", rank).select(*COLUMNS)


def consensus_rules(records: DataFrame) -> DataFrame:
    """Records whose reference line differs from the consensus of their rows; none where it was built by hand or rows come in blocks."""
    from strandloom.operators import msa

    own = records.where(F.element_at("gc", "RF").isNotNull() & F.col("block_separator_line").isNull() & ~R.hand_curated())
    called = msa.consensus(R.rows(own))
    own = own.withColumn("msa_id", F.concat("file", F.lit("#"), "record_num")).join(called, "msa_id")
    dashed = F.upper(F.translate(F.element_at("gc", "RF"), "._~", "---"))
    # A line that only marks occupied columns is compared as such
    bad = own.where(~F.when(msa.is_occupancy(dashed), F.lower(dashed) == msa.occupancy(F.col("consensus"))).otherwise(dashed == F.upper("consensus")))
    return ranked(bad.select("file", "record_num", R.label().alias("label"), F.lit("WARN").alias("severity"), F.lit("rf_consensus_mismatch").alias("check"), F.lit("RF differs from the consensus of the rows").alias("message")))


def repeated_ids(records: DataFrame) -> DataFrame:
    """Records whose ID, in any case, others of their file have too, with the number of them, `copies`.

    IDs are counted first and only those that repeat are joined back, so an ID that a third of all records has is no window of one task."""
    named = records.withColumn("low", F.lower(X.trimmed(R.first_of("ID")))).where("low <> ''")
    copies = named.groupBy(F.col("file").alias("of_file"), F.col("low").alias("of")).agg(F.count("*").alias("copies")).where("copies > 1")
    return named.join(copies, (F.col("file") == F.col("of_file")) & (F.col("low") == F.col("of"))).drop("of_file", "of", "low")


def file_rules(records: DataFrame) -> DataFrame:
    """Findings on files as a whole, and repeated IDs."""
    row = lambda df, severity, check, message: df.select("file", F.lit(None).cast("int").alias("record_num"), F.lit("FILE").alias("label"), F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.alias("message"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    accession = F.exists(R.all_of("AC"), lambda v: X.trimmed(v) != "")
    orcid = F.exists(R.all_of("AU"), lambda v: v.contains("ORCID:"))
    old = F.exists("sequences", lambda r: r["inferred_version"].isin("V0", "V1", "Mixed"))
    auto = F.coalesce(X.automated_name(R.first_of("ID")), F.lit(False))
    cited = F.exists("gf", lambda g: g["tag"].isin("RT", "RA", "RL"))
    count = lambda c: F.sum(c.cast("int"))
    five = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("record_num", R.label().alias("label"))))), 1, 5)
    sums = records.groupBy("file").agg(
        F.count("*").alias("records"), count(accession).alias("accessions"), count(orcid).alias("orcids"), count(old).alias("old"), count(auto).alias("auto"), count(cited).alias("cited"),
        five(accession).alias("with_ac"), five(old).alias("with_old"), five(auto).alias("with_auto"),
    )
    listed = lambda names, n: text(F.array_join(F.transform(names, lambda x: x["label"]), ", "), F.when(F.col(n) > 5, F.concat(F.lit(" and "), (F.col(n) - 5).cast("string"), F.lit(" more"))).otherwise(""))
    out = [
        row(sums.where("accessions > 0"), "INFO", "ac_update_records", text(F.col("accessions").cast("string"), " records have accessions: ", listed("with_ac", "accessions"))),
        row(sums.where("orcids < records"), "INFO", "orcid_missing", text((F.col("records") - F.col("orcids")).cast("string"), " of ", F.col("records").cast("string"), " records have no ORCID")),
        row(sums.where("auto > 0"), "INFO", "automated_name", text(F.col("auto").cast("string"), " names were made by a program: ", listed("with_auto", "auto"))),
        row(sums.where("old > 0"), "INFO", "seqid_legacy_format", text(F.col("old").cast("string"), " records have identifiers of older forms: ", listed("with_old", "old"))),
        row(sums.where("cited > 0"), "WARN", "citation_fields_unused", F.lit("RT, RA and RL are not used")),
    ]
    again = repeated_ids(records)
    severity, check = F.when(accession, "INFO").otherwise("ERROR"), F.when(accession, "duplicate_id_update").otherwise("duplicate_id")
    out.append(again.select("file", "record_num", R.label().alias("label"), severity.alias("severity"), check.alias("check"), text("ID ", X.quoted(X.trimmed(R.first_of("ID"))), " occurs ", F.col("copies").cast("string"), " times").alias("message")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return ranked(found)


def jaro(a: str, b: str) -> float:
    """Jaro similarity with Winkler's bonus for up to four equal first letters."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    swapped = sum(x != y for x, y in zip(matched, other)) // 2
    j = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return j + 0.1 * same * (1 - j)


def jaro_winkler(a: Column, b: Column) -> Column:
    """The same for two columns, in Arrow batches."""

    def scores(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(left, right)])

    return F.pandas_udf(scores, "double")(a, b)


def similar_names(names: DataFrame, vocabulary: DataFrame, least: float = 0.85, k: int = 3) -> DataFrame:
    """name, candidate, score and rank: up to k entries of vocabulary(name) most like each of names(name).

    Compared are names of at least four letters with candidates of the same first letter and a length that differs by at most eight;
    the letter and the length's band are the join's keys."""
    band = lambda c: F.floor(F.octet_length(c) / 8)
    own = names.select(F.col("name")).distinct().where(F.length("name") >= 4).withColumn("first", F.lower(F.substring("name", 1, 1)))
    own = own.withColumn("band", F.explode(F.array(band("name") - 1, band("name"), band("name") + 1)))
    words = vocabulary.select(F.col("name").alias("candidate")).distinct().withColumn("first", F.lower(F.substring("candidate", 1, 1))).withColumn("band", band("candidate"))
    pairs = own.join(words, ["first", "band"]).where(F.abs(F.octet_length("name") - F.octet_length("candidate")) <= 8)
    scored = pairs.withColumn("score", jaro_winkler(F.lower("name"), F.lower("candidate"))).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k).select("name", "candidate", "score", "rank")


def table_rules(records: DataFrame, tables: dict[str, DataFrame]) -> DataFrame | None:
    """Findings against classification(name), taxonomy(name), common(alt, scientific) and names(name_lower); None without any."""
    base = records.select("file", "record_num", R.label().alias("label"), "gf")
    found = []
    if "classification" in tables:
        own = base.withColumn("value", X.trimmed(R.first_of("TP"))).where("value <> ''")
        bad = own.join(tables["classification"], F.col("value") == F.col("name"), "left_anti")
        found.append(bad.select("file", "record_num", "label", F.lit("ERROR").alias("severity"), F.lit("tp_unknown").alias("check"), F.concat(F.lit("TP "), X.quoted(F.col("value")), F.lit(" is no class")).alias("message")))
    if "taxonomy" in tables:
        own = base.select("file", "record_num", "label", F.explode(R.all_of("OC")).alias("raw")).withColumn("value", X.trimmed(F.col("raw"))).where("value <> ''")
        bad = own.join(tables["taxonomy"], F.col("value") == F.col("name"), "left_anti")
        hint = F.lit("")
        if "common" in tables:
            bad = bad.join(tables["common"], F.lower("value") == F.col("alt"), "left")
            hint = F.coalesce(F.concat(F.lit("; scientific name "), X.quoted(F.col("scientific"))), hint)
        else:
            bad = bad.withColumn("scientific", F.lit(None).cast("string"))
        near = similar_names(bad.where("scientific is null").select(F.col("value").alias("name")), tables["taxonomy"])
        near = near.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: X.quoted(x["candidate"])), ", ").alias("near")).withColumnRenamed("name", "value")
        bad = bad.join(near, "value", "left")
        hint = F.concat(hint, F.coalesce(F.concat(F.lit("; like "), F.col("near")), F.lit("")))
        found.append(bad.select("file", "record_num", "label", F.lit("ERROR").alias("severity"), F.lit("oc_unknown").alias("check"), F.concat(F.lit("OC "), X.quoted(F.col("value")), F.lit(" is no taxon"), hint).alias("message")))
    if "names" in tables:
        own = base.withColumn("value", X.trimmed(R.first_of("ID"))).where("value <> ''").join(tables["names"], F.lower("value") == F.col("name_lower"), "left_semi")
        update = R.has("AC")
        found.append(own.select("file", "record_num", "label", F.when(update, "INFO").otherwise("ERROR").alias("severity"), F.when(update, "id_taken_update").otherwise("id_taken").alias("check"), F.concat(F.lit("ID "), X.quoted(F.col("value")), F.lit(" is taken")).alias("message")))
    out = None
    for x in found:
        out = x if out is None else out.unionByName(x)
    return None if out is None else ranked(out)


def coordinate_rules(records: DataFrame, genome: DataFrame) -> DataFrame:
    """Findings on rows against a genome: coordinates that need fixing or fail, and how many identifiers it lacks."""
    from strandloom.operators import coords

    rows = records.select("file", "record_num", R.label().alias("label"), F.posexplode("sequences").alias("rec_order", "r"))
    rows = rows.select(
        "file", "record_num", "label", "rec_order", "r.original_id", "r.assembly_id", "r.sequence_id", F.col("r.seq_start").alias("start"), F.col("r.seq_end").alias("end"), "r.orient",
        X.ungapped(F.col("r.aligned_seq")).alias("sequence"), F.lit(None).cast("string").alias("validated"),
    )
    known = genome.select(F.col("chrom").alias("known"))
    checked = coords.validate(rows.where("start is not null"), genome).join(known, F.col("sequence_id") == F.col("known"), "left")
    row = lambda df, check, message: df.select("file", "record_num", "label", F.lit("WARN").alias("severity"), F.lit(check).alias("check"), message.alias("message"))
    fixed = row(checked.where("validated like 'fixed%'"), "seq_coord_fixed", F.concat(F.lit("row "), X.quoted(F.col("original_id")), F.lit(" would be "), "validated"))
    bad = row(checked.where("known is not null and validated is null"), "seq_coord_invalid", F.concat(F.lit("row "), X.quoted(F.col("original_id")), F.lit(" is not at its place")))
    lost = checked.where("known is null").groupBy("file", "record_num", "label").agg(F.count("*").alias("n"))
    return ranked(fixed.unionByName(bad).unionByName(row(lost, "seq_id_not_in_ref", F.concat(F.col("n").cast("string"), F.lit(" rows are of sequences the genome lacks")))))


def lint(records: DataFrame, tables: dict[str, DataFrame] | None = None, genome: DataFrame | None = None, least: str = "INFO") -> DataFrame:
    """All findings of at least a severity."""
    out = record_rules(records).unionByName(consensus_rules(records)).unionByName(file_rules(records))
    if tables and (more := table_rules(records, tables)) is not None:
        out = out.unionByName(more)
    if genome is not None:
        out = out.unionByName(coordinate_rules(records, genome))
    return out.where(F.col("severity_rank") >= RANK[least])


def failed(findings: DataFrame) -> bool:
    """Whether any finding is an error."""
    return bool(findings.agg(F.bool_or(F.col("severity") == "ERROR")).head()[0])
