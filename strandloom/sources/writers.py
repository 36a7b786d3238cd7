"""Texts of alignments, records, coordinates and findings, and the sinks that write them.

Every format is a column of text by record or alignment; `save` writes such a column in the order given.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import text as X


def join(values: Column, sep: str = "\n") -> Column:
    return F.array_join(values, sep)


def stockholm_text() -> Column:
    """A record: fields, the reference line, rows, other lines by name, and the end."""
    tags = F.map_keys("gc")
    widest = F.array_max(F.concat(F.transform("sequences", lambda r: F.length(r["original_id"])), F.transform(tags, lambda t: F.length(t) + 5), F.array(F.lit(0)))) + 2
    line = lambda name, value: F.concat(F.rpad(name, widest, F.lit(" ")), value)
    gf = F.transform("gf", lambda g: F.concat(F.lit("#=GF "), g["tag"], F.lit(" "), g["value"]))
    rf = F.when(F.array_contains(tags, "RF"), F.array(line(F.lit("#=GC RF"), F.element_at("gc", "RF")))).otherwise(F.array().cast("array<string>"))
    rest = F.transform(F.array_sort(F.filter(tags, lambda t: t != "RF")), lambda t: line(F.concat(F.lit("#=GC "), t), F.element_at("gc", t)))
    rows = F.transform("sequences", lambda r: line(r["original_id"], r["aligned_seq"]))
    return join(F.concat(F.array(F.lit("# STOCKHOLM 1.0")), gf, rf, rows, rest, F.array(F.lit("//"))))


def range_label(reverse_swaps: bool) -> Column:
    """name:start-end of a row, falling on the reverse strand if asked for, else with the strand; the name alone without coordinates."""
    known = (F.coalesce(F.col("seq_start"), F.lit(0)) != 0) | (F.coalesce(F.col("seq_end"), F.lit(0)) != 0)
    swapped = F.when(F.col("orient") == "-", F.concat("name", F.lit(":"), "seq_end", F.lit("-"), "seq_start")).otherwise(F.concat("name", F.lit(":"), "seq_start", F.lit("-"), "seq_end"))
    signed = F.concat("name", F.lit(":"), "seq_start", F.lit("-"), "seq_end", F.lit("_"), "orient")
    return F.when(known, swapped if reverse_swaps else signed).otherwise(F.col("name"))


def ordered(rows: DataFrame, line: Column) -> DataFrame:
    """msa_id and the lines of its rows in order."""
    listed = F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line"))))
    return rows.groupBy("msa_id").agg(join(F.transform(listed, lambda x: x["line"])).alias("text"))


def fasta_text(rows: DataFrame, ungapped: bool = False) -> DataFrame:
    """msa_id and the instances as FASTA."""
    seq = F.translate("seq", "- ", "") if ungapped else F.translate("seq", " ", "-")
    return ordered(rows.where(~F.col("is_reference")), F.concat(F.lit(">"), range_label(True), F.lit("\n"), seq))


def msa_stockholm_text(rows: DataFrame) -> DataFrame:
    """msa_id and the alignment as one record, its reference as the line of that name."""
    dots = F.translate("seq", "- ", "..")
    own = rows.withColumn("label", F.when(F.col("is_reference"), "#=GC RF").otherwise(range_label(False))).withColumn("dots", dots)
    listed = F.array_sort(F.collect_list(F.struct("row_idx", "label", "dots")))
    grouped = own.groupBy("msa_id").agg(listed.alias("rows"), F.max(F.when(F.col("is_reference"), F.col("name"))).alias("id"))
    width = F.greatest(F.array_max(F.transform("rows", lambda r: F.length(r["label"]))), F.lit(8)) + 2
    lines = F.transform("rows", lambda r: F.concat(F.rpad(r["label"], width, F.lit(" ")), r["dots"]))
    head = F.array(F.lit("# STOCKHOLM 1.0"), F.concat(F.lit("#=GF ID "), "id"), F.concat(F.lit("#=GF SQ "), (F.size("rows") - 1).cast("string")))
    return grouped.select("msa_id", join(F.concat(head, lines, F.array(F.lit("//")))).alias("text"))


def clustal_text(rows: DataFrame, width: int = 60) -> DataFrame:
    """msa_id and the alignment in blocks with marks below columns that agree."""
    from strandloom.operators import msa

    marks = msa.strung(msa.conservation(rows).withColumnRenamed("mark", "letter"), "marks")
    named = rows.select("msa_id", "row_idx", range_label(True).alias("label"), "seq")
    column = named.groupBy("msa_id").agg((F.greatest(F.max(F.length("label")), F.lit(10)) + 6).alias("column"), F.max(F.length("seq")).alias("width"), F.max("row_idx").alias("last"))
    body = named.join(column, "msa_id").select("msa_id", "row_idx", F.rpad("label", F.col("column"), F.lit(" ")).alias("label"), F.translate("seq", " ", "-").alias("seq"), "width")
    foot = marks.join(column, "msa_id").select("msa_id", (F.col("last") + 1).alias("row_idx"), F.repeat(F.lit(" "), F.col("column")).alias("label"), F.col("marks").alias("seq"), "width")
    both = body.unionByName(foot).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / width).cast("int"))).alias("block"))
    line = F.concat("label", F.substring(F.col("seq"), F.col("block") * width + 1, F.lit(width)))
    blocks = both.groupBy("msa_id", "block").agg(join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])).alias("text"))
    whole = blocks.groupBy("msa_id").agg(join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return whole.select("msa_id", F.concat(F.lit("CLUSTAL W\n\n"), "text").alias("text"))


def view_text(rows: DataFrame, letters: DataFrame, width: int = 100) -> DataFrame:
    """msa_id and a view in blocks: the consensus, then rows by where they begin, each with running coordinates and marks for transitions (i), transversions (v), gaps (-) and codes (?)."""
    from strandloom.operators import msa

    own = msa.cells(rows).join(letters.select("msa_id", "col", F.upper("letter").alias("cons")), ["msa_id", "col"])
    own = own.select("msa_id", "row_idx", "col", F.col("base").alias("letter"), F.when(F.col("base") == " ", " ").otherwise(X.difference(F.col("cons"), F.col("base"))).alias("mark"))
    lines = own.groupBy("msa_id", "row_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "letter"))), lambda x: x["letter"]), "").alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "mark"))), lambda x: x["mark"]), "").alias("marks"),
    )
    wide = rows.join(lines, ["msa_id", "row_idx"]).join(msa.strung(letters), "msa_id").select("msa_id", "row_idx", "name", "seq_start", "seq_end", "orient", "is_reference", "line", "marks", "consensus")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        first = group["consensus"].iloc[0]
        starts = {r.row_idx: next((i for i, c in enumerate(r.line) if c.isalpha()), len(r.line)) for r in group.itertuples()}
        order = sorted(group[~group["is_reference"]].itertuples(), key=lambda r: (starts[r.row_idx], r.row_idx))
        names = max([9, *(len(r.name) for r in order)])
        out, counts, place = [], {}, 1
        for at in range(0, len(first), width):
            piece = first[at : at + width]
            bases = sum(c.isalpha() for c in piece)
            out.append(f"{'consensus'.ljust(names)} {place:>10} {piece} {place + max(bases - 1, 0)}")
            place += bases
            for r in order:
                own_piece = r.line[at : at + width]
                if not own_piece.strip():
                    continue
                n = sum(c.isalpha() for c in own_piece)
                back = r.orient == "-"
                begin = counts.get(r.row_idx, r.seq_end if back else r.seq_start) or 0
                end = begin - max(n - 1, 0) if back else begin + max(n - 1, 0)
                counts[r.row_idx] = begin - n if back else begin + n
                out += [f"{''.ljust(names)} {'':>10} {r.marks[at : at + width]}".rstrip(), f"{r.name.ljust(names)} {begin:>10} {own_piece} {end}"]
            out.append("")
        return pd.DataFrame({"msa_id": [group["msa_id"].iloc[0]], "text": ["\n".join(out)]})

    return wide.groupBy("msa_id").applyInPandas(draw, "msa_id string, text string")


def statistics_text(stats: DataFrame) -> DataFrame:
    """A line of tab-separated divergences for every row, high ones starred."""
    return stats.select("msa_id", "row_idx", F.format_string("%s%d\t%.2f\t%.2f", F.when(F.col("high"), "**").otherwise(""), "row_idx", "from_reference", "from_consensus").alias("text"))


def averages_text(stats: DataFrame) -> DataFrame:
    """msa_id and a line of an alignment's mean divergences."""
    from strandloom.operators import msa

    return msa.averages(stats).select("msa_id", F.format_string("average\t%.2f\t%.2f", "from_reference", "from_consensus").alias("text"))


def raw_text(rows: DataFrame, origin: DataFrame) -> DataFrame:
    """msa_id and the instances as FASTA without gaps, each with where it is from: origin(msa_id, origin)."""
    named = rows.where(~F.col("is_reference")).join(origin, "msa_id")
    return ordered(named, F.concat(F.lit(">"), "name", F.lit("  "), "origin", F.lit("\n"), F.translate("seq", "- ", "")))


def fasta_entry(name: Column, seq: Column) -> Column:
    """One sequence as FASTA."""
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def output_name(path: str, folder: str) -> str:
    """Where the result on a file goes: under its name into another folder, or beside it with the extension `discoord`."""
    own, _, name = path.rpartition("/")
    if (own or ".").rstrip("/") == folder.rstrip("/"):
        stem = name.rpartition(".")[0] or name
        return f"{own}/{stem}.discoord" if own else f"{stem}.discoord"
    return f"{folder.rstrip('/')}/{name}"


def coordinates_fasta() -> Column:
    """A record of coordinates as FASTA, with what was on its line."""
    from strandloom.operators.coords import formatted_id

    return F.concat(F.lit(">"), F.when(F.col("start").isNotNull(), formatted_id()).otherwise(F.col("original_id")), F.coalesce("metadata", F.lit("")), F.lit("\n"), "sequence")


def coordinates_delimited(sep: str = "\t") -> Column:
    """assembly, sequence, start, end, strand and bases; blanks for what is unknown."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("assembly_id", "sequence_id", "start", "end", "orient", "sequence")])


def coordinates_stockholm(records: DataFrame) -> DataFrame:
    """file, metadata_idx and the text of each record: what stood before its rows, then the rows under their new names."""
    from strandloom.operators.coords import formatted_id

    name = F.when(F.col("start").isNotNull(), formatted_id()).otherwise(F.col("original_id"))
    listed = F.array_sort(F.collect_list(F.struct("rec_order", F.concat(name, F.lit(" "), "aligned_seq").alias("line"))))
    rows = records.groupBy("file", "metadata_idx").agg(F.max("metadata").alias("metadata"), listed.alias("rows"))
    return rows.select("file", "metadata_idx", F.concat("metadata", F.lit("\n"), join(F.transform("rows", lambda x: x["line"])), F.lit("\n//")).alias("text"))


def report_text() -> Column:
    """A line on a coordinate record."""
    shown = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    parts = [("original_id", "original_id", ""), ("assembly_id", "assembly_id", "None"), ("sequence_id", "sequence_id", "None"), ("start", "start", "0"), ("end", "end", "0"), ("orient", "orient", "?"), ("version", "inferred_version", "None"), ("validated", "validated", "invalid")]
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), shown(c, n)) for k, c, n in parts])


def site_report(windows: DataFrame, reach: int, edge: int = 10, all_offsets: bool = True, scores_only: bool = False) -> DataFrame:
    """part, row_idx and text of the lines of a report on duplicated sites, to be saved in that order; windows are those of sites.flanks.

    Parts: 0 the average of each length (and its offset, with all_offsets), 1 the site picked, 2 both sites of each instance whose letters
    score more than zero there, 3 their consensus, 4 these instances from both ends: flank in small letters, then the site and `edge` columns of
    the alignment in capitals. Instances without windows are left out; without any there are no lines."""
    from strandloom.functions.tables import settled
    from strandloom.operators import sites

    own = settled(windows.where("left is not null and right is not null"))
    scores = sites.site_scores(own, reach).where(F.lit(all_offsets) | (F.col("offset") == 0))
    line = lambda part, at, text: (F.lit(part).alias("part"), at.cast("long").alias("row_idx"), text.alias("text"))
    shown = ("length", "average", "offset") if all_offsets else ("length", "average")
    lines = sites.best_offsets(scores).select(*line(0, F.col("length"), F.concat_ws(" ", *shown)))
    best = sites.best_site(scores).head()
    if best is None:
        return lines
    n, k = best.length, best.offset
    where = "outside the alignment" if k == 0 else "wholly inside the alignment, maybe an inverted repeat's end" if k == n else f"{k} of {n} bases inside the alignment"
    one = own.sparkSession.range(1)
    lines = lines.unionByName(one.select(*line(1, F.col("id"), F.lit(f"best: length={n}, offset={k}" + (f" ({where})" if all_offsets else "")))))
    if scores_only:
        return lines
    left, right, raw = sites.site_at(F.lit(n), F.lit(k), reach)
    passing = own.where(raw > 0)
    called = sites.site_consensus(sites.site_letters(own, n, k, reach)).groupBy().agg(join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("text"))
    label = F.concat("name", F.lit(":"), "seq_start", F.lit("-"), "seq_end", F.lit("_"), "orient")
    width = max(8, passing.agg(F.max(F.length(label))).head()[0] or 0)
    flank = reach - n + k
    columns = F.translate(F.upper("seq"), " ", "-")
    halves = F.concat(F.lower(F.substring("left", 1, flank)), F.upper(left), F.lit(" "), F.substring(columns, 1, edge), F.lit(" ... "),
                      F.when(F.length("seq") > edge, F.substring(columns, -edge, edge)).otherwise(columns), F.lit(" "), F.upper(right), F.lower(F.substring("right", reach - k + n + 1, 2 * reach)))
    head = "flank, site and alignment".ljust(flank + n + 1 + edge) + " ... " + "alignment, site and flank"
    return (
        lines.unionByName(passing.select(*line(2, F.col("row_idx"), F.concat(left, F.lit("\n"), right))))
        .unionByName(called.select(*line(3, F.lit(0), F.col("text"))))
        .unionByName(one.select(*line(4, F.lit(-1), F.lit(" " * (width + 2) + head))))
        .unionByName(passing.select(*line(4, F.col("row_idx"), F.concat(F.rpad(label, width, " "), F.lit("  "), halves))))
    )


def findings_text() -> Column:
    """file, label, severity, check and message between tabs."""
    return F.concat_ws("\t", "file", "label", "severity", "check", "message")


def save(texts: DataFrame, path: str, order: list[str], compressed: bool = False, files: int = 1) -> None:
    """Writes the column `text` in order, as `files` text files whose names sort in that order."""
    out = texts.repartitionByRange(files, *order).sortWithinPartitions(*order) if files > 1 else texts.orderBy(*order).coalesce(1)
    out.select("text").write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)
