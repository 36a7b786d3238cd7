"""Readers of alignment, genome and search files as DataFrames.

Files are read as bytes by Spark, so any store works and gzip is recognised by its magic number; one task parses a file at a time
and hands its rows on in batches. Every reader takes a path, a glob or a list.
"""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import ids

SEQUENCE = "original_id string, assembly_id string, sequence_id string, seq_start long, seq_end long, orient string, inferred_version string, aligned_seq string"
RECORD = (
    f"file string, record_num int, start_line long, header string, gf array<struct<tag string, value string>>, gc map<string,string>, sequences array<struct<{SEQUENCE.replace(' string', ': string').replace(' long', ': long')}>>, "
    "unknown_annotations array<string>, terminated boolean, block_separator_line long"
)
MSA = "file string, msa_id string, row_idx int, is_reference boolean, name string, seq string, seq_start long, seq_end long, orient string"
COORDINATES = (
    "file string, metadata_idx int, rec_order int, original_id string, assembly_id string, sequence_id string, start long, end long, orient string, inferred_version string, "
    "sequence string, aligned_seq string, metadata string, validated string"
)
GENOME = "assembly string, chrom string, length long, seq string"
PAIRWISE = (
    "file string, hit_no int, sw_score int, pct_div double, pct_del double, pct_ins double, query_name string, query_start long, query_end long, query_remaining long, query_seq string, "
    "subj_name string, subj_start long, subj_end long, subj_remaining long, subj_seq string, orientation string, id string"
)
FAMILY = (
    "file string, id string, id_line string, description string, accession string, date string, keywords array<string>, organism string, oc_lineage array<string>, "
    "references array<struct<number: string, authors: string, title: string, location: string>>, comments array<string>, sq_summary string, consensus_name string, consensus string"
)
BLAST = "score int, qseqid string, qstart long, qend long, qlen long, sstrand string, sseqid string, sstart long, send long, slen long, qseq string, sseq string"
ROWS = 2000


def names(schema: str) -> list[str]:
    return [f.name for f in __import__("pyspark.sql.types", fromlist=["types"]).StructType.fromDDL(schema).fields]


def read(spark: SparkSession, path, schema: str, parse: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows that parse(file name, bytes) yields for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = names(schema)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                content = bytes(content)
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = []
                for row in parse(file, content):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.mapInPandas(run, schema)


def text_lines(content: bytes) -> list[str]:
    """Lines without their ends; only line feeds end them, with or without a carriage return before."""
    lines = content.decode("utf-8").split("\n") if content else []
    return [line.removesuffix("\r") for line in (lines[:-1] if lines and not lines[-1] else lines)]


def stockholm_records(lines: list[str]) -> Iterator[dict]:
    """The records of a file in which each ends with a line of two slashes; a last one may lack it."""
    r, number, blank = None, 0, None
    for n, line in enumerate(lines, 1):
        t = line.strip()
        if r is None:
            if line.startswith("# STOCKHOLM"):
                number += 1
                r = {"record_num": number, "start_line": n, "header": line.rstrip(), "gf": [], "gc": {}, "rows": [], "unknown": [], "terminated": False, "separator": None}
                blank = None
            continue
        if t == "//":
            r["terminated"] = True
            yield r
            r = None
        elif not t:
            blank = blank or (n if r["rows"] else None)
        elif line.startswith("# STOCKHOLM"):
            continue
        elif line.startswith(("#=GF", "#=GC")):
            tag, _, value = re.sub(r"\s+", " ", line[4:].strip(), count=1).partition(" ")
            if line.startswith("#=GF"):
                r["gf"].append((tag, value.strip()))
            else:
                r["gc"][tag] = r["gc"].get(tag, "") + value.strip()
        elif line.startswith(("#=GS", "#=GR")):
            continue
        elif t.startswith("#"):
            r["unknown"].append(t)
        else:
            parts = t.split(None, 1)
            if len(parts) == 2:
                if blank and r["separator"] is None:
                    r["separator"] = blank
                r["rows"].append((parts[0], parts[1].strip()))
    if r is not None:
        yield r


def stockholm(spark: SparkSession, path, raw: bool = False) -> DataFrame:
    """RECORD rows. raw: identifiers stay unparsed, which spares the parsing where only fields matter."""

    def parse(file, content):
        for r in stockholm_records(text_lines(content)):
            rows = [dict(zip(("original_id", *ids.FIELDS, "aligned_seq"), (name, *((None,) * 6 if raw else ids.parse(name)), seq))) for name, seq in r["rows"]]
            gf = [{"tag": t, "value": v} for t, v in r["gf"]]
            yield (file, r["record_num"], r["start_line"], r["header"], gf, r["gc"], rows, r["unknown"], r["terminated"], r["separator"])

    return read(spark, path, RECORD, parse)


def simple_coordinates(name: str) -> tuple[str, int, int, str]:
    """name, start, end and orient as alignment rows carry them; 0, 0 and + if there are none."""
    m = re.fullmatch(r"(.*):(\d+)-(\d+)(?:_?([+-]))?", name)
    if not m:
        return name, 0, 0, "+"
    a, b = int(m[2]), int(m[3])
    return m[1], min(a, b), max(a, b), m[4] or ("-" if a > b else "+")


def msa_rows(file: str, msa_id: str, rows: list[tuple[str, str]]) -> Iterator[tuple]:
    """Rows of an alignment, the first of them the reference."""
    for i, (name, seq) in enumerate(rows):
        yield (file, msa_id, i, i == 0, *[(n, seq, a, b, o) for n, a, b, o in [simple_coordinates(name)]][0])


def stockholm_msa(spark: SparkSession, path) -> DataFrame:
    """MSA rows of every record; RF is the reference, named after ID, else the first row. Rows of one name stay separate."""

    def parse(file, content):
        for r in stockholm_records(text_lines(content)):
            name = next((v for t, v in r["gf"] if t == "ID" and v), "consensus")
            dashed = [(n, s.translate(str.maketrans("._~", "---"))) for n, s in r["rows"]]
            if "RF" in r["gc"]:
                dashed.insert(0, (name, r["gc"]["RF"].translate(str.maketrans("._~", "---"))))
            if not dashed:
                raise ValueError(f"{file}: record {r['record_num']} has no rows")
            yield from msa_rows(file, f"{file}#{r['record_num']}", dashed)

    return read(spark, path, MSA, parse)


def fasta_entries(lines: list[str]) -> Iterator[tuple[str, str]]:
    head, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts)
            head, parts = line[1:].rstrip("\r\n"), []
        elif head is not None:
            parts.append(line.strip())
    if head is not None:
        yield head, "".join(parts)


def fasta_msa(spark: SparkSession, path) -> DataFrame:
    """Aligned FASTA: the first entry is the reference."""
    return read(spark, path, MSA, lambda file, c: msa_rows(file, file, [(h.strip(), s) for h, s in fasta_entries(text_lines(c))]))


def clustal_msa(spark: SparkSession, path) -> DataFrame:
    """Clustal blocks, joined by name in the order names first appear."""

    def parse(file, content):
        lines = text_lines(content)
        if not lines or not lines[0].upper().startswith("CLUSTAL"):
            raise ValueError(f"{file}: no Clustal header")
        rows: dict[str, list[str]] = {}
        for line in lines[1:]:
            if line.strip() and line[0] not in " \t" and len(parts := line.split()) > 1:
                rows.setdefault(parts[0], []).append(re.sub(r"[^A-Za-z\-]", "", parts[1]).upper())
        yield from msa_rows(file, file, [(n, "".join(s)) for n, s in rows.items()])

    return read(spark, path, MSA, parse)


def ig_msa(spark: SparkSession, path) -> DataFrame:
    """IG alignments: a comment ends a row; FRAGMENT gives the next row's coordinates."""

    def parse(file, content):
        rows, place, name, parts = [], None, None, []
        for line in [*text_lines(content), ";"]:
            t = line.strip()
            if t.startswith(";"):
                if name is not None:
                    rows.append((name, "".join(parts), place))
                    name, parts, place = None, [], None
                if m := re.search(r"FRAGMENT\s+(\d+)\s*->\s*(\d+)", t):
                    place = int(m[1]), int(m[2])
            elif t and name is None:
                name = t.split()[0]
            elif t:
                parts.append(t)
        for i, (n, s, p) in enumerate(rows):
            a, b = p or (0, 0)
            yield (file, file, i, i == 0, n, s, min(a, b), max(a, b), "-" if a > b else "+")

    return read(spark, path, MSA, parse)


def ig_family(spark: SparkSession, path) -> DataFrame:
    """Family records with two-letter tags behind a semicolon; one in each file."""

    def parse(file, content):
        f = {"ID": "", "AC": "", "DT": "", "OS": "", "SQ": ""}
        de, kw, oc, cc, refs, name, seq, after = [], [], [], [], [], None, [], False
        split = lambda v: [x for p in v.rstrip(".").split(";") if (x := p.strip().rstrip("."))]
        for line in text_lines(content):
            if line.startswith(";"):
                tag, value = line[1:3].strip(), line[3:].strip()
                if tag == "DE":
                    de.append(value)
                elif tag == "KW":
                    kw += split(value)
                elif tag == "OC":
                    oc += split(value)
                elif tag == "CC":
                    cc.append(value)
                elif tag == "RN":
                    refs.append({"number": value, "authors": "", "title": "", "location": ""})
                elif tag in ("RA", "RT", "RL") and refs:
                    key = {"RA": "authors", "RT": "title", "RL": "location"}[tag]
                    refs[-1][key] = f"{refs[-1][key]} {value}".strip()
                elif tag in f:
                    f[tag] = f[tag] or value
                    after = after or tag == "SQ"
            elif after and line.strip():
                name, seq = (line.strip(), seq) if name is None else (name, [*seq, line.strip()])
        yield (file, (f["ID"].split() or [""])[0], f["ID"], " ".join(de), f["AC"], f["DT"], kw, f["OS"], oc, refs, cc, f["SQ"], name, "".join(seq))

    return read(spark, path, FAMILY, parse)


SCORE_LINE = re.compile(r"\s*(\d+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+\S+\s+\d+")


def pairwise(spark: SparkSession, path) -> DataFrame:
    """Alignments of a cross-match search: a line of scores, then blocks of query, match and subject."""

    def parse(file, content):
        hit, number, turn = None, 0, 0
        done = lambda h: (file, *h[:17])
        for line in text_lines(content):
            t = line.split()
            if SCORE_LINE.match(line) and len(t) >= 9:
                if hit:
                    yield done(hit)
                number += 1
                reverse = t[8] == "C"
                at = 9 if reverse else 8
                left = lambda x: int(x.strip("()"))
                name, rest = t[at], t[at + 1 :]
                triple = []
                while rest and len(triple) < 3:
                    x = rest.pop(0)
                    if re.fullmatch(r"\(?\d+\)?", x):
                        triple.append(x)
                if len(triple) < 3:
                    hit = None
                    continue
                a, b, c = triple
                start, end, remaining = (left(c), left(b), left(a)) if reverse else (left(a), left(b), left(c))
                tail = next((x for x in rest if x != "*"), None)
                hit = [number, int(t[0]), float(t[1]), float(t[2]), float(t[3]), t[4], int(t[5]), int(t[6]), left(t[7]), "", name, start, end, remaining, "", "-" if reverse else "+", tail]
                turn = 0
            elif hit and (line.startswith("Gap_init") or line.startswith("Transitions /")):
                yield done(hit)
                hit = None
            elif hit:
                if turn == 1:  # the line of marks, blank or not
                    turn = 2
                elif len(t) >= 4 and re.fullmatch(r"\d+", t[-1]):
                    seq = t[3] if t[0] == "C" and len(t) >= 5 else t[2]
                    hit[9 if turn == 0 else 14] += seq
                    turn = 1 if turn == 0 else 0
        if hit:
            yield done(hit)

    return read(spark, path, PAIRWISE, parse)


def blast(spark: SparkSession, path) -> DataFrame:
    """Tabular hits of twelve columns; comments and shorter lines are passed over, a bad number is an error."""
    t = F.split("value", "\t")
    lines = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").where(F.size(t) >= 12)
    fields = [f.split() for f in BLAST.split(", ")]
    cast = lambda c, kind: c if kind == "string" else F.trim(c).cast(kind)
    out = lines.select(*[cast(F.get(t, F.lit(i)), kind).alias(name) for i, (name, kind) in enumerate(fields)])
    bad = F.raise_error(F.lit("a hit has no number where one belongs"))
    for name, kind in fields:
        if kind != "string":
            out = out.withColumn(name, F.when(F.col(name).isNull(), bad.cast(kind)).otherwise(F.col(name)))
    return out.withColumn("orientation", F.when(F.col("sstrand") == "minus", "-").otherwise("+"))


def assembly_of(path: str) -> str:
    return re.sub(r"(?i)(\.(gz|2bit|fasta|fna|fa|fas|fsa))+$", "", os.path.basename(path))


def twobit_entries(content: bytes, only: str | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, str]]:
    """Name, length and bases (from start up to end) of the sequences of a 2bit file of either byte order and version, in upper case; masks are ignored.

    only: the rest is skipped, and of the one named no more is unpacked than asked for."""
    order = "<" if content[:4] == b"\x43\x27\x41\x1a" else ">"
    magic, version, count, _ = struct.unpack_from(order + "4I", content, 0)
    if magic != 0x1A412743 or version not in (0, 1):
        raise ValueError("no 2bit file")
    at, index = 16, []
    wide = "Q" if version else "I"
    for _ in range(count):
        size = content[at]
        name = content[at + 1 : at + 1 + size].decode()
        (offset,) = struct.unpack_from(order + wide, content, at + 1 + size)
        index.append((name, offset))
        at += 1 + size + struct.calcsize(wide)
    for name, at in index:
        if only is not None and name != only:
            continue
        size, blocks = struct.unpack_from(order + "2I", content, at)
        starts = struct.unpack_from(f"{order}{blocks}I", content, at + 8)
        lengths = struct.unpack_from(f"{order}{blocks}I", content, at + 8 + 4 * blocks)
        at += 8 + 8 * blocks
        (masks,) = struct.unpack_from(order + "I", content, at)
        at += 8 + 8 * masks
        stop = size if end is None else min(end, size)
        packed = content[at + start // 4 : at + (stop + 3) // 4]
        seq = bytearray(b"".join(FOUR[b] for b in packed)[start % 4 :][: max(0, stop - start)])
        for s, n in zip(starts, lengths):
            a, b = max(s, start), min(s + n, stop)
            if a < b:
                seq[a - start : b - start] = b"N" * (b - a)
        yield name, size, seq.decode()


FOUR = [bytes(b"TCAG"[(b >> s) & 3] for s in (6, 4, 2, 0)) for b in range(256)]


def twobit_bytes(entries: list[tuple[str, str]], order: str = "<") -> bytes:
    """A version 0 file of sequences of ACGT and N."""
    head, bodies = struct.pack(order + "4I", 0x1A412743, 0, len(entries), 0), []
    at = 16 + sum(5 + len(n) for n, _ in entries)
    index = b""
    for name, seq in entries:
        runs = [(m.start(), len(m[0])) for m in re.finditer("N+", seq)]
        codes = [("TCAG".find(c) if c != "N" else 0) for c in seq] + [0] * (-len(seq) % 4)
        packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))
        body = struct.pack(f"{order}2I{2 * len(runs)}I2I", len(seq), len(runs), *[r[0] for r in runs], *[r[1] for r in runs], 0, 0) + packed
        index += bytes([len(name)]) + name.encode() + struct.pack(order + "I", at)
        at += len(body)
        bodies.append(body)
    return head + index + b"".join(bodies)


def genome(spark: SparkSession, path) -> DataFrame:
    """assembly (from the file's name), chrom, length and upper-case seq of FASTA or 2bit files."""

    def parse(file, content):
        for name, size, seq in genome_entries(content):
            yield (assembly_of(file), name, size, seq)

    return read(spark, path, GENOME, parse)


def genome_entries(content: bytes, only: str | None = None, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, str]]:
    """Name, length and bases of the sequences of a genome file, or of a part of one of them."""
    if content[:4] in (b"\x43\x27\x41\x1a", b"\x1a\x41\x27\x43"):
        yield from twobit_entries(content, only, start, end)
        return
    for head, seq in fasta_entries(text_lines(content)):
        name = (head.split() or [""])[0]
        if only is None or name == only:
            yield name, len(seq), seq[start:end].upper()


def genome_range(spark: SparkSession, path, chrom: str, start: int, end: int) -> DataFrame:
    """chrom and the sequence from start up to end, counted from 0; an error beyond the end. Other sequences are skipped, and so is the rest of a 2bit one."""

    def parse(file, content):
        for name, size, seq in genome_entries(content, chrom, start, end):
            if size < end:
                raise ValueError(f"{chrom} ends before {end}")
            yield name, seq

    return read(spark, path, "chrom string, seq string", parse)


#: Bytes that kinds of files are told from.
HEAD = 1 << 16


def unpacked_head(content: bytes) -> bytes:
    """The first bytes of a file, unpacked if it is gzip, of which the beginning is enough."""
    return zlib.decompressobj(31).decompress(content, HEAD) if content[:2] == b"\x1f\x8b" else content[:HEAD]


def head_lines(content: bytes) -> list[str]:
    """The first lines of a file; a letter that is cut at the end goes."""
    return text_lines(unpacked_head(content).decode("utf-8", "ignore").encode())


def sniff(content: bytes) -> str:
    """Kind of an alignment file from its first two hundred lines: stockholm, clustal, fasta, ig_family, ig_msa, pairwise or unknown."""
    for line in head_lines(content)[:200]:
        t = line.strip()
        if t.startswith("# STOCKHOLM"):
            return "stockholm"
        if t.upper().startswith("CLUSTAL"):
            return "clustal"
        if t.startswith(">"):
            return "fasta"
        if t.startswith(";"):
            return "ig_family" if re.match(r";[A-Z]{2}(\s|$)", t) else "ig_msa"
        if t[:1].isdigit():
            return "pairwise"
    return "unknown"


def sniff_coordinates(content: bytes) -> tuple[str, bool]:
    """Kind of a file of coordinate records (fasta, stockholm, tsv, csv, 2bit or unknown), and whether it is compressed."""
    packed = content[:2] == b"\x1f\x8b"
    if unpacked_head(content)[:4] in (b"\x43\x27\x41\x1a", b"\x1a\x41\x27\x43"):
        return "2bit", packed
    for line in head_lines(content)[:15]:
        for sign, kind in ((line.startswith(">"), "fasta"), (line.startswith("# STOCKHOLM 1.0"), "stockholm"), ("\t" in line, "tsv"), ("," in line, "csv")):
            if sign:
                return kind, packed
    return "unknown", packed


def coordinates(spark: SparkSession, path, columns: int = 2, header: bool = False) -> DataFrame:
    """COORDINATES rows of FASTA, Stockholm or delimited files.

    Delimited files have an identifier and a sequence (columns=2), or assembly, sequence, start, end, strand and bases (columns=6)."""

    def row(file, meta, order, name, seq, aligned, text, fields=None):
        asm, sid, a, b, o, v = fields or ids.parse(name)
        return (file, meta, order, name, asm, sid, a, b, o, v, seq, aligned, text, None)

    def parse(file, content):
        kind, _ = sniff_coordinates(content)
        lines = text_lines(content)
        if kind == "fasta":
            for i, (head, seq) in enumerate(fasta_entries(lines)):
                name = (head.split() or [""])[0]
                yield row(file, i, i, name, re.sub("[.-]", "", seq), None, head[head.find(name) + len(name) :])
        elif kind == "stockholm":
            order, meta, notes, rows = 0, 0, [], []
            for n, line in enumerate(lines, 1):
                t = line.strip()
                if t == "//":
                    if not rows:
                        raise ValueError(f"{file}:{n}: a record without rows")
                    for name, aligned in rows:
                        yield row(file, meta, order, name, re.sub("[.-]", "", aligned), aligned, "\n".join(notes))
                        order += 1
                    meta, notes, rows = meta + 1, [], []
                elif t.startswith("#"):
                    notes.append(line.rstrip())
                elif t:
                    if len(t.split()) != 2:
                        raise ValueError(f"{file}:{n}: a row of {len(t.split())} fields")
                    rows.append(tuple(t.split()))
            if rows or notes:
                raise ValueError(f"{file}: the last record doesn't end")
        elif kind in ("tsv", "csv"):
            for i, line in enumerate(lines[header:]):
                t = line.split("\t" if kind == "tsv" else ",")
                if columns == 2 and len(t) >= 2 and kind == "tsv":
                    yield row(file, i, i, t[0], re.sub("[.-]", "", t[1]), None, "")
                elif columns == 6 and len(t) >= 6:
                    asm, sid, a, b, o, seq = (x or None for x in t[:6])
                    yield row(file, i, i, line, seq, None, "", (asm, sid, int(a) if a else None, int(b) if b else None, o, "V2"))

    return read(spark, path, COORDINATES, parse)


def kinds(spark: SparkSession, path) -> dict[str, str]:
    """The kind of each file of a path, glob or list."""
    heads = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD).alias("head"))
    return {r["path"]: sniff(bytes(r["head"])) for r in heads.toLocalIterator()}


def pairwise_msa(spark: SparkSession, path) -> DataFrame:
    """MSA rows of search files: the hits of each subject of a file, merged by the subject."""
    from strandloom.operators import pairwise as merging

    hits = pairwise(spark, path).withColumn("subj_name", F.concat("file", F.lit("#"), "subj_name"))
    rows = merging.merge(merging.sides(hits))
    file = F.regexp_extract("ref", "^(.*)#", 1)
    own = F.when(F.col("row_idx") == 0, F.regexp_extract("ref", "([^#]*)$", 1)).otherwise(F.col("name"))
    return rows.select(file.alias("file"), F.col("ref").alias("msa_id"), "row_idx", (F.col("row_idx") == 0).alias("is_reference"), own.alias("name"), "seq", F.col("start").alias("seq_start"), F.col("end").alias("seq_end"), "orient")


def msa(spark: SparkSession, path) -> DataFrame:
    """MSA rows of files of any alignment format, each read as what it is; family records are no alignments and raise ValueError."""
    by_kind: dict[str, list[str]] = {}
    for file, kind in kinds(spark, path).items():
        by_kind.setdefault(kind, []).append(file)
    readers = {"stockholm": stockholm_msa, "clustal": clustal_msa, "fasta": fasta_msa, "ig_msa": ig_msa, "pairwise": pairwise_msa}
    if not by_kind or (odd := sorted(by_kind.keys() - readers.keys())):
        raise ValueError(f"{path}: {'no' if not by_kind else ', '.join(odd)} files hold no alignment")
    out = None
    for kind, own in sorted(by_kind.items()):
        rows = readers[kind](spark, own)
        out = rows if out is None else out.unionByName(rows)
    return out


def first_sequence(spark: SparkSession, path: str) -> DataFrame:
    """name and seq, in upper case, of the first entry of a FASTA file."""

    def parse(file, content):
        for head, seq in fasta_entries(text_lines(content)):
            yield (head.split() or [""])[0], seq.upper()
            break

    return read(spark, path, "name string, seq string", parse).limit(1)


def reference_files(spark: SparkSession, folder: str) -> DataFrame:
    """assembly and path of the genomes of a folder: NAME.2bit, else NAME.fa."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    by = {f.rpartition("/")[2].removesuffix(end): f for end in (".fa", ".2bit") for f in found if f.endswith(end)}
    return spark.createDataFrame(sorted(by.items()), "assembly string, path string")


def lookup_lines(spark: SparkSession, path) -> DataFrame:
    """line_no and value of a table's lines that are neither blank nor comments."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return rows.withColumn("value", F.regexp_replace("value", r"\s+$", "")).where("value not like '#%' and value <> ''")


def lookup_tables(spark: SparkSession, classification=None, taxonomy=None, common=None, names=None) -> dict[str, DataFrame]:
    """The reference tables that paths are given for: classification(name), taxonomy(name), common(alt, scientific), names(name_lower)."""
    out = {}
    tabbed = lambda i: F.get(F.split("value", "\t"), F.lit(i))
    if classification:
        out["classification"] = lookup_lines(spark, classification).select(F.explode(F.array(tabbed(0), tabbed(1))).alias("name")).where("name is not null").distinct()
    if taxonomy:
        out["taxonomy"] = lookup_lines(spark, taxonomy).select(F.col("value").alias("name")).distinct()
    if common:
        pairs = lookup_lines(spark, common).select("line_no", F.lower(tabbed(0)).alias("alt"), tabbed(1).alias("scientific")).where("scientific is not null")
        out["common"] = pairs.groupBy("alt").agg(F.max_by("scientific", "line_no").alias("scientific"))
    if names:
        out["names"] = lookup_lines(spark, names).select(F.lower("value").alias("name_lower")).distinct()
    return out


def taxonomy_dump(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """taxonomy(name) and common(alt, scientific) of a names table: lines(line_no, value), fields between bars."""
    t = F.split("value", r"\t\|\t?")
    rows = lines.select("line_no", F.get(t, F.lit(0)).alias("id"), F.get(t, F.lit(1)).alias("name"), F.get(t, F.lit(3)).alias("class"))
    science = rows.where(F.col("class") == "scientific name").groupBy("id").agg(F.max_by("name", "line_no").alias("scientific"))
    # The classes of names that lead to the scientific one
    other = rows.where(F.col("class").isin("common name", "genbank common name", "blast name", "equivalent name"))
    alt = other.join(science, "id").select(F.lower("name").alias("alt"), "scientific", "line_no").groupBy("alt").agg(F.max_by("scientific", "line_no").alias("scientific"))
    return science.select(F.col("scientific").alias("name")).distinct(), alt
