"""Alignments, genomes, records and windows derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import text as X
from strandloom.functions.tables import settled
from strandloom.operators import sites
from strandloom.operators.msa import raw

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
ALIGNED = "ACGT-ACGTACGTRACGTYACGT-AC"
BASES = "ACGTTACGTACGTAACGTCACGTGAC"
WIDTH = 40
PIECE = 24
#: Bases from one record to the next; kinds of records, and how far off the wrong ones are.
STEP = 400
KINDS = 14
SHIFTED = {1: -1, 2: -1, 3: 2, 6: 10, 10: -2, 11: -3, 12: 1, 13: 3}
REACH, INSTANCE = 10, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spelled(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in lower case: what the table makes of their letters (0: left out), one text after the other, and where each begins and the last ends."""
    data, offsets = raw(column)
    codes = table[data[offsets[0] : offsets[-1]]]
    kept = codes != 0
    ends = np.concatenate([[0], np.cumsum([np.count_nonzero(kept[a:b]) for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])])]).astype(np.int64)
    return codes[kept], ends


def spelling(values: str) -> np.ndarray:
    """For each byte, the value of that letter of ALPHABET; 0 of other bytes."""
    table = np.zeros(256, np.uint8)
    table[[ord(c) for c in ALPHABET]] = [ord(c) for c in values]
    return table


def rows_of(batch, table: np.ndarray):
    """Of a batch with a `text` in lower case: its rows of WIDTH letters as a matrix, and the number of rows of each text; a null has one row."""
    letters, ends = spelled(batch.column(batch.schema.get_field_index("text")), table)
    n = np.maximum(-(-np.diff(ends) // WIDTH), 1)
    out, first = np.full((int(n.sum()), WIDTH), 45, np.uint8), np.cumsum(n) - n
    flat = out.reshape(-1)
    for at, x, y in zip((first * WIDTH).tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        flat[at : at + y - x] = letters[x:y]
    return out, n


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of WIDTH columns, source/0, source/1 and so on: each document has a row for every WIDTH letters of its text, so none is left out.

    The last row of a text is filled with dashes; a text without letters has one row. The least doc_id of an alignment is its reference.
    Rows are cut in Arrow batches and leave them by alignment. References are found from the number of rows of each text: a document is
    one from the block on where those before it in order have ended."""
    table_ = spelling(ALIGNED)
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.lower("text").alias("text")).where("source is not null")

    def heights(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = raw(batch.column(2))
            kept = table_[data] != 0
            n = [max(-(-np.count_nonzero(kept[a:b]) // WIDTH), 1) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["source", "doc_id", "n"])

    id_type = d.schema["doc_id"].dataType.simpleString()
    levels = d.mapInArrow(heights, f"source string, doc_id {id_type}, n int").where("doc_id is not null").groupBy("source", "n").agg(F.min("doc_id").alias("least"))
    down = Window.partitionBy("source").orderBy(F.desc("n"))
    levels = levels.select(F.col("source").alias("of"), F.min("least").over(down).alias("first"), F.coalesce(F.lead("n").over(down), F.lit(0)).alias("below"))
    firsts = settled(levels.groupBy("of", "first").agg(F.min("below").alias("since")))
    d = d.join(firsts, (F.col("source") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left").select("source", "doc_id", "since", "text")

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                seqs, n = rows_of(batch, table_)
                doc = np.repeat(np.arange(len(n)), n)
                block = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                source = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((block, source[doc]))
                doc, block, seqs = doc[order], block[order], seqs[order]
                of, null = pa.array(doc), batch.column(3).is_null().to_numpy(zero_copy_only=False)[doc]
                since = batch.column(2).fill_null(2**31 - 1).to_numpy(zero_copy_only=False)[doc]
                ids = batch.column(1).take(of)
                names = pc.binary_join_element_wise(batch.column(0).take(of), pa.array(block).cast(pa.string()), "/")
                seq = pa.StringArray.from_buffers(len(doc), pa.py_buffer(np.arange(len(doc) + 1, dtype=np.int32) * WIDTH), pa.py_buffer(np.ascontiguousarray(seqs)))
                if null.any():
                    seq = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), seq)
                first = pa.array(block >= since, mask=ids.is_null().to_numpy(zero_copy_only=False))
                made = pa.RecordBatch.from_arrays([names, ids, first, seq], ["msa_id", "row_idx", "is_reference", "seq"])
                for k in range(0, made.num_rows, 1 << 16):
                    yield made.slice(k, 1 << 16)

    return d.mapInArrow(cut, f"msa_id string, row_idx {id_type}, is_reference boolean, seq string")


ALN = f"""
aln AS (
  SELECT source || '/' || block AS msa_id, doc_id AS row_idx, doc_id = min(doc_id) OVER (PARTITION BY source, block) AS is_reference,
         rpad(substr(whole, block * {WIDTH} + 1, {WIDTH}), {WIDTH}, '-') AS seq
  FROM (
    SELECT source, doc_id, whole, unnest(range(0, greatest(1, (length(whole) + {WIDTH - 1}) // {WIDTH}))) AS block
    FROM (SELECT source, doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ALPHABET}', '{ALIGNED}') AS whole FROM documents))),
flat AS (
  SELECT msa_id, row_idx, is_reference,
         CASE WHEN regexp_matches(seq, '[A-Z]') THEN
           translate(regexp_extract(seq, '^([^A-Z]*)', 1), '-', ' ')
           || substr(seq, length(regexp_extract(seq, '^([^A-Z]*)', 1)) + 1, {WIDTH} - length(regexp_extract(seq, '^([^A-Z]*)', 1)) - length(regexp_extract(seq, '([^A-Z]*)$', 1)))
           || translate(regexp_extract(seq, '([^A-Z]*)$', 1), '-', ' ')
         ELSE repeat(' ', {WIDTH}) END AS seq
  FROM aln),
cols AS (SELECT msa_id, CAST(i AS INTEGER) AS col FROM (SELECT DISTINCT msa_id FROM aln), range(0, {WIDTH}) t(i)),
res AS (SELECT msa_id, row_idx, is_reference, CAST(i AS INTEGER) AS col, substr(seq, CAST(i + 1 AS BIGINT), 1) AS base FROM aln, range(0, {WIDTH}) t(i)),
fres AS (SELECT msa_id, row_idx, is_reference, CAST(i AS INTEGER) AS col, substr(seq, CAST(i + 1 AS BIGINT), 1) AS base FROM flat, range(0, {WIDTH}) t(i))"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chromosome for each document. Letters become bases in Arrow batches."""
    bases = spelling(BASES)

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                text = batch.column(1)
                seqs, ends = spelled(text, bases)
                null = text.is_null().to_numpy(zero_copy_only=False)
                valid = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
                seq = pa.Array.from_buffers(pa.string(), len(text), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(seqs)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64(), mask=null), seq], ["chrom", "length", "seq"])

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chrom"), F.lower("text").alias("text"))
    return d.mapInArrow(cut, "chrom string, length long, seq string").select(F.lit("g").alias("assembly"), "chrom", "length", "seq")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of coordinates, one for every STEP bases of each chromosome of 60 bases or more, right or wrong by document and place.

    The kinds take turns: right, half-open, one to three bases off to either side, on the other strand, out of reach, with an unknown base,
    without coordinates, and of a chromosome that isn't there. Pieces are cut in Arrow batches."""
    bases = spelling(BASES)

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                seqs, ends = spelled(batch.column(2), bases)
                size = np.diff(ends)
                n = np.where(size >= 60, (size - 60) // STEP + 1, 0)
                doc = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = batch.column(1)
                lost = first.is_null().to_numpy(zero_copy_only=False)[doc]
                # As substring() does, a place before the first counts from the end
                at = nth * STEP + first.fill_null(1).to_numpy(zero_copy_only=False)[doc]
                x = np.where(at > 0, at - 1, np.where(at < 0, size[doc] + at, 0))
                width = np.where(lost, 0, np.minimum(PIECE, size[doc] - x))
                to = np.concatenate([[0], np.cumsum(width)])
                piece = seqs[np.arange(to[-1]) + np.repeat(ends[:-1][doc] + x - to[:-1], width)]
                valid = pa.py_buffer(np.packbits(~lost, bitorder="little")) if lost.any() else None
                pieces = pa.Array.from_buffers(pa.string(), len(doc), [valid, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(piece)])
                made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(nth, pa.int32()), pieces], ["doc_id", "nth", "piece"])
                for m in range(0, made.num_rows, 1 << 16):
                    yield made.slice(m, 1 << 16)

    offset = (F.lit(10) + F.col("doc_id") % 17).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", offset.alias("first"), F.lower("text").alias("text"))
    d = d.mapInArrow(cut, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, nth int, piece string")
    kind = (F.col("doc_id") + F.col("nth")) % KINDS
    at = (F.col("nth") * STEP + offset).cast("int")
    piece = F.col("piece")
    shift = F.lit(0)
    for of, by in SHIFTED.items():
        shift = F.when(kind == of, by).otherwise(shift)
    seq = F.when(kind.isin(4, 5), X.reverse_complement(piece)).when(kind == 7, F.concat(F.substring(piece, 1, PIECE - 1), F.lit("N"))).otherwise(piece)
    known = kind != 8
    chrom = F.concat(F.lit("c"), "doc_id")
    return d.select(
        chrom.alias("file"), F.lit(0).alias("metadata_idx"), F.col("nth").alias("rec_order"), F.concat(F.lit("r"), "doc_id", F.lit("/"), "nth").alias("original_id"), F.lit(None).cast("string").alias("assembly_id"),
        F.when(kind == 9, "none").otherwise(chrom).alias("sequence_id"), F.when(known, (at + shift).cast("long")).alias("start"),
        F.when(known, (at + shift + PIECE - 1 + F.when(kind == 1, 1).otherwise(0)).cast("long")).alias("end"), F.when(known, F.when(kind == 5, "-").otherwise("+")).alias("orient"),
        F.lit("V2").alias("inferred_version"), seq.alias("sequence"), F.lit(None).cast("string").alias("aligned_seq"), F.lit("").alias("metadata"), F.lit(None).cast("string").alias("validated"),
    )


SHIFT_SQL = "CASE kind " + " ".join(f"WHEN {of} THEN {by}" for of, by in SHIFTED.items()) + " ELSE 0 END"
GEN = f"""
gen AS (SELECT doc_id, 'c' || doc_id AS chrom, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}') AS g FROM documents),
nth AS (SELECT doc_id, g, unnest(range(0, (length(g) - 60) // {STEP} + 1)) AS nth FROM gen WHERE length(g) >= 60),
cut AS (SELECT doc_id, nth, (doc_id + nth) % {KINDS} AS kind, nth * {STEP} + 10 + doc_id % 17 AS place, substr(g, nth * {STEP} + 10 + doc_id % 17, {PIECE}) AS piece FROM nth),
rec AS (
  SELECT 'c' || doc_id AS file, CAST(nth AS INTEGER) AS rec_order, CASE WHEN kind = 9 THEN 'none' ELSE 'c' || doc_id END AS sequence_id,
         CASE WHEN kind <> 8 THEN place + {SHIFT_SQL} END AS s,
         CASE WHEN kind <> 8 THEN place + {SHIFT_SQL} + {PIECE - 1} + CASE kind WHEN 1 THEN 1 ELSE 0 END END AS e,
         CASE WHEN kind = 8 THEN NULL WHEN kind = 5 THEN '-' ELSE '+' END AS o,
         CASE WHEN kind IN (4, 5) THEN translate(reverse(piece), 'ACGT', 'TGCA') WHEN kind = 7 THEN substr(piece, 1, {PIECE - 1}) || 'N' ELSE piece END AS q
  FROM cut),
tried AS (
  SELECT rec.*, gen.g, CASE WHEN e - s = length(q) THEN s + 1 ELSE s END AS b, coalesce(e - s = length(q), FALSE) AS half, translate(reverse(q), 'ACGT', 'TGCA') AS rq
  FROM rec LEFT JOIN gen ON rec.sequence_id = gen.chrom),
hit AS (
  SELECT file, rec_order, min(struct_pack(nth := CASE d WHEN 0 THEN 0 WHEN -3 THEN 1 WHEN -2 THEN 2 WHEN -1 THEN 3 ELSE 3 + d END, d := d, plus := substr(g, CAST(b + d AS BIGINT), length(q)) = q, minus := substr(g, CAST(b + d AS BIGINT), length(q)) = rq)) AS h
  FROM tried, range(-3, 4) t(d)
  WHERE g IS NOT NULL AND b + d >= 1 AND e + d <= length(g) AND e - b + 1 = length(q)
    AND (substr(g, CAST(b + d AS BIGINT), length(q)) = q OR substr(g, CAST(b + d AS BIGINT), length(q)) = rq)
  GROUP BY file, rec_order),
lab AS (
  SELECT t.file, t.rec_order, t.sequence_id, t.q, t.rq, h.h IS NOT NULL AS located,
         CASE WHEN h.h IS NULL THEN CASE WHEN t.g IS NULL THEN t.s ELSE t.b END ELSE t.b + h.h.d END AS start,
         CASE WHEN h.h IS NULL THEN t.e ELSE t.e + h.h.d END AS end_,
         CASE WHEN h.h IS NULL THEN t.o WHEN h.h.d = 0 AND ((h.h.plus AND h.h.minus) OR (CASE WHEN h.h.plus THEN '+' ELSE '-' END) = t.o) THEN t.o WHEN h.h.plus THEN '+' ELSE '-' END AS orient,
         t.o, t.half, h.h.d AS d
  FROM tried t LEFT JOIN hit h ON t.file = h.file AND t.rec_order = h.rec_order),
val AS (
  SELECT file, rec_order, sequence_id, q, rq, start, end_ AS "end", orient,
         CASE WHEN located THEN
           CASE WHEN NOT half AND orient = o AND d = 0 THEN 'valid'
           ELSE 'fixed' || CASE WHEN half THEN '_halfopen' ELSE '' END || CASE WHEN orient = o THEN '' ELSE '_orient' END
             || CASE WHEN d < 0 THEN '_minus' || -d WHEN d > 0 THEN '_plus' || d ELSE '' END END END AS validated
  FROM lab),
pat AS (SELECT q AS pattern, '+' AS strand, q AS word FROM val WHERE validated IS NULL UNION SELECT q, '-', rq FROM val WHERE validated IS NULL),
occ AS (
  SELECT pattern, chrom, CAST(i - 1 AS BIGINT) AS pos, strand
  FROM (SELECT chrom, i, substr(g, i, {PIECE}) AS piece FROM (SELECT chrom, g, unnest(range(1, length(g) - {PIECE - 2})) AS i FROM gen)) s JOIN pat ON s.piece = pat.word
)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of 2 * REACH bases at the ends of every instance, with the reason why an instance has none.

    Instances of INSTANCE bases lie every 2 * REACH bases of a chromosome, the first so that its left window begins the chromosome, and one
    more so that its right window ends it: in chromosomes of 50 bases or more windows cover every base. An instance has its own stretch of the chromosome beside it, so
    that the work is in proportion to the bases and nothing is joined. A chromosome shorter than a stretch has one instance, at its edge, without windows."""
    size = INSTANCE + 2 * REACH
    bases = spelling(BASES)
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), "doc_id").alias("chrom"), F.lower("text").alias("text")).where("text is not null")

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                data, offsets = raw(batch.column(1))
                doc, at, seqs, sizes = [], [], [], []
                for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    g = bases[data[x:y]]
                    g = g[g != 0]
                    last = max(len(g) - size, 0)
                    starts = np.arange(0, last + 1, 2 * REACH)
                    starts = starts if starts[-1] == last else np.append(starts, last)
                    doc.append(np.full(len(starts), i))
                    at.append(starts)
                    seqs.append(g if len(g) < size else np.lib.stride_tricks.sliding_window_view(g, size)[starts].ravel())
                    sizes.append(np.full(len(starts), min(len(g), size)))
                if not doc:
                    continue
                at, ends = np.concatenate(at), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                seq = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.concatenate(seqs)))
                name = pc.binary_join_element_wise(batch.column(0).take(pa.array(np.concatenate(doc))), pa.array(at).cast(pa.string()), "+")
                made = pa.RecordBatch.from_arrays([name, seq], ["name", "g_seq"])
                for n in range(0, made.num_rows, 1 << 16):
                    yield made.slice(n, 1 << 16)

    pieces = d.mapInArrow(cut, "name string, g_seq string")
    own = F.rpad(F.substring("g_seq", REACH + 1, INSTANCE), INSTANCE, "A")
    rows = pieces.select(F.lit(0).alias("row_idx"), "name", own.alias("seq"), F.lit(REACH + 1).cast("long").alias("seq_start"), F.lit(REACH + INSTANCE).cast("long").alias("seq_end"), F.lit("+").alias("orient"), "g_seq", F.length("g_seq").cast("long").alias("length"))
    return sites.flanked(rows, INSTANCE, reach=REACH)
