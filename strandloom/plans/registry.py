"""The alignment engine's registered queries and their SQL.

Each query applies an operator to the whole of a table of the driver's; plans.derive makes alignments, genomes and records of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alphabet, ids
from strandloom.functions import text as X
from strandloom.functions.tables import settled, shared_dir
from strandloom.operators import coords, families, lint, msa, pairwise, records, sites
from strandloom.plans import derive
from strandloom.plans.derive import ALN, GEN
from strandloom.sources import files, writers

MATRIX = "m(cand, idx, obs, score) AS (VALUES " + ", ".join(f"('{c}', {i}, '{o}', {s})" for c, i, o, s in alphabet.score_rows()) + ")"
SITE_MATRIX = "m(cand, idx, obs, score) AS (VALUES " + ", ".join(f"('{c}', {i}, '{o}', {s})" for c, i, o, s in alphabet.score_rows(sites.LETTERS, alphabet.site_score)) + ")"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for the same rows."""

    def register(make):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


FIRST_PASS = f"""
prof AS (SELECT msa_id, col, base, count(*) AS n FROM fres WHERE NOT is_reference AND base <> ' ' AND contains('{alphabet.LETTERS}', base) GROUP BY ALL),
tot AS (SELECT msa_id, col, cand, idx, sum(n * score) AS total FROM prof JOIN m ON base = obs GROUP BY ALL),
top AS (SELECT msa_id, col, cand, row_number() OVER (PARTITION BY msa_id, col ORDER BY total DESC, cand = 'N' DESC, idx) AS r FROM tot),
fp AS (SELECT cols.msa_id, cols.col, coalesce(cand, 'N') AS letter FROM cols LEFT JOIN top ON top.msa_id = cols.msa_id AND top.col = cols.col AND r = 1)"""
#: Pairs of neighbouring letters decide in order, each after the one before it.
FULL = """
kept AS (SELECT msa_id, col, letter, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS j, lead(letter) OVER (PARTITION BY msa_id ORDER BY col) AS right_, lead(col) OVER (PARTITION BY msa_id ORDER BY col) AS next_ FROM fp WHERE letter <> '-'),
duo AS (
  SELECT k.msa_id, k.j, k.letter, k.right_, a.base AS hl, b.base AS hr, count(*) AS n
  FROM kept k JOIN fres a ON a.msa_id = k.msa_id AND a.col = k.col AND NOT a.is_reference AND a.base <> ' '
  JOIN fres b ON b.msa_id = k.msa_id AND b.row_idx = a.row_idx AND b.col = k.next_ AND b.base <> ' '
  GROUP BY ALL),
sums AS (
  SELECT duo.msa_id, duo.j, sum(n * (ll.score + rr.score)) AS dn, sum(n * (gl.score + rr.score)) AS dg,
         sum(n * CASE WHEN hl || hr IN ('CA', 'TG') THEN 12 WHEN hl || hr = 'TA' THEN -5 WHEN hl || hr IN ('TC', 'TT') THEN 2 + gr.score
                      WHEN hl || hr IN ('AA', 'GA') THEN 2 + cl.score ELSE cl.score + gr.score END) AS cg
  FROM duo JOIN m ll ON ll.cand = letter AND ll.obs = hl JOIN m rr ON rr.cand = right_ AND rr.obs = hr JOIN m gl ON gl.cand = 'G' AND gl.obs = hl
  JOIN m cl ON cl.cand = 'C' AND cl.obs = hl JOIN m gr ON gr.cand = 'G' AND gr.obs = hr
  GROUP BY ALL),
step AS (SELECT kept.msa_id, kept.j, kept.col, kept.letter, coalesce(cg > dn, FALSE) AS f0, coalesce(cg > dg, FALSE) AS fg FROM kept LEFT JOIN sums ON sums.msa_id = kept.msa_id AND sums.j = kept.j),
walk(msa_id, j, fired, before) AS (
  SELECT msa_id, j, f0, FALSE FROM step WHERE j = 1
  UNION ALL
  SELECT s.msa_id, s.j, CASE WHEN w.fired THEN s.fg ELSE s.f0 END, w.fired FROM walk w JOIN step s ON s.msa_id = w.msa_id AND s.j = w.j + 1),
cons AS (
  SELECT fp.msa_id, fp.col, CASE WHEN w.fired THEN 'C' WHEN w.before THEN 'G' ELSE fp.letter END AS letter
  FROM fp LEFT JOIN step s ON s.msa_id = fp.msa_id AND s.col = fp.col LEFT JOIN walk w ON w.msa_id = s.msa_id AND w.j = s.j)"""


@query(f"WITH {ALN} SELECT msa_id, col, base, count(*) AS n FROM res WHERE NOT is_reference AND base <> ' ' AND contains('{alphabet.LETTERS}', base) GROUP BY ALL")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.profile(derive.alignments(spark, sf_dir))


@query(f"WITH {ALN} SELECT cols.msa_id, cols.col, count(base) AS coverage FROM cols LEFT JOIN res ON res.msa_id = cols.msa_id AND res.col = cols.col AND NOT is_reference AND base <> ' ' GROUP BY ALL")
def coverage(spark, sf_dir):
    return msa.coverage(derive.alignments(spark, sf_dir))


@query(f"WITH {ALN}, {MATRIX}, {FIRST_PASS} SELECT * FROM fp")
def consensus_first_pass(spark, sf_dir):
    return msa.best_letters(msa.clear_flanks(derive.alignments(spark, sf_dir)))


@query(f"""WITH RECURSIVE {ALN}, {MATRIX}, {FIRST_PASS}, {FULL}
SELECT regexp_extract(msa_id, '^(.*)/', 1) AS msa_id, string_agg(letter, '' ORDER BY CAST(regexp_extract(msa_id, '/([0-9]+)$', 1) AS INTEGER), col) AS consensus FROM cons GROUP BY 1""")
def consensus(spark, sf_dir):
    """The consensus of each source: those of its alignments, in order."""
    own = msa.consensus(derive.alignments(spark, sf_dir)).select(F.regexp_extract("msa_id", "^(.*)/", 1).alias("msa_id"), F.regexp_extract("msa_id", "/([0-9]+)$", 1).cast("int").alias("col"), F.col("consensus").alias("letter"))
    return msa.strung(own)


@query(f"""WITH {ALN}, {MATRIX},
prof AS (SELECT msa_id, col, base, count(*) AS n FROM res WHERE NOT is_reference GROUP BY ALL),
tot AS (SELECT msa_id, col, cand, sum(n * score) AS total FROM prof JOIN m ON base = obs GROUP BY ALL)
SELECT cols.msa_id, cols.col, CAST(coalesce(max(total), 0) AS BIGINT) AS score FROM cols LEFT JOIN tot ON tot.msa_id = cols.msa_id AND tot.col = cols.col GROUP BY ALL""")
def column_quality(spark, sf_dir):
    return msa.column_scores(derive.alignments(spark, sf_dir))


#: A segment from i is as long as it can be where its sum is never less than at i and its end is the first place of the greatest sum; those inside another go.
@query(f"""WITH {ALN}, {MATRIX},
prof AS (SELECT msa_id, col, base, count(*) AS n FROM res WHERE NOT is_reference GROUP BY ALL),
tot AS (SELECT msa_id, col, cand, sum(n * score) AS total FROM prof JOIN m ON base = obs GROUP BY ALL),
q AS (SELECT cols.msa_id, cols.col, CAST(coalesce(max(total), 0) AS BIGINT) AS score FROM cols LEFT JOIN tot ON tot.msa_id = cols.msa_id AND tot.col = cols.col GROUP BY ALL),
cum AS (SELECT msa_id, col, sum(-score) OVER (PARTITION BY msa_id ORDER BY col) AS s FROM q),
sums AS (SELECT msa_id, col, s FROM cum UNION ALL SELECT DISTINCT msa_id, -1, 0 FROM q),
lim AS (SELECT a.msa_id, a.col AS i, a.s, min(b.col) AS lim FROM sums a LEFT JOIN sums b ON a.msa_id = b.msa_id AND b.col > a.col AND b.s <= a.s GROUP BY ALL),
seg AS (SELECT l.msa_id, l.i, arg_max(b.col, struct_pack(s := b.s, first := -b.col)) AS j, max(b.s) - l.s AS score FROM lim l JOIN sums b ON b.msa_id = l.msa_id AND b.col > l.i AND (l.lim IS NULL OR b.col < l.lim) GROUP BY l.msa_id, l.i, l.s)
SELECT x.msa_id, CAST(x.i + 1 AS INTEGER) AS start, CAST(x.j AS INTEGER) AS "end", CAST(x.score AS BIGINT) AS score FROM seg x
WHERE NOT EXISTS (SELECT 1 FROM seg y WHERE y.msa_id = x.msa_id AND y.i <= x.i AND y.j >= x.j AND (y.i < x.i OR y.j > x.j))""")
def low_quality_blocks(spark, sf_dir):
    return msa.low_quality_blocks(derive.alignments(spark, sf_dir))


@query(f"""WITH {ALN} SELECT cols.msa_id, cols.col, CASE WHEN count(DISTINCT base) = 1 THEN '*' ELSE ' ' END AS mark
FROM cols LEFT JOIN res ON res.msa_id = cols.msa_id AND res.col = cols.col AND base NOT IN ('-', '.', ' ') GROUP BY ALL""")
def conservation(spark, sf_dir):
    return msa.conservation(derive.alignments(spark, sf_dir))


def reference_letters(rows):
    return msa.cells(rows.where("is_reference")).select("msa_id", "col", F.col("base").alias("letter"))


def kimura_sql(letters: str, x: str = "") -> str:
    """CTEs that end in k{x}: every instance's divergence from `letters`(msa_id, col, base)."""
    return f"""
pos{x} AS (
  SELECT r.msa_id, r.row_idx, r.col, r.base AS o, c.base AS c, lag(c.base) OVER w AS pc, lead(c.base) OVER w AS nc
  FROM res r JOIN ({letters}) c ON c.msa_id = r.msa_id AND c.col = r.col
  WHERE NOT r.is_reference AND c.base <> '-' AND r.base <> ' '
  WINDOW w AS (PARTITION BY r.msa_id, r.row_idx ORDER BY r.col)),
flag{x} AS (
  SELECT *, CAST(c || o IN ('AG', 'GA', 'CT', 'TC') AS INTEGER) AS ti,
         CAST(contains('ACGT', c) AND contains('ACGT', o) AND c <> o AND c || o NOT IN ('AG', 'GA', 'CT', 'TC') AS INTEGER) AS tv,
         CAST(contains('ACGT', c) AND contains('ACGT', o) AS INTEGER) AS well, coalesce(pc = 'C' AND c = 'G', FALSE) AS site, coalesce(c = 'C' AND nc = 'G', FALSE) AS next_site
  FROM pos{x}),
part{x} AS (
  SELECT *, CASE WHEN site THEN CASE lag(ti) OVER (PARTITION BY msa_id, row_idx ORDER BY col) + ti WHEN 2 THEN 10 WHEN 1 THEN 1 ELSE 0 END WHEN next_site THEN 0 ELSE 10 * ti END AS tenths
  FROM flag{x}),
agg{x} AS (SELECT msa_id, row_idx, CAST(sum(ti) AS BIGINT) AS ti, CAST(sum(tv) AS BIGINT) AS tv, CAST(sum(well) AS BIGINT) AS well, CAST(sum(tenths) AS BIGINT) AS tenths, CAST(sum(CAST(site AS INTEGER)) AS BIGINT) AS cpg_sites FROM part{x} GROUP BY ALL),
allr{x} AS (SELECT a.msa_id, a.row_idx, coalesce(ti, 0) AS ti, coalesce(tv, 0) AS tv, coalesce(well, 0) AS well, coalesce(tenths, 0) AS tenths, coalesce(cpg_sites, 0) AS cpg_sites FROM aln a LEFT JOIN agg{x} g ON g.msa_id = a.msa_id AND g.row_idx = a.row_idx WHERE NOT a.is_reference),
k{x} AS (
  SELECT *, tenths / 10.0::DOUBLE AS ti_adjusted,
         CASE WHEN well = 0 THEN 0 WHEN 1 - 2.0 * ti / well - 1.0 * tv / well <= 0 OR 1 - 2.0 * tv / well <= 0 THEN NULL
              ELSE greatest(100 * (-0.5 * ln(1 - 2.0::DOUBLE * ti / well - 1.0::DOUBLE * tv / well) - 0.25 * ln(1 - 2.0::DOUBLE * tv / well)), 0) END AS k1,
         CASE WHEN well = 0 THEN 0 WHEN 1 - 0.2 * tenths / well - 1.0 * tv / well <= 0 OR 1 - 2.0 * tv / well <= 0 THEN NULL
              ELSE greatest(100 * (-0.5 * ln(1 - 2.0::DOUBLE * (tenths / 10.0::DOUBLE) / well - 1.0::DOUBLE * tv / well) - 0.25 * ln(1 - 2.0::DOUBLE * tv / well)), 0) END AS k2
  FROM allr{x})"""


KIMURA = f"{ALN}, " + kimura_sql("SELECT * FROM res WHERE is_reference")
number = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 6)  # noqa: E731  null for NaN


@query(f"WITH {KIMURA} SELECT msa_id, row_idx, ti, tv, CAST(ti_adjusted AS DOUBLE) AS ti_adjusted, well, cpg_sites, round(CAST(k1 AS DOUBLE), 6) + 0.0::DOUBLE AS kimura, round(CAST(k2 AS DOUBLE), 6) + 0.0::DOUBLE AS kimura_adjusted FROM k")
def kimura_pairs(spark, sf_dir):
    rows = derive.alignments(spark, sf_dir)
    found = msa.divergence(rows, reference_letters(rows))
    return found.withColumn("kimura", number("kimura")).withColumn("kimura_adjusted", number("kimura_adjusted"))


@query(f"WITH {KIMURA} SELECT msa_id, round(CAST(sum(coalesce(k1, 0)) / count(*) AS DOUBLE), 6) AS kimura, round(CAST(sum(coalesce(k2, 0)) / count(*) AS DOUBLE), 6) AS kimura_adjusted FROM k GROUP BY msa_id")
def kimura_mean(spark, sf_dir):
    rows = derive.alignments(spark, sf_dir)
    found = msa.mean_divergence(msa.divergence(rows, reference_letters(rows)))
    return found.select("msa_id", F.round("kimura", 6).alias("kimura"), F.round("kimura_adjusted", 6).alias("kimura_adjusted"))


@query(f"""WITH RECURSIVE {KIMURA}, {MATRIX}, {FIRST_PASS}, {FULL}, {kimura_sql("SELECT msa_id, col, letter AS base FROM cons", "2")}
SELECT k.msa_id, k.row_idx, round(CAST(coalesce(k.k1, 100) AS DOUBLE), 6) + 0.0::DOUBLE AS from_reference, round(CAST(coalesce(k2.k1, 100) AS DOUBLE), 6) + 0.0::DOUBLE AS from_consensus, coalesce(k.k1, 100) >= 90 AS high
FROM k JOIN k2 ON k2.msa_id = k.msa_id AND k2.row_idx = k.row_idx""")
def statistics(spark, sf_dir):
    found = msa.statistics(derive.alignments(spark, sf_dir))
    return found.withColumn("from_reference", F.round("from_reference", 6)).withColumn("from_consensus", F.round("from_consensus", 6))


#: Means are cut where the mean of a few rounded values cannot fall, so that both sides cut alike: floor(1000 * x + CUT) / 1000.
CUT = 0.123456789


@query(ORACLE_SQL["statistics"].replace("SELECT k.msa_id, k.row_idx,", ", s AS (SELECT k.msa_id, k.row_idx,") + f""")
SELECT msa_id, floor(1000 * avg(from_reference) + {CUT}) / 1000 AS from_reference, floor(1000 * avg(from_consensus) + {CUT}) / 1000 AS from_consensus FROM s GROUP BY msa_id""")
def statistics_averages(spark, sf_dir):
    found = msa.averages(statistics(spark, sf_dir))
    return found.select("msa_id", *[(F.floor(1000 * F.col(c) + CUT) / 1000).alias(c) for c in ("from_reference", "from_consensus")])


@query(f"""WITH {ALN} SELECT msa_id, string_agg('>' || row_idx || '  ' || msa_id || chr(10) || replace(seq, '-', ''), chr(10) ORDER BY row_idx) AS text FROM aln WHERE NOT is_reference GROUP BY msa_id""")
def raw_sequences(spark, sf_dir):
    rows = derive.alignments(spark, sf_dir).withColumn("name", F.col("row_idx").cast("string"))
    return writers.raw_text(rows, rows.select("msa_id", F.col("msa_id").alias("origin")).distinct())


@query(f"WITH {ALN} SELECT msa_id, row_idx, translate(reverse(regexp_replace(upper(seq), '[^ACGTRYKMSWBDHVNX\\- ]', 'N', 'g')), 'ATGCRYKMBVDH', 'TACGYRMKVBHD') AS iupac, translate(reverse(seq), 'ACGT', 'TGCA') AS plain, translate(seq, '-_~', '...') AS dotted, replace(replace(seq, '-', ''), '.', '') AS bases FROM aln")
def sequence_functions(spark, sf_dir):
    rows, seq = derive.alignments(spark, sf_dir), F.col("seq")
    return rows.select("msa_id", "row_idx", X.reverse_complement_iupac(seq).alias("iupac"), X.reverse_complement(seq).alias("plain"), X.normalize_gaps(seq).alias("dotted"), X.ungapped(seq).alias("bases"))


@query(f"""WITH {ALN},
b AS (SELECT msa_id, col, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS nth, count(*) OVER (PARTITION BY msa_id) AS size FROM res WHERE is_reference AND base <> '-'),
r AS (SELECT msa_id, min(col) AS a, max(col) + 1 AS z FROM b WHERE nth > 3 AND nth <= size - 2 GROUP BY msa_id)
SELECT aln.msa_id, row_idx, is_reference, substr(seq, a + 1, z - a) AS seq FROM aln JOIN r ON r.msa_id = aln.msa_id""")
def trim(spark, sf_dir):
    return msa.trim(derive.alignments(spark, sf_dir), 3, 2)


@query(f"WITH {ALN} SELECT msa_id, row_idx, is_reference, substr(seq, 6, 15) AS seq FROM flat WHERE regexp_matches(substr(seq, 6, 15), '[^ ]')")
def slice_columns(spark, sf_dir):
    return msa.slice_columns(msa.clear_flanks(derive.alignments(spark, sf_dir)), F.lit(5), F.lit(20))


@query(f"WITH {ALN} SELECT msa_id, row_idx, is_reference, seq FROM aln WHERE is_reference OR length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) >= 34")
def min_length(spark, sf_dir):
    return msa.min_length(derive.alignments(spark, sf_dir), 34)


@query(f"""WITH RECURSIVE {ALN}, {MATRIX}, {FIRST_PASS}, {FULL},
b AS (SELECT msa_id, col, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS nth FROM cons WHERE letter <> '-'),
r AS (SELECT msa_id, min(col) AS a, max(col) + 1 AS z FROM b WHERE nth BETWEEN 4 AND 12 GROUP BY msa_id)
SELECT aln.msa_id, row_idx, is_reference, substr(seq, a + 1, z - a) AS seq FROM aln JOIN r ON r.msa_id = aln.msa_id""")
def sub_range(spark, sf_dir):
    return msa.sub_range(derive.alignments(spark, sf_dir), 4, 12)


@query(f"""WITH RECURSIVE {ALN}, {MATRIX}, {FIRST_PASS}, {FULL},
r AS (SELECT msa_id, min(col) AS a, max(col) + 1 AS z FROM cons WHERE letter IN ('A', 'C', 'G', 'T') GROUP BY msa_id)
SELECT aln.msa_id, row_idx, is_reference, substr(seq, a + 1, z - a) AS seq FROM aln JOIN r ON r.msa_id = aln.msa_id""")
def trim_ambiguous(spark, sf_dir):
    return msa.trim_ambiguous(derive.alignments(spark, sf_dir))


@query(f'WITH {GEN} SELECT file, rec_order, start, "end", orient, validated FROM val')
def coord_validate(spark, sf_dir):
    return coords.validate(derive.records(spark, sf_dir), derive.genome(spark, sf_dir)).select("file", "rec_order", "start", "end", "orient", "validated")


@query(f"""WITH {GEN}
SELECT CASE WHEN s IS NULL THEN 'r' || substr(file, 2) || '/' || rec_order ELSE sequence_id END AS sequence_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", o AS orient, q AS sequence FROM rec""")
def coordinate_scan(spark, sf_dir):
    """Records of coordinates written as FASTA and read again."""
    path = f"{shared_dir(spark)}/coordinates-{uuid.uuid4().hex}"
    texts = derive.records(spark, sf_dir).select("file", "rec_order", writers.coordinates_fasta().alias("text"))
    writers.save(texts, path, ["file", "rec_order"], files=8)
    return files.coordinates(spark, path).select("sequence_id", "start", "end", "orient", "sequence")


@query(r"""SELECT 'd' || doc_id AS id, replace(source, chr(10), ' ') AS de, lang AS cc, CAST(1 AS INTEGER) AS n_rows, 'A.C' || repeat('G', CAST(doc_id % 7 AS INTEGER)) AS seq FROM documents""")
def record_scan(spark, sf_dir):
    """Records of documents written as Stockholm, packed, and read again."""
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    key = F.col("doc_id")
    pair = lambda t, v: F.struct(F.lit(t).alias("tag"), v.alias("value"))
    seq = F.concat(F.lit("A.C"), F.repeat(F.lit("G"), (key % 7).cast("int")))
    made = derive.table(spark, sf_dir, "documents").select(
        key, F.array(pair("ID", F.concat(F.lit("d"), key)), pair("DE", F.col("source")), pair("CC", F.col("lang"))).alias("gf"), F.create_map(F.lit("RF"), F.translate(seq, "ACG", "xxx")).alias("gc"),
        F.array(F.struct(F.concat(F.lit("chr"), key, F.lit(":5-9_+")).alias("original_id"), seq.alias("aligned_seq"))).alias("sequences"),
    )
    writers.save(made.select("doc_id", writers.stockholm_text().alias("text")), path, ["doc_id"], compressed=True, files=8)
    back = files.stockholm(spark, path)
    return back.select(records.first_of("ID").alias("id"), records.first_of("DE").alias("de"), records.first_of("CC").alias("cc"), F.size("sequences").alias("n_rows"), F.get("sequences", F.lit(0))["aligned_seq"].alias("seq"))


@query(f"WITH {GEN} SELECT pattern, chrom, pos, strand FROM occ")
def remap_hits(spark, sf_dir):
    g = derive.genome(spark, sf_dir)
    open_ = coords.validate(derive.records(spark, sf_dir), g).where("validated is null")
    return coords.occurrences(open_.select(F.col("sequence").alias("pattern")), g)


RANKED = f"""{GEN},
h AS (
  SELECT file, rec_order, chrom, pos, strand, start, q, CAST(coalesce(chrom = sequence_id, FALSE) AS INTEGER) AS own, max(CAST(coalesce(chrom = sequence_id, FALSE) AS INTEGER)) OVER (PARTITION BY file, rec_order) AS any_own
  FROM val JOIN occ ON occ.pattern = val.q WHERE validated IS NULL),
ranked AS (
  SELECT file, rec_order, chrom AS hit_chrom, pos + 1 AS hit_start, pos + length(q) AS hit_end, strand AS hit_strand,
         CAST(row_number() OVER (PARTITION BY file, rec_order ORDER BY coalesce(abs(pos - start), 4611686018427387904), chrom, strand, pos) AS INTEGER) AS place, count(*) OVER (PARTITION BY file, rec_order) AS hits
  FROM h WHERE own = any_own)"""


@query(f"WITH {RANKED} SELECT * FROM ranked")
def remap_ranked(spark, sf_dir):
    g = derive.genome(spark, sf_dir)
    return coords.ranked_hits(coords.validate(derive.records(spark, sf_dir), g), g)


#: The records of a sequence or its reverse complement choose in turn, each the first place that none before it has.
@query(f"""WITH RECURSIVE {RANKED},
places AS (SELECT file, rec_order, list(struct_pack(c := hit_chrom, a := hit_start, z := hit_end, o := hit_strand) ORDER BY place) AS places FROM ranked GROUP BY ALL),
turn AS (
  SELECT val.file, val.rec_order, least(val.q, val.rq) AS key, places, row_number() OVER (PARTITION BY least(val.q, val.rq) ORDER BY val.file, val.rec_order) AS nth
  FROM val JOIN places ON places.file = val.file AND places.rec_order = val.rec_order),
held AS (SELECT least(q, rq) AS key, list(struct_pack(c := sequence_id, a := start, z := "end", o := orient)) AS held FROM val WHERE validated IS NOT NULL AND start IS NOT NULL GROUP BY ALL),
first AS (SELECT turn.*, coalesce(held, []) AS held FROM turn LEFT JOIN held ON held.key = turn.key WHERE nth = 1),
walk(file, rec_order, key, nth, n, taken) AS (
  SELECT file, rec_order, key, nth, len(places), list_append(held, coalesce(list_filter(places, lambda p: NOT list_contains(held, p))[1], places[1])) FROM first
  UNION ALL
  SELECT t.file, t.rec_order, t.key, t.nth, len(places), list_append(taken, coalesce(list_filter(places, lambda p: NOT list_contains(taken, p))[1], places[1]))
  FROM walk w JOIN turn t ON t.key = w.key AND t.nth = w.nth + 1),
chosen AS (SELECT file, rec_order, n, taken[-1] AS p FROM walk)
SELECT val.file, val.rec_order,
       CASE WHEN p IS NOT NULL OR (validated IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND orient IS NOT NULL) THEN 'g' END AS assembly_id,
       coalesce(p.c, sequence_id) AS sequence_id, coalesce(p.a, start) AS start, coalesce(p.z, "end") AS "end", coalesce(p.o, orient) AS orient,
       coalesce(validated, CASE WHEN n = 1 THEN 'fixed_remapped_unique' WHEN n > 1 THEN 'fixed_remapped_ambig' END, 'invalid') AS validated
FROM val LEFT JOIN chosen ON chosen.file = val.file AND chosen.rec_order = val.rec_order""")
def remap_claim(spark, sf_dir):
    return coords.curate(derive.records(spark, sf_dir), derive.genome(spark, sf_dir), "g").select("file", "rec_order", "assembly_id", "sequence_id", "start", "end", "orient", "validated")


@query(f"""WITH {GEN}
SELECT CASE WHEN validated = 'valid' THEN 'valid' WHEN validated LIKE 'fixed%' THEN 'fixed' ELSE 'invalid' END AS kind, coalesce(validated, 'invalid') AS validated, count(*) AS n FROM val GROUP BY ALL""")
def label_counts(spark, sf_dir):
    return coords.label_counts(coords.validate(derive.records(spark, sf_dir), derive.genome(spark, sf_dir)))


@query(f"""WITH {ALN},
top AS (SELECT msa_id, col, base AS t, 1 + coalesce(sum(CAST(base <> '-' AS INTEGER)) OVER (PARTITION BY msa_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM res WHERE is_reference),
own AS (
  SELECT r.msa_id, r.row_idx, t.pos, coalesce(string_agg(r.base, '' ORDER BY r.col) FILTER (t.t = '-' AND r.base <> '-'), '') AS inserted, coalesce(max(r.base) FILTER (t.t <> '-'), '') AS letter
  FROM res r JOIN top t ON t.msa_id = r.msa_id AND t.col = r.col WHERE NOT r.is_reference GROUP BY ALL),
room AS (SELECT msa_id, pos, max(length(inserted)) AS room FROM own GROUP BY ALL),
bases AS (SELECT top.msa_id, top.pos, coalesce(max(t) FILTER (t <> '-'), '') AS base FROM top GROUP BY ALL),
made AS (
  SELECT b.msa_id, string_agg(repeat('-', CAST(room AS BIGINT)) || base, '' ORDER BY b.pos) AS seq, max(b.pos) FILTER (base <> '') AS size
  FROM bases b JOIN room ON room.msa_id = b.msa_id AND room.pos = b.pos GROUP BY ALL)
SELECT msa_id AS ref, CAST(0 AS INTEGER) AS row_idx, msa_id AS name, CAST(1 AS BIGINT) AS start, CAST(size AS BIGINT) AS "end", '+' AS orient, seq FROM made WHERE size > 0
UNION ALL
SELECT own.msa_id, CAST(dense_rank() OVER (PARTITION BY own.msa_id ORDER BY own.row_idx) AS INTEGER), CAST(own.row_idx AS VARCHAR), 1,
       length(replace(string_agg(inserted || letter, '' ORDER BY own.pos), '-', '')), '+', string_agg(inserted || repeat('-', CAST(room - length(inserted) AS BIGINT)) || letter, '' ORDER BY own.pos)
FROM own JOIN room ON room.msa_id = own.msa_id AND room.pos = own.pos JOIN made ON made.msa_id = own.msa_id WHERE size > 0 GROUP BY own.msa_id, own.row_idx""")
def pairwise_merge(spark, sf_dir):
    rows = derive.alignments(spark, sf_dir)
    top = settled(rows.where("is_reference").select(F.col("msa_id").alias("ref"), F.col("seq").alias("top")))
    both = rows.where("not is_reference").join(top, F.col("msa_id") == F.col("ref"))
    hits = both.select("ref", F.col("row_idx").alias("hit_no"), F.lit(1).alias("ref_start"), F.col("top").alias("ref_seq"), F.col("row_idx").cast("string").alias("name"), F.lit(1).alias("start"), F.length(F.replace("seq", F.lit("-"), F.lit(""))).alias("end"), F.lit("+").alias("orient"), "seq")
    return pairwise.merge(hits)


#: Both windows of an instance every 20 bases of a chromosome, and of one at its end.
SITES = """
w AS (
  SELECT substr(g, place + 1, 20) AS l, substr(g, place + 26, 20) AS r
  FROM (SELECT g, unnest(list_distinct(list_append(range(0, length(g) - 44, 20), length(g) - 45))) AS place FROM gen WHERE length(g) >= 45))"""
TSD = f"""{GEN},
{SITES},
x AS (
  SELECT a AS length, b AS "offset", substr(l, CAST(10 - a + b + j AS BIGINT), 1) AS p, substr(r, CAST(10 - b + j AS BIGINT), 1) AS q
  FROM w, range(1, 11) t(a), range(0, 11) u(b), range(1, 11) v(j) WHERE b <= a AND j <= a),
s AS (
  SELECT CAST(length AS INTEGER) AS length, CAST("offset" AS INTEGER) AS "offset",
         sum(CASE WHEN p = q THEN CASE WHEN p IN ('A', 'T') THEN 9 ELSE 10 END WHEN p || q IN ('AG', 'GA', 'CT', 'TC') THEN -6 WHEN p || q IN ('AT', 'TA') THEN -17 ELSE -15 END) + round(count(*) * 6.9::DOUBLE, 1) AS score
  FROM x GROUP BY ALL)"""


def windows(spark, sf_dir):
    return derive.windows(spark, sf_dir).where("reason is null")


@query(f"WITH {TSD} SELECT * FROM s")
def tsd_scores(spark, sf_dir):
    return sites.site_scores(windows(spark, sf_dir), derive.REACH)


@query(f"""WITH {TSD},
a AS (SELECT length, "offset", CAST(trunc(score / length + 0.5) AS BIGINT) AS average FROM s)
SELECT length, "offset", average FROM a ORDER BY average DESC, length DESC, "offset" DESC LIMIT 1""")
def tsd_best(spark, sf_dir):
    return sites.best_site(sites.site_scores(windows(spark, sf_dir), derive.REACH))


@query(f"""WITH {GEN}, {SITE_MATRIX}, {SITES},
s AS (SELECT substr(l, 8, 5) AS l, substr(r, 9, 5) AS r FROM w),
z AS (
  SELECT l, r, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN substr(l, i, 1) = substr(r, i, 1) THEN CASE WHEN substr(l, i, 1) IN ('A', 'T') THEN 9 ELSE 10 END
    WHEN substr(l, i, 1) || substr(r, i, 1) IN ('AG', 'GA', 'CT', 'TC') THEN -6 WHEN substr(l, i, 1) || substr(r, i, 1) IN ('AT', 'TA') THEN -17 ELSE -15 END)) AS raw FROM s),
b AS (SELECT i - 1 AS pos, unnest([substr(l, i, 1), substr(r, i, 1)]) AS base FROM z, range(1, 6) t(i) WHERE raw > 0),
t AS (SELECT pos, cand, idx, sum(score) AS total FROM b JOIN m ON base = obs GROUP BY ALL)
SELECT CAST(pos AS INTEGER) AS pos, cand AS letter FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY total DESC, idx) AS k FROM t) WHERE k = 1""")
def tsd_consensus(spark, sf_dir):
    return sites.site_consensus(sites.site_letters(windows(spark, sf_dir), 5, 2, derive.REACH))


@query(r"""
WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DF' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') WHEN 1 THEN 'DR' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.1' WHEN 2 THEN ' DF' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '.4 ' WHEN 3 THEN 'DX12' ELSE p_name END AS ac FROM part)
SELECT p_partkey, ac, regexp_matches(trim(ac), '^D[FR](\d{7}|\d{9})(\.\d*)?$') AS valid,
       CASE WHEN regexp_matches(trim(ac), '^D[FR]\d{7}(\.\d+)?$') THEN regexp_replace(trim(ac), '^(D[FR])(\d{7}(\.\d+)?)$', '\1' || '00' || '\2') ELSE ac END AS padded FROM v""")
def accessions(spark, sf_dir):
    key = F.col("p_partkey")
    padded = lambda n: F.lpad(key.cast("string"), n, "0")
    ac = (
        F.when(key % 5 == 0, F.concat(F.lit("DF"), padded(7))).when(key % 5 == 1, F.concat(F.lit("DR"), padded(9), F.lit(".1")))
        .when(key % 5 == 2, F.concat(F.lit(" DF"), padded(7), F.lit(".4 "))).when(key % 5 == 3, "DX12").otherwise(F.col("p_name"))
    )
    parts = derive.table(spark, sf_dir, "part").select("p_partkey", ac.alias("ac"))
    return parts.select("p_partkey", "ac", X.valid_accession(F.col("ac")).alias("valid"), X.pad_accession(F.col("ac")).alias("padded"))


@query(r"""
WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'rnd-' || c_custkey || '_family-7#x' WHEN 1 THEN 'LTR-1_Family-' || c_custkey ELSE c_name END AS id,
  lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-0000-1111-22' || CASE c_custkey % 3 WHEN 0 THEN '3X' WHEN 1 THEN '34' ELSE '3Y' END AS orcid,
  CASE c_custkey % 3 WHEN 0 THEN 'https://doi.org/10.1101/' || c_custkey || 'v2' WHEN 1 THEN 'http://doi.org/10.1093/x' || c_custkey || 'v2' ELSE '10.1101/' || c_custkey END AS doi FROM customer)
SELECT c_custkey, regexp_matches(id, '(?i)^(rnd|ltr)-\d+_family-\d+') AS automated, regexp_matches(orcid, '^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$') AS orcid_valid,
  CASE WHEN starts_with(regexp_replace(doi, '^https?://doi\.org/', ''), '10.1101/') THEN regexp_replace(regexp_replace(doi, '^https?://doi\.org/', ''), 'v\d+$', '') ELSE regexp_replace(doi, '^https?://doi\.org/', '') END AS doi FROM v""")
def identifier_rules(spark, sf_dir):
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("rnd-"), key, F.lit("_family-7#x"))).when(key % 4 == 1, F.concat(F.lit("LTR-1_Family-"), key)).otherwise(F.col("c_name"))
    orcid = F.concat(F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("-0000-1111-22"), F.when(key % 3 == 0, "3X").when(key % 3 == 1, "34").otherwise("3Y"))
    doi = F.when(key % 3 == 0, F.concat(F.lit("https://doi.org/10.1101/"), key, F.lit("v2"))).when(key % 3 == 1, F.concat(F.lit("http://doi.org/10.1093/x"), key, F.lit("v2"))).otherwise(F.concat(F.lit("10.1101/"), key))
    return derive.table(spark, sf_dir, "customer").select("c_custkey", X.automated_name(name).alias("automated"), X.valid_orcid(orcid).alias("orcid_valid"), X.normalize_doi(doi).alias("doi"))


@query("""
WITH v AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'chr' || s_suppkey || ':' || 10 || '-' || 50 || '_-' WHEN 1 THEN 'asm:chr' || s_suppkey || ':90-20' WHEN 2 THEN 'chr' || s_suppkey || '_5_25_R' WHEN 3 THEN 'a' || s_suppkey || ':b' ELSE 'name' || s_suppkey END AS id FROM supplier)
SELECT s_suppkey, id, CASE s_suppkey % 5 WHEN 1 THEN 'asm' WHEN 3 THEN 'a' || s_suppkey END AS assembly_id, CASE WHEN s_suppkey % 5 = 3 THEN 'b' WHEN s_suppkey % 5 = 4 THEN id ELSE 'chr' || s_suppkey END AS sequence_id,
  CAST(CASE s_suppkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 5 END AS BIGINT) AS seq_start, CAST(CASE s_suppkey % 5 WHEN 0 THEN 50 WHEN 1 THEN 90 WHEN 2 THEN 25 END AS BIGINT) AS seq_end,
  CASE WHEN s_suppkey % 5 < 3 THEN '-' END AS orient, CASE s_suppkey % 5 WHEN 0 THEN 'V2' WHEN 1 THEN 'V1' WHEN 2 THEN 'V0' ELSE 'Undefined' END AS inferred_version FROM v""")
def identifier_parse(spark, sf_dir):
    key = F.col("s_suppkey")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("chr"), key, F.lit(":10-50_-"))).when(key % 5 == 1, F.concat(F.lit("asm:chr"), key, F.lit(":90-20"))).when(key % 5 == 2, F.concat(F.lit("chr"), key, F.lit("_5_25_R")))
        .when(key % 5 == 3, F.concat(F.lit("a"), key, F.lit(":b"))).otherwise(F.concat(F.lit("name"), key))
    )
    return derive.table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("id")).withColumn("p", ids.parsed_single(F.col("id"))).select("s_suppkey", "id", "p.*")


@query("""SELECT d.p_partkey, count(*) OVER (PARTITION BY lower(trim(p_brand))) AS copies FROM part d QUALIFY copies > 1""")
def duplicate_ids(spark, sf_dir):
    gf = F.array(F.struct(F.lit("ID").alias("tag"), F.col("p_brand").alias("value")))
    recs = derive.table(spark, sf_dir, "part").select(F.lit("part").alias("file"), F.col("p_partkey").alias("record_num"), gf.alias("gf"))
    return lint.repeated_ids(recs).select(F.col("record_num").alias("p_partkey"), "copies")


@query("""SELECT c_custkey, 'tp_unknown' AS "check", 'TP "' || c_mktsegment || '" is no class' AS message FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def unknown_classes(spark, sf_dir):
    known = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    gf = F.array(F.struct(F.lit("TP").alias("tag"), F.col("c_mktsegment").alias("value")))
    recs = derive.table(spark, sf_dir, "customer").select(F.lit("customer").alias("file"), F.col("c_custkey").alias("record_num"), gf.alias("gf"))
    return lint.table_rules(recs, {"classification": known}).select(F.col("record_num").alias("c_custkey"), "check", "message")


@query("""
WITH n AS (SELECT DISTINCT n_name || 'S' AS name FROM nation WHERE length(n_name) >= 3), v AS (SELECT DISTINCT n_name AS candidate FROM nation),
s AS (SELECT name, candidate, jaro_winkler_similarity(lower(name), lower(candidate)) AS score FROM n JOIN v ON lower(name[1]) = lower(candidate[1]) AND abs(strlen(name) - strlen(candidate)) <= 8),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM s WHERE score >= 0.85)
SELECT name, candidate, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def similar_names(spark, sf_dir):
    nations = derive.table(spark, sf_dir, "nation")
    found = lint.similar_names(nations.select(F.concat("n_name", F.lit("S")).alias("name")), nations.select(F.col("n_name").alias("name")))
    return found.withColumn("score", F.round("score", 6))


@query("""
WITH c(key, class, place) AS (VALUES ('PROMO', 'a', 0), ('promo', 'b', 1), ('STANDARD; Transposable Element', 'c', 2)),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_type, ' ', 1) || '; Transposable Element' ELSE split_part(p_type, ' ', 1) END AS k FROM part),
f AS (SELECT lower(key) AS low, arg_min(class, place) AS class FROM c GROUP BY 1)
SELECT p_partkey, class FROM p LEFT JOIN f ON lower(k) = low""")
def class_lookup(spark, sf_dir):
    classes = spark.createDataFrame([("PROMO", "a", 0), ("promo", "b", 1), ("STANDARD; Transposable Element", "c", 2)], "key string, class string, place int")
    first = F.element_at(F.split("p_type", " "), 1)
    parts = derive.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.array(first, F.lit("transposable element"), F.lit("more"))).otherwise(F.array(first)).alias("keywords"))
    return families.classified(parts, classes).select("p_partkey", "class")


def source_records(spark, sf_dir):
    """A record for each document: its source as ID, an author and titles of publications out of order."""
    d = derive.table(spark, sf_dir, "documents")
    pair = lambda t, v: F.struct(F.lit(t).alias("tag"), v.alias("value"))
    gf = F.array(pair("ID", F.col("source")), pair("RT", F.col("lang")), pair("RN", F.lit("[1]")), pair("AC", F.concat(F.lit("DF"), F.lpad(F.col("doc_id").cast("string"), 7, "0"))), pair("AU", F.when(F.col("doc_id") % 2 == 0, "A Smith").otherwise("Anna Smith")))
    return d.select(
        F.col("lang").alias("file"), F.col("doc_id").cast("int").alias("record_num"), F.lit("# STOCKHOLM 1.0").alias("header"), gf.alias("gf"), F.create_map(F.lit("RF"), F.lit("x-x")).alias("gc"),
        F.array(F.struct(F.lit("chr_1_3").alias("original_id"), F.lit("V0").alias("inferred_version"), F.lit("A-C").alias("aligned_seq"))).alias("sequences"),
        F.array().cast("array<string>").alias("unknown_annotations"), F.lit(True).alias("terminated"), F.lit(None).cast("long").alias("block_separator_line"),
    )


@query("""SELECT CAST(doc_id AS INTEGER) AS record_num, 'ID=' || replace(source, 'src', 'S') || ';RT=' || lang || ';RN=[1];AC=DF00' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || ';AU=' || CASE WHEN doc_id % 2 = 0 THEN 'A Smith' ELSE 'Anna Smith' END || ';CC=note' AS fields FROM documents""")
def edit_fields(spark, sf_dir):
    done = records.edit(source_records(spark, sf_dir), records.Edits(append=[("CC", "note")], sub=[("ID", "/src/S/")]))
    return done.select("record_num", F.array_join(F.transform("gf", lambda g: F.concat(g["tag"], F.lit("="), g["value"])), ";").alias("fields"))


@query("""SELECT lang AS file, CAST(count(*) AS BIGINT) AS rows_changed, CAST(count(*) AS BIGINT) AS accessions_padded, CAST(count(*) AS BIGINT) AS rf_changed FROM documents GROUP BY lang""")
def clean_report(spark, sf_dir):
    return records.clean_report(records.clean(source_records(spark, sf_dir)))


@query("""
WITH f(severity, check_, alternate) AS (VALUES ('ERROR', 'missing_required_field', 0), ('ERROR', 'missing_required_field', 0), ('ERROR', 'missing_required_field', 0), ('ERROR', 'missing_required_field', 0), ('WARN', 'ref_block_incomplete', 0), ('ERROR', 'ref_block_order', 0),
  ('ERROR', 'rf_invalid_chars', 0), ('WARN', 'seq_nonstandard_gap', 0), ('ERROR', 'au_format', 1))
SELECT lang AS file, CAST(doc_id AS INTEGER) AS record_num, severity, check_ AS "check", count(*) AS n FROM documents, f WHERE alternate = 0 OR doc_id % 2 = 0 GROUP BY ALL""")
def lint_records(spark, sf_dir):
    return lint.record_rules(source_records(spark, sf_dir)).groupBy("file", "record_num", "severity", "check").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT lang, count(*) OVER (PARTITION BY lang, lower(source)) AS copies FROM documents)
SELECT lang AS file, 'INFO' AS severity, c AS "check", CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT lang FROM documents), (VALUES ('ac_update_records'), ('orcid_missing'), ('seqid_legacy_format')) t(c)
UNION ALL SELECT DISTINCT lang, 'WARN', 'citation_fields_unused', CAST(1 AS BIGINT) FROM documents
UNION ALL SELECT lang, 'INFO', 'duplicate_id_update', count(*) FROM d WHERE copies > 1 GROUP BY lang""")
def lint_files(spark, sf_dir):
    return lint.file_rules(source_records(spark, sf_dir)).groupBy("file", "severity", "check").agg(F.count("*").alias("n"))


@query(f"""WITH {GEN} SELECT chrom AS hit_no, chrom AS name, 1 AS start, CAST(length(g) AS INTEGER) AS "end", '+' AS orient, repeat(' ', 10) || g || repeat(' ', 10) AS seq FROM gen""")
def blast_projection(spark, sf_dir):
    """Each chromosome as a hit on a subject of ten bases more on either side."""
    length = F.col("length").cast("int")
    g = derive.genome(spark, sf_dir)
    hits = g.select(F.col("chrom").alias("hit_no"), F.col("chrom").alias("qseqid"), F.lit(1).alias("qstart"), length.alias("qend"), F.lit(11).alias("sstart"), (length + 10).alias("send"), F.lit("+").alias("orientation"), F.col("seq").alias("qseq"), F.col("seq").alias("sseq"))
    return pairwise.project(hits, F.col("qend") + 20)
