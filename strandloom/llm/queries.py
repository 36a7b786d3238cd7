"""The registered queries of the corpus operators, and the SQL that DuckDB can check them with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, mixing, neighbours, rollups, templates, topk, toxicity, warc
from .common import checkpoint, held_out, shared_dir, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at target weights takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3 AS stop,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
r AS (SELECT *, CAST(stop AS DOUBLE) / weight AS room FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY room, source NULLS LAST) AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r),
f AS (SELECT arg_min(level, place) AS level FROM l WHERE level <= room),
t AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), f.level * weight) AS target FROM l, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + least(greatest(budget - rounds * source_size - start, 0), size) AS BIGINT) AS taken
FROM e
"""


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of similarity 0.9 on three-word shingles connect."""
    return jaccard.join_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS shingle
  FROM d WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
  WHERE 100 * p.both_ >= 90 * (x.n + y.n - p.both_)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; `score` is its proportion of the text."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back from the archives it was written to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hexed,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hexed, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the five nearest by cosine of every fiftieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup of all documents after four batches: words and tokens of one vocabulary are loaded, counts of documents in other languages than English are revised to
    another vocabulary, and documents that repeat an earlier text are deleted. Each batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    first, other = rollups.WORDS, ("byte_bpe_50k", "byte_bpe_multi_50k")
    rows = docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("name"), F.col("text").cast("string").alias("text"))
    rows = checkpoint(rollups.with_counts(rows, [first, *other]).drop("text"))
    under = lambda df, version, weight: df.select("source", "lang", F.lit(version).alias("tokenizer"), weight.alias("sign"), F.col(f"`{version}`").alias("tokens"))
    plus, minus = F.lit(1).cast("long"), F.lit(-1).cast("long")
    foreign = F.col("lang").isNotNull() & (F.col("lang") != "en")
    # A text's rows are first counted by source and language, so that one text is not one task's; of all of them, the first stays
    counts = [F.max(f"`{v}`").alias(v) for v in (first, *other)]
    group = checkpoint(rows.groupBy("name", "source", "lang").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), *counts))
    texts = group.groupBy(F.col("name").alias("of")).agg(F.sum("n").alias("copies"), F.min(F.struct("least", "source", "lang")).alias("kept")).where("copies > 1")
    again = group.join(texts, F.col("name") == F.col("of"))
    is_kept = F.struct("least", "source", "lang").eqNullSafe(F.col("kept"))
    gone = F.when(is_kept, 1 - F.col("n")).otherwise(-F.col("n"))
    rollup = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batches = {
        "words": under(rows, first, plus),
        "tokens": under(rows, other[0], plus),
        "tokens, revised": under(rows.where(foreign), other[0], minus).unionByName(under(rows.where(foreign), other[1], plus)),
        "copies": under(again, first, gone).unionByName(under(again.where(~foreign), other[0], gone)).unionByName(under(again.where(foreign), other[1], gone)),
    }
    for name, deltas in [*batches.items(), *batches.items()]:
        rollup.commit(name, deltas)
    return rollup.totals()


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of what is left of every document."""
    kept = templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(raw) AS line, generate_subscripts(raw, 1) AS pos FROM d),
w AS (
  SELECT doc_id, line, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS words
  FROM l),
u AS (SELECT DISTINCT doc_id, words FROM w WHERE len(words) > 0),
k AS (SELECT words, len(words) AS n, words[1:3] AS head, count(*) AS docs, min(doc_id) AS first FROM u GROUP BY words),
t AS (SELECT words, n, head, docs, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM k),
c AS (SELECT n, head, place, word FROM t GROUP BY n, head, place, word HAVING sum(docs) >= CASE WHEN n > 50 THEN 2 ELSE 3 END),
s AS (SELECT t.words, count(*) AS constant FROM t JOIN c USING (n, head, place, word) WHERE place > 3 GROUP BY t.words),
m AS (SELECT k.* FROM k LEFT JOIN s ON k.words = s.words WHERE 100 * coalesce(s.constant, 0) >= 60 * greatest(k.n - 3, 0)),
g AS (SELECT n, head, min(first) AS first FROM m GROUP BY n, head HAVING sum(docs) >= CASE WHEN n > 50 THEN 2 ELSE 3 END),
x AS (SELECT m.words, g.first FROM m JOIN g ON m.n = g.n AND m.head = g.head),
o AS (SELECT w.doc_id, w.pos, w.line, len(w.words) AS n, x.words IS NOT NULL AND x.first <> w.doc_id AS gone FROM w LEFT JOIN x ON w.words = x.words)
SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_sha256
FROM o GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


#: Score from which a document counts as toxic.
TOXIC = 0.7
QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_jaccard": op2_jaccard,
    "op3_bpe": op3_bpe,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_token_counts": op8_token_counts,
    "op9_neighbours": op9_neighbours,
    "op10_lines": op10_lines,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op2_jaccard": OP2_SQL, "op5_warc": OP5_SQL, "op7_topk": OP7_SQL, "op10_lines": OP10_SQL}
