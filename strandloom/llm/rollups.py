"""Token counts as rollups that signed deltas maintain.

A rollup holds additive totals, documents and tokens by source, language and tokenizer version, as the sum of committed batches.
A batch is a table of signed counts: an insert adds a document's, a delete takes them away, a revision does both, old and new.
Deltas are summed by key before they are stored, so a batch is as small as its keys, whatever its rows.

A commit is idempotent: the data are written under a name of their own, then a marker named after the batch is created, which
only one writer can where the store's rename replaces nothing, as in HDFS; a batch that has a marker is left as it is, and data without
a marker count for nothing. Totals are the same in whatever order batches are committed. `compact` folds the batches of one moment into one
table, named by a marker that lists them; what is committed meanwhile counts besides it.

Null source or language is a key of its own. Null texts have no tokens but count as documents. Keys whose documents and tokens are
both zero are left out. An unknown tokenizer version raises KeyError. Very long texts are counted whole. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from functools import cache
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_columns
from .common import WORD, word_count

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"
#: Tokenizer versions: words, counted by a pattern, and vocabularies by the file that holds them.
WORDS = "words/1"
TOKENIZERS = {WORDS: None, "byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


@cache
def vocabulary(file: str):
    """The encoder of a vocabulary, loaded once by each worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(file), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_counts(docs: DataFrame, versions: list[str], text: str = "text") -> DataFrame:
    """docs with a column of each version's name: the tokens of the text; 0 for null. Special tokens' names are ordinary text."""
    files = {v: TOKENIZERS[v] for v in versions}
    encoded = [v for v in versions if v != WORDS]

    def make(batch):
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        return [[len(vocabulary(files[v]).encode_ordinary(t)) for t in texts] for v in encoded]

    out = with_columns(docs, [T.StructField(v, T.LongType()) for v in encoded], make) if encoded else docs
    return out.withColumn(WORDS, word_count(F.col(text))) if WORDS in versions else out


def counted(docs: DataFrame, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer and tokens of every document."""
    slim = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    return with_counts(slim, [version]).select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.col(f"`{version}`").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas that add documents."""
    return counts.select(*KEYS, F.lit(1).alias("sign"), F.col("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take documents away."""
    return counts.select(*KEYS, F.lit(-1).alias("sign"), F.col("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace counts; keys may change too."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self.fs = self.at("commits").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.at("commits"))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at("commits")))

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def mark(self, name: str, text: str) -> bool:
        """Creates a marker with its text under a name that no other writer gets; False if there is one."""
        draft, final = self.at(f"drafts/{uuid.uuid4().hex}"), self.at(f"commits/{name}")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            return False
        return True

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas(source, lang, tokenizer, sign, tokens), once; False if it was there."""
        name = "batch=" + quote(batch, safe="")
        if name in self.names():
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        folder = f"data/{uuid.uuid4().hex}"
        summed.write.parquet(f"{self.path}/{folder}")
        return self.mark(name, folder)

    def bases(self) -> list[str]:
        return [n for n in self.names() if n.startswith("base=")]

    def covered(self, base: str) -> list[str]:
        """Batches that a compacted table holds."""
        return self.text(f"commits/{base}").split("\n")[1:]

    def sources(self) -> tuple[list[str], list[str]]:
        """Folders to add up, and the batches they hold."""
        names = self.names()  # once: what comes later is not of this moment
        base = max((n for n in names if n.startswith("base=")), default=None)
        held = self.covered(base) if base else []
        seen = set(held)
        rest = {n: self.text(f"commits/{n}") for n in names if not n.startswith("base=") and n not in seen}
        folders = ([self.text(f"commits/{base}").split("\n")[0]] if base else []) + list(rest.values())
        return folders, held + list(rest)

    def totals(self) -> DataFrame:
        """documents and tokens by key."""
        return self.summed(self.sources()[0])

    def summed(self, folders: list[str]) -> DataFrame:
        """documents and tokens by key in some folders."""
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Folds what is committed into one table; markers stay, so that replays are still known."""
        folders, held = self.sources()
        folder = f"data/{uuid.uuid4().hex}"
        self.summed(folders).write.parquet(f"{self.path}/{folder}")
        self.mark(f"base={len(self.bases()):08d}", "\n".join([folder, *held]))
