"""Language identification as inference of a mixture.

A text is taken as a mixture of languages: each of its byte trigrams comes from one of them, drawn by the document's
proportions. Expectation-maximisation estimates the proportions from the trigrams' likelihoods under each language. Of the
nested sets that hold the one, two, ... languages of largest proportion, the one with the best penalised likelihood stands:
each further language costs `PENALTY * log(number of trigrams)`.

The trigram model has 2 ** 16 hashed counts a language, half a megabyte, whatever the corpus; a text is counted by the same
buckets, so a text of any length takes no more room in the inference. It is fitted on at most about
`TRAINING_DOCUMENTS` documents of each language, picked by a hash of doc_id; predictions read whole texts.

Null texts and texts without a letter are `und` with score 0, as is every text if there is nothing to learn from. Ties go to
the language that sorts first. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_columns
from .common import training_row

BUCKETS = 1 << 16
TRAINING_DOCUMENTS = 10_000
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 10
#: Bytes of a long text that are counted at a time; bytes up to which sorting is cheaper than counting by bucket.
PIECE, SHORT = 1 << 18, 1 << 13
UNDETERMINED = "und"
#: Steps of the share of documents that is learnt from.
STEPS = 1 << 50
#: Bytes other than ASCII letters and those of other scripts stand for one blank.
BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


RUNS = re.compile(b" +")


def normalised(text: str) -> bytes:
    """A lower-cased text in bytes, a blank for each run of what isn't a letter, and one at either end."""
    return RUNS.sub(b" ", (" " + text.lower() + " ").encode("utf-8", "replace").translate(BLANKS))


def buckets(raw: bytes) -> np.ndarray:
    """Buckets of the trigrams of some bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) & np.uint32(BUCKETS - 1)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text."""
    return buckets(normalised(text))


class Model:
    """Trigram probabilities of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.p = np.ascontiguousarray(p.T * BUCKETS) if languages else np.zeros((BUCKETS, 0))

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The chosen languages with their proportions, largest first, and the mean log-likelihood ratio of a trigram against chance."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return [], -math.inf
        at, n = counts(text)
        r, n = self.p[at], n.astype(float)
        size = n.sum()
        if not size:
            return [], -math.inf
        shares = proportions(r, n)
        order = np.argsort(-shares, kind="stable")
        best, fit, cost = (shares[order[:1]] * 0 + 1), n @ np.log(r[:, order[0]]), PENALTY * math.log(size + 1)
        for k in range(2, len(order) + 1):
            if shares[order[k - 1]] < 1e-3:
                break
            own = r[:, order[:k]]
            pi = proportions(own, n)
            found = n @ np.log(own @ pi)
            if found - cost * (k - 1) <= fit - cost * (len(best) - 1):
                break
            best, fit = pi, found
        chosen = sorted(zip((self.languages[i] for i in order), best.tolist()), key=lambda x: (-x[1], x[0]))
        return chosen, fit / size


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's trigrams, and how often it has each. Long texts are counted PIECE bytes at a time."""
    raw = normalised(text)
    if len(raw) <= SHORT:
        return np.unique(buckets(raw), return_counts=True)
    n = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw) - 2, PIECE):
        n += np.bincount(buckets(raw[start : start + PIECE + 2]), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def proportions(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expectation-maximisation from even proportions; r: likelihoods by trigram and language, n: how often the text has each trigram."""
    pi = np.full(r.shape[1], 1 / r.shape[1])
    for _ in range(ROUNDS):
        new = pi * ((n / (r @ pi)) @ r) / n.sum()
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi / pi.sum()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int = TRAINING_DOCUMENTS) -> Model:
    """Learns from text and lang of documents that are not held out."""
    known = docs.where(training_row(F.col("doc_id")) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, limit / n) * STEPS))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        import pyarrow as pa

        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = own.setdefault(k, np.zeros(BUCKETS, np.int64))
                at, n = counts(t)
                c[at] += n
        for k, c in own.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(c[at], pa.int64())})

    rows = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    found = np.zeros((len(languages), BUCKETS))
    at = {k: i for i, k in enumerate(languages)}
    found[np.array([at[k] for k in rows["lang"].to_pylist()], int), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, found)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (its proportion), languages (the chosen set) and fit (mean log-likelihood ratio of a trigram against chance; null without letters)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    language = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    added = [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(language)), T.StructField("fit", T.DoubleType()),
    ]

    def make(batch):
        out = [[], [], [], []]
        for t in batch.column(batch.schema.get_field_index(text)):
            chosen, fits = shared.value.mixture(t.as_py())
            out[0].append(chosen[0][0] if chosen else UNDETERMINED)
            out[1].append(min(1.0, max(0.0, chosen[0][1])) if chosen else 0.0)
            out[2].append([{"lang": k, "share": s} for k, s in chosen])
            out[3].append(fits if chosen else None)
        return out

    return with_columns(df, added, make)


def accepted() -> Column:
    """Whether an identified document has a language: letters, and trigrams likelier under its languages than by chance."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("fit") > 0)
