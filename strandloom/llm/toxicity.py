"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a character model of words: the probability of a letter after the six before it (blanks
before the word's first, an end mark after its last) from the class's own counts, discounted, and backing off to
continuation counts that both classes share. An expression too rare for a class's own counts is so judged by the shared ones,
which favour neither class. An expression's evidence is the difference of its log-likelihoods under the two models, each divided by its
length; a document's is that of its most toxic expression, and one slope and one constant make a score of it. (Divided by the length of
a whole document, a few toxic expressions disappear among hundreds of others.) Slope and constant are fitted on a fifth of the training rows
that the models did not count.

The fit uses at most about `TRAINING_DOCUMENTS` labelled documents, picked by a hash of doc_id. Letters are whole code points: those
that the sample has most, up to `ALPHABET`, are letters of their own and all others are one more. Scores read whole texts.

Null and empty texts and texts without letters have no evidence and get the score of its absence. Repeated labels of a document count
as toxic if any is; null labels count as none. Without labels of both classes every score is 0. Extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_columns
from .common import checkpoint, training_row

TRAINING_DOCUMENTS = 12_000
#: Steps of the share of documents that is learnt from.
STEPS = 1 << 50
DISCOUNT = 0.75
#: Words whose evidence a worker keeps, and the longest of these.
REMEMBERED, LONGEST = 400_000, 64
#: Words that are judged together.
AT_ONCE = 50_000
LETTERS = re.compile(r"[^\W\d_]+")
#: Bits of a letter in an n-gram's key, the marks before and after a word, and the letter for all that the alphabet lacks.
BITS, BEFORE, AFTER, OTHER = 9, 1, 2, 3
MASK = (1 << BITS) - 1
#: Letters with numbers of their own.
ALPHABET = MASK - OTHER
#: Letters of the longest n-grams; their keys fill 63 bits.
ORDER = 7


def words(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return LETTERS.findall(text.lower()) if text else []


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def ngrams(batch: list[str], alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of words, and the index of each one's word. alphabet: sorted code points; without one the first 511 are their own numbers."""
    sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
    points = code_points(chr(AFTER).join(batch) + chr(AFTER))
    if alphabet is None:
        letters = np.where(points <= MASK, points, OTHER)
    else:
        at, known = at_keys(alphabet, points) if len(alphabet) else (0, False)
        letters = np.where(points == AFTER, AFTER, np.where(known, at + OTHER + 1, OTHER))
    ends = np.cumsum(sizes)
    within = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
    key = letters.copy()
    for back in range(1, ORDER):
        before = np.full(len(letters), BEFORE, np.int64)
        before[back:] = np.where(within[back:] >= back, letters[:-back], BEFORE)
        key |= before << (BITS * back)
    return key, np.repeat(np.arange(len(batch)), sizes)


class Model:
    """Evidence of letters in context, as two tables sorted by key, and the constant and slope of a score."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, alphabet: np.ndarray | None = None):
        self.alphabet = alphabet
        order = np.argsort(keys)
        self.keys, counts = keys[order], [toxic[order].astype(float), ordinary[order].astype(float)]
        backoff = shared(self.keys)
        context = self.keys >> BITS
        self.contexts, at = np.unique(context, return_inverse=True)
        self.evidence, self.leftover = np.zeros(len(self.keys)), np.zeros(len(self.contexts))
        for sign, c in zip((1, -1), counts):
            total, kinds = np.bincount(at, c, len(self.contexts)), np.bincount(at, c > 0, len(self.contexts))
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + left[at] * backoff
            self.evidence += sign * np.log(np.maximum(p, 1e-12))
            self.leftover += sign * np.log(left)
        self.weights = np.zeros(2)
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def judged(self, batch: list[str]) -> np.ndarray:
        """Evidence of words: the log-likelihood ratio of each, by its length."""
        key, word = ngrams(batch, self.alphabet)
        own, seen = at_keys(self.keys, key)
        ctx, near = at_keys(self.contexts, key >> BITS)
        ratio = np.where(seen, self.evidence[own], np.where(near, self.leftover[ctx], 0.0))
        return np.bincount(word, ratio, len(batch)) / np.bincount(word, minlength=len(batch))

    def evidence_of(self, found: list[str]) -> np.ndarray:
        """Evidence of each of some words, that of the shorter ones remembered."""
        mine = dict.fromkeys(found)
        if new := [w for w in mine if w not in self.known]:
            values = dict(zip(new, self.judged(new).tolist()))
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.known.update((w, v) for w, v in values.items() if len(w) <= LONGEST)
            if missing := [w for w in mine if w not in self.known and w not in values]:
                values |= dict(zip(missing, self.judged(missing).tolist()))
            lookup = lambda w: values[w] if w in values else self.known[w]
        else:
            lookup = self.known.__getitem__
        return np.fromiter(map(lookup, found), float, len(found))

    def strongest(self, texts: list[str | None]) -> np.ndarray:
        """The evidence of each text's most toxic word; 0 where there is none."""
        out = np.full(len(texts), -np.inf)
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            found = words(text) if len(self.keys) else []
            for start in range(0, len(found), AT_ONCE):
                waiting.append((i, found[start : start + AT_ONCE]))
                size += len(waiting[-1][1])
                if size >= AT_ONCE:
                    self.compare(out, waiting)
                    waiting, size = [], 0
        self.compare(out, waiting)
        return np.where(np.isfinite(out), out, 0.0)

    def compare(self, out: np.ndarray, waiting: list[tuple[int, list[str]]]) -> None:
        """Takes parts of texts in."""
        if not waiting:
            return
        values = self.evidence_of([w for _, part in waiting for w in part])
        of = np.repeat([i for i, _ in waiting], [len(part) for _, part in waiting])
        np.maximum.at(out, of, values)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.strongest(texts) * self.weights[1] + self.weights[0], -500, 500)))


def at_keys(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def shared(keys: np.ndarray) -> np.ndarray:
    """For each n-gram the probability of its last letter after all but the first before it, from continuation counts of all orders below."""
    p, seen = None, keys
    levels = []
    for order in range(ORDER - 1, 0, -1):  # distinct left neighbours of each n-gram
        short = np.sort(seen & ((1 << (BITS * order)) - 1))
        grams, n = np.unique(short, return_counts=True)
        levels.append((order, grams, n.astype(float)))
        seen = grams
    for order, grams, n in reversed(levels):
        ctx, at = np.unique(grams >> BITS, return_inverse=True)
        total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
        lower = np.full(len(grams), 1 / max(1, len(grams))) if p is None else p[1][at_keys(p[0], grams & ((1 << (BITS * (order - 1))) - 1))[0]]
        p = grams, np.maximum(n - DISCOUNT, 0) / total[at] + DISCOUNT * kinds[at] / total[at] * lower
    return p[1][at_keys(p[0], keys & ((1 << (BITS * (ORDER - 1))) - 1))[0]] if len(keys) else np.zeros(0)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS) -> Model:
    """Learns from labelled documents that are not held out."""
    empty = Model(*np.zeros((3, 0), np.int64))
    known = labels.where(training_row(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    size = known.count()
    if not size:
        return empty
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) < int(min(1.0, limit / size) * STEPS))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # about `limit` ids at most
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0
    rows = checkpoint(rows.select("text", "is_toxic", fold.alias("fold")))

    def letters(batches):
        import pyarrow as pa

        for batch in batches:
            points, n = np.unique(code_points("".join("".join(words(t)) for t in batch.column(0).to_pylist())), return_counts=True)
            yield pa.RecordBatch.from_pydict({"point": points, "n": n.astype(np.int64)})

    top = rows.select("text").mapInArrow(letters, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(ALPHABET)
    alphabet = np.sort(np.array([r["point"] for r in top.collect()], np.int64))

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        found = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(set(words(text)))  # an expression counts once a document
        for toxic, c in found.items():
            if c:
                key, word = ngrams(list(c), alphabet)
                keys, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, np.fromiter(c.values(), float, len(c))[word]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"key": keys, "toxic": n * toxic, "ordinary": n * (not toxic)})

    grams = rows.where("not fold").select("text", "is_toxic").mapInArrow(count, "key long, toxic long, ordinary long")
    table = grams.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
    key, toxic, ordinary = (table[c].to_numpy() for c in ("key", "toxic", "ordinary"))
    del table
    if not toxic.any() or not ordinary.any():
        return empty
    model = Model(key, toxic, ordinary, alphabet)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("strongest", T.DoubleType())]
    judged = with_columns(rows.where("fold").select("text", "is_toxic"), added, lambda b: [shared_model.value.strongest(b.column(0).to_pylist()).tolist()])
    judged = judged.select("strongest", "is_toxic").toArrow()
    x, y = judged["strongest"].to_numpy(), np.array(judged["is_toxic"].to_pylist(), bool)
    # Without examples of both classes: as likely as not from where a letter is e times likelier in toxic words
    model.weights = regression(x[:, None], y.astype(float)) if y.any() and not y.all() else np.array([-4.0, 4.0])
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score, from 0 to 1, higher for texts like those labelled toxic."""
    shared_model = df.sparkSession.sparkContext.broadcast(model)
    make = lambda b: [shared_model.value.scores(b.column(b.schema.get_field_index(text)).to_pylist()).tolist()]
    return with_columns(df, [T.StructField("score", T.DoubleType())], make)
