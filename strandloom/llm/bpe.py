"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge: every merge makes a token, and
the token would hold the pair. Between such bytes a cut is certain. A text is therefore split, first where the vocabulary's
pre-tokenizer splits it, then at each such pair, and every fragment is encoded on its own; the ids are concatenated.
Fragments recur, so each worker keeps a bounded table of those it has encoded.

Nulls count as empty texts; empty texts have no ids. Texts of any length are taken whole: a fragment of n bytes costs
O(n log n). Extra columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release

#: The pre-tokenization pattern of the byte-level vocabularies, as their documentation gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern means it.
SPACE = regex.compile(r"\s")
#: Fragments that a worker remembers, of either kind.
REMEMBERED = 250_000
#: Longest fragment, in bytes, that is searched for the next merge from end to end; longer ones keep a heap.
SHORT = 48
#: Rank of a pair that no merge joins.
NONE = (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + i)] = b
    return letters


def unlike_code_points(pre_tokenizer) -> list[int]:
    """Code points that `regex` counts as letters or numbers and the vocabulary's pre-tokenizer does not: the two know different versions of Unicode."""
    every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)
    letters = regex.findall(r"\p{L}", every)
    asked = letters + regex.findall(r"\p{N}", every)
    joined = "".join(("a" if i < len(letters) else "1") + c + "\n" for i, c in enumerate(asked))
    starts = {at for _, (at, _) in pre_tokenizer.pre_tokenize_str(joined)}
    return [ord(c) for i, c in enumerate(asked) if 3 * i + 1 in starts]


def ranges(points: list[int]) -> list[tuple[int, int]]:
    """Sorted code points as closed ranges."""
    out: list[tuple[int, int]] = []
    for c in points:
        out[-1:] = [(out[-1][0], c)] if out and c == out[-1][1] + 1 else [*out[-1:], (c, c)]
    return out


class Encoded(dict):
    """Ids of a pre-token, made when first asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = tuple(chain.from_iterable(map(self.codec.merge, self.codec.fragments(piece.encode()))))
        return ids


class Spaced(dict):
    """Ids of a chunk between two single spaces, with the space before it. A chunk that is empty or begins with white space shares its space with others: it has no ids of its own."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if not chunk or SPACE.match(chunk):
            raise KeyError(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        known = self.codec.known
        ids = self[chunk] = tuple(chain.from_iterable(map(known.__getitem__, self.codec.pieces.findall(" " + chunk))))
        return ids


class Codec:
    """Encoder and decoder of a byte-level BPE vocabulary in the `tokenizers` library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = {raw(token): i for token, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.byte_ids = [vocabulary[bytes([b])] for b in range(256)]
        self.ranks = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.ranks[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        self.bytes_of = {i: token for token, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        self.inside = {pair for token in vocabulary for pair in zip(token, token[1:])}
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        from tokenizers import pre_tokenizers

        self.reference = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        unlike = unlike_code_points(self.reference)
        self.unlike = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges(sorted(unlike))) + "]") if unlike else None
        lead = chr(min(unlike, default=0x10FFFF)).encode()[0]
        self.low = bytes(range(lead))
        self.known, self.spaced = Encoded(self), Spaced(self)

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        Where no single space stands beside other white space, the text is cut at its spaces: the pattern lets a space
        join what follows it, and white space before it ends there as at the end of a text."""
        if self.unlike is not None and text.encode().translate(None, self.low) and self.unlike.search(text):
            pieces = [text[a:b] for _, (a, b) in self.reference.pre_tokenize_str(text)]
            return list(chain.from_iterable(map(self.known.__getitem__, pieces)))
        first, *chunks = text.split(" ")
        try:
            ids = list(chain.from_iterable(map(self.spaced.__getitem__, chunks)))
        except KeyError:
            return list(chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(text))))
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(first)))) + ids

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        """Cuts a pre-token between bytes that no token holds side by side."""
        start = 0
        for i, pair in enumerate(zip(piece, piece[1:]), 1):
            if pair not in self.inside:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of a fragment: of all neighbours the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in fragment]
        n, ranks = len(ids), self.ranks
        if n <= SHORT:
            get = ranks.get
            found = [get(pair, NONE) for pair in zip(ids, ids[1:])]
            while found and (least := min(found)) is not NONE:
                i = found.index(least)
                ids[i : i + 2] = [least[1]]
                del found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), NONE)
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), NONE)
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        waiting = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (found := ranks.get((a, b)))]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if found := ranks.get((ids[i], ids[after[i]])):
                    heapq.heappush(waiting, (found[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (found := ranks.get((ids[before[i]], ids[i]))):
                heapq.heappush(waiting, (found[0], before[i], ids[before[i]], ids[i]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; special tokens in it become their ids."""
        if not text:
            return []
        if not any(map(text.__contains__, self.special)):
            return self.plain(text)
        ids, start = [], 0
        for m in self.specials.finditer(text):
            ids += [*self.plain(text[start : m.start()]), self.special[m[0]]]
            start = m.end()
        return ids + self.plain(text[start:])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, once per worker."""
    return Codec(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies; every node has the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_columns(df: DataFrame, added: list[T.StructField], make) -> DataFrame:
    """df with columns that make(batch) gives, a list for each; a column of the same name is replaced."""
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + added)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [pa.field(f.name, to_arrow_type(f.dataType)) for f in added]
        for batch in batches:
            fields = [batch.schema.field(i) for i in range(len(kept))]
            arrays = [batch.column(i) for i in range(len(kept))]
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(x, k.type) for x, k in zip(made, kinds, strict=True)], schema=pa.schema(fields + kinds)
            )
        release()

    ordered = [f"`{f.name}`" for f in kept]
    return df.select(*ordered, *[f"`{f.name}`" for f in df.schema.fields if f.name.lower() in names]).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "tokens", path: str | None = None, check: bool = False) -> DataFrame:
    """Adds the token ids of a text column. check: raises ValueError if ids don't decode to their text."""
    path = path or vocabulary_path()

    def make(batch):
        own, out = codec(path), []
        for t in batch.column(batch.schema.get_field_index(text)):
            t = t.as_py()
            out.append(own.encode(t))
            if check and own.decode(out[-1]) != (t or ""):
                raise ValueError(f"ids of a text of {len(t)} letters decode to another")
        return [out]

    return with_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ids: str = "tokens", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of a column of token ids; null ids count as none."""
    path = path or vocabulary_path()
    return with_columns(
        df,
        [T.StructField(text, T.StringType())],
        lambda batch: [[codec(path).decode(t or ()) for t in batch.column(batch.schema.get_field_index(ids)).to_pylist()]],
    )


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of encoding a text column and decoding the ids.

    Both directions run on one batch, so that ids never leave the worker."""
    path = path or vocabulary_path()

    def make(batch):
        own, counts, ids_sha, text_sha = codec(path), [], [], []
        digits = {i: str(i) for i in own.bytes_of}
        for t in batch.column(batch.schema.get_field_index(text)):
            ids = own.encode(t.as_py())
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return [counts, ids_sha, text_sha]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_columns(df, added, make)
