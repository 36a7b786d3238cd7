import random

import public_tokenizers
import pytest
from strandloom.llm import bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [
    "", "a", "Hello  world \n\n x", "it's we'll ~'s ''s x'ré", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "a" * 3000, "é" * 999 + "ß",
    " \t\r\n  　 x\u0085y", "日本語テキスト 12３４ ½", "😀🏽‍♀️ zero‍width", "\x00\x1c\x1d\x7f", "aͅ՘㈻0", "x" * 10 + " " * 500 + "y", "==>>~~``''\"\"--__",
    "�﻿", "ab" * 700 + "1" * 700, "\U00018d09\U000323b0a 1꟎b",
]


def test_as_the_library(library):
    codec = bpe.codec(bpe.vocabulary_path())
    rng = random.Random(7)
    letters = "abcdeéß'’ \n\t.,-1٣日<|>" + "՘😀"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([128, 245, 11]) == library.decode([128, 245, 11], skip_special_tokens=False)


def test_frames(spark, library):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "it's\n ok", None), (3, "it's\n ok", None)], "doc_id long, text string, tokens string")
    rows = bpe.decode(bpe.encode(df)).collect()
    assert [(r.doc_id, r.decoded) for r in rows] == [(1, ""), (2, ""), (3, "it's\n ok"), (3, "it's\n ok")]
    assert list(rows[2].tokens) == library.encode("it's\n ok").ids
    assert bpe.digests(df.limit(0)).count() == 0
    r = bpe.digests(df).collect()
    assert r[0].n_tokens == 0 and r[0].ids_sha256 == r[1].decoded_sha256
