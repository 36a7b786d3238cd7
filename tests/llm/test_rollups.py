import pytest
from strandloom.llm import rollups


def test_batches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, None, "en"), (3, "c", "s", None), (3, "c", "s", None)], "doc_id long, text string, source string, lang string")
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    words = rollups.counted(docs, "words/1")
    assert r.commit("one/1", rollups.inserts(words))
    want = {("s", "en"): (1, 2), (None, "en"): (1, 0), ("s", None): (2, 2)}
    state = lambda: {(x.source, x.lang): (x.documents, x.tokens) for x in r.totals().where("tokenizer = 'words/1'").collect()}
    assert state() == want
    assert not r.commit("one/1", rollups.inserts(words)) and state() == want
    moved = docs.where("doc_id = 1").selectExpr("doc_id", "'x y z' as text", "'t' as source", "lang")
    r.commit("two", rollups.revisions(words.where("doc_id = 1"), rollups.counted(moved, "words/1")))
    want = {("t", "en"): (1, 3), (None, "en"): (1, 0), ("s", None): (2, 2)}
    assert state() == want
    r.compact()
    assert state() == want and not r.commit("two", rollups.inserts(words))
    r.commit("three", rollups.deletes(words.where("doc_id = 3")))
    assert rollups.Rollup(spark, f"file://{tmp_path}/r").commit("three", rollups.inserts(words)) is False
    assert state() == {("t", "en"): (1, 3), (None, "en"): (1, 0)}
    r.compact()
    assert len(r.bases()) == 2 and state() == {("t", "en"): (1, 3), (None, "en"): (1, 0)}
    with pytest.raises(KeyError):
        rollups.counted(docs, "none")


def test_data_without_marker_count_for_nothing(spark, tmp_path):
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    spark.createDataFrame([("s", "en", "w", 1, 1)], rollups.SCHEMA).write.parquet(f"{tmp_path}/r/data/lost")
    assert r.totals().count() == 0
    assert r.commit("empty", spark.createDataFrame([], "source string, lang string, tokenizer string, sign int, tokens long")) and r.totals().count() == 0


def test_tokens_are_the_library_s(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    texts = ["The cat, isn't it?\n\n 42  ", None, "", "été über 日本 😀 <|endoftext|>", "a" * 3000 + " b"]
    docs = spark.createDataFrame([(i, t, "s", "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, tokens int")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in rollups.counted(docs, "byte_bpe_50k").collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.tokens for r in rollups.counted(docs, "byte_bpe_multi_50k").collect()}
    assert got == {i: len(other.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_query_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from strandloom.llm import queries
    from tokenizers import Tokenizer

    assert public_tokenizers
    rows = [(1, "the cat", "a", "en"), (2, "the cat", "b", "de"), (2, "the cat", "b", "de"), (None, "the cat", "a", "en"), (3, "el gato", None, "es"), (4, None, "a", None), (5, "", "a", None), (None, "x y z", "b", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for d, t, s, g in rows:
        order = (d is None, d if d is not None else 0, s is not None, s or "", g is not None, g or "")
        if (t or "") not in kept or order < kept[t or ""][0]:
            kept[t or ""] = (order, s, g)
    want = {}
    for text, (_, source, lang) in kept.items():
        foreign = lang not in (None, "en")
        for version, n in (("words/1", len(text.split())), ("byte_bpe_multi_50k" if foreign else "byte_bpe_50k", len(rollups.vocabulary(rollups.TOKENIZERS["byte_bpe_multi_50k" if foreign else "byte_bpe_50k"]).encode_ordinary(text)))):
            documents, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = documents + 1, tokens + n
    assert Tokenizer
    assert {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in queries.op8_token_counts(spark, str(tmp_path)).collect()} == want


def test_commits_beside_a_compaction(spark, tmp_path, monkeypatch):
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    row = lambda n: spark.createDataFrame([("s", "en", "words/1", 1, n)], "source string, lang string, tokenizer string, sign int, tokens long")
    r.commit("one", row(10))
    sources = r.sources

    def late():
        found = sources()
        if not r.bases() and len(r.names()) == 1:  # a batch comes after the compaction has looked
            rollups.Rollup(spark, r.path).commit("two", row(10))
        return found

    monkeypatch.setattr(r, "sources", late)
    r.compact()
    assert [(x.documents, x.tokens) for x in rollups.Rollup(spark, r.path).totals().collect()] == [(2, 20)]
