import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_jaccard import brute as groups_of
from test_templates import brute as lines_of
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "wh", "tion", "ou"], "de": ["sch", "ung", "ä", "keit", "ei"]}
    word = lambda k: "".join(rng.choices(parts[k], k=rng.randrange(1, 4)))
    rows = []
    for i in range(160):
        k = rng.choice(list(parts))
        lines = [" ".join(word(k) for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 5))]
        if i % 4 == 0:
            lines.insert(0, f"Page {i} of the archive")
        if i % 9 == 1:
            lines = rows[-1][1].split("\n")[:-1] + [rows[-1][1].split("\n")[-1] + " end"]
        rows.append((i, "\n".join(lines), k, f"s{i % 3}", 0))
    rows += [(500, None, "en", "s1", 0), (501, "12 - 3", None, None, 0), (502, "the wh", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "lines", "copies", "mix", "tokens"]

    one = steps["language"](spark, docs, "")
    assert one.columns == docs.columns and {r[0] for r in rows} - {r.doc_id for r in one.collect()} == {500, 501}
    kept = [(r.doc_id, r.text) for r in one.collect()]
    two = steps["lines"](spark, one, "")
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted((d, t) for d, t, *_ in lines_of(kept))
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = steps["copies"](spark, two, "")
    texts = [(r.doc_id, r.text) for r in two.collect()]
    want = {d for d, _, c in groups_of(texts, 5, 80) if d == c}
    assert {r.doc_id for r in three.collect()} == want and len(want) < len(texts)
    four = steps["mix"](spark, three, "").collect()
    size, taken = Counter(), Counter()
    for r in three.collect():
        size[r.source] += len(r.text.split())
    for r in four:
        taken[r.source] += len(r.text.split())
    assert sum(taken.values()) in range(sum(size.values()) - 3, sum(size.values()) + 4)
    five = steps["tokens"](spark, spark.createDataFrame(four, docs.schema), "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = Counter((r.doc_id, tuple(r.tokens)) for r in five)
    assert by == Counter((r.doc_id, tuple(library.encode(r.text).ids)) for r in four)

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
