import random
import re
from collections import Counter, defaultdict

from strandloom.llm import templates


def brute(rows, min_docs=3, similar=60, leading=3):
    words = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    leaves = defaultdict(lambda: defaultdict(list))
    for d, text in rows:
        for w in {words(x) for x in (text or "").split("\n")} - {()}:
            leaves[len(w), w[:leading]][w].append(d)
    drop = {}
    for kinds in leaves.values():
        at = Counter()
        for w, ds in kinds.items():
            for i, x in enumerate(w):
                at[i, x] += len(ds)
        own = [w for w in kinds if 100 * sum(at[i, x] >= min_docs for i, x in enumerate(w) if i >= leading) >= similar * max(0, len(w) - leading)]
        ds = [d for w in own for d in kinds[w]]
        if len(ds) >= min_docs and any(d is not None for d in ds):
            drop |= {w: min(d for d in ds if d is not None) for w in own}
    out = []
    for d, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if words(x) not in drop or drop[words(x)] == d]
        out.append((d, None if text is None else "\n".join(kept), sum(bool(words(x)) for x in all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("the of and ing tion ou er an wh sh".split())
    passage = [word() + word() for _ in range(40)]
    rows = []
    for i in range(150):
        lines = [" ".join(word() + word() for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(6))]
        if rng.random() < 0.3:
            own = list(passage)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(3, 40)] = word()
            lines.append(" ".join(own))
        if rng.random() < 0.3:
            lines.append(f"  Page {rng.randrange(99)} of\t{rng.randrange(99)}  ")
        if rng.random() < 0.2:
            lines += ["All rights reserved", "All rights reserved", ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "All rights reserved\nown"), (None, "x"), (903, "a$1b " + "q" * 50_000), (904, "All rights reserved"), (904, "All rights reserved"), (905, "x\r\nAll rights reserved\r\n")]
    df = spark.createDataFrame([(*r, "l", 1) for r in rows], "doc_id long, text string, line string, n_lines int")
    got = templates.drop_lines(df)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert found == brute(rows)
    assert any(r[3] for r in found)


def test_empty(spark):
    assert templates.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d")] * 4, "doc_id long, text string")
    assert [r.n_dropped for r in templates.drop_lines(df).collect()] == [0] * 4


def test_long_lines_of_two_documents(spark):
    """Lines of more than 50 words take two documents, exact or varied; shorter ones take three."""
    of = lambda k, n: [f"{k}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n)]
    exact, short, varied, other = of("x", 51), of("y", 50), of("z", 60), of("q", 60)
    changed = [w if i not in (7, 40) else "changed" for i, w in enumerate(varied)]
    lone = varied[:3] + other[3:]
    rows = [(1, "\n".join(" ".join(x) for x in (exact, varied, short))), (2, "\n".join(" ".join(x) for x in (["own", "line"], exact, changed))), (3, "\n".join(" ".join(x) for x in (short, lone))), (4, " ".join(other) + "\n" + " ".join(other))]
    rows += [(5, f"{' '.join(of('p', 55))} 7"), (None, f"{' '.join(of('p', 55))} 8"), (None, " ".join(of("n", 55)))]
    got = templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {r.text for r in got}
    assert text == {rows[0][1], "own line", rows[2][1], rows[3][1], rows[4][1], "", rows[6][1]}
    at = {n > 50: brute([(d, "\n".join(x for x in (t or "").split("\n") if (len(x.split()) > 50) == (n > 50))) for d, t in rows], 2 if n > 50 else 3) for n in (50, 51)}
    assert sum(r.n_dropped for r in got) == sum(r[3] for b in at.values() for r in b) == 3


def test_helper_names_as_columns(spark):
    text = "Page 1 of the archive\nown line here"
    rows = [(i, text.replace("1", str(i)) + str(i), i, i, i, i, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw_ int, own_ int, gone_id int, gone_lines int, kept_text int, n_lines_ int")
    got = sorted(map(tuple, templates.drop_lines(df).collect()))
    assert [r[2:8] for r in got] == [(i,) * 6 for i in range(4)] and [r[-1] for r in got] == [0, 2, 2, 2] and got[1][1] == ""
