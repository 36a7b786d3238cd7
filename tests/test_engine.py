import gzip
import random

import pytest
from pyspark.sql import functions as F
from strandloom.functions import alphabet, ids
from strandloom.functions import text as X
from strandloom.operators import coords, families, lint, msa, pairwise, records, sites
from strandloom.sources import files, writers


def alignment(spark, *seqs, name="a"):
    return spark.createDataFrame([(name, i, i == 0, s) for i, s in enumerate(seqs)], "msa_id string, row_idx int, is_reference boolean, seq string")


def called(spark, *seqs):
    return msa.consensus(alignment(spark, seqs[0], *seqs)).head()["consensus"]


def test_scores():
    assert alphabet.consensus_score("A", "A") == 9 and alphabet.consensus_score("-", "-") == 3 and alphabet.consensus_score("N", "N") == -1
    assert alphabet.consensus_score("X", "Z") == -3 and alphabet.site_score("T", "K") == -3 and len(alphabet.score_rows()) == 324


def test_consensus(spark):
    assert called(spark, "CG", "CG", "CG") == "CG"
    assert called(spark, *["TG"] * 3, *["CA"] * 3, *["CG"] * 2) == "CG"
    assert called(spark, *["AC"] * 4) != "CG"
    assert called(spark, *["T-G"] * 3, *["C-A"] * 3) == "C-G"
    assert called(spark, "A  ", "A--") == "ANN"


def sequential(rows):
    """The consensus pair by pair, each seeing what the one before wrote."""
    import re

    rows = [re.sub("^[^A-Z]*|[^A-Z]*$", lambda m: m[0].replace("-", " "), r) if re.search("[A-Z]", r) else " " * len(r) for r in rows]
    score = lambda c, o: alphabet.consensus_score(c, o if o in alphabet.LETTERS else "N")
    out = []
    for i in range(len(rows[0])):
        own = [r[i] for r in rows if r[i] in alphabet.LETTERS]
        best = max(alphabet.LETTERS, key=lambda c: (sum(score(c, o) for o in own), c == "N", -alphabet.LETTERS.index(c)))
        out.append(best)
    kept = [i for i, c in enumerate(out) if c != "-"]
    for i, k in zip(kept, kept[1:]):
        dn = cg = 0
        for r in rows:
            a, b = r[i], r[k]
            if " " in (a, b):
                continue
            dn += score(out[i], a) + score(out[k], b)
            cg += {"CA": 12, "TG": 12, "TA": -5, "TC": 2 + score("G", b), "TT": 2 + score("G", b), "AA": 2 + score("C", a), "GA": 2 + score("C", a)}.get(a + b, score("C", a) + score("G", b))
        if cg > dn:
            out[i], out[k] = "C", "G"
    return "".join(out)


def test_consensus_against_the_sequential_form(spark):
    rng = random.Random(3)
    data, want = [], {}
    for m in range(150):
        width = rng.randrange(2, 9)
        rows = ["".join(rng.choices("ACGTCGTG-NR", k=width)) for _ in range(rng.randrange(1, 7))]
        data += [(str(m), i, i == 0, s) for i, s in enumerate([rows[0], *rows])]
        want[str(m)] = sequential(rows)
    got = {r.msa_id: r.consensus for r in msa.consensus(spark.createDataFrame(data, "msa_id string, row_idx int, is_reference boolean, seq string")).collect()}
    assert got == want


def against(spark, cons, obs):
    rows = alignment(spark, cons, obs)
    letters = msa.cells(rows.where("is_reference")).select("msa_id", "col", F.col("base").alias("letter"))
    return msa.divergence(rows, letters).head()


def test_divergence(spark):
    assert against(spark, "ACGT", "ACGT").kimura == 0
    r = against(spark, "AAAA", "GGGG")
    assert r.ti == 4 and r.kimura != r.kimura
    r = against(spark, "ACGX", "ATAX")
    assert (r.ti, r.ti_adjusted, r.cpg_sites) == (2, 1.0, 1)
    r = against(spark, "ACGX", "ATGX")
    assert (r.ti, r.ti_adjusted, r.cpg_sites) == (1, 0.1, 1)


def test_profiles(spark):
    rows = alignment(spark, "ACG", "ACG", "A  ")
    assert [r.coverage for r in msa.coverage(rows).orderBy("col").collect()] == [2, 1, 1]
    rows = alignment(spark, "ACGT-ACGT", "ACGT-ACGT", "ACGT-TTTT")
    assert "".join(r.mark for r in msa.conservation(rows).orderBy("col").collect()) == "****    *"
    assert msa.profile(rows.limit(0)).count() == 0 and msa.consensus(rows.limit(0)).count() == 0
    assert msa.mean_divergence(against_frame(spark)).head().kimura == 0


def against_frame(spark):
    return spark.createDataFrame([("a", float("nan"), 0.0)], "msa_id string, kimura double, kimura_adjusted double")


def test_segments():
    assert msa.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 0, 4), (2, 2, 3), (4, 10, 7)]
    assert [(a, b) for a, b, _ in msa.maximal_segments([5, 5, -100, 5, 5])] == [(0, 1), (3, 4)]
    assert msa.maximal_segments([-1, 0]) == []


def test_column_edits(spark):
    rows = alignment(spark, "AC-GT", "AC-GT", "  -GT")
    texts = lambda df: [r.seq for r in df.orderBy("row_idx").collect()]
    assert texts(msa.trim(rows, 1, 1)) == ["C-G", "C-G", " -G"]
    assert texts(msa.slice_columns(rows, F.lit(0), F.lit(2))) == ["AC", "AC"]
    assert texts(msa.reverse(rows))[0] == "AC-GT"
    assert texts(msa.min_length(rows, 3)) == ["AC-GT", "AC-GT"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("myasm:mychr:4-43_-", ("myasm", "mychr", 4, 43, "-", "V2")),
        ("seq2:10-7", (None, "seq2", 7, 10, "-", "V1")),
        ("seq2_7_10_R", (None, "seq2", 7, 10, "-", "V0")),
        ("Seq3_6_45_R_26_40_12_15_R", (None, "Seq3", 6, 9, "+", "V0")),
        ("Seq3:45-6:26-40:15-12", (None, "Seq3", 6, 9, "+", "V1")),
        ("Seq3:6-45_-:26-40_+:12-15_-", (None, "Seq3", 6, 9, "+", "V2")),
        ("seq1", (None, "seq1", None, None, None, "Undefined")),
        ("seq1:1", ("seq1", "1", None, None, None, "Undefined")),
        ("seq2_7_10_-", (None, "seq2_7_10_-", None, None, None, "Undefined")),
        ("", (None,) * 6),
    ],
)
def test_identifiers(name, want):
    assert ids.parse(name) == want


def test_identifier_columns(spark):
    names = ["myasm:mychr:4-43_-", "seq2:10-7", "seq2_7_10_R", "seq1", "a:b", None, "Seq3:45-6:26-40:15-12"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("p", ids.parsed(F.col("n")))
    assert [tuple(r.p) for r in df.collect()] == [ids.parse(n) for n in names]
    one = df.select("n", ids.parsed_single(F.col("n")).alias("s")).limit(6).collect()
    assert [tuple(r.s) if r.s else (None,) * 6 for r in one] == [ids.parse(n) for n in names[:6]]


GENOME = [("g", "one", 60, "ACGTTGCAAGGCTTACCATGGATCCTTAGCGATACAGGTCCATTTGACCAGTAACGTTTCC"), ("g", "two", 40, "TTTTTACGACCATTTGGGCATCGATCGGGATTTACCATAC")]


def coordinate(spark, rows):
    full = [("f", 0, i, n, None, n, s, e, o, "V2", q, None, "", None) for i, (n, s, e, o, q) in enumerate(rows)]
    return spark.createDataFrame(full, files.COORDINATES)


def test_validation_and_remapping(spark):
    g = spark.createDataFrame(GENOME, files.GENOME)
    one, two = GENOME[0][3], GENOME[1][3]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [
        ("one", 11, 24, "+", one[10:24]), ("one", 10, 24, "+", one[10:24]), ("one", 10, 23, "+", one[10:24]), ("one", 14, 27, "+", one[10:24]), ("one", 11, 24, "-", one[10:24]),
        ("one", 9, 22, "+", rc(one[10:24])), ("two", None, None, None, two), ("one", 40, 53, "+", one[10:24]), ("none", 1, 4, "+", two[20:34]), ("two", 1, 12, "+", "NNNNNNNNNNNN"), ("one", 0, 2, "+", "ACG"), ("one", 9, 4, "+", "ACG"),
    ]
    labels = [r.validated for r in coords.validate(coordinate(spark, rows), g).orderBy("rec_order").collect()]
    assert labels == ["valid", "fixed_halfopen", "fixed_plus1", "fixed_minus3", "fixed_orient", "fixed_orient_plus2", "valid", None, None, None, None, None]
    done = {r.rec_order: r for r in coords.curate(coordinate(spark, rows), g, "g").collect()}
    assert (done[7].start, done[7].end, done[7].validated) == (11, 24, "fixed_remapped_unique")
    assert (done[8].sequence_id, done[8].start, done[8].assembly_id) == ("two", 21, "g") and done[9].validated == "invalid"
    assert {r.kind: r.n for r in coords.label_counts(coords.curate(coordinate(spark, rows), g, "g")).groupBy("kind").agg(F.sum("n").alias("n")).collect()}["invalid"] == 1


def test_validation_reads_the_genome_once(spark):
    """Drawn records about the ends of chunks and chromosomes, held against plain Python; the genome is read once for all of them, and once more for sequences too long for a chunk."""
    draw = random.Random(15)
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole = {f"c{n}": "".join(draw.choices("ACGT", k=n)) for n in (1, 5, 40, 4096, 4100, 13000, 40000)} | {"c0": ""}
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def wanted(name, s, e, o, q):
        half = s is not None and e - s == len(q)
        b = s + 1 if half else s
        if name not in whole:
            return s, e, o, None
        if s is None:
            return s, e, o, "valid" if q == whole[name] else None
        for d in (0, -3, -2, -1, 1, 2, 3) if b >= 1 and e - b + 1 == len(q) > 0 else ():
            piece = whole[name][b + d - 1 : e + d]
            if b + d >= 1 and e + d <= len(whole[name]) and piece in (q, turned(q)):
                strand = "+" if piece == q else "-"
                strand = o if d == 0 and (piece == turned(piece) or strand == o) else strand
                label = ("_halfopen" if half else "") + ("" if strand == o else "_orient") + (f"_minus{-d}" if d < 0 else f"_plus{d}" if d else "")
                return b + d, e + d, strand, f"fixed{label}" if label else "valid"
        return b, e, o, None

    rows = [(n, None, None, None, q) for n, q in whole.items() if len(q) < 16000] + [("c4096", None, None, None, whole["c4100"][:4096]), (None, 3, 6, "+", "ACGT"), ("none", 70000, 70004, "+", "ACGT"), ("c40", 70000, 70004, "+", "ACGT"), ("c0", 1, 4, "+", "ACGT"), ("c0", 5000, 5004, "-", "ACGT"), ("c40", 5, 9, "+", None)]
    for _ in range(600):
        name = draw.choice(list(whole))
        size, edge = draw.choice([1, 2, 8, 24, 300]), draw.choice([0, 4096, 8192, 12288, len(whole[name])])
        s = edge + draw.randint(-size - 8, 9)
        q = whole[name][max(s - 1, 0) : max(s - 1, 0) + size] if draw.random() < 0.9 else "".join(draw.choices("ACGT", k=size))
        off = draw.choice([0, 0, -4, -3, -2, -1, 1, 2, 3, 4])
        rows.append((draw.choice([name] * 9 + ["none"]), s + off - draw.choice([0, 0, 1]), s + off + len(q) - 1, draw.choice("+-"), draw.choice([q, turned(q)])))
    far = [("c40000", 11, 20010, "+", whole["c40000"][10:20010]), ("c40000", 13, 20013, "-", whole["c40000"][10:20010]), ("c40000", None, None, None, whole["c40000"]), ("c13000", 1, 16400, "+", "A" * 16400)]
    g = spark.createDataFrame([("g", n, len(q), q) for n, q in whole.items()], files.GENOME)
    g = g.mapInArrow(counted, g.schema)
    for own, reads in ((rows, 1), (rows + far, 2)):
        before = seen.value
        got = coords.validate(coordinate(spark, own), g).orderBy("rec_order").select("start", "end", "orient", "validated").collect()
        assert [tuple(r) for r in got] == [wanted(*r) if r[4] is not None else (*r[1:4], None) for r in own]
        assert seen.value - before == reads * len(whole)


def test_claims(spark):
    """Equal sequences take the nearest free places in order."""
    g = spark.createDataFrame([("g", "c", 33, "AATTTGGTTTCCGTTTAAAAACCCCGGGGAACC")], files.GENOME)
    rows = [("c", 30, 32, "+", "TTT")] * 4
    got = [(r.start, r.validated) for r in coords.curate(coordinate(spark, rows), g, drop_duplicates=True).orderBy("rec_order").collect()]
    assert got == [(s, "fixed_remapped_ambig") for s in (19, 18, 17, 14)]
    one = [(r.start, r.validated) for r in coords.curate(coordinate(spark, rows * 2), g, drop_duplicates=True).orderBy("rec_order").collect()]
    assert one[4:] == [(8, "fixed_remapped_ambig"), (3, "fixed_remapped_ambig"), (30, "removed_remapped_duplicate"), (30, "removed_remapped_duplicate")]


def test_claims_after_a_join_changed_at_run_time(spark):
    """All records of a sequence claim in one task, also where a shuffled join turns out to be a broadcast."""
    draw = random.Random(4)
    words = ["".join(draw.choices("ACGT", k=20)) for _ in range(40)]
    g = spark.createDataFrame([("g", f"c{i}", 120, w * 6) for i, w in enumerate(words)], files.GENOME)
    rows = coordinate(spark, [("none", None, None, None, w) for _ in range(6) for w in words])
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = coords.remap(rows.repartition(4), g).select("sequence_id", "start").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted((f"c{i}", 20 * j + 1) for i in range(40) for j in range(6))


def test_occurrences_by_both_joins(spark, monkeypatch):
    g = spark.createDataFrame(GENOME, files.GENOME)
    p = spark.createDataFrame([("CCATTTG",), ("TT",), ("GGATCC",), ("",), (GENOME[0][3],)], "pattern string")
    monkeypatch.setattr(coords, "CHUNK", 16)
    want = set()
    for _, chrom, _, seq in GENOME:
        for q in ("CCATTTG", "TT", "GGATCC", GENOME[0][3]):
            for strand, w in (("+", q), ("-", q[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                want |= {(q, chrom, i, strand) for i in range(len(seq)) if seq.startswith(w, i)}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(coords, "BROADCAST", limit)
        assert {tuple(r) for r in coords.occurrences(p, g).collect()} == want


def test_many_patterns_shuffle_few_places(spark, monkeypatch):
    """Patterns too many to be broadcast: the places that are joined are not all of the genome, and long patterns are compared in full."""
    draw = random.Random(9)
    seqs = ["".join(draw.choices("ACGT", k=n)) for n in (70000, 300, 5)]
    g = spark.createDataFrame([("g", f"c{i}", len(s), s) for i, s in enumerate(seqs)], files.GENOME)
    words = [seqs[0][65500:65524], seqs[0][65530:65700], seqs[0][10:190] + "A", seqs[1][:16], seqs[1][40:64], "ACGTACGTACGTACGTACGTACGT"]
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {(w, f"c{c}", i, o) for c, s in enumerate(seqs) for w in words for o, x in (("+", w), ("-", turned(w))) for i in range(len(s)) if s.startswith(x, i)}
    seen, real = [], coords.sifted
    monkeypatch.setattr(coords, "BROADCAST", 0)
    monkeypatch.setattr(coords, "sifted", lambda *a: seen.append(real(*a)) or seen[-1])
    got = coords.occurrences(spark.createDataFrame([(w,) for w in words], "pattern string"), g)
    assert {tuple(r) for r in got.collect()} == want and seen[0].count() < 100


STOCKHOLM = """# STOCKHOLM 1.0
#=GF ID   One
#=GF DE   A family
#=GF AU   Smith J; ORCID:0000-0001-2345-678X Anna Smith
#=GF RT   Title
#=GF RN   [1]
#=GF SQ   3
#=GC RF   ACg.T
chr:10-14_+  ACg-T
chr:10-14_+  AC*.T
other        ACG
//
# STOCKHOLM 1.x
#=GF ID 123
#=GF AC DF0000001.2
#odd
a_1_3  ACG

b_1_3  ACG
"""


def test_stockholm(spark, tmp_path):
    (tmp_path / "a.sto").write_text(STOCKHOLM)
    (tmp_path / "b.sto.gz").write_bytes(gzip.compress(STOCKHOLM.encode()))
    both = files.stockholm(spark, str(tmp_path))
    assert both.count() == 4
    one, two = files.stockholm(spark, f"{tmp_path}/a.sto").orderBy("record_num").collect()
    assert [r.original_id for r in one.sequences] == ["chr:10-14_+", "chr:10-14_+", "other"] and one.sequences[0].seq_start == 10 and one.terminated
    assert not two.terminated and two.block_separator_line == 18 and two.unknown_annotations == ["#odd"]
    again = files.stockholm(spark, f"{tmp_path}/a.sto").where("record_num = 1").select(writers.stockholm_text().alias("t")).head().t
    (tmp_path / "c.sto").write_text(again)
    three = files.stockholm(spark, f"{tmp_path}/c.sto").head()
    assert (three.gf, three.gc, three.sequences) == (one.gf, one.gc, one.sequences)
    found = {(r.record_num, r.severity, r.check) for r in lint.lint(files.stockholm(spark, f"{tmp_path}/a.sto")).collect()}
    for want in [
        (1, "ERROR", "missing_required_field"), (1, "ERROR", "au_format"), (1, "WARN", "ref_block_incomplete"), (1, "ERROR", "ref_block_order"), (1, "ERROR", "seq_invalid_chars"), (1, "WARN", "seq_nonstandard_gap"),
        (1, "ERROR", "rf_length_mismatch"), (2, "ERROR", "invalid_header"), (2, "ERROR", "missing_terminator"), (2, "ERROR", "block_format"), (2, "ERROR", "id_numeric"), (2, "ERROR", "unknown_annotation"),
        (None, "INFO", "ac_update_records"), (None, "INFO", "seqid_legacy_format"), (None, "WARN", "citation_fields_unused"),
    ]:
        assert want in found, want
    assert (2, "ERROR", "rf_missing") not in found and (1, "ERROR", "sq_mismatch") not in found
    edits = records.Edits(delete=["DE"], set=[("ID", "New"), ("CT", "handbuilt")], append=[("CC", "x")], sub=[("ID", "/e(.)/$1E/")])
    done = records.edit(files.stockholm(spark, f"{tmp_path}/a.sto"), edits, "1").orderBy("record_num").collect()
    assert [(g.tag, g.value) for g in done[0].gf] == [("ID", "NwE"), ("AU", "Smith J; ORCID:0000-0001-2345-678X Anna Smith"), ("RT", "Title"), ("RN", "[1]"), ("SQ", "3"), ("CT", "handbuilt"), ("CC", "x")]
    assert [(g.tag, g.value) for g in done[1].gf][1] == ("AC", "DF000000001.2") and done[0].sequences[0].aligned_seq == "ACg.T"


def test_other_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">ref\nAC-G\nT\n>x:9-5 note\nACCGT\n")
    rows = files.msa(spark, f"{tmp_path}/a.fa").orderBy("row_idx").collect()
    assert [(r.name, r.seq, r.is_reference) for r in rows] == [("ref", "AC-GT", True), ("x:9-5 note", "ACCGT", False)]
    (tmp_path / "a.aln").write_text("CLUSTAL W\n\na  ACg-\nb  ACGT\n   ** \n\na  TT\nb  TA\n")
    assert [r.seq for r in files.msa(spark, f"{tmp_path}/a.aln").orderBy("row_idx").collect()] == ["ACG-TT", "ACGTTA"]
    (tmp_path / "a.ig").write_text("; c\nfirst\nAC\nGT\n; FRAGMENT 9 -> 5\nsecond\nACGT\n")
    got = files.msa(spark, f"{tmp_path}/a.ig").orderBy("row_idx").collect()
    assert [(r.name, r.seq, r.seq_start, r.orient) for r in got] == [("first", "ACGT", 0, "+"), ("second", "ACGT", 5, "-")]
    (tmp_path / "a.2bit").write_bytes(files.twobit_bytes([("c1", "ACGTNNNAC"), ("c2", "T")], ">"))
    assert {(r.assembly, r.chrom, r.length, r.seq) for r in files.genome(spark, f"{tmp_path}/a.2bit").collect()} == {("a", "c1", 9, "ACGTNNNAC"), ("a", "c2", 1, "T")}
    assert files.genome_range(spark, f"{tmp_path}/a.2bit", "c1", 2, 6).head().seq == "GTNN"
    (tmp_path / "a.tab").write_text("# c\n30\tq\t1\t4\t4\tminus\ts\t8\t5\t9\tACGT\tACGT\nshort\n")
    assert files.blast(spark, f"{tmp_path}/a.tab").head().orientation == "-"
    (tmp_path / "a.align").write_text(" 239 29.42 1.92 0.97 q 1 4 (8) C s (2) 9 6 x\n\n  q 1 AC-T 3\n      v\nC s 9 ACGT 6\n\nGap_init rate\n")
    r = files.pairwise(spark, f"{tmp_path}/a.align").head()
    assert (r.sw_score, r.orientation, r.subj_start, r.subj_end, r.query_seq, r.subj_seq) == (239, "-", 6, 9, "AC-T", "ACGT")
    (tmp_path / "a.family").write_text(";ID X1 rest\n;DE a\n;DE b.\n;KW LINE; Transposable Element; z.\n;RN [1]\n;RA A\n;RL RR 3(2) (01-JAN-2000)\n;SQ x\nX1\nACG\nTT\n")
    f = files.ig_family(spark, f"{tmp_path}/a.family")
    r = f.head()
    assert (r.id, r.description, r.keywords, r.consensus) == ("X1", "a b.", ["LINE", "Transposable Element", "z"], "ACGTT")
    classes = spark.createDataFrame([("line; transposable element", "LINE", 0)], "key string, class string, place int")
    rows = spark.createDataFrame([("X1", 0, True, "X1", "ACGTT", 0, 0, "+"), ("X1", 1, False, "c", "AC-TT", 3, 6, "-")], "msa_id string, row_idx int, is_reference boolean, name string, seq string, seq_start long, seq_end long, orient string")
    rec = families.to_records(families.classified(f, classes), rows).head()
    assert [(g.tag, g.value) for g in rec.gf] == [("ID", "X1"), ("DE", "a b."), ("TP", "LINE"), ("AU", "A"), ("**", "submitted 01-JAN-2000"), ("SQ", "1")] and rec.sequences[0].aligned_seq == "AC.TT"
    assert files.sniff(b";AC x") == "ig_family" and files.sniff_coordinates(b"a\tACG\n") == ("tsv", False)
    (tmp_path / "c.fa").write_text(">seq2_7_10   : note\nAA.AT\n")
    c = files.coordinates(spark, f"{tmp_path}/c.fa")
    assert (c.head().sequence, c.head().metadata, c.head().start) == ("AAAT", "   : note", 7)
    assert c.select(writers.coordinates_fasta().alias("t")).head().t == ">seq2:7-10_+   : note\nAAAT"


def test_pairwise_of_many_hits_by_plain_python(spark):
    """Hits with gaps in common, insertions anywhere and other alphabets, laid as plain Python lays them."""
    draw = random.Random(7)
    hits = []
    for ref in ("a", "b\u00e9"):
        genome = "".join(draw.choices("ACGT" if ref == "a" else "AC\u00c9T", k=30))
        for k in range(40):
            start = draw.randrange(0, 20) if k else 0
            top, own = "", ""
            for base in genome[start : draw.randrange(start + 1, 31) if k else 30]:
                more = draw.choices("ACGT-", k=draw.choice([0, 0, 0, 1, 3]))
                top, own = top + "-" * len(more) + base, own + "".join(more) + draw.choice("ACGT-")
            hits.append((ref, len(hits), start + 1, top, f"h{len(hits)}", 1, 9, "+", own))
    want = []
    for ref in ("a", "b\u00e9"):
        cut = []
        for h in (h for h in hits if h[0] == ref):
            at, ins, letters = h[2], {}, {}
            for t, o in zip(h[3], h[8]):
                if t != "-":
                    letters[at] = o
                    at += 1
                elif o != "-":
                    ins[at] = ins.get(at, "") + o
            cut.append((h, ins, letters))
        room = {p: max(len(i.get(p, "")) for _, i, _ in cut) for p in range(1, 32)}
        for h, ins, letters in cut:
            inside = range(min(letters), max(letters) + 2)
            want.append((ref, h[4], "".join((ins.get(p, "").ljust(room[p], "-") if p in inside else " " * room[p]) + (letters.get(p, " ") if p < 31 else "") for p in range(1, 32))))
    df = spark.createDataFrame(hits, "ref string, hit_no int, ref_start int, ref_seq string, name string, start int, end int, orient string, seq string")
    got = pairwise.merge(df.repartition(3)).where("row_idx > 0").orderBy("ref", "row_idx").select("ref", "name", "seq").collect()
    assert list(map(tuple, got)) == want


def test_pairwise(spark):
    hits = spark.createDataFrame(
        [("r", 1, 1, "AC-GT", "a", 1, 5, "+", "ACTGT"), ("r", 2, 3, "GTA--C", "b", 1, 6, "-", "G-ATTC")],
        "ref string, hit_no int, ref_start long, ref_seq string, name string, start long, end long, orient string, seq string",
    )
    assert [r.seq for r in pairwise.merge(hits).orderBy("row_idx").collect()] == ["AC-GTA--C", "ACTGT    ", "  -G-ATTC"]
    with pytest.raises(Exception, match="no hit covers"):
        pairwise.merge(hits.withColumn("ref_start", F.when(F.col("hit_no") == 2, 9).otherwise(1).cast("long"))).collect()
    blast = spark.createDataFrame([(1, "q", 1, 4, 8, 5, "-", "AC-T", "AGGT")], "hit_no int, qseqid string, qstart long, qend long, sstart long, send long, orientation string, qseq string, sseq string")
    assert pairwise.project(blast, 10).head().seq == "    A-GT  "


def test_tables_and_names(spark):
    assert abs(lint.jaro("martha", "marhta") - 0.961111) < 1e-6 and lint.jaro("abc", "xyz") == 0
    words = spark.createDataFrame([("Homo sapiens",), ("Hordeum",)], "name string")
    got = lint.similar_names(spark.createDataFrame([("Homo sapien",)], "name string"), words).collect()
    assert [r.candidate for r in got] == ["Homo sapiens"]


@pytest.mark.parametrize("offset", [0, 2, 5])
def test_sites(spark, offset):
    # An element of which `offset` bases at both ends belong to the site ATTAA; the other letters of the two windows never agree
    left, right = list("C" * 20), list("G" * 20)
    left[10 - 5 + offset : 10 + offset] = "ATTAA"
    right[10 - offset : 15 - offset] = "ATTAA"
    windows = spark.createDataFrame([("".join(left), "".join(right))] * 3 + [(None, None)], "left string, right string")
    scores = sites.site_scores(windows, 10)
    assert scores.count() == 65
    best = sites.best_site(scores).head()
    assert (best.length, best.offset) == (5, offset) and best.average == int(3 * 9 + 3 * 6.9 + 0.5)
    letters = sites.site_letters(windows, 5, offset, 10)
    assert letters.count() == 30
    assert "".join(r.letter for r in sites.site_consensus(letters).orderBy("pos").collect()) == "ATTAA"


def test_site_report(spark):
    chrom = "C" * 10 + "ATTAA" + "CCCCCCGGGGGG" + "ATTAA" + "G" * 10
    genome = spark.createDataFrame([("c", len(chrom), chrom)], "chrom string, length long, seq string")
    rows = spark.createDataFrame([(1, "c", "CCCCCC-GGGGGG", 16, 27, "+"), (2, "d", "CCCCCC-GGGGGG", 16, 27, "+")], "row_idx int, name string, seq string, seq_start long, seq_end long, orient string")
    report = writers.site_report(sites.flanks(rows, genome, 13), 10, edge=4)
    lines = [(r.part, r.text) for r in report.orderBy("part", "row_idx").collect()]
    assert len(lines) == 15, lines
    assert (1, "best: length=5, offset=0 (outside the alignment)") in lines, lines[10:]
    assert lines[-4:-2] == [(2, "ATTAA\nATTAA"), (3, "ATTAA")]
    assert lines[-1] == (4, "c:16-27_+  cccccATTAA CCCC ... GGGG ATTAAggggg")
    assert writers.site_report(sites.flanks(rows, genome, 13), 10, scores_only=True).count() == 11
    assert writers.site_report(sites.flanks(rows.where("row_idx = 2"), genome, 13), 10).count() == 0


def test_windows_and_rows_are_cut_in_batches(spark, tmp_path):
    """No function on strings is left that walks whole texts letter by letter in rows: the plans cut them in Arrow."""
    from strandloom.plans import derive

    docs = [(i, "s", "Ab c" * n) for i, n in enumerate((0, 10, 40, 300))]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for made in (derive.windows(spark, str(tmp_path)), derive.alignments(spark, str(tmp_path))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "translate(" not in plan and "explode" not in plan
    assert derive.alignments(spark, str(tmp_path)).where("is_reference").select("msa_id", "row_idx").count() == 23


def test_site_scores_by_brute_force(spark):
    import random

    rng = random.Random(4)
    drawn = [tuple("".join(rng.choice("ACGTNacgt-R") for _ in range(12)) for _ in range(2)) for _ in range(20)]
    windows = spark.createDataFrame(drawn, "left string, right string")
    pairs = spark.createDataFrame([(a, b) for a in "ACGTNacgt-R" for b in "ACGTNacgt-R"], "a string, b string")
    score = {(r.a, r.b): r.s for r in pairs.select("a", "b", X.site_pair_score(F.col("a"), F.col("b")).alias("s")).collect()}
    want = {}
    for n in range(1, 7):
        for k in range(n + 1):
            want[n, k] = sum(score[a, b] for left, right in drawn for a, b in zip(left[6 - n + k : 6 + k], right[6 - k : 6 - k + n])) + round(20 * n * 6.9, 1)
    got = {(r.length, r.offset): r.score for r in sites.site_scores(windows, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert sites.site_scores(windows.limit(0), 6).count() == 0


def test_writers(spark):
    rows = spark.createDataFrame([("m", 0, True, "r", "ACGT", 0, 0, "+"), ("m", 1, False, "x", "AC-T", 5, 7, "-")], "msa_id string, row_idx int, is_reference boolean, name string, seq string, seq_start long, seq_end long, orient string")
    assert writers.fasta_text(rows).head().text == ">x:7-5\nAC-T"
    assert writers.msa_stockholm_text(rows).head().text.split("\n")[3:] == ["#=GC RF   ACGT", "x:5-7_-   AC.T", "//"]
    assert "AC-T" in writers.clustal_text(rows).head().text and "****" in writers.clustal_text(rows).head().text
    view = writers.view_text(rows, msa.consensus_letters(rows)).head().text
    assert "consensus" in view
    assert writers.statistics_text(msa.statistics(rows)).count() == 1


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).head().v
    assert one(X.reverse_complement(F.lit("ACgN"))) == "NgGT" and one(X.reverse_complement_iupac(F.lit("aR.-"))) == "-NYT"
    assert one(X.pad_accession(F.lit(" DF0000001.3 "))) == "DF000000001.3" and one(X.valid_accession(F.lit("DR1234567."))) is True
    assert one(X.assembly_name(F.lit("/x/GCF.1.fa.GZ"))) == "GCF.1" and one(X.normalize_doi(F.lit("https://doi.org/10.1101/1v2"))) == "10.1101/1"
    assert one(X.quoted(F.lit('a"\\\t'))) == '"a\\"\\\\\\t"'
    assert one(records.substituted(F.lit("abab"), "/a/x/")) == "xbab" and one(records.substituted(F.lit("abab"), "|a|x|g")) == "xbxb"
    with pytest.raises(ValueError):
        records.substitution("/a/")


def test_streaming(spark, tmp_path):
    from strandloom.streaming import lint as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.sto").write_text(STOCKHOLM)
    q = stream.findings(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").where("check = 'id_numeric'").count() == 1


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20


@pytest.fixture(scope="module")
def whole_texts(spark, tmp_path_factory):
    """A folder of documents longer than an alignment is wide, and the same in SQL's reach."""
    import duckdb

    at = tmp_path_factory.mktemp("whole")
    rng = random.Random(9)
    docs = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz .\n", k=rng.choice([3, 50, 130, 420, 1300]))), f"src{i % 3}") for i in range(40)] + [(40, "", "src0"), (41, "12", "src1"), (42, "x" * 44, "src2"), (43, "xyzab" * 9, "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    sql = duckdb.connect()
    sql.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    sql.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    return str(at), sql, {i: ("".join(c for c in t if c.isalpha()), s) for i, t, s in docs}


def test_derived_tables_leave_no_letter_out(spark, whole_texts):
    from strandloom.plans import derive

    at, _, docs = whole_texts
    aligned, bases = (dict(zip(derive.ALPHABET, x)) for x in (derive.ALIGNED, derive.BASES))
    rows = {(r.msa_id, r.row_idx): r.seq for r in derive.alignments(spark, at).collect()}
    assert rows == {(f"{s}/{k // 40}", i): "".join(aligned[c] for c in t[k : k + 40]).ljust(40, "-") for i, (t, s) in docs.items() for k in range(0, max(len(t), 1), 40)}
    found = derive.windows(spark, at).collect()
    chunks = []
    for t, _ in docs.values():
        starts = sorted({*range(0, len(t) - 44, 20), len(t) - 45}) if len(t) >= 45 else []
        seen = {x for s in starts for x in (*range(s, s + 20), *range(s + 25, s + 45))}
        assert len(t) < 50 or seen == set(range(len(t)))
        chunks += ["".join(bases[c] for c in t[s : s + 45]) for s in starts]
    assert sorted((r.left, r.right) for r in found if r.reason is None) == sorted((c[:20], c[25:]) for c in chunks)
    assert {r.name.split("+")[0] for r in found if r.reason == "edge"} == {f"c{i}" for i, (t, _) in docs.items() if len(t) < 45}
    planted = derive.records(spark, at).collect()
    assert {(r.file, r.rec_order) for r in planted} == {(f"c{i}", k) for i, (t, _) in docs.items() if len(t) >= 60 for k in range((len(t) - 60) // 400 + 1)}


ALIGNED = "profile coverage consensus_first_pass consensus column_quality conservation kimura_pairs kimura_mean sequence_functions trim slice_columns min_length sub_range trim_ambiguous low_quality_blocks statistics pairwise_merge"
PLACED = "statistics_averages raw_sequences coordinate_scan coord_validate remap_hits remap_ranked remap_claim label_counts tsd_scores tsd_best tsd_consensus blast_projection"


@pytest.mark.parametrize("name", f"{ALIGNED} {PLACED}".split())
def test_registered_sql_of_whole_texts(spark, whole_texts, name):
    from strandloom.plans import registry

    at, sql, _ = whole_texts
    got, want = registry.QUERIES[name](spark, at), sql.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


FAULTS = """# STOCKHOLM 1.0
#=GF ID   rnd-1_family-2
#=GF ID   again
#=GF AC   DF12
#=GF AC   
#=GF DE   LONG
#=GF DE   two
#=GF SE   LONG
#=GF TD   AC9
#=GF CT   robot
#=GF KD   x
#=GF AU
#=GF TP   Nope
#=GF OC   Homo sapien
#=GF RN   [1]
#=GF RD   http://x
#=GF ZZ   what
#=GF SQ   5
#=GC RF   xxx
#=GC MM   mq
#=GC QQ   ...
chr1:2-4_+   CGT
chr1:3-5_+   CGT
chr1:40-42_+ CCC
lost:1-3_+   ACG
//
# STOCKHOLM 1.0
#=GF ID   LONGER
#=GF SQ   many
a  ACGT
b  AC
//
# STOCKHOLM 1.0
#=GF ID   Taken
#=GF SQ   1
#=GC RF   AAA
a  CGC
//
# STOCKHOLM 1.0
#=GF ID   taken
#=GF AC   DF000000001
#=GF SQ   1
#=GC RF   ACG
a  ACG
//
"""


def test_every_check_fires(spark, tmp_path):
    (tmp_path / "a.sto").write_text(FAULTS.replace("LONGER", "I" * 50).replace("LONG", "x" * 90))
    for name, text in (("classes", "# c\nroot;LINE\tLINE\n"), ("taxa", "Homo sapiens\nMus\n"), ("common", "man\tHomo sapiens\n"), ("names", "# n\nTaken\n")):
        (tmp_path / name).write_text(text)
    tables = files.lookup_tables(spark, *(f"{tmp_path}/{n}" for n in ("classes", "taxa", "common", "names")))
    assert {k: sorted(r[0] for r in t.collect()) for k, t in tables.items()} == {"classification": ["LINE", "root;LINE"], "taxonomy": ["Homo sapiens", "Mus"], "common": ["man"], "names": ["taken"]}
    genome = spark.createDataFrame([("g", "chr1", 50, "ACGTACGTAA" * 5)], "assembly string, chrom string, length long, seq string")
    read = files.stockholm(spark, f"{tmp_path}/a.sto")
    found = lint.lint(read, tables, genome)
    fired = {r.check for r in found.collect()}
    want = (
        "ac_format empty_field id_multi_line id_too_long id_automated_name de_multi_line de_too_long se_too_long td_invalid_chars ct_unknown kd_not_numeric rd_format mm_invalid_chars mm_length_mismatch "
        "unknown_gf_tag unknown_gc_tag sq_mismatch sq_not_numeric rf_missing rf_consensus_mismatch seq_length_mismatch tp_unknown oc_unknown id_taken id_taken_update duplicate_id duplicate_id_update automated_name "
        "seq_coord_fixed seq_coord_invalid seq_id_not_in_ref"
    )
    assert set(want.split()) <= fired, set(want.split()) - fired
    text = found.where("check = 'oc_unknown'").select(writers.findings_text().alias("t")).head().t
    assert text.split("\t")[2:4] == ["ERROR", "oc_unknown"] and "Homo sapiens" in text and lint.failed(found)


def test_records_of_all_kinds(spark, tmp_path):
    """Coordinates from three kinds of files, written in three kinds; the same rows from plain, packed and 2bit genomes."""
    (tmp_path / "c.sto").write_text("# STOCKHOLM 1.0\n#=GF ID x\nchr1:2-4_+ CG.T\n//\n")
    (tmp_path / "c.tsv").write_text("chr1:2-4_+\tCG-T\n")
    (tmp_path / "c.csv").write_text("g,chr1,2,4,+,CGT\n")
    one = files.coordinates(spark, f"{tmp_path}/c.sto")
    assert one.select("sequence_id", "start", "end", "orient", "sequence").head() == ("chr1", 2, 4, "+", "CGT")
    assert files.coordinates(spark, f"{tmp_path}/c.tsv").select("sequence_id", "start", "sequence").head() == ("chr1", 2, "CGT")
    assert files.coordinates(spark, f"{tmp_path}/c.csv", columns=6).select(writers.coordinates_delimited(",").alias("t")).head().t == "g,chr1,2,4,+,CGT"
    assert writers.coordinates_stockholm(one).head().text == "# STOCKHOLM 1.0\n#=GF ID x\nchr1:2-4_+ CG.T\n//"
    (tmp_path / "genomes").mkdir()
    entries = [("chr1", "ACGTNNACGTACGTTT"), ("chr2", "TTTT")]
    plain = "".join(f">{n} note\n{s[:7].lower()}\n{s[7:]}\n" for n, s in entries)
    (tmp_path / "genomes/g.fa").write_text(plain)
    (tmp_path / "genomes/g.2bit").write_bytes(files.twobit_bytes(entries, "<"))
    (tmp_path / "genomes/h.fa").write_text(plain)
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(plain.encode()))
    rows = [sorted((r.chrom, r.length, r.seq) for r in files.genome(spark, f"{tmp_path}/{p}").collect()) for p in ("genomes/g.fa", "genomes/g.2bit", "g.fa.gz")]
    assert rows[0] == rows[1] == rows[2] == [(n, len(s), s) for n, s in entries]
    for a, b in ((0, 16), (3, 9), (5, 6), (4, 4)):
        assert {files.genome_range(spark, f"{tmp_path}/{p}", "chr1", a, b).head().seq for p in ("genomes/g.fa", "genomes/g.2bit")} == {entries[0][1][a:b]}
    with pytest.raises(Exception, match="ends before"):
        files.genome_range(spark, f"{tmp_path}/genomes/g.2bit", "chr2", 0, 5).collect()
    found = {r.assembly: r.path for r in files.reference_files(spark, f"file://{tmp_path}/genomes").collect()}
    assert found["g"].endswith("g.2bit") and found["h"].endswith("h.fa")
    assert files.first_sequence(spark, f"{tmp_path}/genomes/h.fa").head() == ("chr1", entries[0][1])
    assert writers.output_name("/a/x.fa", "/a") == "/a/x.discoord" and writers.output_name("/a/x.fa", "/b/") == "/b/x.fa"


def test_mixed_and_long_packed_files(spark, tmp_path):
    import os

    (tmp_path / "a.fa").write_text(">r\nACGT\n>x\nAC-T\n")
    (tmp_path / "b.aln").write_text("CLUSTAL W\n\na  ACGT\nb  ACGA\n")
    (tmp_path / "c.align").write_text(" 239 29.42 1.92 0.97 q 1 4 (8) s 6 9 (2) x\n\n  q 1 AC-T 3\n      v\n  s 6 ACGT 9\n\nGap_init rate\n")
    noise = "".join(f">n{i}\n{os.urandom(30).hex().translate(str.maketrans('0123456789abcdef', 'ACGTACGTACGTACGT'))}\n" for i in range(4000))
    (tmp_path / "d.fa.gz").write_bytes(gzip.compress(noise.encode()))
    rows = files.msa(spark, f"{tmp_path}/*")
    assert {r[0]: r[1] for r in rows.groupBy(F.regexp_extract("file", "([^/]*)$", 1)).count().collect()} == {"a.fa": 2, "b.aln": 2, "c.align": 2, "d.fa.gz": 4000}
    assert [r.seq for r in rows.where("file like '%c.align'").orderBy("row_idx").collect()] == ["ACGT", "AC-T"]
    assert files.text_lines("a\x0cb\u2028c\x85\r\nd\n".encode()) == ["a\x0cb\u2028c\x85", "d"]


def test_conversion_and_updates(spark, tmp_path):
    from strandloom.operators import convert

    at = f"{tmp_path}/a.sto"
    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n#=GF ID F1\n#=GF CT handbuilt\n#=GC RF   AAG.T\nx:2-5_+  AC_GT\ny        ACAGT\n//\n")
    made = lambda to, **k: convert.convert(spark, at, to, **k).head().text
    assert made("raw") == ">x  a:1 id=F1\nACGT\n>y  a:1 id=F1\nACAGT" and made("reference") == ">F1\nAAGT"
    assert "AC.GT" in made("stk") and "AC_GT" in made("stk", clean=False) and made("fa").startswith(">x:2-5\nACGT") and made("aln").startswith("CLUSTAL")
    (tmp_path / "b.fa").write_text(made("msa") + "\n")
    assert convert.convert(spark, f"{tmp_path}/b.fa").head().text.startswith("# STOCKHOLM")
    for path, to, k in ((at, None, {}), (f"{tmp_path}/b.fa", "reference", {}), (f"{tmp_path}/b.fa", "aln", {"choice": "1"}), (at, "none", {})):
        with pytest.raises(ValueError):
            convert.convert(spark, path, to, **k)
    new = records.update_reference(files.stockholm(spark, at)).head()
    assert new.gc["RF"].replace(".", "-") == msa.consensus(alignment(spark, "AC-GT", "AC-GT", "ACAGT")).head().consensus and [g.tag for g in new.gf] == ["ID"]
    rows = alignment(spark, "ACGT", "ACGT", "ACGT")
    assert [r.seq for r in msa.sub_align(rows, "2-3").orderBy("row_idx").collect()] == ["CG", "CG", "CG"]
    assert [r.seq for r in msa.sub_align(alignment(spark, "xxxx", "ACGT", "ACGT"), "2-3").where("row_idx > 0").collect()] == ["CG", "CG"]
    with pytest.raises(Exception, match="update it first"):
        msa.sub_align(alignment(spark, "AAAA", "ACGT", "ACGT"), "2-3").collect()
    for bad in ("3-2", "0-2", "4", "a-b"):
        with pytest.raises(ValueError):
            msa.parsed_range(bad)
    stats = msa.statistics(alignment(spark, "ACGTACGT", "ACGTACGA", "ACGTACGT"))
    assert writers.averages_text(stats).head().text.startswith("average\t")

