"""Alignments as tables: profiles, consensus, divergence, quality and column edits.

An alignment is the rows of one `msa_id`: (msa_id, row_idx, is_reference, seq), all of one width and in ASCII, a dash for a gap inside a
row and a blank outside it. Rows are never exploded to cells: letters are counted by column in Arrow batches, whose counts are summed by
msa_id and column, so alignments of any number and depth spread over the cluster; the consensus of an alignment is laid beside its
rows as one array. Rows with a null sequence count as empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import alphabet
from strandloom.functions import text as X
from strandloom.functions.tables import settled


def cells(rows: DataFrame) -> DataFrame:
    """Every cell of every row: msa_id, row_idx, is_reference, col (from 0), base in upper case, blanks included."""
    return rows.select("msa_id", "row_idx", "is_reference", F.posexplode(F.split(F.upper("seq"), "")).alias("col", "base")).where("base <> ''")


def counted(rows: DataFrame, include_reference: bool) -> DataFrame:
    return rows if include_reference else rows.where(~F.col("is_reference"))


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    import pyarrow as pa

    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else pa.py_buffer(b"\0"), np.uint8), offsets


def codes(column) -> tuple[np.ndarray, list]:
    """Number of each value of a string column, and the values."""
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


ASCII = np.array([chr(i) for i in range(128)], object)


def tallies(rows: DataFrame, counting: Column) -> DataFrame:
    """letter_counts of the rows that count, and of all rows one entry without a letter, n = 0, at the last column of each alignment in a batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            of, names = codes(batch.column(0))
            data, offsets = raw(batch.column(1))
            sizes = np.diff(offsets)
            width = max(int(sizes.max()), 1)
            row = np.repeat(np.arange(len(sizes)), sizes)
            col = np.arange(int(sizes.sum())) - np.repeat(offsets[:-1] - offsets[0], sizes)
            letter = data[offsets[0] : offsets[-1]]
            key = ((of[row] * width + col) * 128 + letter)[(letter != 32) & batch.column(2).to_numpy(zero_copy_only=False)[row]]
            if len(names) * width * 128 <= 16 * len(key):
                n = np.bincount(key)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            last = np.zeros(len(names), np.int64)
            np.maximum.at(last, of, sizes)
            wide = np.flatnonzero(last)
            at, base = key // 128, key % 128
            name = pa.array(names, pa.string()).take(pa.array(np.concatenate([at // width, wide])))
            base = pa.array([*ASCII, ""], pa.string()).take(pa.array(np.concatenate([base, np.full(len(wide), 128)])))
            col = np.concatenate([at % width, last[wide] - 1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([name, pa.array(col), base, pa.array(np.concatenate([n, np.zeros(len(wide), n.dtype)]).astype(np.int64))], ["msa_id", "col", "base", "n"])

    slim = rows.select(F.col("msa_id").cast("string").alias("msa_id"), F.upper("seq").alias("seq"), F.coalesce(counting, F.lit(False)).alias("counting"))
    found = slim.where("msa_id is not null").mapInArrow(run, "msa_id string, col int, base string, n long")
    return found.groupBy("msa_id", "col", "base").agg(F.sum("n").alias("n"))


def letter_counts(rows: DataFrame) -> DataFrame:
    """msa_id, col (from 0), base (upper case) and n of every letter that isn't blank, counted in batches and summed."""
    return tallies(rows, F.lit(True)).where("base <> ''")


def profile(rows: DataFrame, include_reference: bool = False) -> DataFrame:
    """msa_id, col, base and n for the letters of the alphabet."""
    return letter_counts(counted(rows, include_reference)).where(F.instr(F.lit(alphabet.LETTERS), F.col("base")) > 0)


def widths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("msa_id").agg(F.max(F.length("seq")).alias("width"))


def columns(rows: DataFrame) -> DataFrame:
    """msa_id and col of every column, covered or not."""
    return widths(rows).where("width > 0").select("msa_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))


def coverage(rows: DataFrame) -> DataFrame:
    """Letters of the alphabet in each column's instances, gaps included; 0 where there are none."""
    own = profile(rows).groupBy("msa_id", "col").agg(F.sum("n").alias("n"))
    return columns(rows).join(own, ["msa_id", "col"], "left").select("msa_id", "col", F.coalesce("n", F.lit(0)).alias("coverage"))


def clear_flanks(rows: DataFrame) -> DataFrame:
    """Dashes before the first and after the last letter of a row become blanks; rows without letters are blank."""
    seq = F.col("seq")
    left, right = F.regexp_extract(seq, r"^([^A-Za-z]*)", 1), F.regexp_extract(seq, r"([^A-Za-z]*)$", 1)
    core = F.substring(seq, F.length(left) + 1, F.length(seq) - F.length(left) - F.length(right))
    out = F.concat(F.translate(left, "-", " "), core, F.translate(right, "-", " "))
    ends = F.substring(seq, 1, 1).rlike("[A-Za-z]") & F.substring(seq, -1, 1).rlike("[A-Za-z]")
    return rows.withColumn("seq", F.when(ends, seq).when(seq.rlike("[A-Za-z]"), out).otherwise(F.repeat(F.lit(" "), F.length(seq))))


def by_column(rows: DataFrame, include_reference: bool, value: Column, name: str, default: Column) -> DataFrame:
    """msa_id, col and a value, made of the scores of every letter of the alphabet (a column for each), in each column; the default where nothing counts.

    Rows are read once, for the counts and for the widths."""
    at = F.instr(F.lit(alphabet.LETTERS), F.col("base"))
    against = lambda c: F.element_at(F.array(*[F.lit(alphabet.consensus_score(c, o)) for o in alphabet.LETTERS]), at)
    counting = F.lit(True) if include_reference else ~F.col("is_reference")
    letter = F.when(F.col("base") == "", 0).otherwise(at) > 0
    found = tallies(rows, counting).groupBy("msa_id", "col").agg(*[F.sum(F.when(letter, F.col("n") * against(c))).alias(c) for c in alphabet.LETTERS], F.bool_or(letter).alias("counts"), F.bool_or(F.col("base") == "").alias("ends"))
    own = settled(found.where("counts or ends").select("msa_id", "col", F.when(F.col("counts"), value).alias(name), "ends"))
    wide = own.where("ends").groupBy("msa_id").agg(F.max("col").alias("last")).select("msa_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("col"))
    return wide.join(own.drop("ends"), ["msa_id", "col"], "left").select("msa_id", "col", F.coalesce(name, default).alias(name))


def beside(rows: DataFrame, letters: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns and the letters of their alignment's letters(msa_id, col, letter), as `cols` and `letters`, and seq in upper case."""
    line = letters.groupBy(F.col("msa_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("col", F.upper("letter").alias("letter")))).alias("line"))
    line = line.select("of", F.transform("line", lambda x: x["col"]).alias("cols"), F.array_join(F.transform("line", lambda x: x["letter"]), "").alias("letters"))
    # Small beside the rows, and as a table its size is known: rows aren't shuffled for it unless alignments are very many
    return rows.join(settled(line), F.col("msa_id") == F.col("of"), how).drop("of").withColumn("seq", F.upper("seq"))


def matched(batch):
    """Of a batch of rows beside their letters: row, place in the line, column, letter and the row's own letter (0 beyond its end) of every entry."""
    at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    data, offsets = raw(at["seq"])
    letters, starts = raw(at["letters"])
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(starts[:-1] - starts[0], sizes)
    col = at["cols"].flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    inside = col < np.diff(offsets)[row]
    own = np.where(inside, data[np.where(inside, offsets[row] + col, 0)], 0)
    return row, place, col, letters[starts[0] : starts[-1]], own


def best_letters(rows: DataFrame, include_reference: bool = False) -> DataFrame:
    """msa_id, col and the letter of greatest score in each column; N wins ties, then the first of the alphabet. N where nothing counts."""
    entry = lambda i, c: F.struct(F.col(c).alias("total"), F.lit(int(c == "N")).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("cand"))
    best = F.array_max(F.array(*[entry(i, c) for i, c in enumerate(alphabet.LETTERS)]))["cand"]
    return by_column(rows, include_reference, best, "letter", F.lit("N"))


def consensus_letters(rows: DataFrame, include_reference: bool = False, cg: int = 12, ta: int = -5, transition: int = 2) -> DataFrame:
    """msa_id, col and letter of the consensus, with CpG sites restored.

    Over neighbouring columns whose letters are no gaps, C and G replace them if they score more over the rows than the letters
    do. A pair's left letter may be the G of the pair before; which pairs fire is a running parity within stretches that
    begin where a pair's outcome doesn't depend on its neighbour."""
    rows = clear_flanks(rows)
    letters = settled(best_letters(rows, include_reference))
    kept = letters.where("letter <> '-'")
    number = np.full(256, alphabet.LETTERS.index("N"), np.int64)
    number[[ord(c) for c in alphabet.LETTERS]] = range(len(alphabet.LETTERS))
    over_plain, over_g = (x.ravel() for x in duo_tables(cg, ta, transition))

    def duos(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            of, names = codes(batch.column(0))
            row, place, col, letter, own = matched(batch)
            pair = np.flatnonzero((row[1:] == row[:-1]) & (own[1:] != 32) & (own[:-1] != 32) & (own[1:] != 0) & (own[:-1] != 0))
            wide, size = int(place.max(initial=0)) + 1, len(alphabet.LETTERS)
            case = ((number[letter[pair]] * size + number[letter[pair + 1]]) * size + number[own[pair]]) * size + number[own[pair + 1]]
            key, first, back = np.unique(of[row[pair]] * wide + place[pair], return_index=True, return_inverse=True)
            sums = [np.bincount(back, weights=x[case], minlength=len(key)).astype(np.int64) for x in (over_plain, over_g)]
            name = pa.array(names, pa.string()).take(pa.array(key // wide))
            yield pa.RecordBatch.from_arrays([name, pa.array(col[pair[first]].astype(np.int32)), *map(pa.array, sums)], ["msa_id", "col", "over_plain", "over_g"])

    own = beside(counted(rows, include_reference), kept).select(F.col("msa_id").cast("string").alias("msa_id"), "seq", "cols", "letters")
    fires = own.mapInArrow(duos, "msa_id string, col int, over_plain long, over_g long").groupBy("msa_id", "col").agg((F.sum("over_plain") > 0).alias("f0"), (F.sum("over_g") > 0).alias("fg"))
    by_col = Window.partitionBy("msa_id").orderBy("col")
    line = kept.join(fires, ["msa_id", "col"], "left").na.fill(False, ["f0", "fg"])
    line = line.withColumn("reset", (F.col("f0") == F.col("fg")).cast("int")).withColumn("flip", (F.col("f0") & ~F.col("fg")).cast("int"))
    line = line.withColumn("stretch", F.sum("reset").over(by_col))
    in_stretch = Window.partitionBy("msa_id", "stretch")
    base = F.coalesce(F.max(F.when(F.col("reset") == 1, F.col("f0"))).over(in_stretch), F.lit(False))
    line = line.withColumn("fired", base != (F.sum("flip").over(in_stretch.orderBy("col")) % 2 == 1))
    before = F.coalesce(F.lag("fired").over(by_col), F.lit(False))
    final = line.select("msa_id", "col", F.when(F.col("fired"), "C").when(before, "G").otherwise(F.col("letter")).alias("final"))
    return settled(letters.join(final, ["msa_id", "col"], "left").select("msa_id", "col", F.coalesce("final", "letter").alias("letter")))


def duo_tables(cg: int, ta: int, transition: int) -> tuple[np.ndarray, np.ndarray]:
    """By left and right letter of the consensus and of a row: what C and G score more than the letters, and than the letters after a G."""
    score = {(a, b): alphabet.consensus_score(a, b) for a in alphabet.LETTERS for b in alphabet.LETTERS}

    def island(l: str, r: str) -> int:
        if l + r in ("CA", "TG", "TA"):
            return ta if l + r == "TA" else cg
        if l + r in ("TC", "TT"):
            return transition + score["G", r]
        return transition + score["C", l] if l + r in ("AA", "GA") else score["C", l] + score["G", r]

    own = np.array([[score[a, b] for b in alphabet.LETTERS] for a in alphabet.LETTERS])
    both = np.array([[island(a, b) for b in alphabet.LETTERS] for a in alphabet.LETTERS])[None, None]
    after = np.broadcast_to(score_row(own, "G")[None, None, :, None] + own[None, :, None, :], (len(own),) * 4)
    return both - (own[:, None, :, None] + own[None, :, None, :]), both - after


def score_row(own: np.ndarray, letter: str) -> np.ndarray:
    return own[alphabet.LETTERS.index(letter)]


def strung(letters: DataFrame, name: str = "consensus") -> DataFrame:
    """msa_id and the letters of all columns, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("col", "letter")))
    return letters.groupBy("msa_id").agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias(name))


def consensus(rows: DataFrame, **params) -> DataFrame:
    """msa_id and consensus."""
    return strung(consensus_letters(rows, **params))


def divergence(rows: DataFrame, against: DataFrame) -> DataFrame:
    """Kimura divergence of every instance from the letters of its alignment: against(msa_id, col, letter).

    Columns whose letter is a gap and blanks are passed over. Of a CpG site's two transitions together count one, one alone a
    tenth; `ti_adjusted` is kept in tenths and divided once."""
    names = ["ti", "tv", "well", "tenths", "cpg_sites"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, substitutions(batch))], ["msa_id", "row_idx", *names])

    own = facing(rows.where(~F.col("is_reference")), against).select("msa_id", "row_idx", "seq", "cols", "letters")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("msa_id", "row_idx"))
    sums = own.mapInArrow(run, kinds + ", " + ", ".join(f"{c} long" for c in names))
    adjusted = F.col("tenths") / 10
    return sums.select(
        "msa_id", "row_idx", "ti", "tv", adjusted.alias("ti_adjusted"), "well", "cpg_sites",
        X.k2p(F.col("ti"), F.col("tv"), F.col("well")).alias("kimura"), X.k2p(adjusted, F.col("tv"), F.col("well")).alias("kimura_adjusted"),
    )


def facing(rows: DataFrame, against: DataFrame) -> DataFrame:
    """rows beside the letters of their alignment, none where there are none."""
    return beside(rows, against, "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<int>"))).withColumn("letters", F.coalesce("letters", F.lit("")))


CODE = np.full(256, 9, np.int8)
CODE[[65, 67, 71, 84]] = range(4)


def substitutions(batch) -> list[np.ndarray]:
    """Transitions, transversions, well characterised places, tenths of adjusted transitions and CpG sites of each row of a batch beside its letters."""
    row, _, _, cons, own = matched(batch)
    kept = (cons != 45) & (own != 32) & (own != 0)
    row, cons, own = row[kept], cons[kept], own[kept]
    a, b = CODE[cons], CODE[own]
    well = (a < 4) & (b < 4)
    ti = (well & (a ^ b == 2)).astype(np.int64)
    tv = well & (a != b) & (ti == 0)
    site = np.zeros(len(row), bool)
    site[1:] = (row[1:] == row[:-1]) & (cons[:-1] == 67) & (cons[1:] == 71)
    both = ti.copy()
    both[1:] += ti[:-1]
    opens = np.append(site[1:], False)[: len(row)]
    tenths = np.where(site, np.array([0, 1, 10])[both], np.where(opens, 0, 10 * ti))
    return [np.bincount(row, weights=x, minlength=batch.num_rows).astype(np.int64) for x in (ti, tv, well, tenths, site)]


def mean_divergence(pairs: DataFrame) -> DataFrame:
    """Sum of the finite divergences over the number of all."""
    finite = lambda c: F.sum(F.when(~F.isnan(c), F.col(c)).otherwise(0.0)) / F.count("*")
    return pairs.groupBy("msa_id").agg(finite("kimura").alias("kimura"), finite("kimura_adjusted").alias("kimura_adjusted"))


def statistics(rows: DataFrame) -> DataFrame:
    """Divergence of every instance from the reference and from the consensus; NaN counts as 100, and 90 or more from the reference is high."""
    reference = cells(rows.where("is_reference")).select("msa_id", "col", F.when(F.col("base") == " ", "-").otherwise(F.col("base")).alias("letter"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            first = substitutions(pa.RecordBatch.from_arrays([at["seq"], at["ref_cols"], at["ref_letters"]], ["seq", "cols", "letters"]))
            yield pa.RecordBatch.from_arrays([at["msa_id"], at["row_idx"], *map(pa.array, [*first[:3], *substitutions(batch)[:3]])], ["msa_id", "row_idx", "ti", "tv", "well", "ti2", "tv2", "well2"])

    # Both in one reading of the rows
    own = facing(rows.where(~F.col("is_reference")), reference).withColumnsRenamed({"cols": "ref_cols", "letters": "ref_letters"})
    own = facing(own, consensus_letters(rows)).select("msa_id", "row_idx", "seq", "cols", "letters", "ref_cols", "ref_letters")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("msa_id", "row_idx"))
    sums = own.mapInArrow(run, kinds + ", ti long, tv long, well long, ti2 long, tv2 long, well2 long")
    full = lambda x: F.when(F.isnan(X.k2p(*map(F.col, (f"ti{x}", f"tv{x}", f"well{x}")))), 100.0).otherwise(X.k2p(*map(F.col, (f"ti{x}", f"tv{x}", f"well{x}"))))
    return sums.select("msa_id", "row_idx", full("").alias("from_reference"), full("2").alias("from_consensus")).withColumn("high", F.col("from_reference") >= 90)


def averages(stats: DataFrame) -> DataFrame:
    """Mean divergences of each alignment of statistics(), the full ones included."""
    return stats.groupBy("msa_id").agg(F.avg("from_reference").alias("from_reference"), F.avg("from_consensus").alias("from_consensus"))


def is_occupancy(line: Column) -> Column:
    """Whether a reference line only marks which columns the consensus occupies."""
    return line.rlike(r"^[xX\-. ]*$")


def occupancy(consensus: Column) -> Column:
    """A consensus as such marks: x for bases, gaps as they are."""
    return F.regexp_replace(consensus, r"[^\-. ]", "x")


def is_stable(reference: Column, consensus: Column) -> Column:
    """Whether a reference line is the consensus, or its occupancy if it is of that kind, letter by letter."""
    return F.when(is_occupancy(reference), reference == occupancy(consensus)).otherwise(reference == consensus)


def column_scores(rows: DataFrame) -> DataFrame:
    """The greatest score of any letter in each column; 0 where nothing counts."""
    return by_column(rows, False, F.greatest(*alphabet.LETTERS).cast("long"), "score", F.lit(0).cast("long"))


def maximal_segments(values: list[float], threshold: float = 0) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) above a threshold.

    A stack of candidates holds the running sum before and after each; a new one joins those back to the last that begins lower."""
    stack: list[list] = []
    total = 0
    for i, v in enumerate(values):
        before, total = total, total + v
        if v <= 0:
            continue
        new = [i, i, before, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k -= 1
            if k < 0 or stack[k][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(a, b, r - l) for a, b, l, r in stack if r - l > threshold]


def low_quality_blocks(rows: DataFrame, threshold: int = 0) -> DataFrame:
    """msa_id, start, end and score of stretches where columns score badly."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(name, line[a]["col"], line[b]["col"], int(s)) for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, s in maximal_segments([-x["score"] for x in line], threshold)]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["msa_id", "start", "end", "score"])

    line = column_scores(rows).groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("col", "score"))).alias("line"))
    return line.mapInArrow(run, "msa_id string, start int, end int, score long")


def conservation(rows: DataFrame) -> DataFrame:
    """A star for columns whose letters all agree, else a blank; reference included."""
    own = letter_counts(rows).where(~F.col("base").isin("-", ".")).groupBy("msa_id", "col").agg(F.count("*").alias("kinds"))
    return columns(rows).join(own, ["msa_id", "col"], "left").select("msa_id", "col", F.when(F.col("kinds") == 1, "*").otherwise(" ").alias("mark"))


def slice_columns(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Columns from start up to end; rows that are blank there go."""
    out = rows.withColumn("seq", F.substring(F.col("seq"), start + 1, F.greatest(end - start, F.lit(0))))
    return out.where(F.col("seq").rlike("[^ ]"))


def trim(rows: DataFrame, left: int, right: int) -> DataFrame:
    """Without the columns of the reference's first `left` and last `right` bases."""
    if not left and not right:
        return rows
    own = cells(rows.where("is_reference")).where(~F.col("base").isin("-", ".", " "))
    order = Window.partitionBy("msa_id")
    own = own.withColumn("nth", F.row_number().over(order.orderBy("col"))).withColumn("size", F.count("*").over(order))
    kept = own.where((F.col("nth") > left) & (F.col("nth") <= F.col("size") - right)).groupBy("msa_id").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("b"))
    return slice_columns(rows.join(kept, "msa_id"), F.col("a"), F.col("b")).drop("a", "b")


def trim_ambiguous(rows: DataFrame) -> DataFrame:
    """From the consensus' first of ACGT to its last."""
    kept = consensus_letters(rows).where(F.col("letter").isin(*"ACGT")).groupBy("msa_id").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("b"))
    return slice_columns(rows.join(settled(kept), "msa_id"), F.col("a"), F.col("b")).drop("a", "b")


def reverse(rows: DataFrame) -> DataFrame:
    """Reverse complement of every row; strands turn where there is an orient column."""
    out = rows.withColumn("seq", X.reverse_complement_iupac(F.col("seq")))
    return out.withColumn("orient", F.translate("orient", "+-", "-+")) if "orient" in rows.columns else out


def min_length(rows: DataFrame, least: int) -> DataFrame:
    """Rows of at least so many letters; references always stay."""
    return rows.where(F.col("is_reference") | (F.length(F.regexp_replace("seq", "[^A-Za-z]", "")) >= least))


def sub_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Columns of the consensus' bases start to end, counted from 1 without gaps."""
    own = consensus_letters(rows).where("letter <> '-'").withColumn("nth", F.row_number().over(Window.partitionBy("msa_id").orderBy("col")))
    kept = own.where(F.col("nth").between(start, end)).groupBy("msa_id").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("b"))
    return slice_columns(rows.join(settled(kept), "msa_id"), F.col("a"), F.col("b")).drop("a", "b")


def parsed_range(text: str) -> tuple[int, int]:
    """Start and end, from 1, of `start-end`; ValueError if it is no range."""
    start, dash, end = text.partition("-")
    if not dash or not start.isdigit() or not end.isdigit() or not 1 <= int(start) <= int(end):
        raise ValueError(f"no range of places from 1, as 10-200: {text!r}")
    return int(start), int(end)


def sub_align(rows: DataFrame, text: str, include_reference: bool = False) -> DataFrame:
    """sub_range of alignments whose reference line is the consensus (of the instances, or of the reference too); others are an error."""
    start, end = parsed_range(text)
    own = rows.where("is_reference").select(F.col("msa_id").alias("of"), F.col("seq").alias("line")).join(consensus(rows, include_reference=include_reference), F.col("of") == F.col("msa_id"))
    unstable = F.raise_error(F.concat(F.lit("the reference line isn't the consensus; update it first: "), "of")).cast("boolean")
    kept = own.select("of", F.coalesce(is_stable(F.col("line"), F.col("consensus")), F.lit(False)).alias("stable"))
    checked = rows.join(kept, F.col("msa_id") == F.col("of")).where(F.when(F.col("stable"), True).otherwise(unstable)).select(*rows.columns)
    return sub_range(checked, start, end)
