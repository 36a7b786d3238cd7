"""Pairwise alignments merged into one by their reference, and search hits laid on a reference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import text as X
from strandloom.functions.tables import settled
from strandloom.operators.msa import raw


def sides(hits: DataFrame, reference: str = "subj") -> DataFrame:
    """ref, hit_no, ref_start, ref_seq, name, start, end, orient and seq of cross-match hits, with either side as the reference.

    The instance keeps its strand only if the subject is the reference."""
    other = "query" if reference == "subj" else "subj"
    orient = F.col("orientation") if reference == "subj" else F.lit("+")
    return hits.select(
        F.col(f"{reference}_name").alias("ref"), "hit_no", F.col(f"{reference}_start").alias("ref_start"), F.upper(f"{reference}_seq").alias("ref_seq"),
        F.col(f"{other}_name").alias("name"), F.col(f"{other}_start").alias("start"), F.col(f"{other}_end").alias("end"), orient.alias("orient"),
        F.upper(f"{other}_seq").alias("seq"), "pct_div",
    )


def letters_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a string column as numbers, and the offsets of its values."""
    data, offsets = raw(column)
    data = data[offsets[0] : offsets[-1]]
    if data.max(initial=0) < 128:
        return data, offsets - offsets[0]
    texts = column.fill_null("").to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])


def strings(letters: np.ndarray, sizes: np.ndarray):
    """The string column of letters as numbers, so many to a value."""
    import pyarrow as pa

    ends = np.cumsum([0, *sizes])
    if letters.max(initial=0) < 128:
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters, np.uint8)))
    text = letters.astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([text[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.string())


def portions(batches, cells: int = 1 << 20):
    """Batches in parts of about so many letters of ref_seq, a row at least."""
    for batch in batches:
        _, offsets = raw(batch.column(batch.schema.get_field_index("ref_seq")))
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(offsets, offsets[at] + cells, "right")) - 1, at + 1)
            yield batch.slice(at, end - at)
            at = end


class Faced:
    """The columns of a batch of hits in which not both sides have a gap: row, whether the reference has a gap, its letter, the hit's own and the place.

    An insertion stands before the base of its place; one after the last base has the place after it."""

    def __init__(self, batch):
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        top, offsets = letters_of(at["ref_seq"])
        own, begins = letters_of(at["seq"])
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        i = np.arange(len(top)) - offsets[:-1][row]
        inside = i < np.diff(begins)[row]
        mine = np.zeros(len(top), own.dtype)
        mine[inside] = own[begins[:-1][row[inside]] + i[inside]]
        kept = (top != 45) | ((mine != 45) & inside)
        self.row, self.top, self.own = row[kept], top[kept], mine[kept]
        self.gap = self.top == 45
        self.bases = np.bincount(self.row[~self.gap], minlength=batch.num_rows)
        self.start = at["ref_start"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.place = self.start[self.row] + np.cumsum(~self.gap) - ~self.gap - (np.cumsum(self.bases) - self.bases)[self.row]

    def insertions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of inserted letters in the columns, their order in their insertion, and where insertions begin among them, with their lengths."""
        at = np.flatnonzero(self.gap)
        new = np.ones(len(at), bool)
        new[1:] = (self.row[at[1:]] != self.row[at[:-1]]) | (self.place[at[1:]] != self.place[at[:-1]])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        return at, np.arange(len(at)) - np.repeat(first, sizes), first, sizes


def wanted(hits: DataFrame) -> DataFrame:
    """What hits ask of their reference, once a batch: stretches of it that they cover (ref, pos, hit_no, bases), and the room of their insertions (ref, pos, room)."""
    kind = hits.schema["hit_no"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches):
            x = Faced(batch)
            ref, hit_no = (batch.column(batch.schema.get_field_index(n)) for n in ("ref", "hit_no"))
            t = pa.table({"ref": ref, "pos": pa.array(x.start), "hit_no": hit_no, "bases": strings(x.top[~x.gap], x.bases)})
            if pa.types.is_integer(hit_no.type):
                t = t.group_by(["ref", "pos", "bases"]).aggregate([("hit_no", "max")]).rename_columns(["ref", "pos", "bases", "hit_no"]).select(["ref", "pos", "hit_no", "bases"])
            yield from t.append_column("room", pa.nulls(len(t), pa.int32())).combine_chunks().to_batches()
            at, _, first, sizes = x.insertions()
            if len(first):
                rows = pa.array(x.row[at[first]])
                t = pa.table({"ref": ref.take(rows), "pos": pa.array(x.place[at[first]]), "room": pa.array(sizes.astype(np.int32))}).group_by(["ref", "pos"]).aggregate([("room", "max")])
                out = pa.table({"ref": t["ref"], "pos": t["pos"], "hit_no": pa.nulls(len(t), hit_no.type), "bases": pa.nulls(len(t), pa.string()), "room": t["room_max"]})
                yield from out.combine_chunks().to_batches()

    return hits.select("ref", "hit_no", "ref_start", "ref_seq", "seq").mapInArrow(run, f"ref string, pos long, hit_no {kind}, bases string, room int")


def laid(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of rows(ref_start, ref_seq, seq, a, width, rooms), with the hit's letters laid on the reference from a on as `own`: insertions where there is room, dashes in the rest, blanks outside."""

    def run(batches):
        import pyarrow as pa

        for batch in portions(batches):
            x, at = Faced(batch), {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            left, width = (at[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("a", "width"))
            rooms, n = at["rooms"].flatten(), at["rooms"].value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), n)
            pos, room = (rooms.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("pos", "room"))
            earlier = pos < x.start[of]
            before = x.start - left + np.bincount(of[earlier], weights=room[earlier], minlength=batch.num_rows).astype(np.int64)
            inner = ~earlier & (pos <= (x.start + x.bases)[of])
            of, pos, room = of[inner], pos[inner], room[inner]
            size = x.bases + np.bincount(of, weights=room, minlength=batch.num_rows).astype(np.int64)
            # Rows' places in one order: how much room there is up to a place of a row
            step = int(x.bases.max(initial=0)) + 2
            keys, total = of * step + pos - x.start[of], np.concatenate([[0], np.cumsum(room)])
            begun = total[np.searchsorted(keys, np.arange(batch.num_rows) * step)]
            base = np.cumsum(width) - width
            cell = x.row * step + x.place - x.start[x.row]
            lead = total[np.where(x.gap, np.searchsorted(keys, cell), np.searchsorted(keys, cell, "right"))] - begun[x.row]
            target = (base + before)[x.row] + x.place - x.start[x.row] + lead
            ins, nth, _, _ = x.insertions()
            target[ins] += nth
            row = np.repeat(np.arange(batch.num_rows), width)
            i = np.arange(len(row)) - base[row]
            out = np.where((i >= before[row]) & (i < (before + size)[row]), 45, 32).astype(x.own.dtype)
            seen = x.own != 0
            out[target[seen]] = x.own[seen]
            yield pa.RecordBatch.from_arrays([*[at[k] for k in names], strings(out, width)], [*names, "own"])

    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInArrow(run, fields + ", own string")


def merge(hits: DataFrame) -> DataFrame:
    """One alignment of the hits of each ref: ref, row_idx (0 for the reference), name, start, end, orient and seq.

    Before each base the widest insertion of any hit makes room for all; a hit's own letters come first there, dashes fill the
    rest. Columns where both sides have a gap are passed over. Bases are named by the hits that cover them, the last in order wins; a place that none covers is an error.
    Hits are read twice, for what they ask of the reference and to be laid on it; they are shuffled once, to be numbered. A hit without a
    base of the reference, or with a null sequence, adds no row."""
    own = hits.where("ref is not null and ref_seq is not null and seq is not null and replace(ref_seq, '-', '') <> ''")
    own = own.select("ref", "hit_no", "name", "start", "end", "orient", F.col("ref_start").cast("long").alias("ref_start"), "ref_seq", "seq")
    asked = settled(wanted(own))
    stretches = asked.where("bases is not null").groupBy("ref", F.col("pos").alias("ref_start"), "bases").agg(F.max("hit_no").alias("hit_no"))
    named = stretches.select("ref", "ref_start", "hit_no", F.posexplode(F.split("bases", "")).alias("i", "base")).where("base <> ''")
    bases = named.groupBy("ref", (F.col("ref_start") + F.col("i")).alias("pos")).agg(F.max_by("base", "hit_no").alias("base"))
    room = asked.where("bases is null").groupBy("ref", "pos").agg(F.max("room").alias("room"))
    span = bases.groupBy("ref").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    places = span.select("ref", "a", "b", F.explode(F.sequence("a", F.col("b") + 1)).alias("pos")).join(bases, ["ref", "pos"], "left").join(room, ["ref", "pos"], "left")
    hole = F.raise_error(F.concat(F.lit("no hit covers place "), F.col("pos"), F.lit(" of "), F.col("ref"))).cast("string")
    places = places.withColumn("room", F.coalesce("room", F.lit(0))).withColumn("base", F.when(F.col("pos") > F.col("b"), "").when(F.col("base").isNull(), hole).otherwise(F.col("base")))
    # One row for each reference: its text, its places with room, and where each place begins
    ordered = F.array_sort(F.collect_list(F.struct("pos", "room", "base")))
    line = places.groupBy("ref", "a", "b").agg(ordered.alias("line"))
    text = F.array_join(F.transform("line", lambda x: F.concat(F.repeat(F.lit("-"), x["room"]), x["base"])), "")
    rooms = F.transform(F.filter("line", lambda x: x["room"] > 0), lambda x: F.struct(x["pos"].alias("pos"), x["room"].alias("room")))
    line = settled(line.select("ref", "a", "b", text.alias("seq"), rooms.alias("rooms")))
    top = line.select("ref", F.lit(0).alias("row_idx"), F.col("ref").alias("name"), F.col("a").alias("start"), F.col("b").alias("end"), F.lit("+").alias("orient"), "seq")
    own = own.withColumn("row_idx", F.row_number().over(Window.partitionBy("ref").orderBy("hit_no")))
    beside = own.join(line.select(F.col("ref").alias("of"), "a", "rooms", F.length("seq").alias("width")), F.col("ref") == F.col("of")).drop("of", "hit_no")
    names = ["ref", "row_idx", "name", "start", "end", "orient"]
    return top.unionByName(laid(beside, names).select(*names, F.col("own").alias("seq")))


def project(hits: DataFrame, reference_length: Column | int) -> DataFrame:
    """Search hits on the columns of their subject: hit_no, name, start, end, orient and seq, insertions dropped, blanks outside.

    Hits on the minus strand are turned; their subject's range may be given in either order."""
    length = reference_length if isinstance(reference_length, Column) else F.lit(reference_length)
    minus = F.col("orientation") == "-"
    turned = lambda c: F.when(minus, X.reverse_complement_iupac(F.col(c))).otherwise(F.upper(c))
    kept = F.filter(F.arrays_zip(F.split(turned("sseq"), "").alias("s"), F.split(turned("qseq"), "").alias("q")), lambda x: (x["s"] != "-") & (x["s"] != ""))
    own = F.array_join(F.transform(kept, lambda x: x["q"]), "")
    left = F.least("sstart", "send") - 1
    seq = F.rpad(F.concat(F.repeat(F.lit(" "), left.cast("int")), own), length, F.lit(" "))
    return hits.select("hit_no", F.col("qseqid").alias("name"), F.col("qstart").alias("start"), F.col("qend").alias("end"), F.col("orientation").alias("orient"), seq.alias("seq"))
