"""Similarity join of documents on word shingles, size-aware.

Equal sets are one node. A node of n shingles lacks at most floor(n * (1 - t)) of them in any node it links with, so of two
linked nodes the first floor(n * (1 - t)) + 2 shingles each, in any common order, share two. The order is rarest first, by the
number of nodes with a shingle. Shingles of one node alone can't be shared: a node whose first shingles are all such, or all
but one, is done. What remains of the others is an overlap join with the fixed threshold of two:

- light nodes, with few shared shingles among their first, are filed under each subset of two of them;
- heavy nodes are found by scanning the inverted lists of single shingles.

The boundary is where the subsets that light nodes file and the list entries that heavy nodes scan cost least together, from
the counts of the data at hand. Entries under one key are linked to the least of them, not with each other, and the components
of these links are families: linked nodes are always of one family.

Nodes of a family are compared on their whole sets. A family of at most `BLOCK` nodes is one task. A larger one is first compared
with `CENTRES` of its nodes, then with the few that these have most links with, each time in blocks of `BLOCK` nodes beside the centres: so
a group of near copies falls into one cluster at the cost of its size. Only where several clusters remain, the nodes outside the largest
are compared with all others, in blocks of nodes of like sizes (a link's sets differ in size by no more than the threshold), two blocks to a task.
Every task emits a spanning forest of the links it finds.

Counting a shingle's nodes takes postings packed by ranges of hash values, about six bytes each, so that a corpus of any size is
counted in ranges of bounded size. A task hands on its nodes by flushes of about `FLUSH` postings; a posting names its node by a number within
its flush, and counts go back to the flush, where the names are. A node that several flushes hold counts for each of them, which makes candidates
of a few more shingles but loses none. A shingle that `HOT` nodes of one flush have is known to be frequent there and then: its postings
don't meet in its range, which only gets its name; the order takes all counts from `HOT` on as equal.

Shingles are 64-bit hashes (48 bits where only candidates depend on them) and sets are named by a 128-bit hash. Null and empty texts and texts
without words have no shingles and link with nothing. Rows are told apart by their sets alone: doc_id may repeat or be null; a component's id
is the least doc_id in it, null if there is none. Only doc_id and the text are read; other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, columns, fresh, release, written
from .components import components
from .shingles import digest, sets

WIDTH, PERCENT = 3, 90
SHARED = 2
#: Postings of a range of hash values, about; postings after which a task hands on what it has; ranges at most (from 1 << 35 postings on ranges grow, and are counted by parts).
RANGE, FLUSH, RANGES = 1_000_000, 1_000_000, 1 << 15
#: Nodes of one task with a shingle that make it a frequent one.
HOT = 1024
BLOCK, CENTRES, FOLLOWED = 512, 64, 8
#: Bits of the filter that finds the texts of families' nodes again: eight for each node within these bounds (8 MB at most are broadcast).
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 26
KEPT = 48
#: Kinds of blobs: postings of a range, names of frequent shingles, and what stays with a flush.
PLAIN, FREQUENT, OWN = range(3)


def slack(n, percent: int = PERCENT):
    """Shingles that a linked node may lack."""
    return n * (100 - percent) // 100


def named(text: str) -> Column:
    """A 64-bit name of a text."""
    return F.xxhash64(F.col(text).cast("string"))


def described(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """doc_id, name (a hash of the text), n_shingles and node (a name of the set; null if empty) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, node = [], []
            for own in sets(batch.column(2), width):
                n.append(len(own))
                node.append(digest(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary())], ["doc_id", "name", "n_shingles", "node"])
        release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named(text).alias("name"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, name long, n_shingles long, node binary")


def packed(flush: int, token: np.ndarray, of: np.ndarray) -> bytes:
    """Postings sorted by token, with their nodes' numbers in the flush."""
    gaps = np.diff(token)
    wide = np.uint32 if not len(gaps) or gaps.max() < 1 << 32 else np.uint64
    small = np.uint16 if not len(of) or of.max() < 1 << 16 else np.uint32
    return b"".join(x.tobytes() for x in (np.array([PLAIN, flush, len(token), small().itemsize, wide().itemsize], np.int64), token[:1], gaps.astype(wide), of.astype(small)))


def flushed(tokens: list[np.ndarray], names: list[bytes], cuts: list[int], ranges: int):
    """(part, blob) of a flush of nodes with their sorted tokens."""
    import xxhash

    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    token, of = np.concatenate(tokens), np.repeat(np.arange(len(tokens), dtype=np.uint32), sizes)
    tokens.clear()  # else they take their memory twice
    order = np.argsort(token, kind="stable")
    token, of = token[order], of[order]
    del order
    held = b"".join(names)
    flush = xxhash.xxh3_64_intdigest(held) >> 1  # the same if the task runs again
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    counts = np.diff(np.append(starts, len(token)))
    frequent, often = token[starts[counts >= HOT]], np.repeat(counts >= HOT, counts)
    head = np.array([OWN, flush, len(names), int(often.sum())], np.int64)
    yield flush % ranges, b"".join([head.tobytes(), held, np.array(cuts, np.int32).tobytes(), token[often].tobytes(), of[often].tobytes()])
    part = range_of(frequent, ranges)
    for r in np.unique(part):
        own = frequent[part == r]
        yield int(r), np.array([FREQUENT, 0, len(own)], np.int64).tobytes() + own.tobytes()
    token, of = token[~often], of[~often]
    part = range_of(token, ranges)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(part[a]), packed(flush, token[a:b], of[a:b])


def postings(docs: DataFrame, width: int, percent: int, ranges: int, text: str) -> DataFrame:
    """part, blob: shingles of the range `part` with the nodes that have them, sorted by shingle, and what stays with the flushes."""

    def handed(*flush):
        import pyarrow as pa

        rows = list(flushed(*flush, ranges))
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows[at : at + 256]], pa.int32()), "blob": pa.array([r[1] for r in rows[at : at + 256]], pa.binary())})

    def run(batches):
        tokens, names, cuts, size, seen = [], [], [], 0, set()
        for batch in batches:
            for own in sets(batch.column(0), width):
                if len(own) < SHARED:
                    continue  # a set of one links with its equals alone
                name = digest(own)
                if name in seen:
                    continue
                seen.add(name)
                kept = np.unique(own >> np.uint64(64 - KEPT))
                tokens.append(kept)
                names.append(name)
                cuts.append(slack(len(own), percent) + SHARED - len(kept))
                size += len(kept)
                if size >= FLUSH:
                    yield from handed(tokens, names, cuts)
                    tokens, names, cuts, size, seen = [], [], [], 0, set()
        if tokens:
            yield from handed(tokens, names, cuts)
        release()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "part int, blob binary")


def range_of(token: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of hash values, of equal widths."""
    return ((token >> np.uint64(KEPT - 32)) * np.uint64(ranges)) >> np.uint64(32)


class Postings:
    """A blob of postings, read by stretches of tokens."""

    def __init__(self, blob: bytes):
        _, self.flush, n, small, wide = np.frombuffer(blob, np.int64, 5)
        self.first = np.frombuffer(blob, np.uint64, 1, 40)
        self.gaps = np.frombuffer(blob, np.uint32 if wide == 4 else np.uint64, n - 1, 48)
        self.of = np.frombuffer(blob, np.uint16 if small == 2 else np.uint32, n, 48 + wide * (n - 1))

    def tokens(self) -> np.ndarray:
        return np.cumsum(np.concatenate([self.first, self.gaps.astype(np.uint64)]), dtype=np.uint64)

    def between(self, low: int, high: int):
        """Tokens from low up to high, and their nodes' numbers."""
        token = self.tokens()
        a = np.searchsorted(token, np.uint64(low))
        b = np.searchsorted(token, np.uint64(high)) if high < 1 << KEPT else len(token)
        return token[a:b].copy(), self.of[a:b]


def shared_of(group: pd.DataFrame) -> pd.DataFrame:
    """Of a range's postings those of shingles with several nodes, by flush, with the counts; what stays with a flush goes on as it is."""
    kinds = [np.frombuffer(b, np.int64, 1)[0] for b in group["blob"]]
    frequent = [np.frombuffer(b, np.uint64, offset=24) for k, b in zip(kinds, group["blob"]) if k == FREQUENT]
    frequent = np.unique(np.concatenate(frequent)) if frequent else np.zeros(0, np.uint64)
    rows = [(int(np.frombuffer(b, np.int64, 1, 8)[0]), b) for k, b in zip(kinds, group["blob"]) if k == OWN]
    own = [Postings(b) for k, b in zip(kinds, group["blob"]) if k == PLAIN]
    parts = max(1, sum(len(p.of) for p in own) // (2 * RANGE))
    edges = [0, 1 << KEPT]
    if parts > 1:  # stretches of about as many postings each
        cuts = np.sort(np.concatenate([p.tokens()[:: max(1, len(p.of) // 64)] for p in own]))
        edges = [0, *np.unique(cuts[np.linspace(0, len(cuts) - 1, parts + 1).astype(int)[1:-1]]).tolist(), 1 << KEPT]
    for low, high in zip(edges, edges[1:]):
        pieces = [(p.flush, *p.between(low, high)) for p in own]
        pieces = [p for p in pieces if len(p[1])]
        if not pieces:
            continue
        token, at, size = np.unique(np.concatenate([p[1] for p in pieces]), return_inverse=True, return_counts=True)
        size[np.isin(token, frequent)] = HOT
        count = np.minimum(size, HOT).astype(np.uint16)[at]
        start = 0
        for flush, mine, of in pieces:
            here = count[start : start + len(mine)]
            start += len(mine)
            several = here > 1
            if several.any():
                short = np.ascontiguousarray(mine[several].view(np.uint8).reshape(-1, 8)[:, : KEPT // 8])
                head = np.array([PLAIN, flush, len(short), of.dtype.itemsize], np.int64)
                rows.append((int(flush), b"".join([head.tobytes(), here[several].tobytes(), of[several].tobytes(), short.tobytes()])))
    return pd.DataFrame(rows, columns=["flush", "blob"])


def first_shared(group: pd.DataFrame) -> pd.DataFrame:
    """node, m and tokens: the shared ones among the first shingles of each node of a flush, if two or more."""
    names, cuts, pieces = None, None, []
    for blob in group["blob"]:
        kind, _, n, x = np.frombuffer(blob, np.int64, 4)
        if kind == OWN:
            names, cuts = np.frombuffer(blob, np.uint64, 2 * n, 32).reshape(-1, 2), np.frombuffer(blob, np.int32, n, 32 + 16 * n)
            token = np.frombuffer(blob, np.uint64, x, at := 32 + 20 * n)
            pieces.append((token, np.frombuffer(blob, np.uint32, x, at + 8 * x), np.full(x, HOT, np.uint16)))
        else:
            count = np.frombuffer(blob, np.uint16, n, 32)
            of = np.frombuffer(blob, np.uint16 if x == 2 else np.uint32, n, 32 + 2 * n).astype(np.uint32)
            full = np.zeros((n, 8), np.uint8)
            full[:, : KEPT // 8] = np.frombuffer(blob, np.uint8, n * (KEPT // 8), 32 + (2 + x) * n).reshape(-1, KEPT // 8)
            pieces.append((full.view(np.uint64).ravel(), of, count))
    token, of, count = (np.concatenate([p[i] for p in pieces]) for i in range(3))
    del pieces
    if not len(token):
        return pd.DataFrame([], columns=["node", "m", "tokens"])
    order = np.lexsort((token, count, of))
    token, of = token[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    m = cuts[of[starts]] + np.diff(np.append(starts, len(of)))
    rows = [(names[of[s]].tobytes(), k, token[s : s + k].astype(np.int64)) for s, k in zip(starts, m.tolist()) if k >= SHARED]
    return pd.DataFrame(rows, columns=["node", "m", "tokens"])


def boundary(sizes: dict[int, int], length: float) -> int:
    """The most shared shingles of a light node, for the least cost. sizes: nodes by their number of them; length: entries of a list, on average."""
    best, least = 0, None
    light, heavy = 0.0, sum(n * m * length for m, n in sizes.items())
    for m in sorted(sizes):
        light += sizes[m] * m * (m - 1) / 2
        heavy -= sizes[m] * m * length
        if least is None or light + heavy <= least:
            best, least = m, light + heavy
    return best


def families(docs: DataFrame, total: int, width: int, percent: int, text: str) -> DataFrame:
    """node, component: nodes that may link, by family."""
    ranges = min(max(4, -(-total // RANGE)), RANGES)
    blobs = postings(docs, width, percent, ranges, text).groupBy("part").applyInPandas(shared_of, "flush long, blob binary")
    first = checkpoint(blobs.groupBy("flush").applyInPandas(first_shared, "node binary, m int, tokens array<long>"))
    lists = first.select("node", "m", F.explode("tokens").alias("key"))
    lengths = lists.groupBy("key").count().agg(F.avg("count")).head()[0] or 1.0
    at = boundary({r[0]: r[1] for r in first.groupBy("m").count().collect()}, lengths)
    subsets = F.flatten(F.transform("tokens", lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.xxhash64(F.array_sort(F.array(x, y))))))
    light = first.where(F.col("m") <= at).select("node", F.explode(subsets).alias("key"))
    lists = lists.withColumn("heavy", F.col("m") > at)
    links = None
    for filed, condition in ((light.withColumn("heavy", F.lit(True)), "a <> z"), (lists, "a <> z and heavy")):
        least = filed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.max("heavy").alias("heavy")).where(condition)
        own = filed.select("key", F.col("node").alias("b")).join(least.select("key", "a"), "key").where("a <> b").select("a", "b").distinct()
        links = own if links is None else links.unionByName(own)
    return components(links)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the right."""
    columns, of = np.unique(np.concatenate(right), return_inverse=True)
    r_row = np.repeat(np.arange(len(right)), [len(s) for s in right])
    l_row = np.repeat(np.arange(len(left)), [len(s) for s in left])
    token = np.concatenate(left)
    at = np.minimum(np.searchsorted(columns, token), len(columns) - 1)
    known = columns[at] == token
    l_row, l_col = l_row[known], at[known]
    # Only columns that both sides have; in bands, whose counts stay below 2 ** 24
    both = np.unique(l_col)
    l_col = np.searchsorted(both, l_col)
    here = np.searchsorted(both, of)
    kept = (here < len(both)) & (both[np.minimum(here, len(both) - 1)] == of) if len(both) else np.zeros(len(of), bool)
    r_row, r_col = r_row[kept], here[kept]
    lo, ro = np.argsort(l_col, kind="stable"), np.argsort(r_col, kind="stable")
    l_row, l_col, r_row, r_col = l_row[lo], l_col[lo], r_row[ro], r_col[ro]
    total = np.zeros((len(left), len(right)), np.int64)
    width = max(1, (1 << 22) // max(len(left), len(right)))
    for start in range(0, len(both), width):
        a = np.zeros((len(left), min(width, len(both) - start)), np.float32)
        b = np.zeros((len(right), a.shape[1]), np.float32)
        i, j = np.searchsorted(l_col, [start, start + width])
        a[l_row[i:j], l_col[i:j] - start] = 1
        i, j = np.searchsorted(r_col, [start, start + width])
        b[r_row[i:j], r_col[i:j] - start] = 1
        total += (a @ b.T).astype(np.int64)
    return total


def near(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets on the left link with which on the right."""
    both = common(left, right)
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (left, right) that connect all that a matrix of links connects."""
    seen_left, seen_right, out = np.zeros(len(links), bool), np.zeros(links.shape[1], bool), []
    for i in range(len(links)):
        if seen_left[i]:
            continue
        seen_left[i], waiting = True, [(i, True)]
        while waiting:
            k, is_left = waiting.pop()
            new = np.flatnonzero((links[k] & ~seen_right) if is_left else (links[:, k] & ~seen_left))
            (seen_right if is_left else seen_left)[new] = True
            out += [(k, int(x)) if is_left else (int(x), k) for x in new]
            waiting += [(int(x), not is_left) for x in new]
    return out


def unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in column]


LINKS = "a binary, b binary, degree int"


def stars_of(percent: int):
    """Links of a block's nodes with the centres beside it, and the block's nodes that have most of them (a null)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        centres, own = group[group["centre"]], group[~group["centre"]]
        if not len(own) or not len(centres):
            return pd.DataFrame([], columns=["a", "b", "degree"])
        links = near(unpacked(own["set"]), unpacked(centres["set"]), percent)
        node, centre = own["node"].to_numpy(), centres["node"].to_numpy()
        rows = [(centre[c], node[i], 0) for i, c in forest(links) if centre[c] != node[i]]
        degree = links.sum(1)
        rows += [(None, node[i], int(degree[i])) for i in np.argsort(-degree, kind="stable")[:FOLLOWED] if degree[i]]
        return pd.DataFrame(rows, columns=["a", "b", "degree"])

    return run


def beside(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """What stars_of finds in all blocks of members(component, members, node, set) with centres(component, node)."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = members.select("component", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "set", F.lit(False).alias("centre"))
    chosen = members.join(centres.select(F.col("component").alias("of"), F.col("node").alias("centre")), (F.col("component") == F.col("of")) & (F.col("node") == F.col("centre")))
    chosen = chosen.select("component", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "node", "set", F.lit(True).alias("centre"))
    return own.unionByName(chosen).groupBy("component", "block").applyInPandas(stars_of(percent), LINKS)


def first_of(df: DataFrame, n: int, *order) -> DataFrame:
    """component and node of each family's first n; partitions hand on no more than n each."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("component").orderBy(*order))).where(F.col("place") <= n).select("component", "node")


def large_links(members: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what is linked in families of more than BLOCK nodes: members(component, members, node, set)."""
    slim = members.select("component", "members", "node", (F.octet_length("set") / 8).cast("long").alias("n"))
    one = checkpoint(beside(members, first_of(slim, CENTRES, F.xxhash64("node"), "node"), percent))
    followed = one.where("a is null").join(slim.select("component", "node"), F.col("b") == F.col("node")).select("component", "node", "degree")
    two = checkpoint(beside(members, first_of(followed, FOLLOWED, F.desc("degree"), "node"), percent))
    found = one.unionByName(two).where("a is not null").select("a", "b")
    clusters = components(found)
    slim = checkpoint(slim.join(clusters.select(F.col("node").alias("of"), F.col("component").alias("cluster")), F.col("node") == F.col("of"), "left").select("component", "node", "n", F.coalesce("cluster", "node").alias("cluster")))
    sizes = slim.groupBy("component", "cluster").count()
    largest = sizes.groupBy("component").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("largest"), F.count("*").alias("clusters")).where("clusters > 1")
    # A link's sets are of one band of sizes or of neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.001 + 1e-6)).cast("int")
    slim = slim.join(largest.select(F.col("component").alias("of"), "largest"), F.col("component") == F.col("of")).select("component", "node", band.alias("band"), (F.col("cluster") != F.col("largest")).alias("outside"))
    counts = slim.groupBy("component", "band").agg(F.count("*").alias("all_"), F.count_if("outside").alias("out_")).select("component", "band", F.ceil(F.col("all_") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.col("out_") / BLOCK).cast("int").alias("out_blocks"))
    counts = checkpoint(counts)
    named = counts.select(F.col("component").alias("of"), F.col("band").alias("of_band"), "all_blocks", "out_blocks")
    slim = slim.join(named, (F.col("component") == F.col("of")) & (F.col("band") == F.col("of_band"))).drop("of", "of_band")
    rows = slim.join(members.select(F.col("node").alias("of"), "set"), F.col("node") == F.col("of")).drop("of")
    side = lambda df, salt, blocks: df.withColumn(salt, F.pmod(F.xxhash64("node"), F.greatest(F.col(blocks), F.lit(1))).cast("int"))
    other = lambda blocks: counts.select(F.col("component").alias("of"), F.col("band").alias("other"), F.col(blocks).alias("others")).where("others > 0")
    key = F.col("component") == F.col("of")

    def spread(df: DataFrame, blocks: str) -> DataFrame:
        """Rows once for each block of their family's other side, in their band and the neighbouring ones."""
        met = df.withColumn("other", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).withColumnRenamed("other", "met")
        met = met.join(other(blocks), key & (F.col("met") == F.col("other"))).drop("of", "other")
        return met.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))

    out = spread(side(rows.where("outside"), "salt", "out_blocks"), "all_blocks").select("component", F.col("band").alias("out_band"), F.col("salt").alias("out_block"), F.col("met").alias("all_band"), F.col("theirs").alias("all_block"), "node", "set", F.lit(True).alias("left"))
    all_ = spread(side(rows, "salt", "all_blocks"), "out_blocks").select("component", F.col("met").alias("out_band"), F.col("theirs").alias("out_block"), F.col("band").alias("all_band"), F.col("salt").alias("all_block"), "node", "set", F.lit(False).alias("left"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["a", "b"])
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        links = near(unpacked(left["set"]), unpacked(right["set"]), percent)
        return pd.DataFrame([(a[i], b[j]) for i, j in forest(links) if a[i] != b[j]], columns=["a", "b"])

    rest = out.unionByName(all_).groupBy("component", "out_band", "out_block", "all_band", "all_block").applyInPandas(compare, "a binary, b binary")
    return found.unionByName(rest)


def links(docs: DataFrame, rows: DataFrame, total: int, width: int, percent: int, text: str) -> DataFrame:
    """a, b: links between nodes that connect whatever is linked."""
    spark = docs.sparkSession
    family = families(docs, total, width, percent, text)
    sizes = family.groupBy("component").agg(F.count("*").alias("members"))
    family = checkpoint(family.join(sizes, "component"))
    # The texts of the nodes: one row of each, found by a filter on its doc_id and then by its node
    key = F.coalesce("doc_id", F.lit(-1))
    chosen = rows.where("node is not null").groupBy("node").agg(F.min(key).alias("chosen")).join(family, "node")
    chosen = checkpoint(chosen)
    size = 1 << min(max(8 * chosen.count(), FEWEST_BITS), MOST_BITS).bit_length() - 1
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    spelt = chosen.select(bit("chosen").alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 31)")).alias("mask")).toPandas()
    bits = np.zeros(size // 32, np.uint32)
    bits[spelt["word"].to_numpy(int)] = spelt["mask"].to_numpy(np.int64).astype(np.uint32)
    known = spark.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((known.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            found = [(k, digest(own), own.tobytes()) for k, own in zip(batch.column(0).to_pylist(), sets(batch.column(1), width)) if len(own)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([f[0] for f in found], pa.int64()), "name": pa.array([f[1] for f in found], pa.binary()), "set": pa.array([f[2] for f in found], pa.binary())})
        release()

    again = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col(text).cast("string").alias("text")).select("doc_id", "text", bit("doc_id").alias("bit"))
    again = again.mapInArrow(run, "key long, name binary, set binary")
    members = again.join(chosen, (F.col("name") == F.col("node")) & (F.col("key") == F.col("chosen"))).select("component", "members", "node", "set").dropDuplicates(["node"])
    members = written(members)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        node, own = group["node"].to_numpy(), unpacked(group["set"])
        return pd.DataFrame([(node[i], node[j]) for i, j in forest(near(own, own, percent)) if i != j], columns=["a", "b"])

    found = members.where(F.col("members") <= BLOCK).groupBy("component").applyInPandas(compare, "a binary, b binary")
    large = members.where(F.col("members") > BLOCK)
    return found if large.isEmpty() else found.unionByName(large_links(large, percent))


def grouped_rows(docs: DataFrame, width: int, percent: int, text: str) -> DataFrame:
    """doc_id, name, n_shingles and component_id of every row."""
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100: below, sets may link on one shingle alone")
    rows = checkpoint(described(docs, width, text))
    total = rows.agg(F.sum("n_shingles")).head()[0] or 0
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    found = checkpoint(components(links(docs, rows, total, width, percent, text)).withColumnRenamed("node", "named"))
    grouped = least.join(found, F.col("node") == F.col("named"), "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = grouped.select(F.col("node").alias("of"), "component").join(ids, "component").select("of", "component_id")
    out = rows.join(by_node, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "name", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: two rows link when their sets' Jaccard similarity is at least percent / 100."""
    return grouped_rows(docs, width, percent, text).drop("name")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs without those that a group has besides the one of least doc_id.

    Rows with null doc_id stay unless their group has another row with one. Rows of one doc_id and different texts go each with its own group; of rows alike in both all stay or go."""
    groups = grouped_rows(docs.select("doc_id", text), width, percent, text)
    gone_id, gone_name = fresh(docs, "gone_id", "gone_name")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(gone_id), F.col("name").alias(gone_name)).distinct()
    kept = docs.join(written(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (named(text) == F.col(gone_name)), "left_anti")
    return kept.select(*columns(docs))
