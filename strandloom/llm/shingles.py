"""Hashed word shingles of whole texts, straight from Arrow's buffers.

Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case. A text's set holds a 64-bit hash of each
run of `width` words; a text with fewer words has the hash of its whole sequence, and one without words the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed together.
PART = 1 << 19
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """Odd pseudo-random multipliers, the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


LETTER = stream(1, 256)
#: A letter's multiplier is that of its place in a stretch of a word times that of the stretch.
STRETCH = 1 << 12
PLACES, STRETCHES = stream(2, STRETCH), stream(4, 1)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where each begins. Long texts are taken by pieces that end at white space, so the work space is about that of PART bytes or of the longest word."""
    if len(data) <= 2 * PART:
        return piece_words(data)
    found, at = [], 0
    while at < len(data):
        end = min(at + PART, len(data))
        while end < len(data):  # on to the next white space
            space = np.flatnonzero(SPACE[data[end : end + PART]])
            end += int(space[0]) if len(space) else min(PART, len(data) - end)
            if len(space):
                break
        hashes, starts = piece_words(data[at:end])
        found.append((hashes, starts + at))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, of bytes taken at once."""
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), starts
    at = np.flatnonzero(inside)
    global STRETCHES
    place = at - np.repeat(starts, np.diff(np.append(np.searchsorted(at, starts), len(at))))
    values = LETTER[FOLD[data[at]]] * PLACES[place % STRETCH]
    if (stretch := int(place.max()) // STRETCH) > 0:
        if stretch >= len(STRETCHES):
            STRETCHES = stream(4, 2 * stretch)
        values *= np.where(place < STRETCH, U(1), STRETCHES[place // STRETCH])
    return mixed(np.add.reduceat(values, np.searchsorted(at, starts))), starts


def sets(column: pa.Array, width: int):
    """Sorted distinct hashes of each text of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    multipliers = stream(3, width)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
        end = min(end, len(column))
        base = offsets[row]
        # A blank between texts keeps words apart
        lengths = np.diff(offsets[row : end + 1])
        joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[base : offsets[end]]
        hashes, starts = words(joined)
        of = np.searchsorted(starts, np.append(begin, len(joined)))
        n = len(hashes)
        runs = np.zeros(max(0, n - width + 1), U)
        for i in range(width):
            runs += hashes[i : n - width + 1 + i] * multipliers[i] if n >= width else U(0)
        runs = mixed(runs)
        for i in range(len(lengths)):
            a, b = of[i], of[i + 1]
            if b - a >= width:
                own = np.sort(runs[a : b - width + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield mixed(np.array([(hashes[a:b] * multipliers[: b - a]).sum(dtype=U) + U(b - a)]))
            else:
                yield np.zeros(0, U)
        row = end


def digest(own: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())
