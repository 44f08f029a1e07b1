"""Vectorised scans over the UTF-8 bytes of an Arrow string column.

Every function works on the column's own byte buffer: no per-row Python string is made.
Word hashes are 64-bit: a polynomial over the bytes modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    null = np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32) if buffers[1] else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], null


def _folding(word: np.ndarray) -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[~word] = 0
    return fold


def _spaceless() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def _alphanumeric() -> np.ndarray:
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x41:0x5B] = True
    word[0x80:] = True
    return word


#: Lower-cased byte for bytes of words, 0 for separators. NUL is a word byte of the first kind: it folds to 1.
NON_SPACE = _folding(_spaceless())
NON_SPACE[0] = 1
LETTERS_DIGITS = _folding(_alphanumeric())


def _cuts(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> list[int]:
    """Positions where the bytes may be cut without cutting a word, about SEGMENT apart."""
    cuts, at, end = [0], 0, len(data)
    while end - at > SEGMENT:
        near = at + SEGMENT
        back = np.flatnonzero(fold[data[max(at, near - 65536) : near]] == 0)
        doc = offsets[np.searchsorted(offsets, near, "right") - 1]
        best = max(int(back[-1]) + 1 + max(at, near - 65536) if len(back) else 0, int(doc))
        if best <= at:  # one word or document without a separator: go on to its end
            ahead = np.flatnonzero(fold[data[near:]] == 0)
            doc = offsets[min(np.searchsorted(offsets, near, "left"), len(offsets) - 1)]
            best = min(near + int(ahead[0]) + 1 if len(ahead) else end, int(doc) if doc > at else end)
        at = best
        cuts.append(at)
    if cuts[-1] != end:
        cuts.append(end)
    return cuts


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Hash, start and end of every word, in order; ``prefixes`` adds hashes of words' first bytes.

    Words never cross the documents that ``offsets`` delimit.
    """
    inner = offsets[1:-1]
    hashes, begins, ends, heads = [], [], [], [[] for _ in prefixes]
    cuts = _cuts(data, offsets, fold)
    up, down = powers(max((b - a for a, b in zip(cuts, cuts[1:])), default=0) + 1)
    for a, b in zip(cuts, cuts[1:]):
        folded = fold[data[a:b]]
        inside = folded != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        end = np.zeros(b - a + 1, bool)
        end[1:] = inside
        end[1:-1] &= ~inside[1:]
        split = inner[np.searchsorted(inner, a, "right") : np.searchsorted(inner, b, "left")] - a
        begin[split] |= inside[split]
        end[split] |= inside[split - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_VALUE[folded] * up[: b - a], out=total[1:])
        length = (e - s).astype(np.uint64)
        hashes.append(mix((total[e] - total[s]) * down[s] + length))
        begins.append(s + a)
        ends.append(e + a)
        for out, n in zip(heads, prefixes):
            stop = np.minimum(s + n, e)
            out.append(mix((total[stop] - total[s]) * down[s] + np.uint64(1_000_003 * n)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    found = join(hashes, np.uint64), join(begins, np.int64), join(ends, np.int64)
    return (*found, [join(h, np.uint64) for h in heads]) if prefixes else found


_STEP = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def sequence_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (any k up to 32)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k * 0x2545F4914F6CDD1D % (1 << 64), np.uint64)
    for j in range(k):
        total += values[j : j + n] * _STEP[j]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5):
    """For each document the sorted distinct hashes of its ``k``-word shingles.

    A document of fewer words, but not none, has its whole word sequence as the one shingle.
    """
    hashed, begins, _ = words(data, offsets, NON_SPACE)
    first = np.searchsorted(begins, offsets)
    runs = sequence_hash(hashed, k)
    for lo, hi in zip(first, first[1:]):
        n = hi - lo
        if n >= k:
            yield np.unique(runs[lo : hi - k + 1])
        elif n:
            yield sequence_hash(hashed[lo:hi], int(n))
        else:
            yield np.zeros(0, np.uint64)
