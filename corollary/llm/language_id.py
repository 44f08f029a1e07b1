"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of bytes, up to three deep. A text's score is its exact
code length under each language's frozen statistics: the longest context that the tree holds predicts
the byte or pays an escape and hands over to the next shorter one, down to a uniform code of 8 bits
(method C escapes, no exclusions). The shortest code wins.

The four bytes that end at a position are one 32-bit number. Code lengths of the numbers seen in
training are kept resolved, escapes included, in hash tables, one for every GROUP languages; a number that
none of these languages has seen is put together from its escape and the next shorter number. So the
model holds what was seen, sparsely: no context is left out, whatever the number of languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_text
from .bytescan import column_bytes

DEPTH = 3
#: What stands before a document.
BLANK = 0x20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
#: Bound: training documents for each language.
MAX_TRAIN = 3000
#: Labels whose counts are broadcast; more are joined in a shuffle.
BROADCAST_LABELS = 10_000
#: Languages that share a table.
GROUP = 8
SEGMENT = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def coded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number: the byte in the lowest place, the farthest in the highest.

    A negative start is that of a document whose first bytes are not given."""
    out = data.astype(np.uint32)
    starts, ends = offsets[:-1], offsets[1:]
    for back in range(1, DEPTH + 1):
        previous = np.full(len(data), BLANK, np.uint8)
        previous[back:] = data[:-back]
        for i in range(back):
            early = (starts + i)[(starts + i >= 0) & (starts + i < ends)]
            previous[early] = BLANK
        out |= previous.astype(np.uint32) << np.uint32(8 * back)
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(rows: DataFrame, label: str, most: int, seed: str, *more: str) -> DataFrame:
    """About ``most`` rows of each label at the most, by a hash of the id (and of the columns ``more``).

    The bound does not move with the size of the table. Rows that agree in these columns go together.
    """
    counts = rows.groupBy(F.col(label).alias("counted_label")).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count(F.lit(1))).alias("counted_share"))
    few = counts.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", *more), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(F.broadcast(counts) if few else counts, F.col(label) == F.col("counted_label")).where(draw < F.col("counted_share")).drop("counted_label", "counted_share")


class Lookup:
    """Row numbers of distinct 32-bit keys: a hash table with linear probing, searched for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.mask = np.uint32((1 << self.bits) - 1)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, 0).astype(np.uint32)  # the last is never a match: its row is -1
        open_rows, at = np.arange(len(keys), dtype=np.int32), self._slots(self.keys[:-1])
        while len(open_rows):
            free = self.row[at] < 0
            self.row[at[free]] = open_rows[free]
            left = self.row[at] != open_rows
            open_rows, at = open_rows[left], (at[left] + np.uint32(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for keys that are not there."""
        at = self._slots(keys)
        out = self.row[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + np.uint32(1)) & self.mask
            out[wrong] = self.row[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[out[wrong]] != keys[wrong])]
        return out


def _node(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Bits of a symbol seen ``count`` times in a context: its share, or the escape and the shorter context's bits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, shorter, np.where(count > 0, np.log2((total + kinds) / count), _escape(total, kinds) + shorter))


def _escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Bits of the escape from a context; none where the tree does not hold it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 0.0, np.log2((total + kinds) / kinds))


def _per_context(context: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct symbols of each context, by language."""
    total, kinds = np.zeros((rows, count.shape[1])), np.zeros((rows, count.shape[1]))
    for k in range(count.shape[1]):
        total[:, k] = np.bincount(context, count[:, k], rows)
        kinds[:, k] = np.bincount(context, count[:, k] > 0, rows)
    return total, kinds


class Table:
    """Resolved code lengths in bits for some languages: dense up to one byte of context, hashed beyond."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        every = np.unique(np.concatenate([codes for codes, _ in counts])).astype(np.uint32)
        count = np.zeros((len(every), len(counts)))
        for k, (codes, seen) in enumerate(counts):
            count[np.searchsorted(every, codes), k] = seen
        levels = []
        for order in (3, 2, 1, 0):
            levels.append((every, count))
            shorter, inverse = np.unique(every & np.uint32((1 << 8 * order) - 1), return_inverse=True)
            less = np.zeros((len(shorter), len(counts)))
            for k in range(len(counts)):
                less[:, k] = np.bincount(inverse, count[:, k], len(shorter))
            every, count = shorter, less
        dense = []
        for order in (0, 1):
            keys, count = levels[3 - order]
            whole = np.zeros((256 ** (order + 1), len(counts)))
            whole[keys] = count
            context = np.arange(len(whole)) >> 8
            total, kinds = _per_context(context, whole, 256**order)
            lower = np.full((256, len(counts)), 8.0) if not order else dense[0]
            dense.append(_node(whole, total[context], kinds[context], np.tile(lower, (256**order, 1))))
        self.bits1 = dense[1].astype(np.float32)
        keys, count = levels[1]
        context = (keys >> np.uint32(8)).astype(np.int64)
        total, kinds = _per_context(context, count, 1 << 16)
        self.escape2 = _escape(total, kinds).astype(np.float32)
        self.seen2, lower = Lookup(keys), self.bits1[keys & np.uint32(0xFFFF)]
        self.bits2 = _node(count, total[context], kinds[context], lower).astype(np.float32)
        keys, count = levels[0]
        found, context = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, kinds = _per_context(context, count, len(found))
        self.context3, self.seen3 = Lookup(found), Lookup(keys)
        nothing = np.zeros((1, len(counts)))  # row -1: contexts that the tree does not hold
        self.escape3 = np.concatenate([_escape(total, kinds), nothing]).astype(np.float32)
        lower = self.bits2[self.seen2.find(keys & np.uint32(0xFFFFFF))]
        self.bits3 = np.concatenate([_node(count, total[context], kinds[context], lower), nothing]).astype(np.float32)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each position under each language."""
        row = self.seen3.find(codes)
        out = self.bits3[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            codes = codes[new]
            short = codes & np.uint32(0xFFFFFF)
            row = self.seen2.find(short)
            rest = self.bits2[row]
            unseen = np.flatnonzero(row < 0)
            rest[unseen] = self.escape2[short[unseen] >> np.uint32(8)] + self.bits1[short[unseen] & np.uint32(0xFFFF)]
            out[new] = self.escape3[self.context3.find(codes >> np.uint32(8))] + rest
        return out


class Trees:
    """The context trees of all languages."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.tables = [Table([counts[x] for x in langs[i : i + GROUP]]) for i in range(0, len(langs), GROUP)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each document under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
            part = offsets[lo : hi + 1]
            for a in range(int(part[0]), int(part[-1]), SEGMENT):  # a very long document takes several rounds
                b, lead = min(a + SEGMENT, int(part[-1])), min(DEPTH, a - int(part[0]))
                inner = np.clip(part, a - lead, b) - (a - lead)
                codes = coded(data[a - lead : b], inner if a == part[0] else np.array([-DEPTH, b - a + lead]))[lead:]
                edges = np.clip(part, a, b) - a
                some = np.flatnonzero(edges[1:] > edges[:-1])
                if len(some):
                    for k, table in enumerate(self.tables):
                        out[lo + some, k * GROUP : (k + 1) * GROUP] += np.add.reduceat(table.bits(codes), edges[some], axis=0, dtype=np.float64)
            lo = hi
        return out


def train(rows: DataFrame, most: int = MAX_TRAIN) -> Trees | None:
    """Trees from (doc_id, lang, text) rows with a language; counting is distributed and partial."""
    chosen = sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), "lang", most, "ppm", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = column_bytes(batch.column("text"))
        names, of = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
        code = np.repeat(of, np.diff(offsets)).astype(np.int64) << 32 | coded(data, offsets)
        found, seen = np.unique(code, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([str(names[i]) for i in found >> 32]), pa.array(found & 0xFFFFFFFF), pa.array(seen)], ["lang", "code", "seen"])

    # distinct runs of four bytes in the bounded sample: statistics of the model, not of documents
    grams = map_text(chosen.select("lang", "text"), count, "lang string, code long, seen long").groupBy("lang", "code").agg(F.sum("seen").alias("seen")).orderBy("lang", "code").toArrow()
    lang, code, seen = (grams.column(i).combine_chunks() for i in range(3))
    names = lang.dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    langs = names.dictionary.to_pylist()
    if not langs:
        return None
    of, code, seen = names.indices.to_numpy(), code.to_numpy(), seen.to_numpy()
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    return Trees([langs[i] for i in order], {langs[i]: (code[of == i], seen[of == i]) for i in order})


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, held_out, text) -> rows of SCHEMA. A text without a letter, or a null one, is "und" with score 0.

    score is the winner's share of 2**-bits over all languages; bits_per_byte is the winner's exact code
    length by the text's bytes. Ties go to the first language in code-point order. Very long texts are coded in segments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = column_bytes(batch.column("text"))
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        lettered = letters[offsets[1:]] > letters[offsets[:-1]]
        for d in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
            lettered[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
        model = shared.value
        if model is None:
            lettered[:] = False
            bits = np.zeros((batch.num_rows, 1))
        else:
            bits = model.lengths(data, offsets)
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        names = model.langs if model is not None else [""]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([names[k] if ok else "und" for k, ok in zip(best, lettered)], pa.string()),
                pa.array(np.where(lettered, score, 0.0)),
                pa.array(np.where(lettered, least / np.maximum(1, np.diff(offsets)), 0.0)),
            ],
            [part.split()[0] for part in SCHEMA.split(", ")],
        )

    return map_text(docs.select("doc_id", "held_out", "text"), each, SCHEMA)


def language_id(docs: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out and have a language; predict every row.

    Null ids are not held out; they are drawn for training by their texts. Null languages are not learned
    from. Repeated rows count as often as they occur. An empty table, or one without languages, gives
    "und" for every row. Prediction reads the text alone; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return identify(rows, train(rows.where("NOT held_out"), most))
