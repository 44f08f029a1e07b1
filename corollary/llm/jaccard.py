"""N-gram Jaccard join with adaptive multi-match prefixes.

Tokens (hashes of 5-word shingles) have one order for all documents, rare ones first. Two sets of
Jaccard similarity s share at least s*|x| tokens, so their prefixes of |x| - ceil(s*|x|) + l tokens
share at least l, for any l. Each document picks its own l by what the prefix will cost: postings
read, and candidates that must be verified, both estimated from token frequencies. A pair must share
a tokens to be similar, by its two sizes. What a set shares beyond its prefix is at most the rest of
it, so the prefixes share at least a less the longer rest: the longer the prefixes that two documents
picked, the more shared tokens are required, and only pairs that have them are verified on their whole sets.

The steps:

1. One pass signs each set with 128 bits (equal sets become one node) and counts tokens in a sketch of
   fixed size, from which the order and the estimates come. An order from rough counts is as right as any.
2. One pass emits prefix postings, packed by bucket; a bucket keeps the tokens of two nodes or more.
   Frequent tokens are salted over several buckets.
3. Lists of many nodes are collapsed first: each node is verified against a few leaders of the list, and
   what links is one component. A group of m near copies so costs a few pairs for each copy, not m**2.
4. In the remaining lists, pairs of nodes in different components are counted by shared prefix tokens.
   Each set has a bitmap of the parities of its tokens' hashes: what two bitmaps differ in bounds how much
   the sets share, and only pairs that can still be similar, and that can still share as many prefix tokens
   as required, become rows. They are verified. Pairs inside a component cannot change the result. Long
   lists are cut into blocks, and each pair of blocks is a cell of its own, so that no list has to meet in
   one task. Of long lists a spanning forest of the likeliest links is verified before all that is left,
   so that a group of m copies, few of them similar to a leader, again costs a few pairs for each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowmap import PIECE, map_text, pieces, release
from .bytescan import column_bytes, mix, shingle_sets
from .components import components
from .scratch import settle, write_once

NUM, DEN = 75, 100
K = 5
#: Counters of the sketch, and rows that it is summed in.
CELLS, SLICES = 1 << 22, 256
CELL_SHIFT = np.uint64(64 - 22)
#: Longest l, and the estimated costs of emitting a posting, meeting another in a list, verifying a pair.
L_MAX, EMIT, MEET, VERIFY = 4, 1.0, 0.5, 20.0
#: Tokens of more estimated documents are salted into lists of about so many.
SALT = 2000
#: Nodes in a list from which it is collapsed by leaders, and leaders for each.
LARGE, LEADERS = 8, 3
#: Postings of the lists of one leader that are dealt together; more are spread over several cells.
SPREAD = 1500
#: Nodes of a list in one block: a longer list is dealt as pairs of blocks.
BLOCK = 1000
#: Nodes in a list from which its likeliest links are verified first.
CROWD = 4
#: Bits of a set's bitmap for each token, and words of bitmaps that are compared at once.
BITS, AT_ONCE = 4, 1 << 19
#: Tokens (in all documents) for which there is one bucket of postings.
BUCKET = 4_000_000
#: Ids of documents to verify that are broadcast; more are joined in a shuffle.
BROADCAST_IDS = 1_000_000


def signature(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of token hashes, as two signed numbers."""
    a = mix(found).sum(dtype=np.uint64)
    b = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


FIRST = ["kind", "doc_id", "n", "sa", "sb", "cells", "bits"]


def parities(found: np.ndarray) -> bytes:
    """A bitmap of at least BITS bits for each token, a power of two: the parity of the tokens of each place.

    Two sets of one place count differ in at least as many tokens as their bitmaps differ in bits. The
    exclusive or of a bitmap's halves is the bitmap of half the places.
    """
    if not len(found):
        return b""
    places = 1 << max(6, int(BITS * len(found) - 1).bit_length())
    seen = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((seen & 1).astype(np.uint8), bitorder="little").tobytes()


def _first_pass(batches):
    """Rows (kind 0) of documents, then rows (kind 1) of the task's sketch: places in a slice, and counts."""
    cells = np.zeros(CELLS, np.int32)
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets, _ = column_bytes(piece.column("text"))
            sets = list(shingle_sets(data, offsets, K))
            cell, seen = np.unique(np.concatenate(sets) >> CELL_SHIFT, return_counts=True)
            cells[cell.astype(np.int64)] += seen.astype(np.int32)
            signs = [signature(s) for s in sets]
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), pa.nulls(n, pa.binary()), pa.array([parities(s) for s in sets], pa.binary())],
                FIRST,
            )
    found = []
    for k, part in enumerate(cells.reshape(SLICES, -1)):
        place = np.flatnonzero(part)
        if len(place):
            found.append((k, zlib.compress(place.astype(np.uint16).tobytes() + part[place].astype(np.uint32).tobytes(), 1)))
    if found:
        none = pa.nulls(len(found), pa.int64())
        numbers, blobs = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, pa.array(numbers, pa.int64()), none, none, pa.array(blobs, pa.binary()), pa.nulls(len(found), pa.binary())], FIRST)


def _levels(mean: float):
    """Sum a slice's sketches and keep one byte a cell: the power of two of its count above what chance gives."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("n").to_pylist(), batch.column("cells").to_pylist()):
                raw = zlib.decompress(blob)
                n = len(raw) // 6
                cells = total.setdefault(k, np.zeros(CELLS // SLICES, np.int64))
                cells[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.uint32, n, 2 * n)
        if total:
            levels = [np.ceil(np.log2(np.maximum(0, v - mean - 4 * np.sqrt(mean + 1)) + 1)).astype(np.uint8).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(levels, pa.binary())], ["n", "cells"])

    return run


class Order:
    """The order of tokens, rare first, and estimates of their frequencies."""

    def __init__(self, level: np.ndarray):
        self.level = level

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens in their order, estimated other documents of each)."""
        level = self.level[(tokens >> CELL_SHIFT).astype(np.int64)]
        place = np.argsort((level.astype(np.uint64) << np.uint64(58)) | (mix(tokens) >> np.uint64(6)), kind="stable")
        return tokens[place], np.exp2(level[place], dtype=np.float64) - 1


def prefix(n: int, excess: np.ndarray) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost for a set of ``n`` tokens in order."""
    need = -(-NUM * n // DEN)
    best = (np.inf, 1, 1)
    met = np.cumsum(excess)
    for chosen in range(1, min(L_MAX, need) + 1):
        length = min(n, n - need + chosen)
        others = float(met[length - 1])
        cost = EMIT * length + MEET * others + VERIFY * others / chosen
        if cost < best[0]:
            best = (cost, chosen, length)
    return best[1], best[2]


def _postings(batch: pa.RecordBatch, order: Order, buckets: int, known: set) -> pa.RecordBatch | None:
    """Packed prefix postings of a piece: (bucket, blob). A blob holds a table of sets and (token, set) pairs."""
    data, offsets, _ = column_bytes(batch.column("text"))
    rows, tokens, owner, salts = [], [], [], []
    for found in shingle_sets(data, offsets, K):
        if not len(found):
            continue
        sign = signature(found)
        if sign in known:
            continue
        known.add(sign)
        ordered, excess = order.of(found)
        _, length = prefix(len(found), excess)
        tokens.append(ordered[:length])
        owner.append(np.full(length, len(rows), np.uint32))
        split = np.ceil(excess[:length] / SALT).astype(np.uint64)
        salts.append(np.where(split > 1, np.uint64(sign[0] & 0xFFFFFFFF) % np.maximum(split, np.uint64(1)) + np.uint64(1), np.uint64(0)))
        rows.append((sign[0], sign[1], len(found), len(found) - length))
    if not rows:
        return None
    token, who, salt = np.concatenate(tokens), np.concatenate(owner), np.concatenate(salts)
    table = np.array(rows, np.int64)
    bucket = mix(token + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
    sort = np.lexsort((token, bucket))
    token, who, salt, bucket = token[sort], who[sort], salt[sort], bucket[sort]
    edge = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets + 1)))
    out = []
    for lo, hi in zip(edge, [*edge[1:], len(bucket)]):
        used, local = np.unique(who[lo:hi], return_inverse=True)
        head = np.array([len(used), hi - lo], np.int64)
        out.append(b"".join(x.tobytes() for x in (head, table[used], token[lo:hi], (salt[lo:hi] > 0).astype(np.uint8), local.astype(np.uint32))))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int64)), pa.array([zlib.compress(x, 1) for x in out], pa.binary())], ["bucket", "blob"])


def _unpack(blob: bytes):
    raw = zlib.decompress(blob)
    used, n = np.frombuffer(raw, np.int64, 2)
    at = 16 + 32 * used
    table = np.frombuffer(raw, np.int64, used * 4, 16).reshape(-1, 4)
    return table, np.frombuffer(raw, np.uint64, n, at), np.frombuffer(raw, np.uint8, n, at + 8 * n), np.frombuffer(raw, np.uint32, n, at + 9 * n)


def _shared(blobs: list[bytes]) -> pa.RecordBatch | None:
    """Postings of one bucket whose token has two different sets or more, or is salted."""
    tables, tokens, salted, owners, base = [], [], [], [], 0
    for blob in blobs:
        table, token, salt, who = _unpack(blob)
        tables.append(table)
        tokens.append(token)
        salted.append(salt)
        owners.append(who.astype(np.int64) + base)
        base += len(table)
    table, token, salt, who = np.concatenate(tables), np.concatenate(tokens), np.concatenate(salted), np.concatenate(owners)
    _, node = np.unique(table[:, :2], axis=0, return_inverse=True)
    sort = np.lexsort((node[who], token))
    token, salt, who = token[sort], salt[sort], who[sort]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[who[1:]] != node[who[:-1]])
    token, salt, who = token[fresh], salt[fresh], who[fresh]
    new = np.flatnonzero(np.diff(token, prepend=token[:1] + np.uint64(1))) if len(token) else np.zeros(0, np.int64)
    size = np.diff([*new, len(token)])
    keep = (np.repeat(size, size) > 1) | (salt > 0)
    if not keep.any():
        return None
    rows = table[who[keep]]
    columns = [pa.array(token[keep].view(np.int64)), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4))]
    return pa.RecordBatch.from_arrays(columns, ["token", "sa", "sb", "n", "rest"])


def _lists(batches):
    """Postings of shared tokens from a partition sorted by bucket; one bucket is held at a time."""
    at, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if bucket != at and held:
                out = _shared(held)
                if out is not None:
                    yield out
                held = []
            at = bucket
            held.append(blob)
    if held:
        out = _shared(held)
        if out is not None:
            yield out
    release()


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The pairs of sets that are similar enough."""
    left, lo, _ = column_bytes(batch.column("left"))
    right, ro, _ = column_bytes(batch.column("right"))
    keep = np.zeros(batch.num_rows, bool)
    for i in range(batch.num_rows):
        x = np.frombuffer(left[lo[i] : lo[i + 1]].tobytes(), np.uint64)
        y = np.frombuffer(right[ro[i] : ro[i + 1]].tobytes(), np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        keep[i] = DEN * both >= NUM * (len(x) + len(y) - both)
    return batch.select(["u", "v"]).filter(pa.array(keep)) if keep.any() else None


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified (u, v) of candidate (u, v); each side's set travels to its pairs."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("left")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("right")), "v").select("u", "v", "left", "right")
    return write_once(map_text(two, _verified, "u long, v long", column="left"), "links")


def _of_nodes(rows: DataFrame, nodes: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """The ``rows`` of the smallest doc_id of each of the ``nodes``, with node, sa and sb (where ``more`` are also on the rows, equal)."""
    wanted = write_once(nodes.join(classes, "node").withColumnRenamed("least", "doc_id"), "wanted")
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["doc_id", *more])


def _sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, tokens) of the documents in candidate pairs: their whole sets, sorted, as bytes."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    rows = _of_nodes(docs, nodes, classes)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = column_bytes(batch.column("text"))
        found = list(shingle_sets(data, offsets, K))
        signs = list(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()))
        same = [signature(s) == sign for s, sign in zip(found, signs)]
        ids = batch.column("node").filter(pa.array(same, pa.bool_()))
        return pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s, ok in zip(found, same) if ok], pa.binary())], ["node", "tokens"])

    return write_once(map_text(rows, each, "node long, tokens binary").dropDuplicates(["node"]), "sets")


def _enough(counted: DataFrame) -> DataFrame:
    """(u, v) of the pairs that share as many prefix tokens as a similar pair of their sizes must.

    ``counted`` has the pairs' shared tokens, sizes n and m, and how much their prefixes leave out.
    """
    overlap = F.ceil(F.lit(NUM) * (F.col("n") + F.col("m")) / F.lit(NUM + DEN))
    return write_once(counted.where(F.col("shared") >= overlap - F.greatest("rest", "left")).select("u", "v"), "pairs")


COUNTED = "u long, v long, shared long, n long, m long, rest long, left long"
CELL = "cell long, token long, node long, n long, rest long, root long, side int, bits binary"
#: What a row's list is to its cell: all of it, a block with itself, or one of two blocks.
WHOLE, LOWER, UPPER, DIAGONAL = range(4)
HELD, CODES = 50_000, 2_000_000


class Bitmaps:
    """Bitmaps of nodes, as rows of 64-bit words: one matrix for each length."""

    def __init__(self, bits: dict[int, bytes], names: np.ndarray):
        words = [np.frombuffer(bits[x], np.uint64) for x in names.tolist()]
        self.width = np.array([len(w) for w in words], np.int64)
        self.row, self.rows = np.zeros(len(names), np.int64), {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.row[own] = np.arange(len(own))
            self.rows[width] = np.stack([words[i] for i in own])

    def _folded(self, at: np.ndarray, width: int, to: int) -> np.ndarray:
        out = self.rows[width][self.row[at]]
        while out.shape[1] > to:
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return out

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of nodes, a lower bound of the number of tokens that only one of them has."""
        out = np.zeros(len(a), np.int64)
        x, y = self.width[a], self.width[b]
        for wide, other in {*zip(x.tolist(), y.tolist())}:
            every = np.flatnonzero((x == wide) & (y == other))
            to = min(wide, other)
            step = max(1, AT_ONCE // max(wide, other))
            for lo in range(0, len(every), step):
                part = every[lo : lo + step]
                words = self._folded(a[part], wide, to) ^ self._folded(b[part], other, to)
                out[part] = np.bitwise_count(words).sum(1, dtype=np.int64)
        return out


def needed(n, m):
    """Tokens that sets of ``n`` and ``m`` must share to be similar."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _forest(x: np.ndarray, y: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Which of the pairs, in this order, join two trees of a forest; ``parent`` is the forest so far."""

    def top(i):
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros(len(x), bool)
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = top(i), top(j)
        if i != j:
            parent[i], out[k] = j, True
    return out


def _count_pairs(table: pa.Table, bits: dict[int, bytes], forest: bool):
    """Pairs of different components in the lists of some tokens, with the number of lists that they share.

    Only pairs whose sizes, bitmaps and shared prefix tokens allow similarity are handed on; with
    ``forest`` only so many of them, the nearest first, as would join components.
    """
    cell, token, node, n, rest, root, side = (table.column(c).to_numpy() for c in ("cell", "token", "node", "n", "rest", "root", "side"))
    order = np.lexsort((root, token, cell))
    cell, token, node, n, rest, root, side = (c[order] for c in (cell, token, node, n, rest, root, side))
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(token)))
    run = np.flatnonzero(fresh | np.concatenate([[True], root[1:] != root[:-1]]))
    length = np.diff(np.append(run, len(token)))
    after = np.repeat(run + length, length)  # the first row of another component
    left = np.repeat(first + size, size) - after  # rows of the list from there
    names, index = np.unique(node, return_inverse=True)
    row_of = np.zeros(len(names), np.int64)
    row_of[index] = np.arange(len(index))
    # prefix tokens whose pairs may meet in other cells: those of other lists, and those of lists in blocks
    elsewhere = (n - rest)[row_of] - np.bincount(index[side == WHOLE], minlength=len(names))
    maps, trees = Bitmaps(bits, names), {}
    codes, waiting, parts = [], 0, 0

    def counted(whole: bool):
        code, shared = np.unique(np.concatenate(codes), return_counts=True)
        x, y = code // len(names), code % len(names)
        u, v = row_of[x], row_of[y]
        if whole:
            can = shared + np.minimum(elsewhere[x], elsewhere[y]) >= needed(n[u], n[v]) - np.maximum(rest[u], rest[v])
            x, y, u, v, shared = x[can], y[can], u[can], v[can], shared[can]
        spare = n[u] + n[v] - 2 * needed(n[u], n[v]) - maps.differing(x, y)
        near = np.flatnonzero(spare >= 0)
        if forest:
            near = near[np.argsort(-spare[near] / (n[u] + n[v])[near], kind="stable")]
            near = near[_forest(root[u[near]], root[v[near]], trees)]
        u, v, shared = u[near], v[near], shared[near]
        columns = (node[u], node[v], shared, n[u], n[v], rest[u], rest[v])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [c.split()[0] for c in COUNTED.split(", ")])

    at = np.flatnonzero(left > 0)
    for step in range(int(left.max(initial=0))):
        at = at[left[at] > step]
        other = after[at] + step
        low, high = np.minimum(n[at], n[other]), np.maximum(n[at], n[other])
        fits = (DEN * low >= NUM * high) & ((side[at] == WHOLE) | (side[at] == DIAGONAL) | (side[at] != side[other]))
        a, b = index[at[fits]], index[other[fits]]
        if len(a):
            codes.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            waiting += len(a)
        if waiting >= CODES:
            yield counted(False)
            codes, waiting, parts = [], 0, parts + 1
    if codes:
        yield counted(not parts)


def _likely_links(batches):
    yield from _pair_lists(batches, True)


def _pair_lists(batches, forest: bool = False):
    """_count_pairs over rows sorted by cell and token, some whole lists at a time.

    A cell's rows start with those that have no token but a node's bitmap; these are held while the cell lasts.
    """
    held, rows, bits, last = [], 0, {}, None
    names = [c.split()[0] for c in CELL.split(", ")]
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        lists = batch.column("token").is_valid().to_numpy(zero_copy_only=False)
        token = batch.column("token").fill_null(0).to_numpy()
        edge = np.ones(len(cell), bool)
        edge[1:] = (cell[1:] != cell[:-1]) | (token[1:] != token[:-1]) | (lists[1:] != lists[:-1])
        ends = np.flatnonzero(edge)
        if last is not None and len(cell) and last == (cell[0], token[0], lists[0]):
            ends = ends[1:]  # a list goes on
        lo = 0
        while lo < len(cell):
            far = ends[(ends > lo) & (rows + ends - lo >= HELD)]
            hi = int(far[0]) if len(far) else len(cell)
            part, is_list = batch.slice(lo, hi - lo), lists[lo:hi]
            given = np.flatnonzero(~is_list)
            if len(given):
                bits |= zip(part.column("node").take(pa.array(given)).to_pylist(), part.column("bits").take(pa.array(given)).to_pylist())
            if is_list.any():
                held.append(part.select(names[:7]).filter(pa.array(is_list)))
            rows += hi - lo
            if len(far):
                if held:
                    yield from _count_pairs(pa.Table.from_batches(held), bits, forest)
                if hi and cell[hi] != cell[hi - 1]:
                    bits = {}
                held, rows = [], 0
            lo = hi
        if len(cell):
            last = (cell[-1], token[-1], lists[-1])
    if held:
        yield from _count_pairs(pa.Table.from_batches(held), bits, forest)
    release()


def _rooted(rows: DataFrame, near: DataFrame) -> DataFrame:
    """``rows`` with the root of each node's component."""
    found = near.select(F.col("node").alias("c"), F.col("root").alias("r"))
    return rows.join(found, F.col("node") == F.col("c"), "left").withColumn("root", F.coalesce("r", "node")).drop("c", "r")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of lists with nodes of several components."""
    mixed = rows.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("t")
    return rows.join(mixed, F.col("token") == F.col("t"), "left_semi")


def _dealt(left: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows of CELL: the postings of each cell after the bitmaps of its nodes."""
    none = lambda *names: [F.lit(None).cast("long").alias(x) for x in names]
    maps = left.select("cell", "node").distinct().join(drawn, "node").select("cell", *none("token"), "node", *none("n", "rest", "root"), F.lit(None).cast("int").alias("side"), "bits")
    rows = left.drop("size").withColumn("bits", F.lit(None).cast("binary")).unionByName(maps)
    return rows.select(*(c.split()[0] for c in CELL.split(", "))).repartition("cell").sortWithinPartitions("cell", F.col("token").asc_nulls_first())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) runs of non-blank characters; a document's set holds its distinct
    5-word shingles, or its whole word sequence if that is shorter. Documents link from a similarity of
    NUM / DEN on; component_id is the smallest doc_id reachable by links, itself included.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing. A null doc_id takes part
    as a copy only: it gets its text's component, or null if no other row has that text. Rows that repeat
    a doc_id with one text are one document; with different texts each is judged by its own text. Ties
    cannot occur: links are exact. Empty tables give empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = write_once(rows.mapInArrow(_first_pass, "kind int, doc_id long, n long, sa long, sb long, cells binary, bits binary"), "signed")
    signed = first.where("kind = 0").select("doc_id", "n", "sa", "sb", "bits")
    tokens = signed.agg(F.sum("n")).first()[0] or 0
    mean = tokens / CELLS
    slices = first.where("kind = 1").select("n", "cells").repartition("n").mapInArrow(_levels(mean), "n long, cells binary")
    level = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    for k, blob in slices.collect():  # a byte for each of CELLS, whatever the corpus
        level[k] = np.frombuffer(bytes(blob), np.uint8)
    order = spark.sparkContext.broadcast(Order(level.ravel()))
    least = signed.where("n > 0").groupBy("sa", "sb").agg(F.min("doc_id").alias("least"))
    classes = write_once(least.where("least IS NOT NULL").withColumn("node", F.monotonically_increasing_id()), "classes")
    settle(spark)

    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BUCKET)

    def emit(batches):
        known: set = set()
        for batch in batches:
            for piece in pieces(batch, "text", 2 * PIECE):
                out = _postings(piece, order.value, buckets, known)
                if out is not None:
                    yield out
        release()

    packed = rows.mapInArrow(emit, "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    lists = write_once(packed.mapInArrow(_lists, "token long, sa long, sb long, n long, rest long"), "postings")
    settle(spark)

    named = lists.join(classes.drop("least"), ["sa", "sb"]).groupBy("token", "node").agg(F.first("n").alias("n"), F.first("rest").alias("rest"))
    posted = write_once(named, "lists")
    leader = lambda i: F.struct(*([F.xxhash64(F.lit(i), "node").alias("rank")] if i else []), "node", "n", "rest")
    stats = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *(F.min(leader(i)).alias(f"leader{i}") for i in range(LEADERS)))
    stats = write_once(stats.where("size > 1"), "stats")
    settle(spark)
    within = DEN * F.least("n", "m") >= NUM * F.greatest("n", "m")
    chosen = F.array_distinct(F.array(*(F.struct(F.col(f"leader{i}.node").alias("v"), F.col(f"leader{i}.n").alias("m"), F.col(f"leader{i}.rest").alias("left")) for i in range(LEADERS))))
    large = stats.where(F.col("size") >= LARGE).select(F.col("token").alias("t"), F.explode(chosen).alias("leader"))
    stars = posted.join(large, F.col("token") == F.col("t")).select(F.col("node").alias("u"), "n", "rest", "leader.v", "leader.m", "leader.left")
    stars = stars.where(within & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), *(F.first(c).alias(c) for c in ("n", "m", "rest", "left")))
    stars = _enough(stars)
    found = _links(stars, _sets(rows, stars, classes))
    settle(spark)
    near = components(found)
    # lists of one leader are dealt together, so that a pair's shared tokens are mostly counted where they meet
    homes = stats.groupBy(F.col("leader0.node").alias("home")).agg(F.ceil(F.sum("size") / SPREAD).alias("cells"))
    lists = stats.select(F.col("token").alias("t"), F.col("leader0.node").alias("home"), "size", F.ceil(F.col("size") / BLOCK).alias("blocks")).join(homes, "home")
    spread = F.pmod(F.xxhash64("token"), F.col("cells"))
    at = posted.join(lists, F.col("token") == F.col("t")).select("home", spread.alias("spread"), "blocks", "size", "token", "node", "n", "rest")
    mixed = _mixed(write_once(_rooted(at, near), "lists")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    left = mixed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("blocks") == 1, WHOLE).when(low == high, DIAGONAL).when(F.col("own") == low, LOWER).otherwise(UPPER)
    left = write_once(left.select(F.xxhash64("home", "spread", "blocks", low, high).alias("cell"), "token", "node", "n", "rest", "root", side.alias("side"), "size"), "cells")
    drawn = write_once(_of_nodes(signed.drop("n"), left.select("node").distinct(), classes, "sa", "sb").select("node", "bits").dropDuplicates(["node"]), "drawn")
    likely = _dealt(left.where(F.col("size") >= CROWD), drawn).mapInArrow(_likely_links, COUNTED)
    likely = write_once(likely.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "likely")
    settle(spark)
    if likely.limit(1).count():
        found = found.unionByName(_links(likely, _sets(rows, likely, classes)))
        settle(spark)
        near = components(found)
        left = write_once(_mixed(_rooted(left.drop("root"), near)), "cells")
    met = _dealt(left, drawn).mapInArrow(_pair_lists, COUNTED)
    met = met.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("shared").alias("shared"), *(F.first(c).alias(c) for c in ("n", "m", "rest", "left")))
    pairs = _enough(met.join(likely, ["u", "v"], "left_anti"))
    settle(spark)
    more = _links(pairs, _sets(rows, pairs, classes))
    settle(spark)
    roots = components(found.unionByName(more)) if more.limit(1).count() else near

    linked = roots.join(classes.select(F.col("node"), "least"), "node")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(smallest, "root").select(F.col("node").alias("c"), "component")
    rooted = classes.join(linked, F.col("node") == F.col("c"), "left").select("sa", "sb", F.coalesce("component", "least").alias("component"))
    out = signed.join(rooted, ["sa", "sb"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
