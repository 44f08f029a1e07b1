"""Suffix-array deduplication: maximal repeats by the common-prefix interval tree of a sharded suffix array.

A string of LENGTH bytes that also starts earlier is removed. Strings of that length are sharded by
content: each has one anchor, the leftmost of its K-byte substrings of least hash, so equal strings
have equal anchors at equal places. Consecutive strings with one anchor form a segment; there are
about 2 segments for each LENGTH - K + 2 bytes, and only they are shuffled, never every position.

1. Segments meet by anchor. Whole segments that are equal are settled there: all but the first go.
   Each distinct segment of an anchor that has several different ones keeps a representative.
2. The bytes of the representatives are fetched, and the suffixes that start in them are sorted into an
   enhanced suffix array for each shard of anchors. A stack scan over its common prefixes gives the
   interval tree; an interval of at least LENGTH bytes whose occurrences have different bytes on their
   left is a maximal repeat (inside the segments), with all its occurrences. All but the first go.
3. Spans are united by document and cut out of the text.

Equal segments are found by 128 bits of hash; the repeats of step 2 are compared by their bytes.
maximal_repeats lists the maximal repeats of whole texts, across segments, by bytes alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowmap import map_text, pieces, release
from .bytescan import BYTE_VALUE, column_bytes, mix, powers
from .scratch import settle, write_once

LENGTH = 100
K = 32
CHUNK = 1 << 20
#: Bytes of text whose segments are collapsed and packed together.
PACKED = 8 << 20
#: Distinct segments of an anchor from which its strings are sharded by their own hash instead.
CROWDED = 20_000
#: Bytes of tails that are sent at once: the tails of one text may hold it many times over.
SENT = 4 << 20
#: Suffixes that a shard sorts at once, unless one anchor has more.
FLUSH = 400_000
LAST = (1 << 63) - 1
OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def segments(data: np.ndarray, offsets: np.ndarray):
    """Columns (document number, first string, last string, anchor hash, segment hash) of all segments.

    String positions count from the document's start.
    """
    parts = []
    for a in range(0, max(0, len(data) - LENGTH + 1), CHUNK - 2 * LENGTH):
        b = min(len(data), a + CHUNK)
        part = data[a:b]
        up, down = powers(CHUNK + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * up[: len(part)], out=total[1:])
        grams = len(part) - K + 1
        hashed = mix((total[K:] - total[:grams]) * down[:grams])
        low = (hashed & ~np.uint64(CHUNK - 1)) | np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= LENGTH - K + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = LENGTH - K + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        start = np.arange(min(len(low), CHUNK - 2 * LENGTH), dtype=np.int64)
        doc = np.searchsorted(offsets, start + a, "right") - 1
        fits = start + a + LENGTH <= offsets[doc + 1]
        start, doc = start[fits], doc[fits]
        if not len(start):
            continue
        anchor = (low[start] & np.uint64(CHUNK - 1)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
        at, doc = anchor[first], doc[first]
        body = (total[hi + LENGTH] - total[lo]) * down[lo]
        body = mix(body + mix((hi - lo).astype(np.uint64) * np.uint64(128) + (at - lo).astype(np.uint64)))
        begin = offsets[doc] - a
        parts.append((doc, lo - begin, hi - begin, hashed[at], body))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def united(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Spans [lo, hi) of each document with touching and overlapping ones made one; sorted."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    shift = doc * (int(hi.max()) + 2)  # one axis for all documents, with gaps between them
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - shift[last]


def _segment_rows(batch: pa.RecordBatch, buckets: int):
    """Packed segments of a piece by bucket (kind 0), and spans already settled inside the piece (kind 1)."""
    data, offsets, _ = column_bytes(batch.column("text"))
    doc, lo, hi, anchor, body = segments(data, offsets)
    if not len(doc):
        return None
    ids, marks = np.asarray(batch.column("doc")), np.asarray(batch.column("tk"))
    _, place = np.unique(np.stack([ids, marks]), axis=1, return_inverse=True)  # order of documents
    order = np.lexsort((lo, place[doc], body, anchor))
    doc, lo, hi, anchor, body = doc[order], lo[order], hi[order], anchor[order], body[order]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (place[doc] != place[doc[head]]) | (lo != lo[head])
    out = []
    if gone.any():
        d, s, e = united(doc[gone], lo[gone], hi[gone] + LENGTH)
        table = np.stack([ids[d], marks[d], s, e], axis=1).astype(np.int64)
        out.append((1, int(mix(anchor[:1])[0] % np.uint64(buckets)), table.tobytes()))
    doc, lo, hi, anchor, body = doc[new], lo[new], hi[new], anchor[new], body[new]
    bucket = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(bucket)]):
        rows = order[a:b]
        used, local = np.unique(doc[rows], return_inverse=True)
        head = np.array([len(used), len(rows)], np.int64)
        parts = (head, ids[used], marks[used], anchor[rows], body[rows], local.astype(np.uint32), lo[rows].astype(np.uint32), (hi - lo)[rows].astype(np.uint8))
        out.append((0, int(bucket[a]), b"".join(np.ascontiguousarray(p).tobytes() for p in parts)))
    kinds, places, blobs = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "bucket", "blob"])


SETTLED = "kind int, anchor long, crowd long, doc long, tk long, lo long, hi long"


def _rows(kind: int, anchor, crowd, doc, tk, lo, hi) -> pa.RecordBatch:
    n = len(doc)
    columns = [np.full(n, kind, np.int32), anchor, crowd, doc, tk, lo, hi]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int32 if i == 0 else np.int64)) for i, c in enumerate(columns)], [c.split()[0] for c in SETTLED.split(", ")])


def _settle_bucket(blobs: list[bytes]):
    """Spans of whole segments that have an equal, earlier one; representatives of anchors with different ones."""
    columns = [[] for _ in range(6)]
    for blob in blobs:
        used, n = np.frombuffer(blob, np.int64, 2)
        at = 16
        table = []
        for kind, size in ((np.int64, used), (np.int64, used), (np.uint64, n), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint8, n)):
            table.append(np.frombuffer(blob, kind, size, at))
            at += np.dtype(kind).itemsize * int(size)
        ids, marks, anchor, body, local, lo, span = table
        for column, values in zip(columns, (ids[local], marks[local], anchor, body, lo.astype(np.int64), span.astype(np.int64))):
            column.append(values)
    doc, tk, anchor, body, lo, span = (np.concatenate(c) for c in columns)
    found, size = np.unique(anchor, return_counts=True)
    keep = size[np.searchsorted(found, anchor)] > 1  # most anchors occur once
    doc, tk, anchor, body, lo, span = (c[keep] for c in (doc, tk, anchor, body, lo, span))
    if not len(doc):
        return
    order = np.lexsort((lo, tk, doc, body, anchor))
    doc, tk, anchor, body, lo, span = (c[order] for c in (doc, tk, anchor, body, lo, span))
    other = np.ones(len(doc), bool)
    other[1:] = anchor[1:] != anchor[:-1]
    new = other.copy()
    new[1:] |= body[1:] != body[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (doc != doc[head]) | (tk != tk[head]) | (lo != lo[head])
    none = np.zeros(int(gone.sum()), np.int64)
    if gone.any():
        yield _rows(1, none, none, doc[gone], tk[gone], lo[gone], (lo + span)[gone] + LENGTH)
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(other))
    crowd = np.repeat(kinds, np.diff(np.append(np.flatnonzero(other), len(doc))))
    mixed = new & (crowd > 1)
    if mixed.any():
        yield _rows(0, anchor[mixed].view(np.int64), crowd[mixed], doc[mixed], tk[mixed], lo[mixed], (lo + span)[mixed])


def _settle_partition(batches):
    at, held = None, []
    for batch in batches:
        for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if kind == 1:
                table = np.frombuffer(blob, np.int64).reshape(-1, 4)
                none = np.zeros(len(table), np.int64)
                yield _rows(1, none, none, *table.T)
                continue
            if bucket != at and held:
                yield from _settle_bucket(held)
                held = []
            at = bucket
            held.append(blob)
    if held:
        yield from _settle_bucket(held)


BODIES = "done boolean, anchor long, doc long, tk long, lo long, hi long, before int, body binary"


def _body_rows(batch: pa.RecordBatch):
    """Bytes of the representatives, keyed by anchor; strings of crowded anchors go by their own hash.

    Those are made one for each piece first, so that no key has more rows than there are pieces.
    """
    data, offsets, _ = column_bytes(batch.column("text"))
    ids, marks, wanted = batch.column("doc").to_pylist(), batch.column("tk").to_pylist(), batch.column("wanted").to_pylist()
    out, crowded = [], []
    for d, rows in enumerate(wanted):
        text = data[offsets[d] : offsets[d + 1]]
        for row in rows:
            lo, hi = row["lo"], row["hi"]
            if row["crowd"] <= CROWDED:
                out.append((False, row["anchor"], ids[d], marks[d], lo, hi, int(text[lo - 1]) if lo else -1, text[lo : hi + LENGTH].tobytes()))
            else:
                crowded += [(text[s : s + LENGTH].tobytes(), ids[d], marks[d], s) for s in range(lo, hi + 1)]
    crowded.sort()
    head = None
    for row in crowded:
        if head is None or row[0] != head[0]:
            head = row
            out.append((False, int.from_bytes(hashlib.blake2b(row[0], digest_size=8).digest(), "little", signed=True), row[1], row[2], row[3], row[3], -1, row[0]))
        elif row[1:] != head[1:]:
            out.append((True, row[3], row[1], row[2], row[3], row[3] + LENGTH, -1, b""))
    if not out:
        return None
    columns = list(zip(*out))
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in BODIES.split(", ")])


def intervals(prefix: np.ndarray, least: int):
    """(depth, first, last) of the intervals of the common-prefix tree that are ``least`` deep, by a stack scan.

    ``prefix[i]`` is the common prefix of suffixes i - 1 and i in sorted order; prefix[0] is 0.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefix) + 1):
        depth = int(prefix[i]) if i < len(prefix) else 0
        left = i - 1
        while stack and stack[-1][0] > depth:
            top, left = stack.pop()
            yield top, left, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def repeats(bodies: list[bytes], before: list[int]):
    """(length, [(body, start), ...]) of the maximal repeats of at least LENGTH bytes in the bodies.

    Strings are found by hash first: those that stand once, and those whose every occurrence has the
    same byte on its left (so that the longer string tells of them), are no maximal repeats and are not
    sorted. The start of a body has no left byte and differs from any.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    body = np.repeat(np.arange(len(bodies)), strings)
    start = np.arange(len(body)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begin[body] + start
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    hashed = (total[at + LENGTH] - total[at]) * down[at]
    left = np.where(start > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + body)
    order = np.argsort(hashed, kind="stable")
    sorted_hash, sorted_left = hashed[order], left[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_hash[1:] != sorted_hash[:-1]]))
    diverse = np.minimum.reduceat(sorted_left, first) != np.maximum.reduceat(sorted_left, first)
    chosen = order[np.repeat(diverse, np.diff(np.append(first, len(order))))]
    if not len(chosen):
        return
    # the enhanced suffix array of the chosen suffixes: bytes to the end of their bodies, then common prefixes
    widest = int((size[body[chosen]] - start[chosen]).max())
    columns = -(-widest // 8) * 8
    length = size[body[chosen]] - start[chosen]
    index = np.minimum(at[chosen][:, None] + np.arange(columns), len(data) - 1)
    block = np.where(np.arange(columns) < length[:, None], data[index], 0).astype(np.uint8)
    keys = block.view(">u8").astype(np.uint64)
    sort = np.lexsort((length, *keys.T[::-1]))
    chosen, block, length = chosen[sort], block[sort], length[sort]
    differ = block[1:] != block[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), columns)
    prefix = np.concatenate([[0], np.minimum(prefix, np.minimum(length[1:], length[:-1]))])
    left = left[chosen]
    for depth, lo, hi in intervals(prefix, LENGTH):
        if left[lo : hi + 1].min() != left[lo : hi + 1].max():
            yield depth, list(zip(body[chosen[lo : hi + 1]].tolist(), start[chosen[lo : hi + 1]].tolist()))


SPANS = "doc long, tk long, lo long, hi long"
GROUPS = "length long, doc long, tk long, lo long, first boolean"


def _grouped(rows: list[tuple]):
    """(length, doc, tk, start, is first) of every occurrence of every maximal repeat of one shard."""
    for length, places in repeats([r[5] for r in rows], [r[4] for r in rows]):
        found = sorted((rows[b][0], rows[b][1], rows[b][2] + s) for b, s in places)
        for place in found:
            yield (length, *place, place == found[0])


def _shards(batches):
    """Rows of BODIES sorted by anchor -> rows of GROUPS. Shards are whole anchors, FLUSH strings or so at once."""
    at, held, strings = None, [], 0

    def flush():
        found = list(_grouped(held))
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 4 else pa.int64()) for i, c in enumerate(columns)], [c.split()[0] for c in GROUPS.split(", ")])

    for batch in batches:
        for done, anchor, doc, tk, lo, hi, before, body in zip(*(batch.column(c.split()[0]).to_pylist() for c in BODIES.split(", "))):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (hi - lo, doc, tk, lo)] + [pa.array([False])], [c.split()[0] for c in GROUPS.split(", ")])
                continue
            if anchor != at and strings >= FLUSH:
                yield from flush()
                held, strings = [], 0
            at = anchor
            held.append((doc, tk, lo, hi, before, body))
            strings += hi - lo + 1
    if held:
        yield from flush()


def _finish(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets, _ = column_bytes(batch.column("text"))
    rows = []
    for d, spans in enumerate(batch.column("spans").to_pylist()):
        text = data[offsets[d] : offsets[d + 1]]
        if spans:
            lo, hi = (np.array([s[k] for s in spans], np.int64) for k in ("lo", "hi"))
            _, lo, hi = united(np.zeros(len(lo), np.int64), lo, hi)
            keep = np.ones(len(text), bool)
            for s, e in zip(lo, hi):
                keep[s:e] = False
            kept = text[keep]
            rows.append((len(text), len(text) - len(kept), len(lo), hashlib.sha256(kept.tobytes()).hexdigest()))
        else:
            rows.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [c.split()[0] for c in OUTPUT.split(", ")])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled spans, maximal repeats) as written tables."""
    spark = rows.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PACKED):
                out = _segment_rows(piece, buckets)
                if out is not None:
                    yield out

    packed = rows.select("doc", "tk", "text").mapInArrow(cut, "kind int, bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    settled = write_once(packed.mapInArrow(_settle_partition, SETTLED), "segments")
    settle(spark)
    wanted = settled.where("kind = 0").groupBy("doc", "tk").agg(F.collect_list(F.struct("anchor", "crowd", "lo", "hi")).alias("wanted"))
    bodies = map_text(rows.select("doc", "tk", "text").join(wanted, ["doc", "tk"]), _body_rows, BODIES)
    groups = write_once(bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, GROUPS), "repeats")
    settle(spark)
    return settled.where("kind = 1"), groups


PLACED = "anchor long, doc long, tk long, lo long, hi long"
OCCURRING = "anchor long, doc long, tk long, lo long, before int, body binary"
MARKED = "start boolean, key long, doc long, tk long, lo long, hi long"
TAILS = "key long, doc long, tk long, lo long, before int, tail binary"
REPEATS = "repeat string, length long, doc long, tk long, lo long, first boolean"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch | None:
    """Rows as a batch of ``schema``; None without rows."""
    if not rows:
        return None
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Every segment: its anchor and place."""
    data, offsets, _ = column_bytes(batch.column("text"))
    doc, lo, hi, anchor, _ = segments(data, offsets)
    ids, marks = np.asarray(batch.column("doc")), np.asarray(batch.column("tk"))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor.view(np.int64), ids[doc], marks[doc], lo, hi)], [c.split()[0] for c in PLACED.split(", ")])


def _occurring(batch: pa.RecordBatch):
    """Bytes of the wanted segments, and the byte before each."""
    data, offsets, _ = column_bytes(batch.column("text"))
    out = []
    for d, (doc, tk, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "tk", "wanted")))):
        text = data[offsets[d] : offsets[d + 1]]
        out += [(w["anchor"], doc, tk, w["lo"], int(text[w["lo"] - 1]) if w["lo"] else -1, text[w["lo"] : w["hi"] + LENGTH].tobytes()) for w in wanted]
    return _arrow(out, OCCURRING)


def _marked(rows: list[tuple]):
    """Of all segments of some anchors: stretches of strings that are repeated, and the left-diverse ones among these.

    A repeat that is maximal starts with a string whose occurrences have different bytes on their left.
    """
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    size = np.array([len(r[5]) for r in rows], np.int64)
    begin, strings = np.cumsum(size) - size, size - LENGTH + 1
    body = np.repeat(np.arange(len(rows)), strings)
    start = np.arange(len(body)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = begin[body] + start
    before = np.array([r[4] for r in rows], np.int64)
    first = np.where(before < 0, 256 + np.arange(len(rows)), before)  # the start of a text differs from any byte
    left = np.where(start > 0, data[np.maximum(at - 1, 0)].astype(np.int64), first[body])
    whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").ravel()
    order = np.argsort(whole, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
    count = np.diff(np.append(new, len(order)))
    diverse = np.minimum.reduceat(left[order], new) != np.maximum.reduceat(left[order], new)
    repeated, starts = np.zeros(len(order), bool), np.zeros(len(order), bool)
    repeated[order] = np.repeat(count > 1, count)
    starts[order] = np.repeat((count > 1) & diverse, count)
    edge = np.flatnonzero(repeated & ~(np.concatenate([[False], repeated[:-1]]) & (start > 0)))
    last = np.flatnonzero(repeated & ~(np.concatenate([repeated[1:], [False]]) & (start + 1 < strings[body])))
    out = [(False, 0, *rows[body[a]][1:3], rows[body[a]][3] + int(start[a]), rows[body[a]][3] + int(start[b]) + LENGTH) for a, b in zip(edge, last)]
    for i in np.flatnonzero(starts):
        key = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + LENGTH].tobytes(), digest_size=8).digest(), "little", signed=True)
        lo = rows[body[i]][3] + int(start[i])
        out.append((True, key, *rows[body[i]][1:3], lo, lo))
    return _arrow(out, MARKED)


def _by_key(each, schema: str, enough: int):
    """Rows sorted by their first column -> ``each`` over lists of rows; equal keys stay together, ``enough`` bytes or so at once."""

    def run(batches):
        held, weight, at = [], 0, None
        for row in (row for batch in batches for piece in pieces(batch, schema.split(", ")[-1].split()[0]) for row in zip(*(piece.column(c.split()[0]).to_pylist() for c in schema.split(", ")))):
                if row[0] != at and weight >= enough:
                    if (out := each(held)) is not None:
                        yield out
                    held, weight = [], 0
                at = row[0]
                held.append(row)
                weight += len(row[-1])
        if held and (out := each(held)) is not None:
            yield out

    return run


def _tails(batch: pa.RecordBatch):
    """The text from each left-diverse start to where repeated strings end: no repeat from there reaches further. SENT bytes or so at once."""
    data, offsets, _ = column_bytes(batch.column("text"))
    out, weight = [], 0
    for d, (doc, tk, spans, starts) in enumerate(zip(*(batch.column(c) for c in ("doc", "tk", "spans", "starts")))):
        text = data[offsets[d] : offsets[d + 1]]
        lo, hi = (np.array([s[k] for s in spans.as_py()], np.int64) for k in ("lo", "hi"))
        _, lo, hi = united(np.zeros(len(lo), np.int64), lo, hi - LENGTH + 1)  # in starts of strings
        for s in starts.as_py():
            p = s["lo"]
            end = int(hi[np.searchsorted(lo, p, "right") - 1]) + LENGTH - 1
            out.append((s["key"], doc.as_py(), tk.as_py(), p, int(text[p - 1]) if p else -1, text[p:end].tobytes()))
            weight += end - p
            if weight >= SENT:
                yield _arrow(out, TAILS)
                out, weight = [], 0
    if out:
        yield _arrow(out, TAILS)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _listed(rows: list[tuple]):
    """Rows of REPEATS from tails that start with the same strings: an enhanced suffix array and its intervals."""
    rows = sorted(rows, key=lambda r: r[5])
    prefix = np.array([0] + [_common(a[5], b[5]) for a, b in zip(rows, rows[1:])], np.int64)
    left = np.array([256 + i if r[4] < 0 else r[4] for i, r in enumerate(rows)], np.int64)
    out = []
    for depth, lo, hi in intervals(prefix, LENGTH):
        if left[lo : hi + 1].min() != left[lo : hi + 1].max():
            name = hashlib.sha256(rows[lo][5][:depth]).hexdigest()
            places = sorted(r[1:4] for r in rows[lo : hi + 1])
            out += [(name, depth, *place, place == places[0]) for place in places]
    return _arrow(out, REPEATS)


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Rows of REPEATS: each occurrence of each maximal repeat of at least LENGTH bytes, in whole texts.

    ``repeat`` is the SHA-256 of the repeated bytes, ``lo`` the byte offset, ``first`` marks the earliest
    occurrence, tk is a hash of the text. Copies, and passages of any length, are listed with all their
    places; a repeat inside a longer one only if it also stands elsewhere. Everything is compared by bytes.
    Rows that repeat a doc_id and a text are one document. The result can grow with the square of a
    text that repeats itself with a short period.
    """
    ship(docs.sparkSession)
    rows = _keyed(docs).select("doc", "tk", "text").dropDuplicates(["doc", "tk"])
    placed = write_once(map_text(rows, _placed, PLACED), "placed")
    shared = placed.groupBy("anchor").count().where("count > 1").select("anchor")
    wanted = placed.join(shared, "anchor", "left_semi").groupBy("doc", "tk").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("wanted"))
    bodies = map_text(rows.join(wanted, ["doc", "tk"]), _occurring, OCCURRING)
    marked = write_once(bodies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_by_key(_marked, OCCURRING, FLUSH), MARKED), "marked")
    of = lambda test, *names: F.collect_list(F.when(test, F.struct(*names)))
    listed = marked.groupBy("doc", "tk").agg(of(~F.col("start"), "lo", "hi").alias("spans"), of(F.col("start"), "key", "lo").alias("starts"))

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield from _tails(piece)
        release()

    tails = rows.join(listed, ["doc", "tk"]).mapInArrow(cut, TAILS)
    return tails.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(_listed, TAILS, 0), REPEATS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows of OUTPUT, one per row of ``docs``: what is left without strings that start earlier elsewhere.

    Earlier is a smaller doc_id, or the same document and a smaller offset. A null or empty text has no
    bytes; texts of fewer than LENGTH bytes lose nothing. A null doc_id comes after all others. Rows that
    repeat a doc_id and a text are one document and do not remove each other's bytes; with one doc_id and
    different texts, a hash of the text decides which is earlier. Very long texts are scanned in chunks.
    Empty tables give empty results; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = _keyed(docs)
    settled, groups = _found(rows)
    more = groups.where("NOT first").select("doc", "tk", "lo", (F.col("lo") + F.col("length")).alias("hi"))
    spans = settled.select("doc", "tk", "lo", "hi").unionByName(more)
    listed = spans.groupBy("doc", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return map_text(rows.join(listed, ["doc", "tk"], "left").select("doc_id", "text", "spans"), _finish, OUTPUT)
