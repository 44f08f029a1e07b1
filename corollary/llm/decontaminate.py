"""Benchmark decontamination with a positional inverted index over the training tokens.

The index is sharded by document: a task's piece of the corpus is a shard. It stores, for each test
term, the sorted token positions in the shard (postings, as one sorted array with term offsets). A
test window looks up its rarest term in the shard, shifts that list by the term's offset to get
possible starts, and intersects with the other terms' shifted lists from rare to frequent. No posting
leaves its task, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import filter_text, map_text
from .bytescan import LETTERS_DIGITS, column_bytes, words
from .scratch import write_once

MATCHES = "doc_id long, item_id string, start long, kind string"
#: Bytes of test texts whose windows are broadcast at once (a window takes about 60 bytes, a word one window); more are searched for block by block.
BROADCAST_LIMIT = 4 << 20
#: Windows whose places are compared at once for proximity.
AT_ONCE = 1 << 15
#: Key of a row of documents while blocks are searched for.
ROW = "row_of_decontaminate"
FOUND = f"{ROW} long, spans array<struct<lo:long,hi:long>>, names array<string>, near array<string>"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


class Windows:
    """Test windows as rows of term ids, with the items they come from."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        column = pa.array([text for _, text in items], pa.string())
        self.data, offsets, _ = column_bytes(column)
        hashed, self.begins, self.ends = words(self.data, offsets, LETTERS_DIGITS)
        self.terms, ids = np.unique(hashed, return_inverse=True)
        self.names = [str(key) for key, _ in items]
        first = np.searchsorted(self.begins, offsets)
        words_of = np.diff(first)
        count = np.where(words_of > 0, np.maximum(1, words_of - size + 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        at = np.repeat(first[:-1], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(words_of[item], size)
        inside = np.arange(size) < length[:, None]
        rows = np.where(inside, ids[np.minimum(at[:, None] + np.arange(size), max(0, len(ids) - 1))] if len(ids) else -1, -1).astype(np.int32)
        whole = np.ascontiguousarray(rows).view(f"V{4 * size}").ravel()
        order = np.argsort(whole, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
        group = np.cumsum(new) - 1
        self.rows, self.length, self.at = rows[order[new]], length[order[new]], at[order[new]]
        pair = np.unique(group.astype(np.int64) * max(1, len(items)) + item[order])
        self.owner = (pair % max(1, len(items))).astype(np.int32)
        self.owned = np.searchsorted(pair // max(1, len(items)), np.arange(len(self.rows) + 1))
        self.size = size
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.terms >> np.uint64(48)).astype(np.int64)] = True

    def owners(self, window: int) -> np.ndarray:
        """Numbers of the items that have a window."""
        return self.owner[self.owned[window] : self.owned[window + 1]]

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        """Term id of each word hash, -1 for words that no test text has."""
        out = np.full(len(hashed), -1, np.int32)
        maybe = np.flatnonzero(self.sieve[(hashed >> np.uint64(48)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.terms, hashed[maybe]), len(self.terms) - 1)
        same = self.terms[near] == hashed[maybe] if len(self.terms) else np.zeros(0, bool)
        out[maybe[same]] = near[same]
        return out

    def folded(self, at: int, n: int) -> list[bytes]:
        return [LETTERS_DIGITS[self.data[self.begins[i] : self.ends[i]]].tobytes() for i in range(at, at + n)]


def shard_matches(w: Windows, tokens: np.ndarray, doc_of: np.ndarray, slop: int, share: float):
    """(exact, near) from one shard's postings: arrays (window, start token), and (window, start, a token of the match)."""
    none = np.zeros(0, np.int64)
    exact, nothing = (none, none), (none, none, none)
    placed = np.flatnonzero(tokens >= 0)
    if not len(placed) or not len(w.rows):
        return exact, nothing
    order = placed[np.argsort(tokens[placed], kind="stable")]  # postings: positions by term, ascending
    counts = np.bincount(tokens[placed], minlength=len(w.terms))
    start = np.concatenate([[0], np.cumsum(counts)])
    much = np.iinfo(np.int64).max
    frequency = np.where(w.rows >= 0, counts[w.rows], much)
    rarity = np.argsort(frequency, axis=1, kind="stable")  # offsets in the window, rarest term first
    rarest = rarity[:, 0]
    lists = frequency[np.arange(len(w.rows)), rarest]
    window = np.repeat(np.arange(len(w.rows)), lists)
    rank = np.arange(len(window)) - np.repeat(np.cumsum(lists) - lists, lists)
    at = order[start[w.rows[window, rarest[window]]] + rank] - rarest[window]
    inside = (at >= 0) & (at + w.length[window] <= len(tokens))
    fits = inside.copy()
    fits[inside] = doc_of[at[inside]] == doc_of[at[inside] + w.length[window[inside]] - 1]
    win, pos = window[fits], at[fits]
    posting = tokens[order].astype(np.int64) * (len(tokens) + 1) + order  # all lists as one sorted array
    for step in range(1, w.size):
        offset = rarity[win, step]
        term = w.rows[win, offset]
        wanted = term.astype(np.int64) * (len(tokens) + 1) + pos + offset  # the shifted place in the term's list
        at = np.minimum(np.searchsorted(posting, wanted), len(posting) - 1)
        same = (term < 0) | (posting[at] == wanted)
        win, pos = win[same], pos[same]
    if not slop:
        return (win, pos), nothing
    return (win, pos), _near(w, tokens, doc_of, order, start, frequency, rarity, slop, share)


def _near(w: Windows, tokens: np.ndarray, doc_of: np.ndarray, order: np.ndarray, start: np.ndarray, frequency: np.ndarray, rarity: np.ndarray, slop: int, share: float):
    """(window, start, anchor) of every place where at least ``share`` of a window's terms are within ``slop`` of theirs.

    Of a window that may miss m terms, one of the m + 1 rarest is there: each of these is looked up in
    turn, the other terms thin out the places, and what is left is tried at every start near by.
    """
    least = np.ceil(share * w.length - 1e-9).astype(np.int64)
    spare = w.length - least
    last = len(tokens) - 1
    found = []
    for turn, part in itertools.product(range(int(spare.max(initial=-1)) + 1), range(0, len(spare), AT_ONCE)):
        windows = part + np.flatnonzero(spare[part : part + AT_ONCE] >= turn)
        offset = rarity[windows, turn]
        lists = frequency[windows, offset]
        window, offset = np.repeat(windows, lists), np.repeat(offset, lists)
        rank = np.arange(len(window)) - np.repeat(np.cumsum(lists) - lists, lists)
        anchor = order[start[w.rows[window, offset]] + rank]
        missed = np.zeros(len(window), np.int64)
        for step in range(w.size):
            if step == turn:
                continue
            other = rarity[window, step]
            term = w.rows[window, other]
            hit = term < 0
            for shift in range(-2 * slop, 2 * slop + 1):
                p = np.clip(anchor + other - offset + shift, 0, last)
                hit |= tokens[p] == term
            missed += ~hit
            keep = missed <= spare[window]
            window, offset, anchor, missed = window[keep], offset[keep], anchor[keep], missed[keep]
        for move in range(-slop, slop + 1):
            at = anchor - offset + move
            got = np.zeros(len(window), np.int64)
            for j in range(w.size):
                term = w.rows[window, j]
                hit = np.zeros(len(window), bool)
                for shift in range(-slop, slop + 1):
                    p = np.clip(at + j + shift, 0, last)
                    hit |= (p == at + j + shift) & (tokens[p] == term) & (doc_of[p] == doc_of[anchor])
                got += hit & (term >= 0)
            close = got >= least[window]
            found.append(np.stack([window[close], at[close], anchor[close]], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(every):
        return (np.zeros(0, np.int64),) * 3
    _, one = np.unique(np.stack([every[:, 0], every[:, 1], doc_of[every[:, 2]]], axis=1), axis=0, return_index=True)
    return tuple(every[one].T)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, share: float = 0.8, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Rows of SCHEMA, one per row of ``docs``.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A window is
    ``size`` consecutive words of an item, or all its words if it has fewer; windows match only inside
    one document. n_hit counts words inside any exact match, n_items the items with one. A proximity
    match has at least ``share`` of a window's terms, each within ``slop`` words of its place, for some
    start; n_near_items counts items with such a match (exact ones included). Exact hash hits are
    confirmed on the bytes. Test texts of more than ``limit`` bytes are searched for block by block.

    Null or empty texts have no words; null and wordless items have no window. Repeated rows give
    repeated results; repeated item_ids count once. Empty tables: no items means nothing is hit, no
    documents means no rows. Other columns, of whatever name, are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = _usable(items)
    shared = _shared_windows(tests, size, limit)
    if shared is None:
        return _in_blocks(rows, tests, size, slop, share, limit)
    return map_text(rows, lambda batch: _search(batch, shared.value, slop, share), SCHEMA)


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 2, share: float = 0.8, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Rows of MATCHES: every place of every match that ``decontaminate`` counts.

    ``start`` is the word of the document at which the window starts; that of a near match may lie up to
    ``slop`` words and a window before the document's first. An item's exact and near matches are both listed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = _usable(items)
    shared = _shared_windows(tests, size, limit)
    if shared is not None:
        return map_text(rows, lambda batch: _listed(batch, shared.value, slop, share), MATCHES)
    out = None
    for windows in _blocks(tests, size, limit):
        block = rows.sparkSession.sparkContext.broadcast(windows)
        part = write_once(map_text(rows, lambda batch, block=block: _listed(batch, block.value, slop, share), MATCHES), "matches")
        block.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _usable(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")


def _shared_windows(tests: DataFrame, size: int, limit: int):
    """Broadcast windows of the test texts, or None if these have more than ``limit`` bytes."""
    weight = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if weight > limit:
        return None
    windows = Windows([(r["item_id"], r["text"]) for r in tests.collect()], size)
    return tests.sparkSession.sparkContext.broadcast(windows)


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test window occurs."""
    tests = _usable(items)
    shared = _shared_windows(tests, size, limit)
    if shared is not None:
        return filter_text(docs, lambda batch: ~np.asarray(_search(batch, shared.value, 0, 1.0).column("contaminated").to_numpy(zero_copy_only=False)))
    keyed = _numbered(docs)
    hit = _block_rows(keyed, tests, size, 0, 1.0, limit).where(F.size("spans") > 0).select(F.col(ROW).alias("hit_row")).distinct()
    return keyed.join(hit, F.col(ROW) == F.col("hit_row"), "left_anti").drop(ROW)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in ROW, written so that the keys stay what they are."""
    return write_once(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _blocks(tests: DataFrame, size: int, limit: int):
    """Windows of blocks of whole items with at most ``limit`` bytes of text, one item at least."""
    held, weight = [], 0
    for r in tests.toLocalIterator():
        more = len(r["text"].encode())
        if held and weight + more > limit:
            yield Windows(held, size)
            held, weight = [], 0
        held.append((r["item_id"], r["text"]))
        weight += more
    if held:
        yield Windows(held, size)


def _block_rows(keyed: DataFrame, tests: DataFrame, size: int, slop: int, share: float, limit: int) -> DataFrame:
    """Rows of FOUND: for each block of test texts, what it has in each row. One search of the documents a block."""
    out = None
    rows = keyed.select(ROW, F.col("text").cast("string").alias("text"))
    for windows in _blocks(tests, size, limit):
        shared = keyed.sparkSession.sparkContext.broadcast(windows)
        part = write_once(map_text(rows, lambda batch, shared=shared: _found(batch, shared.value, slop, share), FOUND), "block")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _in_blocks(rows: DataFrame, tests: DataFrame, size: int, slop: int, share: float, limit: int) -> DataFrame:
    keyed = _numbered(rows)
    listed = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))
    found = _block_rows(keyed, tests, size, slop, share, limit).groupBy(F.col(ROW).alias("found_row"))
    found = found.agg(F.flatten(F.collect_list("spans")).alias("spans"), listed("names").alias("names"), listed("near").alias("near"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["lo"], s["hi"] - 1))))
    found = found.select("found_row", F.size(covered).cast("long").alias("hit"), "names", "near")
    out = map_text(keyed, _counted, f"{ROW} long, doc_id long, n_words long").join(found, F.col(ROW) == F.col("found_row"), "left")
    hit, names, near = F.coalesce("hit", F.lit(0)).cast("long"), *(F.coalesce(c, F.array().cast("array<string>")) for c in ("names", "near"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.size(near).cast("long").alias("n_near_items"),
    )


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _matches(batch: pa.RecordBatch, w: Windows, slop: int, share: float):
    """(first word of each row, exact matches confirmed on the bytes, near matches) as shard_matches has them."""
    data, offsets, _ = column_bytes(batch.column("text"))
    hashed, begins, ends = words(data, offsets, LETTERS_DIGITS)
    first = np.searchsorted(begins, offsets)
    doc_of = np.repeat(np.arange(batch.num_rows), np.diff(first))
    (win, pos), near = shard_matches(w, w.ids(hashed), doc_of, slop, share)
    true = np.array([
        w.folded(int(w.at[i]), int(w.length[i])) == [LETTERS_DIGITS[data[begins[t] : ends[t]]].tobytes() for t in range(p, p + int(w.length[i]))]
        for i, p in zip(win, pos)
    ], bool)
    return first, doc_of, (win[true], pos[true]) if len(win) else (win, pos), near


def _named(w: Windows, doc_of: np.ndarray, wins: np.ndarray, places: np.ndarray) -> dict[int, set[str]]:
    """Names of the items of the matched windows, by row."""
    out: dict[int, set[str]] = {}
    for doc, i in set(zip(doc_of[places].tolist(), wins.tolist())):
        out.setdefault(doc, set()).update(w.names[k] for k in w.owners(i))
    return out


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets, _ = column_bytes(batch.column("text"))
    first = np.searchsorted(words(data, offsets, LETTERS_DIGITS)[1], offsets)
    return pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(np.diff(first), pa.int64())], [ROW, "doc_id", "n_words"])


def _found(batch: pa.RecordBatch, w: Windows, slop: int, share: float) -> pa.RecordBatch | None:
    """Rows of FOUND for the rows in which something of this block is: spans of hit words, item names."""
    first, doc_of, (win, pos), (near, _, anchor) = _matches(batch, w, slop, share)
    names, close = _named(w, doc_of, win, pos), _named(w, doc_of, near, anchor)
    spans: dict[int, set] = {}
    for doc, p, n in zip(doc_of[pos].tolist(), pos.tolist(), w.length[win].tolist()):
        spans.setdefault(doc, set()).add((p - int(first[doc]), p - int(first[doc]) + n))
    rows = sorted(set(names) | set(close))
    if not rows:
        return None
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(ROW).take(pa.array(rows)),
            pa.array([[{"lo": lo, "hi": hi} for lo, hi in sorted(spans.get(d, ()))] for d in rows], span),
            pa.array([sorted(names.get(d, ())) for d in rows], pa.list_(pa.string())),
            pa.array([sorted(close.get(d, ())) for d in rows], pa.list_(pa.string())),
        ],
        [ROW, "spans", "names", "near"],
    )


def _listed(batch: pa.RecordBatch, w: Windows, slop: int, share: float) -> pa.RecordBatch:
    first, doc_of, (win, pos), (near, at, anchor) = _matches(batch, w, slop, share)
    found = set()
    for wins, starts, places, kind in ((win, pos, pos, "exact"), (near, at, anchor, "near")):
        docs = doc_of[places]
        for doc, i, start in zip(docs.tolist(), wins.tolist(), (starts - first[docs]).tolist()):
            found.update((doc, w.names[k], start, kind) for k in w.owners(i))
    doc, item, start, kind = zip(*sorted(found)) if found else ((),) * 4
    ids = batch.column("doc_id").take(pa.array(doc, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(kind, pa.string())], [part.split()[0] for part in MATCHES.split(", ")])


def _search(batch: pa.RecordBatch, w: Windows, slop: int, share: float) -> pa.RecordBatch:
    first, doc_of, (win, pos), (near, _, anchor) = _matches(batch, w, slop, share)
    step = np.zeros(len(doc_of) + 1, np.int64)
    np.add.at(step, pos, 1)
    np.subtract.at(step, pos + w.length[win], 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    n_hit = covered[first[1:]] - covered[first[:-1]]
    hit, close = _named(w, doc_of, win, pos), _named(w, doc_of, near, anchor)
    none = digest([])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(np.diff(first), pa.int64()),
            pa.array(n_hit),
            pa.array([len(hit.get(d, ())) for d in range(batch.num_rows)], pa.int64()),
            pa.array([digest(list(hit[d])) if d in hit else none for d in range(batch.num_rows)]),
            pa.array(n_hit > 0),
            pa.array([len(close.get(d, ())) for d in range(batch.num_rows)], pa.int64()),
        ],
        [part.split()[0] for part in SCHEMA.split(", ")],
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), t AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 10 + 2))) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)
), m AS (SELECT doc_id, item_id, i, n FROM p JOIN t USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
