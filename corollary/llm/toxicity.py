"""Toxicity by a factorization machine over hashed terms: single terms and their pairwise interactions.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x binary over the terms of a text:
its words and their first 4, 5 and 6 bytes, hashed to 2**20 places. Presence, not rate, is what counts, so an
insult in a long text weighs as much as in a short one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import filter_text, map_text
from .bytescan import LETTERS_DIGITS, column_bytes, words
from .language_id import sample
from .scratch import settle, write_once

PLACES = 1 << 20
HEADS = (4, 5, 6)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Bound: training documents of each class.
MAX_TRAIN = 6000
#: Terms, and pairs of terms, are held if chance would let any of those tested look as telling with this probability at the most.
CHANCE = 0.05
#: A term is tested if it is in so many training documents; pairs are sought among so many of the most frequent terms.
LEAST, PAIRED = 3, 2048
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.7


def held_out(id_col: Column, folds: int = 3) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 1, F.lit(False))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hashed term) of every word and word head, in no order, with repeats."""
    hashed, begins, _, heads = words(data, offsets, LETTERS_DIGITS, HEADS)
    doc = np.searchsorted(offsets, begins, "right") - 1
    every = np.concatenate([hashed, *heads])
    return np.tile(doc, 1 + len(HEADS)), (every >> np.uint64(44)).astype(np.int32)


def pairs(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs, by document."""
    code = np.unique(doc.astype(np.int64) * PLACES + term)
    return code // PLACES, code % PLACES


class Machine:
    """A fitted factorization machine: ``slot`` maps a hashed term to its row in w and v, or -1."""

    def __init__(self, slot: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.slot, self.w0, self.w, self.v = slot, w0, w, v

    def logit(self, n: int, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Logits of ``n`` documents from distinct (document, model row) pairs."""
        out = np.full(n, self.w0)
        np.add.at(out, doc, self.w[row])
        sums, squares = np.zeros((n, self.v.shape[1])), np.zeros((n, self.v.shape[1]))
        np.add.at(sums, doc, self.v[row])
        np.add.at(squares, doc, self.v[row] ** 2)
        return out + 0.5 * (sums**2 - squares).sum(1)


def _chi(with1: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """Chi-square of presence against the label, for presence in ``with1`` documents of label 1 of ``seen`` in all."""
    expected = seen * share
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(seen >= LEAST, (with1 - expected) ** 2 / expected + (with1 - expected) ** 2 / (seen - expected), 0.0)
    return np.nan_to_num(chi, posinf=0.0)


def _cut(tests: int) -> float:
    """The chi-square that chance exceeds with probability CHANCE in any of so many tests."""
    low, high, p = 0.0, 1000.0, CHANCE / max(1, tests)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high


def _often(seen: np.ndarray) -> np.ndarray:
    """The most frequent terms, among which pairs are sought."""
    return np.argsort(-seen, kind="stable")[: min(PAIRED, int((seen >= LEAST).sum()))]


def _telling_pairs(labels: np.ndarray, doc: np.ndarray, term: np.ndarray, seen: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Terms of the pairs whose joint presence tells of the label at least twice as much as either term alone."""
    often = _often(seen)
    cut = _cut(len(often) * (len(often) - 1) // 2)
    place = np.full(len(seen), -1, np.int32)
    place[often] = np.arange(len(often))
    single, found = chi[often], np.zeros(len(often), bool)
    for first in range(0, len(often), 256):  # some rows of the table of pairs at once
        both = np.zeros((2, min(256, len(often) - first), len(often)), np.float32)
        for lo in range(0, len(labels), 1024):
            a, b = np.searchsorted(doc, (lo, lo + 1024))
            at = place[term[a:b]]
            block = np.zeros((min(1024, len(labels) - lo), len(often)), np.float32)
            block[doc[a:b][at >= 0] - lo, at[at >= 0]] = 1
            for label in (0, 1):
                part = block[labels[lo : lo + 1024] == label]
                both[label] += part[:, first : first + 256].T @ part
        with1 = both[1].astype(float)
        joint = _chi(with1, with1 + both[0], labels.mean())
        found[first : first + 256] = ((joint > cut) & (joint > 2 * np.maximum(single[first : first + 256, None], single[None]))).any(1)
    return often[found]


def fit(labels: np.ndarray, doc: np.ndarray, term: np.ndarray, seed: int = 7, tested: int | None = None) -> Machine:
    """Choose terms by the chi-square of presence against label, alone and in pairs, then fit by AdaGrad on the log loss.

    Classes weigh the same in sum. ``doc`` and ``term`` are distinct pairs; ``tested`` is the number of
    terms tested, where the pairs of some that cannot be chosen were left out.
    """
    rng = np.random.default_rng(seed)
    n, n1 = len(labels), int(labels.sum())
    doc, names = doc.astype(np.int32), np.flatnonzero(np.bincount(term, minlength=PLACES))
    index = np.zeros(PLACES, np.int32)
    index[names] = np.arange(len(names))
    term = index[term]
    seen = np.bincount(term, minlength=len(names)).astype(float)
    with1 = np.bincount(term[labels[doc] == 1], minlength=len(names)).astype(float)
    chi = _chi(with1, seen, n1 / max(1, n))
    telling = np.flatnonzero(chi > _cut(int((seen >= LEAST).sum()) if tested is None else tested))
    chosen = names[np.union1d(telling, _telling_pairs(labels, doc, term, seen, chi))]
    term = names.astype(np.int32)[term]
    slot = np.full(PLACES, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    w0, w, v = 0.0, np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))
    if not n1 or n1 == n or not len(chosen):
        prior = float(np.log((n1 + 1) / (n - n1 + 1)) - 1)
        return Machine(slot, prior if n else -2.0, w, v)
    inside = slot[term] >= 0
    doc, row = doc[inside], slot[term[inside]]
    first = np.searchsorted(doc, np.arange(n + 1))
    importance = np.where(labels == 1, n / (2 * n1), n / (2 * (n - n1)))
    gw0, gw, gv = 1e-8, np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    rate, decay = 0.15, 1e-4
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            size = first[part + 1] - first[part]
            at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            d, r = np.repeat(np.arange(len(part)), size), row[at]
            model = Machine(slot, w0, w, v)
            p = 1 / (1 + np.exp(-np.clip(model.logit(len(part), d, r), -30, 30)))
            g = (p - labels[part]) * importance[part] / len(part)
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, d, v[r])
            touched, place = np.unique(r, return_inverse=True)
            dw, dv = np.zeros(len(touched)), np.zeros((len(touched), FACTORS))
            np.add.at(dw, place, g[d])
            np.add.at(dv, place, g[d][:, None] * (sums[d] - v[r]))
            dw, dv = dw + decay * w[touched], dv + decay * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= rate / 4 * dv / np.sqrt(gv[touched])
            g0 = float(g.sum())
            gw0 += g0 * g0
            w0 -= rate * g0 / gw0**0.5
    return Machine(slot, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Machine:
    """Fit on at most about ``most`` labelled, not held-out rows of each class.

    The sample's ids are broadcast (their number is bounded by ``most``). Its hashed terms are counted where
    they are; only those of terms that can be chosen come to the driver, which ``most`` bounds as well.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = sample(known.where(~held_out(F.col("doc_id"))), "toxic", most, "fm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets, _ = column_bytes(batch.column("text"))
        doc, term = pairs(*terms_of(data, offsets))
        first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(term.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), found], ["doc_id", "toxic", "terms"])

    listed = write_once(map_text(rows, each, "doc_id long, toxic int, terms array<int>"), "terms")
    one = F.col("toxic") >= 1
    n, n1 = listed.agg(F.count(F.lit(1)), F.count(F.when(one, 1))).first()
    counts = listed.select(one.cast("int").alias("toxic"), F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("with1"))
    counts = counts.where(F.col("seen") >= LEAST).toArrow().sort_by("term")  # PLACES rows at the most
    place, seen, with1 = (counts.column(c).to_numpy() for c in ("term", "seen", "with1"))
    keep, tested = np.zeros(PLACES, bool), len(place)
    keep[place[_chi(with1, seen, n1 / max(1, n)) > _cut(tested)]] = True
    keep[place[_often(seen)]] = True
    del counts, place, seen, with1
    settle(docs.sparkSession)

    def kept(batches):
        for batch in batches:
            lists = batch.column("terms")
            term = lists.flatten().to_numpy()
            inside = keep[term]
            edge = np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            found = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(term[inside]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), found], ["doc_id", "toxic", "terms"])

    got = listed.mapInArrow(kept, "doc_id long, toxic int, terms array<int>").toArrow().combine_chunks().sort_by("doc_id")
    lists = got.column("terms").combine_chunks()
    label = np.clip(got.column("toxic").to_numpy().astype(np.int64), 0, 1)
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    size = np.array(lists.value_lengths().fill_null(0), np.int64)
    doc, term = np.repeat(np.arange(len(label), dtype=np.int32), size), np.asarray(lists.flatten())
    del got, lists
    return fit(label, doc, term, tested=tested)


def probability(batch: pa.RecordBatch, model: Machine) -> np.ndarray:
    """The model's probability of label 1 for each text of a batch."""
    data, offsets, _ = column_bytes(batch.column("text"))
    doc, term = terms_of(data, offsets)
    row = model.slot[term]
    known = row >= 0
    doc, row = pairs(doc[known], row[known])
    return 1 / (1 + np.exp(-np.clip(model.logit(batch.num_rows, doc, row), -500, 500)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, text) -> rows of SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = probability(batch, shared.value)
        columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in SCHEMA.split(", ")])

    return map_text(docs.select("doc_id", "held_out", "text"), each, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Train on labelled rows that are not held out; score every row of ``docs``.

    Scoring reads the text alone. Null or empty texts have no terms and get the model's base score.
    Null ids are not held out and never labelled. Of labels that repeat a doc_id the highest counts.
    Without labels, or with one class only, every score is the smoothed share of that class. Repeated
    rows get the same score; an empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, train(docs, labels, most))


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model scores below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    return filter_text(docs, lambda batch: probability(batch, shared.value) < THRESHOLD)
