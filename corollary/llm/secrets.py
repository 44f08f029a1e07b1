"""Secret scan: three fixed patterns, and the literals that an assignment-aware lexer finds under sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_text
from .bytescan import column_bytes
from .lexer import assignments

KINDS = ("assign", "access", "hex", "literal")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"

#: The base patterns, the length that a match must have, and the group it is measured on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

#: Name parts and the sensitivity that they lend to a target; words that mark a stand-in.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "cred": 2.0, "auth": 1.5, "bearer": 2.0,
    "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0, "client": 0.5, "dsn": 1.5,
}
STAND_INS = ("example", "changeme", "placeholder", "your", "xxxx", "dummy", "sample", "redacted", "todo", "none", "null")
THRESHOLD = 4.0

WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """How far the parts of a target's name (camel case, snake case, dotted) call for secrecy."""
    parts = [p.lower() for p in WORDS.findall(name)]
    return sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts))


def randomness(literal: str) -> float:
    """Points for a literal that looks made by a generator: length, entropy, mixed classes."""
    n = len(literal)
    if n < 6 or any(s in literal.lower() for s in STAND_INS) or literal.startswith(("http://", "https://", "<", "$")) or " " in literal:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(n, 24) / 12 * (entropy / 4) + 0.5 * (classes - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, leftmost and non-overlapping by kind."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals whose target's name and whose own form score THRESHOLD together."""
    found = set()
    for name, literal, spans in assignments(text):
        weight = sensitivity(name)
        if weight >= 1.5 and (points := randomness(literal)) > 0 and weight + points >= THRESHOLD:
            found.update((s, 3, e) for s, e in spans)
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


#: Beginnings of the parts of names that can reach the lexer's least weight, and of the keywords of the base patterns.
STEMS = tuple(sorted({k.encode() for k, v in SENSITIVE.items() if not any(k != o and k.startswith(o) for o in SENSITIVE)} | {b"api_key", b"api"}))


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the documents that can have any span; the others are settled without decoding."""
    raw = data.tobytes()
    found = np.zeros(len(offsets) - 1, bool)
    for source, needles in ((raw.lower(), STEMS), (raw, (b"AKIA",))):
        for needle in needles:
            at = source.find(needle)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                found[doc] = True
                at = source.find(needle, int(offsets[doc + 1]))
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = _HEX[data]
    edge = np.flatnonzero(np.diff(mask)).reshape(-1, 2)
    runs = edge[edge[:, 1] - edge[:, 0] >= 24]
    if len(runs):  # a run may go on over several documents
        first, last = np.searchsorted(offsets, runs[:, 0], "right") - 1, np.searchsorted(offsets, runs[:, 1] - 1, "right") - 1
        step = np.zeros(len(offsets), np.int64)
        np.add.at(step, first, 1)
        np.subtract.at(step, last + 1, 1)
        found |= np.cumsum(step[:-1]) > 0
    return np.flatnonzero(found)


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets, _ = column_bytes(batch.column("text"))
    n, none = batch.num_rows, hashlib.sha256(b"").hexdigest()
    counts = np.zeros((4, n), np.int64)
    base_sha, every = [none] * n, [""] * n
    for d in suspects(data, offsets):
        text = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
        base = base_spans(text)
        taken = {(s, e) for s, _, e in base}
        more = [x for x in lexed_spans(text) if (x[0], x[2]) not in taken]
        for _, kind, _ in base + more:
            counts[kind, d] += 1
        if base:
            base_sha[d] = hashlib.sha256(joined(base).encode()).hexdigest()
        every[d] = joined(sorted(base + more))
    columns = [batch.column("doc_id"), *(pa.array(counts[k]) for k in range(3)), pa.array(base_sha), pa.array(every), pa.array(counts[3])]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in SCHEMA.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA, one per row of ``docs``: counts, digest of the base spans, all spans.

    Base spans are those of BASE, kept whatever the lexer finds. The lexer adds kind "literal" for
    literals that reach a sensitive name, unless a base match has the very same span. Offsets are code points, end exclusive.
    A null text counts as empty; empty texts have no spans; repeated rows give repeated results; an
    empty table gives an empty result. Texts are scanned whole, in time that grows with their length only,
    one after the other, with no shuffle. Only documents with a part of a sensitive name, "AKIA" or a long
    hex run are decoded. Extra columns are ignored.
    """
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _scan, SCHEMA)
