"""Maximal repeats of whole texts against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from corollary.llm import suffix_dedup

LENGTH = suffix_dedup.LENGTH


def brute(rows):
    """{(digest, length, (doc, lo), ...)}: every pair of equal strings, extended to the right, if their lefts differ."""
    texts = sorted({(i, t.encode()) for i, t in rows})
    places = defaultdict(list)
    for i, t in texts:
        for s in range(len(t) - LENGTH + 1):
            places[t[s : s + LENGTH]].append((i, s, t))
    found = set()
    for group in places.values():
        words = set()
        for k, (_, s, t) in enumerate(group):
            for _, r, u in group[:k]:
                n = LENGTH
                while s + n < len(t) and r + n < len(u) and t[s + n] == u[r + n]:
                    n += 1
                words.add(t[s : s + n])
        for w in words:
            own = [(i, s, t) for i, s, t in group if t[s : s + len(w)] == w]
            if len({t[s - 1] if s else (i, s) for i, s, t in own}) > 1:
                found.add((hashlib.sha256(w).hexdigest(), len(w), *sorted((i, s) for i, s, _ in own)))
    return found


@pytest.mark.parametrize("flush", [suffix_dedup.FLUSH, 1])
def test_copies_and_long_passages_have_all_their_places(spark, monkeypatch, flush):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    copy, passage = text(700), text(500)
    rows = [(1, copy), (2, copy), (2, copy), (3, copy[:400] + text(30)), (4, text(40) + copy[100:650])]
    rows += [(10 + k, text(rng.randint(0, 60)) + passage[k * 20 :] + text(rng.randint(0, 60)) + passage[: 150 + 40 * k]) for k in range(6)]
    rows += [(30, "ab" * 90), (31, "x" + "ab" * 70), (32, "q" * 100), (33, "q" * 101), (34, "q" * 99), (35, ""), (36, text(300))]
    frame = spark.createDataFrame(rows + [(37, None)], "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for r in suffix_dedup.maximal_repeats(frame).collect():
        groups[r["repeat"], r["length"]].append((r["doc"], r["lo"], r["first"]))
    got = {(*key, *sorted(p[:2] for p in places)) for key, places in groups.items()}
    want = brute(rows)
    assert got == want
    assert all([p[2] for p in sorted(places)] == [True] + [False] * (len(places) - 1) for places in groups.values())
    assert any(w[1] > 700 and w[2:] == ((1, 0), (2, 0)) for w in want)
    assert suffix_dedup.maximal_repeats(frame.limit(0)).collect() == []
