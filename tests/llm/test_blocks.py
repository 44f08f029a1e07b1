"""Decontamination in blocks of test texts, and proximity against brute force."""

import random
import re
from collections import defaultdict

from corollary.llm import decontaminate, queries

WORDS = [f"w{k}" for k in range(14)]
DOCS = "doc_id long, text string, note int"


def tables(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bench = [(k, some(rng.randint(3, 16))) for k in range(5)]
    docs = [(1, bench[0][1] + " " + some(5), 0), (1, some(9), 1), (None, bench[1][1], 2), (None, "clean words only", 3), (None, None, 4), (2, "", 5), (2, bench[2][1], 6), (2, bench[2][1], 6)]
    for k, (_, t) in enumerate(bench):
        w = t.split()
        put, changed, gone = list(w), list(w), list(w)
        put.insert(len(w) // 2, "new")
        changed[len(w) // 3] = "otherword"
        del gone[len(w) // 2]
        docs += [(10 * k + 20 + n, " ".join(x), 7) for n, x in enumerate((put, changed, gone))] + [(10 * k + 25, some(60), 8)]
    return docs, bench


def near(docs, items, size=10, slop=2, share=0.8):
    """Number of items with a proximity match for each row, by trying every start."""
    cut = lambda t: re.findall(r"[0-9a-z]+", t or "")
    out = []
    for _, t, _ in docs:
        w, names = cut(t), set()
        for k, text in items:
            own = cut(text)
            for i in range(max(1, len(own) - size + 1)):
                part = own[i : i + size]
                for s in range(-slop - size, len(w) + slop):
                    got = sum(any(0 <= s + j + d < len(w) and w[s + j + d] == x for d in range(-slop, slop + 1)) for j, x in enumerate(part))
                    if 10 * got >= 8 * len(part):
                        names.add(k)
        out.append(len(names))
    return out


def test_blocks_give_what_one_search_gives(spark):
    docs, bench = tables(spark)
    frame = lambda n: spark.createDataFrame(docs, DOCS).repartition(n)
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = decontaminate.decontaminate(frame(1), items)
    assert whole.count() == len(docs)
    want = sorted((str(d[0]), n) for d, n in zip(docs, near(docs, bench)))
    assert sorted((str(r["doc_id"]), r["n_near_items"]) for r in whole.collect()) == want
    assert any(r["n_near_items"] > r["n_items"] for r in whole.collect())
    for limit in (0, 60):
        assert rows(decontaminate.decontaminate(frame(3), items, limit=limit)) == rows(whole)
    kept = decontaminate.without_contaminated(frame(2), items)
    assert rows(decontaminate.without_contaminated(frame(3), items, limit=0)) == rows(kept)
    assert {r["note"] for r in kept.collect()} >= {1, 3, 4, 5}


def test_matches_are_what_is_counted(spark):
    docs, bench = tables(spark)
    docs = [(n, t, x) for n, (_, t, x) in enumerate(docs)]
    frame, items = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    listed = decontaminate.matches(frame, items).collect()
    assert sorted(listed) == sorted(decontaminate.matches(frame, items, limit=0).collect())
    own, text = defaultdict(set), {i: t for i, t, _ in docs}
    for r in listed:
        own[r["doc_id"], r["kind"]].add(r["item_id"])
        if r["kind"] == "exact":
            words = text[r["doc_id"]].split()[r["start"] : r["start"] + 10]
            item = bench[int(r["item_id"])][1].split()
            assert any(words[: len(item)] == item[i : i + 10] for i in range(max(1, len(item) - 9)))
    for r in decontaminate.decontaminate(frame, items).collect():
        exact, near = own[r["doc_id"], "exact"], own[r["doc_id"], "near"]
        assert (r["n_items"], r["items_sha256"], r["n_near_items"]) == (len(exact), decontaminate.digest(list(exact)), len(near))


def test_a_query_keeps_proximity(spark):
    got = queries.QUERIES["benchmark_proximity"](spark, "/root/testdata/sf0.001")
    assert got.columns == [part.split()[0] for part in decontaminate.SCHEMA.split(", ")]
    assert got.where("n_near_items > 0").count() > 0 and got.where("n_near_items < n_items").count() == 0
