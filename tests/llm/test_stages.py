"""Every stage of the pipeline against a plain version of it, and costs of what the chat query returns."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corollary.llm import bytescan, chat, jaccard, line_dedup, queries, toxicity
from test_tables import brute, chats, code
from test_texts import BLANK, components, hits

FOLDER = "/root/testdata/sf0.001"


def plain(name, rows, spark):
    """Ids that a stage keeps of (doc_id, text) rows, by comparing everything with everything."""
    if name == "toxicity":
        docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/labels.parquet")
        return {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("score < 0.7").collect()}
    if name == "exact dedup":
        first = {}
        for i, t in sorted(rows):
            first.setdefault(BLANK.sub(" ", t or ""), i)
        return set(first.values())
    if name == "n-gram jaccard join":
        return {i for i, _, root in components(rows) if i == root}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    return {h[0] for h in hits(rows, items) if not h[5]}


def test_stages_do_what_their_plain_versions_do(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, FOLDER).cache()
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept == plain(name, rows, spark), name
        assert len(kept) > 0.5 * len(rows), name


def cost(rows):
    """Cost of the decisions that the query returned for one conversation, by the table of costs alone."""
    out = 0
    for r in rows:
        out += chat.RELABEL[code(r["role"])][chat.ROLES.index(r["new_role"])] + chat.MERGE * r["action"].endswith("+merge") + chat.INSERT * len(r["inserted"])
    return out


def test_the_chat_query_returns_the_least_cost(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in chats(7, 150)], "conv_id long, turn long, role string, text string, label int, merged string")
    by = defaultdict(list)
    for r in chat.repair_chats(df).collect():
        by[r["conv_id"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r["turn"] is None, r["turn"] or 0, (r["role"] is not None, r["role"] or "")))
        codes = [code(r["role"]) for r in rows]
        whole = chat.transfer(codes)[chat.START]
        assert cost(rows) == min(c + e[0] for c, e in zip(whole, chat.ENDINGS))
        if len(codes) <= 6:
            assert cost(rows) == brute(codes)


def test_the_chat_query_over_its_table(spark):
    by = defaultdict(list)
    for r in queries.QUERIES["op8_chat_formatting"](spark, FOLDER).collect():
        by[r["conv_id"]].append(r)
    assert len(by) > 10
    for rows in by.values():
        rows.sort(key=lambda r: (r["turn"] is None, r["turn"] or 0, (r["role"] is not None, r["role"] or "")))
        whole = chat.transfer([code(r["role"]) for r in rows])[chat.START]
        assert cost(rows) == min(c + e[0] for c, e in zip(whole, chat.ENDINGS))


def test_a_line_at_the_ratio_stays(spark):
    """On three pages of ten a line is at 0.3 and stays; on four it goes. One page is long."""
    pages = [(k, f"http://h.example/{k}", "<p>three</p>" * (k < 3) + "<p>four</p>" * (k < 4) + f"<p>own {k}</p>" + ("<p>long text</p>" * 20_000 if k == 9 else "")) for k in range(10)]
    pages.append(pages[0])  # a repeated row is a page of its own: four of eleven, and five
    got = {(r["page_id"], r["n_dropped"]): r["text"].split("\n") for r in line_dedup.line_dedup(spark.createDataFrame(pages[:10], "page_id long, url string, html string")).collect()}
    assert got[0, 1] == ["three", "own 0"] and got[3, 1] == ["own 3"] and len(got[9, 0]) == 20_001
    again = line_dedup.line_dedup(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["n_dropped"]) for r in again)[:3] == [(0, 2), (0, 2), (1, 2)]


def some(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 20}, {"BLOCK": 20, "SPREAD": 60, "CROWD": 2, "BROADCAST_IDS": 0, "BUCKET": 500}])
def test_a_large_group_of_copies_that_are_mostly_not_similar(spark, monkeypatch, bounds):
    """Three hundred edited copies of one text, few of them similar enough: the components are those of all pairs, wherever lists are cut."""
    for name, value in bounds.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(12)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    want = components(rows)
    assert 5 < len({c for _, _, c in want}) < 280
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == sorted(want)


@pytest.mark.parametrize("forest", [False, True])
def test_pairs_of_a_crowded_list(forest):
    """Every similar pair is handed on; with a forest, fewer rows than nodes, and they join what similar pairs join."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(50)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(50)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words))
    data, offsets, _ = bytescan.column_bytes(pa.array(texts))
    sets = list(bytescan.shingle_sets(data, offsets))
    rows = [(7, int(t), i, len(s), 0, i, 0) for i, s in enumerate(sets) for t in s[:40].view(np.int64)]
    names = [c.split()[0] for c in jaccard.CELL.split(", ")][:7]
    table = pa.table({n: pa.array(c, pa.int32() if n == "side" else pa.int64()) for n, c in zip(names, zip(*rows))})
    got = [r for b in jaccard._count_pairs(table, {i: jaccard.parities(s) for i, s in enumerate(sets)}, forest) for r in b.to_pylist()]
    pairs = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in got}
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (len(sets[i]) + len(sets[j]))}
    if not forest:
        assert similar <= pairs and len(pairs) < 0.7 * 150 * 149 / 2
    else:
        assert len(got) < 150


def test_bitmaps_never_say_too_much():
    """Folded or not, two bitmaps differ in at most as many bits as the sets in tokens."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 90)), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, len(x) // 2)), rng.integers(0, 1 << 63, int(rng.integers(0, 120)), dtype=np.uint64)]))
        maps = jaccard.Bitmaps({0: jaccard.parities(x), 1: jaccard.parities(y)}, np.array([0, 1]))
        apart = len(np.setxor1d(x, y))
        assert maps.differing(np.array([0]), np.array([1]))[0] <= apart and maps.differing(np.array([1]), np.array([1]))[0] == 0


def test_numbers_of_documents_that_repeat_an_id(spark):
    """Rows that repeat an id with different texts are documents of their own: neither's links reach the other."""
    a, b = some(random.Random(1), 30, "abcdefghijklmnop"), some(random.Random(2), 30, "qrstuvwxyz")
    df = spark.createDataFrame([(5, a), (5, b), (6, a + " z"), (7, b + " c")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 5)]
