"""Operators on whole tables: mixing, line dedup, chats, the pipeline, the registered queries."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from corollary.llm import chat, line_dedup, mixing
from corollary.llm.components import components

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shares(sizes):
    """Targets by handing out and capping again and again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    target, left, open_names = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_names:
        total = sum(weight[s] for s in open_names)
        given = {s: left * weight[s] / total for s in open_names}
        left = 0.0
        for s, g in given.items():
            room = 3 * sizes[s] - target[s]
            target[s] += min(g, room)
            left += max(0.0, g - room)
            if g >= room:
                open_names.discard(s)
    return target


def check_mix(rows, quality, got):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = shares(sizes)
    source = {i: s for i, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    # whole epochs first; then the documents of least key, one of them in part
    import hashlib

    def key(i):
        u = (int(hashlib.md5(f"mix-1:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        return -math.log(u) / quality.get(i, 1.0)

    by = defaultdict(list)
    for r in got:
        by[source[r["doc_id"]]].append(r)
    for s, own in by.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest = round(target[s]) - epochs * sizes[s]
        for r in sorted(own, key=lambda r: (key(r["doc_id"]), r["doc_id"] is None, r["doc_id"] or 0, -r["size"])):
            part = max(0, min(r["size"], rest))
            assert r["taken"] == epochs * r["size"] + part
            rest -= part


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", "Z", None]), "w " * rng.randint(0, 40)) for i in range(400)]
    rows += [(1000, "tiny", "one two"), (1001, "empty", ""), (1002, "empty", None), (None, "a", "x y z"), (1003, "big", "w " * 30_000)]
    quality = {i: rng.choice([0.5, 2.0]) for i in range(0, 400, 3)}
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, size int, key double").repartition(4)
    weights = spark.createDataFrame([*quality.items(), (399, None), (398, -1.0)], "doc_id long, quality double")
    got = mixing.mix_sources(docs, weights).collect()
    assert len(got) == len(rows)
    check_mix(rows, quality, got)
    again = mixing.mix_sources(docs.repartition(7), weights).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixing_small_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).collect() == []
    got = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "a", "")], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    one = mixing.mix_sources(spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y")], schema)).collect()
    assert [r["taken"] for r in one] == [2, 2]


def test_line_dedup(spark):
    rng = random.Random(6)
    pages = []
    for i in range(60):
        host = rng.choice(["one.example", "one.example", "two.example", "solo%d.example" % i])
        lines = ["<nav>Menu</nav>", f"<p>text {i} &amp; more</p>"] + (["<p>often</p>"] if i % 3 else []) + ["<script>x<p>y</p></script><!-- <p>no</p> -->"]
        pages.append((i, f"https://user@{host.upper()}:80/a?b#c", "<html>" + "".join(lines) + "\n tail " + "</html>", "clash"))
    pages += [(100, None, "<p>Menu"), (101, "not a url", "Menu\nMenu"), (102, "http://one.example/x", None), (103, "http://one.example/", "")]
    pages = [(p + ("clash",))[:4] for p in pages]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, lines string")
    got = {r["page_id"]: r for r in line_dedup.line_dedup(df).collect()}
    assert len(got) == len(pages)
    lines = {i: r["n_lines"] for i, r in got.items()}
    assert lines[100] == 1 and lines[101] == 2 and lines[102] == lines[103] == 0
    hosts = Counter(r["host"] for r in got.values())
    for i, r in got.items():
        if r["host"] == "one.example" and i < 100:
            assert "Menu" not in r["text"] and "tail" not in r["text"] and f"text {i} &amp; more" in r["text"]
        if r["host"] is None or hosts[r["host"]] < 3:
            assert r["n_dropped"] == 0
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def chats(seed, long_turns):
    rng = random.Random(seed)
    rows = []
    for c in [*range(12), 99]:
        for t in range(long_turns if c == 99 else rng.randint(1, 6)):
            rows.append((None if c == 5 else c, t, rng.choice(["user", "assistant", "system", "human", None, "User ", "??"]), f"t{c}-{t}" if t % 4 else ""))
    return [*rows, (3, None, "user", "tail"), (3, None, None, None)]


def code(role):
    name = (role or "").strip().lower()
    name = chat.ALIASES.get(name, name)
    return chat.ROLES.index(name) if name in chat.ROLES else chat.UNKNOWN


def brute(codes, state=chat.START):
    """Least cost over all sequences of moves."""
    if not codes:
        return chat.ENDINGS[state][0]
    return min(move[0] + brute(codes[1:], move[1]) for move in chat.MOVES[codes[0]][state])


def test_chats_are_legal_cheapest_and_whole(spark):
    rows = chats(1, 200)
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:2]], "conv_id long, turn long, role string, text string, chunk int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")  # the long conversation spans many chunks
    try:
        got = chat.repair_chats(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) + 2
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, (r[2] is not None, r[2] or "")))
        pieces = {(r["turn"], r["role"]): r for r in got if r["conv_id"] == conv}
        codes = [code(r[2]) for r in own]
        shown = "".join(pieces[r[1], r[2]]["rendered"] for r in own)
        roles = [x.split("\n")[0] for x in shown.split(chat.OPEN)[1:]]
        body = roles[1:] if roles[0] == "system" else roles
        assert body and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and len(body) % 2 == 0
        assert shown.count(chat.CLOSE) == len(roles) and all((r[3] or "") in shown for r in own)
        moves, ending = chat.repair(codes)
        cost = sum(m[0] for m in moves) + chat.INSERT * len(ending)
        whole = chat.transfer(codes)[chat.START]
        assert cost == min(c + e[0] for c, e in zip(whole, chat.ENDINGS))
        if len(codes) <= 6:
            assert cost == brute(codes)
    assert chat.repair_chats(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if k.startswith("op")))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(FOLDER, t)}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_the_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == before.columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= left, name
        assert all(tuple(r) == tuple(rows[r["doc_id"]]) for r in docs.collect())
        left = now
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in got} == left
    check_mix([(i, rows[i]["source"], rows[i]["text"]) for i in left], {r["doc_id"]: 2.0 if r["quality"] == 1 else 0.5 for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}, got)


def test_stages_take_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, norm string"
    text = "a b c d e f g h i j k l"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, None, None), (3, text, "en", "s", 9, "x", "y"), (3, text, "en", "s", 9, "x", "y"), (4, text, "en", "t", 9, "x", "y"), (5, text + " m", "en", "t", 9, "x", "y"), (None, "lonely", "en", "t", 9, "x", "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER).cache()
            assert [f.name for f in docs.schema] == [f.split()[0] for f in schema.split(", ")]
        ids = sorted((r["doc_id"] for r in docs.collect()), key=str)
        assert ids == ([1, 3, None] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(ids)
