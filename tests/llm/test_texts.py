"""Operators on texts against plain versions of themselves, on small and awkward tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corollary.llm import bytescan, decontaminate, exact_dedup, jaccard, language_id, secrets, suffix_dedup, toxicity

WORDS = "the of and alpha beta gamma delta epsilon Zeta ETA theta iota kappa élan über naïve x1 42".split()
BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: Columns whose names operators use inside; they must neither disturb nor come back.
CLASHES = "node long, tokens string, norm string, h128 string, size long, n long, token string, doc long, tk long, kind int, lang string, source string"


def frame(spark, rows):
    """(doc_id, text) rows with clashing extra columns."""
    full = [(i, t, 7, "x", "y", "z", 1, 2, "w", 3, 4, 5, "en", "src") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, " + CLASHES).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, "Two words"), (7, "two\twords"), (8, "1 2 3 4 5"), (None, "null id text " * 3), (None, None), (50, "two  words"), (50, "other text of the same id")]
    base = [prose(rng, rng.randint(30, 160)) for _ in range(12)]
    at = 100
    for b in base:
        for _ in range(rng.randint(1, 4)):
            words = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append((at, " ".join(words)))
            at += 1
    hot = prose(rng, 60)
    out += [(at + k, hot) for k in range(30)]  # a third of all rows is one text
    out += [(at + 40, hot.replace(" ", "\n", 5)), (at + 41, "word " * 3000), (at + 42, hot + " " + prose(rng, 4000)), (at + 43, "\x00a\x00b " * 60), (at + 43, "\x00a\x00b " * 60)]
    return out


def test_words_are_those_of_the_patterns(rows):
    texts = [t for _, t in rows] + ["Été x", "A-b_c", "ſK"]
    data, offsets, null = bytescan.column_bytes(pa.array(texts))
    assert list(null) == [t is None for t in texts]
    for fold, pattern in ((bytescan.NON_SPACE, r"[^\x20\x09-\x0D]+"), (bytescan.LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashed, begins, ends = bytescan.words(data, offsets, fold)
        got = [data[a:b].tobytes().decode() for a, b in zip(begins, ends)]
        low = [re.sub("[A-Z]+", lambda m: m[0].lower(), t or "") for t in texts]
        want = [w for t in low for w in re.findall(pattern, t)]
        assert [re.sub("[A-Z]+", lambda m: m[0].lower(), g) for g in got] == want
        by = defaultdict(set)
        for h, w in zip(hashed.tolist(), want):
            by[h].add(w)
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want))


def test_words_do_not_depend_on_the_segments(monkeypatch, rows):
    data, offsets, _ = bytescan.column_bytes(pa.array([t for _, t in rows]))
    whole = [x.tolist() for x in bytescan.words(data, offsets, bytescan.NON_SPACE)]
    monkeypatch.setattr(bytescan, "SEGMENT", 64)
    assert [x.tolist() for x in bytescan.words(data, offsets, bytescan.NON_SPACE)] == whole


def test_exact_dedup(spark, rows):
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub(" ", t or "")].append(i)
    want, seen = [], set()
    for i, t in rows:
        norm = BLANK.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and norm not in seen
        if kept:
            seen.add(norm)
        want.append((i, keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def shingles(text):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows):
    """(doc_id, n, component) by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    return [(i, len(s), min(members[root(k)]) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates(spark, rows):
    known = [(i, t) for i, t in rows if i is not None]
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, known)).collect())) == sorted(components(known))


def test_near_duplicates_without_ids_or_rows(spark):
    text = "a b c d e f g"
    got = jaccard.near_duplicates(frame(spark, [(None, text), (3, text), (None, "lonely words stand here alone"), (None, "")])).collect()
    assert sorted((r["component_id"] is None, r["n_shingles"]) for r in got) == [(False, 3), (False, 3), (True, 0), (True, 1)]
    assert jaccard.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("salt,large", [(jaccard.SALT, jaccard.LARGE), (3, 3)])
def test_near_duplicates_in_large_groups(spark, monkeypatch, salt, large):
    """Near copies of one text in all directions, among texts that share a passage only."""
    monkeypatch.setattr(jaccard, "SALT", salt)
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"y{i}_{k}" for k in range(rng.randint(5, 60))] + base[:40])) for i in range(40)]
    assert sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows)).collect())) == sorted(components(rows))


def test_prefixes_share_what_is_required():
    """Of any two similar sets the chosen prefixes share as many tokens as the filter asks."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = np.sort(rng.choice(200, n, replace=False))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(n * rng.uniform(0.7, 1))), replace=False), rng.choice(200, int(rng.integers(0, 6)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        (_, p), (_, q) = (jaccard.prefix(len(z), rng.integers(0, 50, len(z)).astype(float)) for z in (x, y))
        overlap = -(-75 * (len(x) + len(y)) // 175)
        assert len(np.intersect1d(x[:p], y[:q])) >= max(1, overlap - max(len(x) - p, len(y) - q))


def removed(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in sorted(texts):
        for s in range(len(t) - 99):
            first.setdefault(t[s : s + 100], (i, s))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if first[t[s : s + 100]] != (i, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowded,flush", [(suffix_dedup.CROWDED, suffix_dedup.FLUSH), (2, 50)])
def test_remove_repeats(spark, rows, monkeypatch, crowded, flush):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rng = random.Random(2)
    known = [(i, t) for i, t in rows if i is not None and i != 50]
    passage = prose(rng, 40)
    known += [(500 + k, prose(rng, rng.randint(0, 30)) + passage[k : 200 + k] + prose(rng, 20)) for k in range(12)]
    known += [(600, "ab" * 400), (601, "x" + "ab" * 300), (602, "q" * 99), (603, "q" * 99), (604, "q" * 101), (605, "é" * 120)]
    assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, known)).collect())) == removed(known)
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_null_ids_are_last(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(frame(spark, [(None, text), (9, text)])).collect()}
    assert got == {9: 0, None: 300}


def test_maximal_repeats_list_all_occurrences():
    rng = random.Random(4)
    letters = lambda n: bytes(rng.choice(b"abcdefghij") for _ in range(n))
    shared = letters(130)
    bodies = [letters(40) + shared + letters(20), letters(5) + shared + letters(60), shared[10:] + letters(30)]
    found = {length: sorted(places) for length, places in suffix_dedup.repeats(bodies, [-1] * 3)}
    assert found[130] == [(0, 40), (1, 5)] and found[120] == [(0, 50), (1, 15), (2, 0)]


def test_intervals_of_the_prefix_tree():
    # suffixes of "banana" in order: a ana anana banana na nana
    assert sorted(suffix_dedup.intervals(np.array([0, 1, 3, 0, 0, 2]), 1)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def hits(docs, items, size=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = lambda t: re.findall(pattern, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - size + 1)) if w and k is not None else ():
            windows[tuple(w[i : i + size])].add(str(k))
    out = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    names |= own
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_LIMIT, 0])
def test_decontaminate(spark, rows, limit):
    rng = random.Random(8)
    bench = [(k, prose(rng, 25)) for k in range(6)] + [(6, None), (7, ""), (8, "... !"), (9, "Zeta iota"), (10, rows[-3][1][:200]), (11, "one"), (None, "the of")]
    docs = [r for r in rows if r[0] is not None and r[0] not in (50, rows[-1][0])] + [(900 + k, prose(rng, 8) + " " + t[3:].upper() + "; " + prose(rng, 9)) for k, t in bench[:6]]
    items = spark.createDataFrame([(k, t, 1) for k, t in bench], "item_id long, text string, doc_id int")
    got = [tuple(r)[:6] for r in decontaminate.decontaminate(frame(spark, docs), items, limit=limit).collect()]
    assert sorted(got, key=str) == hits(docs, bench)
    left = decontaminate.without_contaminated(frame(spark, docs), items, limit=limit)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(h[0] for h in hits(docs, bench) if not h[5])
    assert left.columns == frame(spark, docs).columns
    none = decontaminate.decontaminate(frame(spark, docs), items.limit(0), limit=limit)
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)
    assert decontaminate.decontaminate(frame(spark, []), items, limit=limit).collect() == []


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = [(1, "alpha beta gamma delta very epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    got = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontaminate.decontaminate(frame(spark, docs), items).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 1)}


def test_secrets(spark):
    texts = [
        None, "", "nothing here", "password=abc", "Password : 'abcdef' token=\"t0ken12345\" tokenx = 5", "é AKIA" + "A1" * 8 + " AKIA12 " + "0f" * 12 + "g" + "a" * 23,
        "api_key: zz apikey= xx-yy-zz", "password=password=abcdef1", "ſecret=abcdefgh Key", 'DB_PWD = "q8Zr-12kLp_0x"\nuser = "bob"', 'k = "Zx81-kLmN-77aQ"\nclient.secret_value = k\n', "SECRET=a" * 3, "x" * 5000 + " passwd=" + "Q" * 3000,
    ]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, list(enumerate(texts)))).collect()}
    patterns = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24))
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, flags, g, least) in enumerate(patterns) for m in re.finditer(p, t or "", flags) if len(m[g]) >= least)
        joined = ",".join(s for _, _, s in spans)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert {s for _, _, s in spans} <= set(r["spans"].split(",")) | ({""} if not spans else set())
    assert got[9]["spans"] == "literal:10:23"
    start = texts[10].index("Zx81")
    assert got[10]["spans"] == f"literal:{start}:{start + 14}"  # the constant, where its literal stands
    assert secrets.scan_secrets(frame(spark, [])).collect() == []


def test_language_id_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edge_cases(spark):
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (5, "", None), (None, "the hat", None), (7, "éé", "en"), (8, "the " * 400_000, None)]], "doc_id long, text string, lang string, held_out int")
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 5}
    assert got[8]["lang_pred"] == "en" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    unlabelled = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).collect() == []


def trees_of(texts):
    """Trees of {language: text}."""
    counts = {}
    for lang, text in texts.items():
        data, offsets, _ = bytescan.column_bytes(pa.array([text]))
        counts[lang] = np.unique(language_id.coded(data, offsets), return_counts=True)
    return language_id.Trees(sorted(texts), counts)


def code_length(text, probe):
    """Bits of a probe after a text, by counting whole bytes by hand, with escapes."""
    pad = lambda t: [0x20] * 3 + list(t.encode())
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
    own = pad(text)
    for i in range(3, len(own)):
        for k in range(4):
            counts[k][tuple(own[i - k : i])][own[i]] += 1

    def bits(history, s, k):
        if k < 0:
            return 8.0
        seen = counts[k].get(tuple(history[len(history) - k :]), {})
        total, kinds = sum(seen.values()), len(seen)
        if not total:
            return bits(history, s, k - 1)
        return np.log2((total + kinds) / seen[s]) if seen.get(s) else np.log2((total + kinds) / kinds) + bits(history, s, k - 1)

    after = pad(probe)
    return sum(bits(after[i - 3 : i], after[i], 3) for i in range(3, len(after)))


def test_code_lengths_are_those_of_the_tree():
    """The tables' code lengths against counting by hand with escapes, of every byte as it is."""
    texts = {"xx": "abracadabra Abracadabra", "yy": "été à la plage, été 12", "zz": "cadaver"}
    trees = trees_of(texts)
    for probe in (*texts.values(), "cadabra zebra", "q", "É\x00 abr", "été"):
        data, offsets, _ = bytescan.column_bytes(pa.array([probe]))
        got = trees.lengths(data, offsets)[0]
        for k, lang in enumerate(sorted(texts)):
            assert abs(got[k] - code_length(texts[lang], probe)) < 1e-3, (lang, probe)


def test_no_language_loses_its_contexts():
    """Of seventy languages, each with words of its own, each knows its own: code lengths are those of each alone."""
    rng = random.Random(4)
    texts = {f"l{k:02}": " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for k in range(70)}
    trees = trees_of(texts)
    for k, (lang, text) in enumerate(sorted(texts.items())):
        data, offsets, _ = bytescan.column_bytes(pa.array([text]))
        got = trees.lengths(data, offsets)[0]
        assert got.argmin() == k and abs(got[k] - code_length(text, text)) < 1e-2


def test_code_lengths_do_not_depend_on_the_segments(monkeypatch):
    texts = ["abra " * 50, "", "x", "cadabra, " * 90]
    data, offsets, _ = bytescan.column_bytes(pa.array(texts))
    trees = trees_of({"xx": "abra " * 50 + "cadabra, " * 30})
    whole = trees.lengths(data, offsets)
    monkeypatch.setattr(language_id, "SEGMENT", 37)
    assert np.allclose(trees.lengths(data, offsets), whole, atol=1e-3)


def test_toxicity_learns_and_generalises(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    assert np.mean(np.array(bad) >= 0.7) > 0.6 and np.mean(np.array(good) >= 0.7) < 0.05


def test_the_machine_learns_an_interaction():
    """Neither term alone is bad, both together are: no additive weights can tell."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    label = a & b
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.concatenate([np.full(a.sum(), 11), np.full(b.sum(), 22)])
    order = np.lexsort((term, doc))
    model = toxicity.fit(label, doc[order], term[order])
    score = lambda rows: 1 / (1 + np.exp(-model.logit(1, np.zeros(len(rows), int), model.slot[np.array(rows, int)])))[0]
    assert score([11, 22]) > 0.7 > 0.5 > max(score([11]), score([22]), score([]))


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (None, "a"), (3, "a b")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.toxicity(docs, some).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 5
