"""Near-duplicates, repeated passages and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import covertree, graph, minhash, suffix
from barline.llm.queries import QUERIES


def least(nodes, edges):
    """Smallest reachable node of each node."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (3, 4), (4, 3)]
    df = spark.createDataFrame([*edges, (None, 2), (2, None)], "a long, b long")
    want = least({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert graph.components(df.where("false")).count() == 0


def sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(docs, size, percent):
    s = [sets(t, size) for _, t in docs]
    edges = []
    for i in range(len(docs)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                edges.append((docs[i][0], docs[j][0]))
    return {d: (len(s[i]), c) for i, (d, c) in enumerate(least([d for d, _ in docs], edges).items())}


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(prose):
    """Exact copies, near copies around the threshold, a large group of near copies, short texts."""
    rng = random.Random(8)
    docs = [prose(i, rng.randint(1, 300)) for i in range(60)]
    for i in range(20):
        docs += [edited(docs[i], rng, k) for k in (1, 2, 4)]
    docs += [docs[3]] * 5 + [docs[3].upper(), docs[5].replace(" ", "\t\n")]
    big = prose(99, 400)
    docs += [edited(big, rng, rng.randint(1, 8)) for _ in range(90)]
    docs += ["", " \n ", "one", "One", "one two", "ONE two", "one two three", "a  a  a a a", "a a a"]
    rng.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_documents_equal_all_pairs(spark, documents, copies, size, percent):
    out = minhash.near_documents(documents(copies, ("id", "uid", "n", "key")), size, percent).collect()
    want = near(copies, size, percent)
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.first == (r.id == r.component_id) for r in out)


def test_near_documents_with_small_nodes(spark, documents, copies, monkeypatch):
    monkeypatch.setattr(minhash, "NODE", 8)
    out = minhash.near_documents(documents(copies), 3, 85).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == near(copies, 3, 85)


def test_near_documents_of_one_template(spark, documents, prose, monkeypatch):
    """Documents of one template lie below the threshold, planted pairs of them just above it."""
    monkeypatch.setattr(minhash, "MEMBERS", 60)
    rng = random.Random(12)
    template = prose(77, 300)
    docs = [edited(template, rng, 6) for _ in range(240)]
    docs += [edited(d, rng, 7) for d in docs[:40]]
    rows = list(enumerate(docs))
    want = near(rows, 3, 85)
    assert 40 <= len(docs) - len({c for _, c in want.values()}) <= 80
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_documents(documents(rows), 3, 85).collect()}
    assert got == want


def test_rows_of_the_leaders_component_do_not_meet_them(spark):
    members = [(i, 7 if i < 60 else 8, 10, b"", 1) for i in range(61)] + [(i, 9, 10, b"", 2) for i in range(100, 140)]
    rows = spark.createDataFrame(members, "rep long, comp long, n long, short binary, p long")
    lead = (0, 7, 10, b"")
    kind = "struct<rep long, comp long, n long, short binary>"
    nodes = spark.createDataFrame([(1, lead, (1, 7, 10, b""), 7, 8), (2, (100, 9, 10, b""), (101, 9, 10, b""), 9, 9)], f"p long, lead {kind}, other {kind}, lo long, hi long")
    assert [r["rep"] for r in minhash._meet(rows, nodes).collect()] == [60]
    mixed = spark.createDataFrame([(1, lead, (60, 8, 10, b""), 7, 8)], nodes.schema)
    assert minhash._meet(rows, mixed).count() == 61


def test_near_documents_edge_cases(spark, documents):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, "z " * 50_000)]
    out = minhash.near_documents(documents(rows), 5, 80).collect()
    assert len(out) == 6 and sum(r.first for r in out) == 4
    assert minhash.near_documents(documents([]), 5, 80).count() == 0


def test_near_documents_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_documents"](spark, sf).collect()}
    want = near(docs, 3, 85)
    assert got == want


def brute_spans(docs, width, keep_first):
    """docs: (key, bytes) in order. Covered bytes by looking every window up."""
    seen = defaultdict(list)
    for k, (_, raw) in enumerate(docs):
        for i in range(len(raw) - width + 1):
            seen[raw[i : i + width]].append((k, i))
    out = []
    for k, (_, raw) in enumerate(docs):
        cover = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            at = seen[raw[i : i + width]]
            if len(at) > 1 and not (keep_first and at[0] == (k, i)):
                cover[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(int), [0]])))
        out.append((docs[k][0], len(raw), [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])], bytes(np.frombuffer(raw, np.uint8)[~cover])))
    return out


@pytest.fixture(scope="module")
def passages(prose):
    rng = random.Random(4)
    shared = [prose(500 + i, 60) for i in range(3)]
    docs = []
    for i in range(30):
        text = prose(i, rng.randint(5, 120))
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randrange(len(text))
            text = text[:at] + p[rng.randrange(20) :] + text[at:]
        docs.append(text)
    docs += [docs[0], docs[1], docs[2][:-3], "ab" * 400, "x" * 500, "The The " * 60, "", "short", "é" * 150, "中" * 70]
    return list(enumerate(docs))


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_equal_all_windows(spark, documents, passages, keep_first, hot):
    out = suffix.remove_repeats(documents(passages, ("spans", "uid", "h")), 200, keep_first, hot=hot).collect()
    got = sorted((r.id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in out)
    assert got == brute_spans([(d, t.encode()) for d, t in passages], 200, keep_first)
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") or r.text.isprintable() or "\n" in r.text for r in out)


def test_long_texts_come_in_segments(spark, documents, prose, monkeypatch):
    text = prose(1, 3000)
    rows = [(1, text), (2, prose(2, 50) + text[5000:7000]), (3, None)]
    df = documents(rows)
    whole = sorted(map(str, suffix.remove_repeats(df).collect()))
    monkeypatch.setattr(suffix, "SEGMENT", 1500)
    assert whole == sorted(map(str, suffix.remove_repeats(df).collect()))


def test_repeats_edge_cases(spark, documents, prose):
    text = prose(9, 80)
    rows = [(1, text), (1, text), (None, text), (2, None)]
    out = suffix.remove_repeats(documents(rows)).collect()
    assert sorted(len(r.kept) for r in out) == [0, 0, 0, len(text.encode())]
    assert suffix.remove_repeats(documents([])).count() == 0


def test_repeats_query(spark, sf):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in QUERIES["op8_suffix_dedup"](spark, sf).collect()}
    assert got == {d: (n, sum(b - a for a, b in s), len(s)) for d, n, s, _ in brute_spans(docs, 200, False)}


def links(vectors, least_cos=0.9):
    ok = {}
    for i, v in vectors:
        x = None if v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x / np.linalg.norm(x)
    ids = sorted(ok)
    edges = [(a, b) for a in ids for b in ids if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= least_cos]
    n = defaultdict(int)
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    comp = least([i for i, _ in vectors], edges)
    return {i: (n[i], comp[i]) for i, _ in vectors}


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 64)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = [base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.35]) for _ in range(300)]
    x += [base[0] + rng.normal(size=16) * 0.02 for _ in range(150)] + [base[1]] * 30 + [base[1] * 3.0]
    rows = [(i * 3, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [float("inf")] * 16), (5004, [None] + [1.0] * 15), (5005, []), (5006, [1.0, 2.0]), (5007, [1.0, 2.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "n": F.lit("x")})
    got = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()}
    assert got == links(rows)
    assert covertree.near_vectors(df.where("false")).count() == 0


def test_pairs_of_blocks_send_a_bounded_share_in_a_round(spark, monkeypatch):
    """However many blocks there are, a round sends all of them about twice; links are those of all pairs."""
    for name, value in (("BLOCK", 16), ("TILE", 2), ("ROUND_BYTES", 1)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(c) for c in (base[i % 20] + rng.normal(size=8) * (0.2 + i % 3)).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent, blocks, land = [], [], covertree.land

    def seen(frame):
        out = land(frame)
        if "round" in out.columns:
            rounds = out.groupBy("round").count().collect()
            sent.extend(r["count"] for r in rounds)
            blocks.append(out.select("node", "part").distinct().count())
        return out

    monkeypatch.setattr(covertree, "land", seen)
    got = {r.id: (r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()}
    assert got == links(rows)
    assert blocks[0] > 15 and len(sent) > 3
    assert max(sent) <= 4 * blocks[0] and sum(sent) <= blocks[0] * (blocks[0] / 2 + 2)


def test_tree_nodes_cover_their_members():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.build(np.arange(500), np.ones(500, np.int64), x)
    for level in range(covertree.LEVELS):
        starts, stops = tree.first[-1][level]
        for s, e, c, r in zip(starts, stops, tree.centre[level], tree.radius[level]):
            assert np.linalg.norm(tree.unit[s:e] - tree.unit[c], axis=1).max() <= r + 1e-6 <= covertree.TOP / 2**level + 1e-5
