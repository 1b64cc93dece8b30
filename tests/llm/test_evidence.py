"""Secret scan, whitening and manifest against plain code."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import merkle, secretscan, whitening
from barline.llm.queries import QUERIES

LONG_TABLES = "doc_id long, text string, lang string, source string, n_chars long"

EXPRESSIONS = {
    "assign": (r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    "access": (r"AKIA([A-Z0-9]+)", 12),
    "hex": (r"([0-9a-f]+)", 32),
    "pem": (r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY-----)", 0),
    "forge": (r"gh[opsur]_([A-Za-z0-9]+)", 36),
    "chat": (r"xox[abeoprs]-([A-Za-z0-9-]+)", 10),
    "bearer": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 16),
}
PIECES = ["token", "PassWord", "passwd", "secret", "api_key", "APIKEY", " ", "  ", ":", "=", "==", "'", '"', "AKIA", "AKIAAKIA", "abcdef0123", "0123456789abcdef" * 2, "ABCDEF12", "é", "😀", "\n", "\x00", "x", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "A1b2" * 9, "xoxb-", "eyJ", ".", " the ", "_", "ſecret", "toKen", "tok"]


def plain(text):
    found = []
    for place, (kind, (pattern, least)) in enumerate(EXPRESSIONS.items()):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [(kind, a, z) for a, _, kind, z in sorted(found)]


def test_scan_finds_what_plain_expressions_find(spark, documents):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(PIECES) for _ in range(60_000)), "0a" * 700_000, "x" * 600_000 + " token: " + "=" * 900_000, "", None, "token: secret: abcdefghij", "token==abcdefg", "token= 'abcdefgh'"]
    texts += texts[:20]
    got = secretscan.scan(documents(list(enumerate(texts)), more=("spans", "id", "kind", "start")))
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in got.collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}


def test_lanes_that_start_inside_a_match_are_read_again():
    scan, text = secretscan.scanner(), "ab" * 5000 + " " + "AKIA" + "Z" * 3000 + " api_key" + " " * 2000 + "= " + "q" * 2000
    assert [(scan.kinds[r], a, z) for r, a, z in secretscan.spans(scan, [text.encode()])[0]] == plain(text)


def test_minimal_automaton_has_no_states_that_nothing_tells_apart():
    auto = secretscan.compiled([secretscan.read("(ab|cb|db)x{2,3}")], False)
    assert len(auto.marks) == 7  # nothing, a letter, b, x, xx, xxx and the dead end
    with pytest.raises(ValueError):
        secretscan.compiled([secretscan.read("a*")], False)


@pytest.mark.parametrize("text", ["(a", "[", "a{2", ".", r"\d", "é", "a)"])
def test_expressions_outside_the_syntax_are_refused(text):
    with pytest.raises(ValueError):
        secretscan.read(text)


def test_empty_tables(spark, documents):
    assert secretscan.scan(documents([])).count() == 0
    assert merkle.manifest(documents([]), ["doc_id", "text"]).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- whitening ----
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, v string, component int")


def judged(rows):
    kept = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in kept]
    return kept, np.array(x, object)


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 12)) * np.array([30, 20, 12, 8, 5, 3, 2, 1, 0.7, 0.5, 0.3, 0.2]) @ rng.normal(size=(12, 12))
    rows = [(i, v.tolist(), 0, 1, "x", 2) for i, v in enumerate(base)]
    rows += [(800, None, 0, 1, "x", 2), (801, [], 0, 1, "x", 2), (802, [1.0] * 11 + [None], 0, 1, "x", 2), (803, [float("nan")] * 12, 0, 1, "x", 2), (804, [float("inf")] + [0.0] * 11, 0, 1, "x", 2), (5, rows[5][1], 0, 1, "x", 2), (None, rows[6][1], 0, 1, "x", 2)]
    kept, x = judged(rows)
    n, s = len(kept), x.sum(0)
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert len(got) == 8 * n and set(got["n"]) == {n}
    want = sorted(int(((n * row - s) ** 2).sum()) for row in x)
    assert sorted(int(v) for v in got[got["component"] == 1]["deviation"]) == want
    c = (x - s / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    one = got[got["id"] == 3].sort_values("component")
    assert np.allclose(np.abs(one["whitened"].to_numpy(float)), np.abs((c[3] @ u[:, :8]) / np.sqrt(e[:8])), atol=1e-8)
    assert np.allclose(one["explained"].to_numpy(float), e[:8] / e.sum(), rtol=1e-9)
    w = got["whitened"].to_numpy(float).reshape(n, 8)
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9


def test_covariance_is_exact_where_products_are_far_from_the_mean():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 40), 1 << 40, (50, 5)).astype(object)
    n, s = len(x), x.sum(0)
    c = n * x - s
    pairs = [int((c[:, i] ** 2).sum()) if i == j else int(((c[:, i] + c[:, j]) ** 2).sum()) for i in range(5) for j in range(i, 5)]
    small = np.array(c.tolist(), np.int64)
    i, j = np.triu_indices(5)
    both = np.where(i == j, small[:, i], small[:, i] + small[:, j])
    assert whitening.squares(both).tolist() == pairs
    exact = np.array([[int((c[:, a] * c[:, b]).sum()) / n**3 for b in range(5)] for a in range(5)])
    assert (whitening.covariance(pairs, n, 5) == exact).all()


def test_equal_vectors_a_single_one_and_odd_lengths(spark):
    one = [(1, [0.5, 0.25], 0, 1, "x", 2)]
    assert whitening.whiten(vectors(spark, one)).count() == 0
    assert whitening.whiten(vectors(spark, one * 4)).count() == 0
    line = [(i, [float(i), 2.0 * i], 0, 1, "x", 2) for i in range(6)] + [(9, [1.0], 0, 1, "x", 2)]
    got = whitening.whiten(vectors(spark, line)).toPandas()
    assert set(got["id"]) == set(range(6)) and set(got["component"]) == {1} and np.allclose(got["explained"], 1)


def test_numbers_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30, 0.0], 0, 1, "x", 2), (2, [0.0, 1.0], 0, 1, "x", 2)])).collect()


# ---- manifest ----
def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(own):
            run = i // 3 * 3
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 3]))
            own[k] = i // 3
        nodes = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof hash, folded, verified) of (id, text, lang, source, n)."""
    groups = {}
    for d, text, lang, source, n in rows:
        bare = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((d is not None, d or 0, leaf_of((d, source, lang, n, text)), leaf_of((d, source, lang, n, bare))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(g := sorted(groups[s]), *tree([leaf for _, _, leaf, _ in g])) for s in order]
    root, upper = tree([t[1] for t in trees])
    out = []
    for (g, subroot, paths), up in zip(trees, upper):
        for (some, d, leaf, claim), path in zip(g, paths):
            for left, right in path + up:
                claim = H("".join(left) + claim + "".join(right))
            proof = "".join(x for left, right in path + up for x in left + right)
            out.append((d if some else None, leaf, subroot, root, H(proof), claim, claim == root))
    return sorted(out, key=repr)


def manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, LONG_TABLES).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_manifest"](spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("sizes, chunk", [([1], 7), ([2, 1, 1], 2187), ([9, 10], 7), ([27, 1, 82], 7), ([1] * 30, 7), ([200, 3, 1, 1, 40, 2], 7), ([200, 3, 1, 1, 40, 2], 2187)])
def test_manifest_of_all_shapes(spark, tmp_path, monkeypatch, sizes, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = [(1000 * k + i, f"{i} line\nnext" if i % 3 else "one line", "en", None if k == 1 else f"s{k:02d}", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest(spark, tmp_path, rows) == brute(rows)


def test_manifest_of_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 5)
    rows = [(i, None if i % 4 == 0 else "é\n" * (i % 3), None if i % 5 == 0 else "", ["b", "B", "é", "", None, "😀", "�"][i % 7], None if i % 6 == 0 else -i) for i in range(60)]
    rows += rows[:9] + [(None, "x", "en", "b", 1), (None, None, None, None, None), (None, "x", "en", "b", 1), (7, "other", "en", "b", 1)]
    rows += [(-5, "long " * 400_000 + "\n", "en", "b", 2)]
    assert manifest(spark, tmp_path, rows) == brute(rows)


def test_proofs_verify_alone_and_clashing_columns_go(spark, documents):
    df = documents([(i, f"text {i}") for i in range(40)], more=("id", "key", "leaf", "place", "part", "tree", "idx", "root", "claim"))
    rows = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.concat("text", F.lit("!"))}).collect()
    assert len(rows) == 40
    for r in rows:
        assert merkle.fold(r["leaf"], r["proof"], bytes(r["sides"])) == r["root"] != r["folded_root"]


def test_missing_is_the_smallest_set_that_suffices():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 200)
        lo = rng.randrange(n)
        hi = rng.randint(lo + 1, n)
        asked = set(merkle.missing(lo, hi, n))
        known, size, level = set(range(lo, hi)), n, 0
        while size > 1:
            runs = {i // 3 for i in known}
            need = {(level, i) for r in runs for i in range(3 * r, min(3 * r + 3, size)) if i not in known}
            assert need == {a for a in asked if a[0] == level}
            known, size, level = runs, -(-size // 3), level + 1
        assert all(level > a[0] for a in asked)
