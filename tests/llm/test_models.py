"""Exact search, URL filter, quality classifier and the pipeline."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barline.llm import kneser, topk, urls
from barline.llm.common import land
from barline.llm.queries import BYTE_BPE, QUERIES

from test_dedup import brute_spans, near
from test_tokens import check_packing


def best(rows, k, every):
    ok = {i: np.array(v, object) for i, v in rows if i is not None and v and None not in v}
    out = set()
    for q in ok:
        if q % every:
            continue
        scored = sorted((-int((ok[q] * v).sum()), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("high", [9, 10**8])
def test_top_k_equals_brute_force(spark, monkeypatch, high):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = random.Random(high)
    rows = [(i, [rng.randint(-high, high) for _ in range(6)]) for i in range(200)] + [(1000 + i, [1] * 6) for i in range(60)]
    rows += [(2000, None), (2004, [None] * 6), (2008, []), (2012, [3, 4]), (2016, [5, 6]), (None, [1] * 6), (2020, [7])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumns({"id": F.lit(1), "score": F.lit("x"), "block": F.lit(2)})
    got = topk.top_k(df, F.col("vec_id") % 4 == 0, 5).collect()
    assert len(got) == len(set(got)) and {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == best(rows, 5, 4)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 4 == 0).count() == 0


def test_top_k_of_one_dimension(spark):
    rows = [(i, [x]) for i, x in enumerate(range(-7, 23))]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 4 == 0, 20).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == best(rows, 20, 4)


def test_top_k_query(spark, sf):
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = [(r.vec_id, [math.floor(64 * x) for x in r.embedding]) for r in raw]
    got = QUERIES["op3_top_k"](spark, sf).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == best(rows, 20, 20)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    found = None
    for text, verdict in urls.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (found is None or len(text) > len(found[0])):
            found = (text, verdict)
    return found or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://a.net", "http://a.net/x", "http://EXAMPLE.net/en/1?q#f", "http://x.example.com/de/", "http://x.example.com/de",
    "ftp://www.org/fr/?a", "http://aorg/fr/", "http://b.org/fr/x://y/z", "http://h?x/y", "http://h#a?b", "http://É.org/fr/é", "http://ok.example.org/en/1",
]


def test_rules_and_parts(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, *URLS[-2:]])] + [(None, "http://n.net/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("id", "host", "gram", "score")})
    got = urls.judge(df).collect()
    want = Counter((i, *parts(u), ruled(*parts(u))[0]) for i, u in rows)
    assert Counter((r.id, r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict == (ruled(r.host, r.path)[1] or "allow") for r in got)  # no rejected ones: no cut
    assert urls.judge(df.where("false")).count() == 0


def chain(texts):
    """Plain Witten-Bell model of order two over (text, weight)."""
    n = [Counter(), Counter(), Counter()]
    for text, w in texts:
        s = "^^" + text + "$"
        for i in range(2, len(s)):
            for k in range(3):
                n[k][s[i - k : i + 1]] += w
    total, after = [Counter(), Counter(), Counter()], [defaultdict(set), defaultdict(set), defaultdict(set)]
    for k in range(3):
        for g, c in n[k].items():
            total[k][g[:-1]] += c
            after[k][g[:-1]].add(g[-1])

    def p(g, k=2):
        if k == 0:
            return (n[0][g] + 1) / (total[0][""] + len(urls.TARGETS))
        ctx, below = g[:-1], p(g[1:], k - 1)
        if not total[k][ctx] or (k == 2 and total[k][ctx] < urls.MIN_COUNT):
            return below
        t = len(after[k][ctx])
        return (n[k][g] + t * below) / (total[k][ctx] + t)

    return p


def test_models_against_plain_code(spark):
    rng = random.Random(6)
    good = [f"http://{rng.choice(['blog.', 'www.', ''])}{rng.choice(['thin', 'onder', 'reath'])}{rng.randint(1, 9)}.example.com/en/{rng.randint(1, 99)}" for _ in range(80)]
    bad = [f"http://{rng.choice(['casino', 'cheap-pills', 'free-bets'])}-{rng.choice(['win', 'now'])}.example.com/x/{rng.randint(1, 99)}" for _ in range(12)]
    rows = list(enumerate([*good, *bad, good[0], None, "https://cheap-win.example.com/x/5"]))
    got = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    texts, known = Counter(), {}
    for _, u in rows:
        rest = "" if u is None else u.split("://", 1)[-1].lower()
        texts[rest] += 1
        known[rest] = any(m in rest.split("/")[0] for m in urls.REJECTED)
    a, r = (chain([(t, w) for t, w in texts.items() if known[t] == side]) for side in (False, True))

    def score(t):
        s = "^^" + t + "$"
        return float(np.mean([math.log(a(s[i - 2 : i + 1])) - math.log(r(s[i - 2 : i + 1])) for i in range(2, len(s))]))

    def moments(side):
        x, w = np.array([score(t) for t in texts if known[t] == side]), np.array([texts[t] for t in texts if known[t] == side])
        mean = (x * w).sum() / w.sum()
        return mean, math.sqrt((x * x * w).sum() / w.sum() - mean * mean)

    (mg, sg), (mb, sb) = moments(False), moments(True)
    cut = (mg * sb + mb * sg) / (sg + sb)
    want = {i: "block" if score("" if u is None else u.split("://", 1)[-1].lower()) < cut else "allow" for i, u in rows}
    assert got == want and want[len(rows) - 1] == "block"


def test_known_spam_hosts_are_blocked_and_others_not(spark):
    out = QUERIES["op9_url_filter"](spark, "/root/testdata/sf0.01").where("rule is null").collect()
    for r in out:
        assert (r.verdict == "block") == any(m in r.host for m in urls.REJECTED)


def kneser_ney(grams):
    """Plain interpolated modified Kneser-Ney of order three; grams: Counter of token triples."""
    c3 = grams
    c2, c1 = Counter(), Counter()
    for g in c3:
        c2[g[1:]] += 1
    for g in c2:
        c1[g[1:]] += 1

    def prepare(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        one = 1 - 2 * y * n[2] / n[1] if n[1] else 0.5
        two = 2 - 3 * y * n[3] / n[2] if n[2] else one
        more = 3 - 4 * y * n[4] / n[3] if n[3] else two
        d = {1: min(max(one, 0.1), 0.95), 2: min(max(two, 0.1), 1.9), 3: min(max(more, 0.1), 2.9)}
        total, held = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3)]
        return counts, d, total, held

    levels = [prepare(c) for c in (c1, c2, c3)]

    def p(g):
        if not g:
            return 1 / kneser.SIZE
        counts, d, total, held = levels[len(g) - 1]
        below = p(g[1:])
        if not total[g[:-1]]:
            return below
        c = counts[g]
        return (c - d[min(c, 3)] if c else 0.0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * below

    return p


def plain_grams(text):
    toks, run, last = [], 0, None
    for w in text.split():
        run = run + 1 if w == last else 0
        toks.append(min(run, kneser.RUN) if run else kneser.token(w))
        last = w
    toks = [0, 0, *toks]
    return [tuple(toks[i - 2 : i + 1]) for i in range(2, len(toks))]


def test_perplexity_equals_plain_code(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(kneser, "BLOCK_DOCS", 16)
    rows = [(i, prose(i, 5 + 9 * i)) for i in range(40)] + [(50, None), (51, " \n"), (52, "word " * 400), (53, "SHOUT!! " * 30)]
    df = documents(rows, ("id", "uid", "good", "gram", "cut"))
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] * 2 + [(None,), (999,)], "id long")
    got = {r.id: r for r in kneser.quality(df, trusted).collect()}
    p = kneser_ney(Counter(g for i, t in rows if i < 40 and i % 2 == 0 for g in plain_grams(t)))
    logp = {i: (sum(math.log(p(g)) for g in plain_grams(t or "")), len(plain_grams(t or ""))) for i, t in rows}
    mean = sum(logp[i][0] for i in range(0, 40, 2)) / sum(logp[i][1] for i in range(0, 40, 2))
    for i, (total, n) in logp.items():
        assert got[i].n_words == n
        if n:
            assert got[i].perplexity == pytest.approx(math.exp(-(total + kneser.PRIOR * mean) / (n + kneser.PRIOR)), rel=1e-9)
            assert got[i].kept == (got[i].perplexity <= got[i].cut)
        else:
            assert got[i].perplexity is None and not got[i].kept
    assert all(got[i].kept for i in range(40)) and not got[52].kept and not got[53].kept


def test_quality_without_trust_and_on_an_empty_table(spark, documents):
    none = spark.createDataFrame([], "id long")
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (2, "")]
    assert sorted(r.kept for r in kneser.quality(documents(rows), none).collect()) == [False, True, True, True]
    assert kneser.quality(documents([]), none).count() == 0


def test_quality_on_held_out_labels(spark):
    """Trained on one half of the trusted labels, judged on the other half and on known junk."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    trusted = labels.where("quality = 1 and toxic = 0").where(half).select(F.col("doc_id").alias("id"))
    out = kneser.quality(docs, trusted).join(labels.where(~half), F.col("id") == labels["doc_id"]).collect()
    clean = [r.kept for r in out if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in out if r.quality == 0]
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1


def test_cut_is_the_quantile_of_held_out_trusted_documents(spark, documents, prose):
    """Short junk has no allowance, and no document above the quantile is kept."""
    rows = [(i, prose(i, 40)) for i in range(60)] + [(100 + i, "7 !! ZZ") for i in range(3)]
    trusted = spark.createDataFrame([(i,) for i in range(60)], "id long")
    got = {r.id: r for r in kneser.quality(documents(rows), trusted).collect()}
    assert kneser.MARGIN == 1 and not any(got[i].kept for i in (100, 101, 102))
    assert sum(got[i].kept for i in range(60)) >= 58


def test_the_model_is_over_words(spark, documents, prose):
    """Words of equal shape are different tokens: a known text with its long words' letters turned round is less likely."""
    assert len({kneser.token(w) for w in ("thand", "thone", "other", "thand.")}) == 4
    text = prose(7, 200)
    turned = " ".join(w[::-1] if len(w) > 3 and w.isalpha() else w for w in text.split())
    rows = [(i, prose(i, 200)) for i in range(40)] + [(100, text), (101, turned)]
    trusted = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = {r.id: r for r in kneser.quality(documents(rows), trusted).collect()}
    assert got[100].perplexity == got[7].perplexity and got[100].kept
    assert got[101].perplexity > 10 * got[100].perplexity and not got[101].kept


def test_rounds_and_split_words_change_no_score(spark, documents, prose, monkeypatch):
    """Every word is sent in one round, a round sends about its share of the bytes, and the scores are those of one round."""
    rows = [(i, prose(i % 50, 150) + " the of the " * (i % 7)) for i in range(60)]
    df, trusted = documents(rows), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "id long")
    one = {r.id: r for r in kneser.quality(df, trusted).collect()}
    monkeypatch.setattr(kneser, "ROUND_CHARS", sum(len(t) for _, t in rows) // 4)
    monkeypatch.setattr(kneser, "SHOWN", 1)
    plans, planned = [], kneser.planned
    monkeypatch.setattr(kneser, "planned", lambda *a: plans.append(planned(*a)) or plans[-1])
    many = {r.id: r for r in kneser.quality(df, trusted).collect()}
    assert len(plans[0].words) and plans[0].splits.max() > 1
    for i, r in one.items():
        assert (many[i].n_words, many[i].kept) == (r.n_words, r.kept)
        assert many[i].perplexity == pytest.approx(r.perplexity, rel=1e-9) and many[i].cut == pytest.approx(r.cut, rel=1e-9)
    marked = df.selectExpr("doc_id uid", "text", "0L code")
    sent = [marked.mapInArrow(kneser._postings(plans[0], 4, now), kneser.MESSAGE).where("part >= 0").collect() for now in range(4)]
    words = sum(len(t.split()) for _, t in rows)
    assert sum(len(r.u) // kneser.NEAR for some in sent for r in some) == words
    size = [sum(len(r.u) + len(r.v) + len(r.w) + len(r.docs) + len(r.n) for r in some) for some in sent]
    assert max(size) < 0.45 * sum(size)


def test_runs_and_common_contexts_do_not_fill_one_part(spark, documents, prose, monkeypatch):
    """A run of one word, and a context that every document has, are spread; the scores are those of plain code."""
    rows = [(i, prose(i, 40) + (" we see that" * 8 + f" we see w{i % 9}" * 9 if i % 2 else "") + (" ha" * 700 if i % 5 == 0 else "")) for i in range(100)]
    df, trusted = documents(rows), spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(i,) for i in range(1, 100, 4)], "id long")
    monkeypatch.setattr(kneser, "SHOWN", 1)
    monkeypatch.setattr(kneser, "PARTS", 64)
    plans, planned = [], kneser.planned
    monkeypatch.setattr(kneser, "planned", lambda *a: plans.append(planned(*a)) or plans[-1])
    got = {r.id: r for r in kneser.quality(df, trusted).collect()}
    p = kneser_ney(Counter(g for i, t in rows if i % 2 == 0 or i % 4 == 1 for g in plain_grams(t)))
    for i, t in rows:
        grams = plain_grams(t)
        assert got[i].n_words == len(grams)
        assert got[i].perplexity == pytest.approx(math.exp(-sum(math.log(p(g)) for g in grams) / len(grams)), rel=1e-9)
    parts, flat = Counter(), Counter()
    marked = df.selectExpr("doc_id uid", "text", "0L code")
    for r in marked.mapInArrow(kneser._postings(plans[0], 1, 0), kneser.MESSAGE).where("part >= 0").collect():
        (parts if r.part < 64 else flat)[r.part] += len(r.docs) // 2
    words = sum(len(t.split()) for _, t in rows)
    assert words > 14_000 and max(parts.values()) < words / 30 and max(flat.values()) < words / 10


def a_part(n, vocabulary, blocks, plan):
    """One part's trigrams in messages of some blocks, a third of them trusted, and what the part is told."""
    rng = np.random.default_rng(5)
    words = np.unique(np.append(rng.integers(9, 1 << 62, vocabulary), plan.words))
    u, w, v = (rng.choice(words, n) for _ in range(3))
    v[: n // 4] = plan.words[0]
    docs = (rng.integers(0, 4, n) * (rng.random(n) < 0.5)).astype("<u2") << 13 | rng.integers(0, 900, n).astype("<u2")
    rows, near = [], (1 << 8 * kneser.NEAR) - 1
    for block in range(blocks):
        mine = np.arange(block, n, blocks)
        mine = mine[np.argsort(plan.keys(u[mine], v[mine]), kind="stable")]
        value, run = kneser._grouped(v[mine])
        rows.append(kneser._message(0, block, kneser._near(u[mine]), value, kneser._near(w[mine]), kneser._planes(docs[mine]), run))
    known = np.unique(w)
    names = [f"{x}{m}" for x in "ce" for m in kneser.MODELS]
    told = [(kneser.WORD, np.zeros_like(known), known), (kneser.BIGRAM, np.full_like(known, plan.words[0]), known)]
    told = [{"kind": np.full(len(k), kind), "v": first, "w": k} | {c: 1 + (k >> 3 + i) % 9 for i, c in enumerate(names)} for kind, first, k in told]
    assert len(np.unique(known & near)) == len(known)
    return pa.Table.from_batches(rows), pa.concat_tables([pa.table(t) for t in told])


def a_plan():
    plan = kneser.Plan(1, np.array([5 << 50]), np.array([2]))
    plan.d1 = plan.d2 = plan.d3 = [(0.6, 1.1, 1.4, 1e6)] * len(kneser.MODELS)
    plan.base = [1e-8 * (1 + m) for m in kneser.MODELS]
    plan.t2, plan.k2 = np.full((len(kneser.MODELS), 1), 5e5), np.full((len(kneser.MODELS), 1), 2e5)
    return plan


def test_slices_of_a_part_change_no_sum(monkeypatch):
    part, got = a_part(20_000, 300, 3, a_plan()), []
    for size in (1 << 30, 700):
        monkeypatch.setattr(kneser, "SLICE", size, raising=False)
        got.append(kneser._scored(a_plan())(*part))
    assert got[0].num_rows == 3 and got[0].equals(got[1])


def test_a_part_is_judged_in_little_memory():
    """A worker holds less than 130 bytes a trigram of a part of the usual size, besides the part itself."""
    part, n = a_part(1_500_000, 200_000, 40, a_plan()), 1_500_000
    tracemalloc.start()
    kneser._scored(a_plan())(*part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 * n


def test_words_are_those_of_split():
    """Words are cut from bytes as str.split cuts texts, whatever the white space."""
    rng = random.Random(2)
    some = ["a", "B", "é", "İ", "Σ", "\x00", "😀", "​", "᠎", "Â", "x" * 70, *kneser.SPACES, " ", " ", "\n"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    flat, n = kneser.tokens(texts)
    words = [t.lower().split() for t in texts]
    assert n.tolist() == [len(x) for x in words]
    want = [0 if k and w == x[k - 1] else kneser.token(w) for x in words for k, w in enumerate(x)]
    assert [0 if t <= kneser.RUN else t for t in flat.tolist()] == want


def test_places_of_hashes():
    rng = np.random.default_rng(1)
    for bits in (64, 62, 48):
        known = np.unique(np.append(rng.integers(0, 1 << bits, 5000, np.uint64), np.arange(9, dtype=np.uint64)))
        asked = np.concatenate([known, known + np.uint64(1), rng.integers(0, (1 << 64) - 1, 500, np.uint64)])
        assert (kneser._place(known, asked) == np.searchsorted(known, asked)).all()
    assert kneser._place(known[:0], asked).tolist() == [0] * len(asked)


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    """Stage by stage on the smallest tables; the classifier's verdicts are tested above."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(_write(stage(spark, docs, sf), tmp_path / name))
        seen.append(docs)
    assert [d.columns for d in seen[:3]] == [columns] * 3
    first = {r.doc_id: r.text for r in seen[0].collect()}
    groups = near(sorted(first.items()), 5, 80)
    second = {r.doc_id: r.text for r in seen[1].collect()}
    assert second == {d: first[d] for d, (_, c) in groups.items() if d == c}
    third = {r.doc_id: r.text for r in seen[2].collect()}
    raw = sorted((d, t.encode()) for d, t in second.items())
    whole = dict(raw)
    for d, _, spans, _ in brute_spans(raw, 200, True):
        cut, at = "", 0
        for a, b in [*spans, (len(whole[d]), len(whole[d]))]:
            cut += whole[d][at:a].decode("utf-8", "ignore")
            at = b
        assert third[d] == cut
    lib = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    check_packing(seen[3].collect(), {d: lib.encode(t, add_special_tokens=False).ids + [0] for d, t in third.items()}, 2048)
    ran = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()}
    assert ran == {tuple(r) for r in seen[3].select("doc_id", "piece", "start", "length", "ids_crc32").collect()}


def _write(df, path):
    df.write.parquet(str(path))
    return str(path)


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = docs.withColumns({c: F.lit("x") for c in ("new", "UID", "_none", "id", "c0", "n", "kept", "first", "uid_")})
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:3]:
        columns = docs.columns
        docs, none = land(stage(spark, docs, sf)), land(stage(spark, none, sf))
        assert docs.columns == none.columns == columns and none.count() == 0
        assert docs.count() and docs.where("new = 'x' and UID = 'x' and _none = 'x'").count() == docs.count()
    assert corpus_pipeline.pack(spark, none, sf).count() == 0
