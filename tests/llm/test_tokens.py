"""Encoders, counts, packing and token files against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barline.llm import bpe, counts, packing, tokenfile, vocab
from barline.llm.queries import BYTE_BPE, QUERIES, WORD_BPE

BYTE, WORD = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(WORD_BPE)
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PARTS = [
    " ", "\n", "\t", "a", "th", " the", "'s", "'LL", "1", "²", "é", "ß", "!", "***", "  ", "\n\n", "\x00", "\x1f", "\xa0", "　", "中", "文",
    "😀", "<|endoftext|>", "<|startoftext|>", "ΑΣ", "İ", "́", "\r\n", "٣", "Ⅷ", "aaaaaaaaaaaa", "​",
]
ODD = ["", " ", "\n", "x\n\n\ny", "a" * 3000, "ab" * 2000 + "!" * 900, " lead", "trail ", "\n\nlead", "tab\tand \t two"]
CLASH = ("id", "ids", "n_tokens", "uid", "length")


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def want(path, texts):
    return [e.ids for e in LIB[path].encode_batch([t or "" for t in texts], add_special_tokens=False)]


def mixed(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("make,path", [(bpe.speculating, BYTE), (vocab.merging, BYTE), (vocab.merging, WORD)])
def test_encoders_equal_the_library(make, path):
    texts = mixed() + ODD
    flat, lens = make(path).batch(texts)
    ends = np.cumsum(lens)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, lens)] == want(path, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text_encodes_as_the_library_does(texts):
    for make, path in ((bpe.speculating, BYTE), (vocab.merging, WORD)):
        flat, lens = make(path).batch(texts)
        ends = np.cumsum(lens)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, lens)] == want(path, texts)
    assert counts.counting(BYTE).counts(texts).tolist() == [len(x) for x in want(BYTE, texts)]


def test_cache_keeps_working_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(vocab, "CACHE", 40)
    monkeypatch.setattr(vocab, "KEEP", 10)
    encoder = vocab.Encoder(vocab.load(BYTE), vocab.load(BYTE).merge)
    for texts in (mixed(60), ["one two three"] * 3, mixed(60)):
        flat, lens = encoder.batch(texts)
        assert flat.tolist() == [i for ids in want(BYTE, texts) for i in ids]


def test_cache_is_bounded_by_its_chunks_and_their_characters(monkeypatch):
    """A worker's memory: 160,000 short chunks, then long ones."""
    encoder = vocab.Encoder(vocab.load(BYTE), vocab.load(BYTE).merge)
    for k in range(8):
        encoder.batch([" ".join(f"{k}x{i}" for i in range(20_000))])
        assert len(encoder.pieces) <= 140_000
    monkeypatch.setattr(vocab, "CHARS", 20_000)
    rng = random.Random(6)
    for _ in range(8):
        texts = ["".join(rng.choices("abcdefgh", k=300)) for _ in range(50)]
        flat, lens = encoder.batch(texts)
        assert sum(map(len, encoder.pieces)) <= 35_000
    assert flat.tolist() == [i for ids in want(BYTE, texts) for i in ids]
    assert len(encoder.start) == len(encoder.len) == len(encoder.pieces)


def test_token_files_meet_a_chunk_once(monkeypatch):
    """Chunks that come again are merged once while they are within the token files' cache."""
    monkeypatch.setattr(vocab, "CACHE", 400)
    monkeypatch.setattr(vocab, "KEEP", 300)
    merged, known = [], vocab.load(WORD)
    encoder = vocab.Encoder(known, lambda words: merged.extend(words) or known.merge(words), tokenfile.CHUNKS)
    texts = [" ".join(f"w{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) for k in range(4)]
    for _ in range(3):
        for text in texts:
            flat, _ = encoder.batch([text])
            assert flat.tolist() == want(WORD, [text])[0]
    assert len(merged) == 800


def test_chunks_split_at_once_are_those_split_one_by_one():
    rng, encoder = random.Random(8), vocab.merging(WORD)
    some = ["a", "B", "É", "ß", "µ", "ª", "²", "½", "1", "23", "'s", "'", "Ω", "İ", "中", "!", "?!", "-", "ÿ", "\xad"]
    fresh = ["".join(rng.choices(some, k=rng.randint(1, 9))) for _ in range(3000)]
    for chunks in (fresh, fresh[:1], ["Ω"], ["'s"], ["É23x"]):
        words, taken = encoder._split_end(chunks)
        assert taken.tolist() == [len(encoder._words_end(c)) for c in chunks]
        assert words == [w for c in chunks for w in encoder._words_end(c)]


def test_speculation_is_refuted_and_repaired():
    spec = bpe.Speculator(vocab.load(BYTE))
    words = [w.encode() for w in (" thandering", " onatlyre", " xyzzyqu", "aaaaaaa", " eanreoust")]
    ids, lens = spec.encode(words)
    right, n = spec.vocab.merge(words)
    assert ids.tolist() == right.tolist() and lens.tolist() == n.tolist()


def test_whole_tokens_are_proved():
    v = vocab.load(BYTE)
    whole = counts.prove_whole(v)
    some = sorted(whole)[::500]
    assert all(len(v.merge([w])[0]) == 1 for w in some) and len(whole) > 40_000


def test_encode_decode_with_nulls_ties_and_clashing_columns(spark, documents):
    rows = [(1, None), (1, "same"), (1, "same"), (None, "no id <|endoftext|> é"), (2, ""), (3, "x" * 100_000)]
    df = documents(rows, CLASH)
    got = bpe.encode(df, BYTE).collect()
    ids = {t: i for t, i in zip([t for _, t in rows], want(BYTE, [t for _, t in rows]))}
    assert Counter((r.id, bytes(r.ids), r.decoded, r.n_tokens) for r in got) == Counter((d, u4(ids[t]), t or "", len(ids[t])) for d, t in rows)
    again = bpe.decode(bpe.encode(df, BYTE), BYTE).collect()
    assert Counter((r.id, r.decoded) for r in again) == Counter((d, t or "") for d, t in rows)
    assert bpe.encode(documents([]), BYTE).count() == 0
    counted = counts.token_counts(df, BYTE, limit=3).collect()
    assert Counter(map(tuple, counted)) == Counter((d, len((t or "").encode()), len(ids[t]), len(ids[t]) > 3) for d, t in rows)
    assert counts.token_counts(documents([]), BYTE).count() == 0


def test_queries_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    ids = dict(zip([d.doc_id for d in docs], want(BYTE, [d.text for d in docs])))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op1_bpe"](spark, sf).collect()}
    decoded = {d: LIB[BYTE].decode(i, skip_special_tokens=False) for d, i in ids.items()}
    assert got == {d: (len(i), hashlib.sha256(u4(i)).hexdigest(), hashlib.sha256(decoded[d].encode()).hexdigest()) for d, i in ids.items()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    assert got == {d: len(i) for d, i in ids.items()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_token_files"](spark, sf).collect()}
    at, right = 0, {}
    for d, i in zip(docs, want(WORD, [d.text for d in docs])):
        right[d.doc_id] = (at, len(i) + 1, zlib.crc32(u4(i + [1])))
        at += len(i) + 1
    assert got == right
    check_packing(QUERIES["op7_packing"](spark, sf).collect(), {d: i + [0] for d, i in ids.items()}, 2048)


def check_packing(rows, bodies, capacity):
    bins, per = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(per) == set(bodies)
    for d, body in bodies.items():
        at = 0
        for i, (piece, start, length, crc) in enumerate(sorted(per[d])):
            assert (piece, start, crc) == (i, at, zlib.crc32(u4(body[start : start + length])))
            assert length == capacity or i == 0
            at += length
        assert at == len(body)
    total = sum(map(len, bodies.values()))
    assert len(bins) <= 1.02 * -(-total // capacity) + 1
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
    runs, bins = packing.plan(Counter(lengths), capacity)
    filled, seen = defaultdict(list), Counter()
    for length, low, high, each, first, at in runs:
        for rank in range(low, high):
            seen[length, rank] += 1
            filled[first + (rank - low) // each].append((at + (rank - low) % each * length, length))
    assert all(n == 1 for n in seen.values()) and len(seen) == len(lengths)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    assert bins == len(filled) == len(rooms)


def test_packing_with_repeated_rows_nulls_and_an_empty_table(spark, documents):
    from pyspark.sql import functions as F

    rows = [(1, "same words"), (1, "same words"), (None, None), (2, ""), (3, "very long " * 3000)]
    cut = packing.pieces(documents(rows, CLASH), BYTE, 512).withColumn("crc", F.crc32("ids")).drop("ids")
    out = packing.pack(cut, 512).collect()
    assert sum(r.length for r in out) == sum(len(i) + 1 for i in want(BYTE, [t for _, t in rows]))
    places = Counter((r.sequence_id, r.offset) for r in out)
    assert max(places.values()) == 1
    empty = packing.pieces(documents([]), BYTE).withColumn("crc", F.crc32("ids")).drop("ids")
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 4097, 300_000])
def test_blocks_decode_whole_and_from_checkpoints(n, monkeypatch):
    monkeypatch.setattr(tokenfile, "STRIDE", 16)
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
    coder = tokenfile.Coder(tokenfile.scaled(np.bincount(ids, minlength=5000)))
    block = coder.encode(ids)
    assert coder.decode(block).tolist() == ids.tolist()
    marks = -(-n // (16 * tokenfile.LANES))
    assert [i for k in range(marks) for i in coder.decode(block, k, k + 1).tolist()] == ids.tolist()
    if n:
        damaged = bytearray(block)
        damaged[-3] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(damaged))


def test_frequencies_fill_the_table():
    for counts_ in (np.zeros(100, int), np.array([10**9, 1, 0, 0]), np.arange(49_408)):
        freq = tokenfile.scaled(np.asarray(counts_))
        assert freq.sum() == 1 << tokenfile.SCALE and freq.min() >= 1


def test_token_files_with_ties_nulls_and_an_empty_table(spark, documents):
    rows = [(5, "b"), (5, "b"), (None, "null id"), (-3, None), (2**40, "long " * 50_000)]
    got = tokenfile.round_trip(documents(rows, CLASH), WORD, 49_408).orderBy("start").collect()
    assert [r.id for r in got] == [None, -3, 5, 5, 2**40]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    text = {None: "null id", -3: "", 5: "b", 2**40: "long " * 50_000}
    assert all(bytes(r.ids) == u4(want(WORD, [text[r.id]])[0] + [1]) for r in got)
    assert tokenfile.round_trip(documents([]), WORD, 49_408).count() == 0
