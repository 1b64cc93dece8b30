"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

Tokens are the lower-cased words, by 62 bits of their hash, and for a word that repeats the one
before its place in the run. The model is counted on all trusted documents, together with one
model per fold that leaves the fold out.

Trigrams uvw are dealt by their middle word into parts, where their counts, those of vw and of
the contexts uv and v are at hand. A first sweep, over trusted texts, counts them and sends out
what words need: in how many bigrams they end. A second one deals the trigrams of all documents,
counts those of trusted ones again and adds up log p. That is a sum: log p(w) and what the
contexts v and uv and the known vw and uvw add; log p(w) is looked up in parts dealt by words.
Frequent middle words are split by u, so their bigrams are counted across parts, and what those
add is looked up like log p(w). Frequent contexts uv are split by w, and their sums are counted
across parts. What repeats in a document, a trigram in a row or a word, is sent once with its
number. Sweeps go in rounds of some parts, as the trigrams of all would
take several times the input's disk. A document is kept if it does not exceed its language's
quantile of the trusted documents' perplexities, each under the model without its fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import claim, drop, land, sized, text_batches, tidied, with_uid

SIZE = 1 << 20  # words over which what the lowest order leaves over is spread
LONG = 64  # bytes of a word that are hashed along with others'
START, REPEAT, RUN = 0, 1, 8  # tokens 1 to 8: a word that repeats the one before, by its place in the run
BLOCK_DOCS, BLOCK_CHARS = 8192, 4_000_000  # a posting has 13 bits for its document
ROUNDS, ROUND_CHARS = 6, 4_000_000  # rounds of a sweep over all documents, fewer if a round would have less text
PART_CHARS, PARTS = 8_000_000, 16  # about the text in a part, and the fewest parts in a round
SHOWN = 16  # one of so many documents tells which words are frequent; only the balance of parts depends on it
FINE = 4  # pieces of a part's share that what is split has about
SHARE, LEAST = 1 << 15, 4  # the least share of a block, and number in it, that is told
QUANTILE, MARGIN, PRIOR, FOLDS = 0.99, 1.0, 0, 3
MODELS = range(FOLDS + 1)  # the model of all trusted documents, then those without a fold
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token(word: str) -> int:
    """A word's token, whatever its case: 62 bits of its hash, above START and the repeats."""
    return int(tokens([word])[0][0])


# The white space of str.split; in UTF-8 some takes two or three bytes, by these first ones.
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in SPACES if c.isascii()]] = 1
KIND[[c.encode()[0] for c in SPACES if not c.isascii()]] = 2
WIDE = {n: np.array([int.from_bytes(c.encode(), "little") for c in SPACES if len(c.encode()) == n], np.uint64) for n in (2, 3)}


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the last; of ``data`` less its last eight."""
    return np.ndarray(len(data) - 8, "<u8", data, strides=(1,))


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as bytes with eight zeros after them, where words start in them, the
    words' bytes, and their number per text."""
    raw = [t.lower().encode() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    data = np.frombuffer(b"\n".join([*raw, bytes(8)]), np.uint8)
    kind = KIND[data]
    marks = np.flatnonzero(kind > 0)
    wide = marks[kind[marks] == 2]
    if len(wide):
        marks = marks[kind[marks] == 1]
        for n, known in WIDE.items():
            hit = wide[np.isin(_eight(data)[wide] & np.uint64((1 << 8 * n) - 1), known)]
            if len(hit):
                marks = np.concatenate([marks, *[hit + k for k in range(n)]])
        marks.sort()
    start = np.append(0, marks[:-1] + 1)[: len(marks)]
    size = marks - start
    some = np.flatnonzero(size)
    start, size = start[some], size[some]
    return data, start, size, np.diff(np.searchsorted(start, ends), prepend=0)


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of words, hashed eight bytes at a time."""
    eight, out = _eight(data), size.astype(np.uint64)
    short = np.minimum(size, 8)
    out = _mixed(out, eight[start] << ((8 - short) << 3).view(np.uint64))
    some = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        if not len(some):
            break
        unused = np.maximum(k + 8 - size[some], 0) << 3
        out[some] = _mixed(out[some], eight[start[some] + k] << unused.view(np.uint64))
        some = some[size[some] > k + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return RUN + 1 + (out >> np.uint64(2)).view(np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts end to end, and their number per text."""
    data, start, size, n = _cut(texts)
    flat = _hashed(data, start, size)
    again = np.flatnonzero(flat[1:] == flat[:-1]) + 1
    again = again[~np.isin(again, (np.cumsum(n) - n)[n > 0])]
    if len(again):
        cut = _runs(again - np.arange(len(again)))
        run = np.arange(len(again)) - np.repeat(cut, _lengths(cut, len(again))) + 1
        flat[again] = REPEAT + np.minimum(run, RUN) - 1
    return flat, n


def trigrams(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two tokens before and the token, one triple per word."""
    first = (np.cumsum(n) - n)[n > 0]
    v = np.append(START, flat[:-1])[: len(flat)]
    v[first] = START
    u = np.append(START, v[:-1])[: len(flat)]
    u[first] = START
    return u, v, flat


def keys(*parts: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams; their length takes part."""
    x = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        x = _mixed(x, p.view(np.uint64))
    return x


def _mixed(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    x = x * M1
    x += more
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(uids, codes, tokens, their number per text) of blocks of bounded size, from (uid, text, code)."""
    uids, codes, flats, lens, held = [], [], [], [], 0
    for batch, texts in text_batches(batches, "text"):
        for lo in range(0, len(texts), BLOCK_DOCS):
            some = texts[lo : lo + BLOCK_DOCS]
            if uids and (len(uids) + len(some) > BLOCK_DOCS or held > BLOCK_CHARS):
                yield uids, np.array(codes, np.int64), np.concatenate(flats), np.concatenate(lens)
                uids, codes, flats, lens, held = [], [], [], [], 0
            flat, n = tokens(some)
            uids += batch.column(0).to_pylist()[lo : lo + BLOCK_DOCS]
            codes += batch.column(2).to_pylist()[lo : lo + BLOCK_DOCS]
            flats.append(flat), lens.append(n)
            held += sum(map(len, some))
    if uids:
        yield uids, np.array(codes, np.int64), np.concatenate(flats), np.concatenate(lens)


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal entries start."""
    if not len(sorted_by[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, (x[1:] != x[:-1] for x in sorted_by))]))


def _lengths(cut: np.ndarray, n: int) -> np.ndarray:
    return np.diff(cut, append=n)


def _squeezed(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal entries, cut where they have more than 255: their first places and lengths."""
    cut = _runs(*by)
    size = _lengths(cut, len(by[0]))
    if len(cut) and size.max() > 255:
        pieces = (size + 254) // 255
        cut = np.repeat(cut, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = _lengths(cut, len(by[0]))
    return cut, size.astype(np.uint8)


@dataclass
class Plan:
    """What all tasks know: the number of parts, the frequent words and contexts (by their keys)
    with their splits, and once they are counted the discounts and what is left of all sums of
    frequent words and contexts."""

    parts: int
    words: np.ndarray
    splits: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    shares: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    d1: list = field(default_factory=list)
    d2: list = field(default_factory=list)
    d3: list = field(default_factory=list)
    base: list = field(default_factory=list)
    t2: np.ndarray | None = None
    k2: np.ndarray | None = None
    t3: np.ndarray = field(default_factory=lambda: np.empty((len(MODELS), 0)))
    k3: np.ndarray = field(default_factory=lambda: np.empty((len(MODELS), 0)))

    def frequent(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the frequent words, and whether the word is one."""
        return _find(self.words, v)

    def crowded(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the frequent contexts, and whether the context is one; ``u`` as parts know it."""
        return _find(self.pairs, keys(u, v))

    def keys(self, u: np.ndarray, v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """Sorted by these, trigrams are sorted by part and have equal middle words together."""
        at, hit = self.frequent(v)
        sub = np.zeros(len(v), np.uint64)
        some = np.flatnonzero(hit)
        if len(some):
            sub[some] = keys(u[some]) % self.splits[at[some]].astype(np.uint64)
            if len(self.pairs):
                at, hit = self.crowded(u[some] & SEEN, v[some])
                some, at = some[hit], at[hit]
                sub[some] = keys(u[some], w[some]) % self.shares[at].astype(np.uint64)
        return keys(v, sub)

    def part(self, key: np.ndarray) -> np.ndarray:
        return _scaled(key, self.parts)

    def flat(self, key: np.ndarray) -> np.ndarray:
        """Parts of words and of frequent words' bigrams come after those of trigrams."""
        return self.parts + _scaled(key, self.parts // 2)


def _scaled(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _place(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """``np.searchsorted`` in distinct hashes: from the first with the same upper bits on."""
    known, asked, bits = known.view(np.uint64), asked.view(np.uint64), len(known).bit_length() + 1
    shift = np.uint64(max(0, int(known[-1]).bit_length() - bits) if len(known) else 0)
    first = np.append(0, np.cumsum(np.bincount((known >> shift).view(np.int64), minlength=1 << bits)))
    at = first[np.minimum(asked >> shift, np.uint64(1 << bits)).view(np.int64)]
    known = np.append(known, np.uint64((1 << 64) - 1))
    todo = np.flatnonzero(known[at] < asked)
    while len(todo):
        at[todo] += 1
        todo = todo[known[at[todo]] < asked[todo]]
    return at


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``known``, and whether they hold what was asked."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(_place(known, asked), len(known) - 1)
    return at, known[at] == asked


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Middle words and contexts with a noticeable share of a block (size 1 and 2), and the number
    of all trigrams (size 0)."""
    claim("kneser")
    for _, _, flat, n in _blocks(batches):
        gram = trigrams(flat, n)
        first, _ = _squeezed(*gram, np.repeat(np.arange(len(n)), n))
        u, v = gram[0][first], gram[1][first]
        word, n1 = np.unique(v, return_counts=True)
        pair, n2 = np.unique(keys(u & SEEN, v), return_counts=True)
        least = max(LEAST, len(v) / SHARE)
        found = [(np.zeros(1, np.int64), np.array([len(v)]))] + [(x[n >= least].view(np.int64), n[n >= least]) for x, n in ((word, n1), (pair, n2))]
        size = np.repeat(np.arange(3), [len(x) for x, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array(size), *[pa.array(np.concatenate(x)) for x in zip(*found)]], names=["size", "x", "n"])


def planned(marked: DataFrame, parts: int) -> Plan:
    """Words that take more than half of a part's share are split finely, and so are contexts of theirs."""
    shown = marked.where(F.pmod(F.xxhash64("uid"), F.lit(SHOWN)) == 0).mapInArrow(_shown, "size long, x long, n long")
    sums = shown.groupBy("size", "x").agg(F.sum("n").alias("n"))
    total = sums.where("size = 0").first()
    limit = max(1.0, (total.n if total else 0) / parts)
    often = F.when(F.col("size") == 1, F.col("n") > limit / 2).when(F.col("size") == 2, F.col("n") > limit / FINE)
    rows = [(r["size"], r.x, math.ceil(FINE * r.n / limit)) for r in sums.where(often).collect()]
    words, pairs = (np.array(sorted(r[1:] for r in rows if r[0] == size), np.int64).reshape(-1, 2).T for size in (1, 2))
    order = np.argsort(pairs[0].view(np.uint64))
    return Plan(parts, words[0], words[1], pairs[0].view(np.uint64)[order], pairs[1][order])


MESSAGE = "part long, block long, u binary, v binary, w binary, docs binary, n binary, times binary"
KINDS = pa.schema([("part", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("u", "v", "w", "docs", "n", "times")]])
HEAD = -1
SLICE = 150_000  # about the trigrams of a part that are judged at once
NEAR = 6  # bytes by which the neighbours of a part's middle words are known
SEEN = (1 << 8 * NEAR) - 1


def _planes(a: np.ndarray) -> bytes:
    """Bytes of the entries, plane by plane, as those of small numbers compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _near(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), 8)[:, :NEAR].T.tobytes()


def _neighbours(raws: list[memoryview]) -> np.ndarray:
    ends = np.cumsum([len(r) // NEAR for r in raws])
    out = np.zeros((ends[-1], 8), np.uint8)
    for raw, lo, hi in zip(raws, [0, *ends], ends):
        out[lo:hi, :NEAR] = np.frombuffer(raw, np.uint8).reshape(NEAR, -1).T
    return out.view("<i8").reshape(-1)


def _times(times: np.ndarray) -> bytes:
    """How often each entry counts; nothing if each counts once."""
    return times.tobytes() if (times > 1).any() else b""


def _often(raw: list[memoryview], docs: list[memoryview]) -> np.ndarray:
    return np.concatenate([np.frombuffer(t, np.uint8) if len(t) else np.ones(len(d) // 2, np.uint8) for t, d in zip(raw, docs)])


def _entries(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _message(part: int, block: int, u: bytes, v: bytes, w: bytes, docs: bytes, n: bytes, times: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, block, u, v, w, docs, n, times), KINDS)], schema=KINDS)


def _slices(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal parts."""
    cut = _runs(part)
    for a, n in zip(cut.tolist(), _lengths(cut, len(part)).tolist()):
        yield int(part[a]), slice(a, a + n)


def _sorted(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """``some`` places, by the upper bits of their keys and then by place: at least by the 32 bits that tell a part."""
    low = np.uint64((1 << len(key).bit_length()) - 1)
    return (np.sort(key[some] & ~low | some.view(np.uint64)) & low).view(np.int64)


def _grouped(v: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal entries: entries and lengths."""
    cut = _runs(v)
    return _planes(v[cut]), _planes(_lengths(cut, len(v)).astype("<u4"))


def _counts(plan: Plan, rounds: int, now: int) -> Callable:
    """Distinct trigrams of blocks of trusted documents, with their number per fold, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("kneser")
        for _, codes, flat, n in _blocks(batches):
            gram, fold = trigrams(flat, n), np.repeat(codes - 1, n)
            place = plan.keys(*gram)
            mine = np.flatnonzero(plan.part(place) % rounds == now)
            if not len(mine):
                continue
            key = keys(*[g[mine] for g in gram])
            order = np.argsort(key)
            cut, order = _runs(key[order]), mine[order]
            count, first = np.stack([np.add.reduceat((fold[order] == k).astype("<u4"), cut).astype("<u4") for k in range(FOLDS)], 1), order[cut]
            order = _sorted(place[first], np.arange(len(first)))
            first, count = first[order], count[order]
            (u, v, w), place = [g[first] for g in gram], place[first]
            for part, s in _slices(plan.part(place)):
                value, run = _grouped(v[s])
                yield _message(part, 0, _planes(u[s]), value, _planes(w[s]), run, _planes(np.ascontiguousarray(count[s]).reshape(-1)))

    return run


def _models(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct trigrams by their keys, and their counts per model, from numbers per fold."""
    key = keys(u, v, w)
    order = np.argsort(key)
    cut = _runs(key[order])
    first = order[cut]
    folds = np.stack([np.add.reduceat(n[order, k], cut) for k in range(FOLDS)]) if len(cut) else np.zeros((FOLDS, 0), np.int64)
    every = folds.sum(0)
    return key[first], u[first], v[first], w[first], np.concatenate([[every], every - folds])


def _ends(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each first is, and how many entries have a count, per model."""
    known, first, place = np.unique(key, return_index=True, return_inverse=True)
    return known, first, np.stack([np.bincount(place[c > 0], minlength=len(known)) for c in counts])


COUNTED = "kind int, part long, v long, w long, " + ", ".join(f"c{m} long" for m in MODELS)
WORD, BIGRAM, PAIR, TOTALS = 1, 2, 3, 10  # kinds of rows; TOTALS + 2 and + 3 are counts of counts


def _rows(kind: int, part: int, v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> pa.Table:
    names = ["kind", "part", "v", "w", *[f"c{m}" for m in MODELS]]
    return pa.table([pa.array(np.full(len(w), kind, np.int32)), pa.array(np.full(len(w), part, np.int64)), pa.array(v), pa.array(w), *[pa.array(c.astype(np.int64)) for c in counts]], names=names)


def _totals(order: int, counts: np.ndarray) -> pa.Table:
    """How many counts are 1 to 4, and under 0 their sum."""
    rows = np.stack([counts.sum(1), *[(counts == k).sum(1) for k in (1, 2, 3, 4)]], 1)
    return _rows(TOTALS + order, 0, np.zeros(5, np.int64), np.arange(5), rows)


def _crowds(plan: Plan, part: int, u: np.ndarray, v: np.ndarray, a: np.ndarray) -> pa.Table:
    """Per frequent context, under 0 the sum of its trigrams' counts, under 1 to 3 how many are 1, 2 and more."""
    at, hit = plan.crowded(u & SEEN, v)
    known, place = np.unique(at[hit], return_inverse=True)
    a = a[:, hit]
    sums = np.array([[np.bincount(place, x, len(known)) for x in (c, c == 1, c == 2, c > 2)] for c in a]).reshape(len(a), -1)
    return _rows(PAIR, part, np.tile(known, 4), np.repeat(np.arange(4), len(known)), sums)


def _counted(plan: Plan) -> Callable:
    """Of one part of the trusted trigrams: counts of counts, the bigrams that end in a word, the
    bigrams of frequent words, and the sums of frequent contexts."""

    def run(table: pa.Table) -> pa.Table:
        claim("kneser")
        rows = table.to_pylist()
        u, w = (np.concatenate([_entries(r[c], "<i8") for r in rows]) for c in "uw")
        v = np.concatenate([np.repeat(_entries(r["v"], "<i8"), _entries(r["docs"], "<u4")) for r in rows])
        n = np.concatenate([_entries(r["n"], "<u4").reshape(-1, FOLDS).astype(np.int64) for r in rows])
        _, u, v, w, a = _models(u, v, w, n)
        crowds = _crowds(plan, rows[0]["part"], u, v, a)
        _, first, b = _ends(keys(v, w), a)
        v, w = v[first], w[first]
        _, split = plan.frequent(v)
        word, first, e = _ends(w, np.where(split, 0, b))
        out = [_totals(3, a), _totals(2, b[:, ~split]), _rows(WORD, rows[0]["part"], np.zeros(len(word), np.int64), word, e), _rows(BIGRAM, rows[0]["part"], v[split], w[split], b[:, split]), crowds]
        return pa.concat_tables(out)

    return run


def _named(name: str) -> list[Column]:
    return [F.col(f"{name}{m}") for m in MODELS]


def _spread(df: DataFrame, kind: int, name: str) -> DataFrame:
    """The rows of ``_totals`` for a table of counts."""
    sums = [x for m, c in zip(MODELS, _named(name)) for x in (F.sum(c).alias(f"s{m}_0"), *[F.count(F.when(c == k, 1)).alias(f"s{m}_{k}") for k in (1, 2, 3, 4)])]
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("w"), *[F.coalesce(f"s{m}_{k}", F.lit(0)).alias(f"c{m}") for m in MODELS]) for k in range(5)]))
    return df.agg(*sums).select(each.alias("x")).select(F.lit(kind).alias("kind"), "x.*")


def _discounts(totals: dict[int, list[int]]) -> list[tuple[float, float, float, float]]:
    """Per model the modified Kneser-Ney discounts for counts 1, 2 and more, and the sum of all counts."""
    out = []
    for m in MODELS:
        total, n1, n2, n3, n4 = (float(totals[k][m]) if k in totals else 0.0 for k in range(5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        one = 1 - 2 * y * n2 / n1 if n1 else 0.5
        two = 2 - 3 * y * n3 / n2 if n2 else one
        more = 3 - 4 * y * n4 / n3 if n3 else two
        out.append((min(max(one, 0.1), 0.95), min(max(two, 0.1), 1.9), min(max(more, 0.1), 2.9), total))
    return out


def _kept(n: Column, d: tuple[float, ...]) -> Column:
    """What the discount takes from a count and leaves to the lower order."""
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _left(n: np.ndarray, d: list[tuple[float, ...]]) -> np.ndarray:
    """``_kept`` for all models."""
    return np.stack([np.array([0.0, *x[:3]])[np.minimum(c, 3).astype(np.int64)] for c, x in zip(n, d)])


def _placed(plan: Plan, rounds: int, kind: int) -> Callable:
    """Counts of words or of frequent words' bigrams, with the part that looks them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "vw")
            part = plan.flat(keys(w) if kind == WORD else keys(v, w))
            new = {"round": pa.array(part % rounds), "part": pa.array(part), "kind": pa.array(np.full(len(w), kind, np.int32))}
            yield pa.RecordBatch.from_arrays([*new.values(), *batch.columns], names=[*new, *batch.schema.names])

    return run


SIDE = ["round", "part", "kind", "v", "w", *[f"c{m}" for m in MODELS], *[f"e{m}" for m in MODELS]]


def counted(trusted: DataFrame, plan: Plan, rounds: int, sweeps: int) -> DataFrame:
    """(round, part, kind, v, w, c0, ..., e0, ...), landed by round: the counts c of frequent
    words' bigrams vw and e of bigrams that end in w, for the parts that need them. Fills in what
    the plan lacks."""
    landed = [land(trusted.mapInArrow(_counts(plan, sweeps, now), MESSAGE).groupBy("part").applyInArrow(_counted(plan), COUNTED)) for now in range(sweeps)]
    rows = reduce(DataFrame.unionAll, landed)
    c2 = land(rows.where(F.col("kind") == BIGRAM).groupBy("v", "w").agg(*[F.sum(c).alias(f"c{m}") for m, c in zip(MODELS, _named("c"))]))
    words = rows.where(F.col("kind") == WORD).select("w", *[c.alias(f"e{m}") for m, c in zip(MODELS, _named("c"))])
    words = words.unionAll(c2.select("w", *[(c > 0).cast("long").alias(f"e{m}") for m, c in zip(MODELS, _named("c"))]))
    c1 = land(words.groupBy("w").agg(*[F.sum(c).alias(f"e{m}") for m, c in zip(MODELS, _named("e"))]))

    totals = rows.where(F.col("kind") >= TOTALS).select("kind", "w", *_named("c")).unionAll(_spread(c2, TOTALS + 2, "c")).unionAll(_spread(c1, TOTALS + 1, "e"))
    sums = {(r[0], r[1]): r[2:] for r in totals.groupBy("kind", "w").agg(*map(F.sum, _named("c"))).collect()}
    plan.d1, plan.d2, plan.d3 = (_discounts({k: sums[i, k] for i, k in sums if i == TOTALS + order}) for order in (1, 2, 3))
    left = c1.agg(*[F.coalesce(F.sum(_kept(c, d)), F.lit(0.0)) for c, d in zip(_named("e"), plan.d1)]).first()
    plan.base = [(x / d[3] if d[3] else 1.0) / SIZE for x, d in zip(left, plan.d1)]
    plan.t2, plan.k2 = np.zeros((len(MODELS), len(plan.words))), np.zeros((len(MODELS), len(plan.words)))
    for row in c2.groupBy("v").agg(*map(F.sum, _named("c")), *[F.sum(_kept(c, d)) for c, d in zip(_named("c"), plan.d2)]).collect():
        at = np.searchsorted(plan.words, row[0])
        plan.t2[:, at], plan.k2[:, at] = row[1 : 1 + len(MODELS)], row[1 + len(MODELS) :]
    plan.t3, plan.k3 = np.zeros((len(MODELS), len(plan.pairs))), np.zeros((len(MODELS), len(plan.pairs)))
    for at, size, *n in rows.where(F.col("kind") == PAIR).groupBy("v", "w").agg(*map(F.sum, _named("c"))).collect():
        if size:
            plan.k3[:, at] += [x * d[size - 1] for x, d in zip(n, plan.d3)]
        else:
            plan.t3[:, at] = n

    def placed(df: DataFrame, kind: int) -> DataFrame:
        return df.mapInArrow(_placed(plan, rounds, kind), "round long, part long, kind int, " + ", ".join(f"{c} long" for c in df.columns)).select(*SIDE)

    asked = rows.where(F.col("kind").isin(WORD, BIGRAM)).select((F.col("part") % rounds).alias("round"), "part", "kind", "v", "w")
    none = [F.lit(0).cast("long").alias(f"c{m}") for m in MODELS]
    side = [
        asked.where(F.col("kind") == WORD).join(c1, "w").select(*SIDE[:5], *none, *_named("e")),
        asked.where(F.col("kind") == BIGRAM).join(c2, ["v", "w"]).select(*SIDE[:5], *_named("c"), *[F.lit(0).cast("long").alias(f"e{m}") for m in MODELS]),
        placed(c1.select(F.lit(0).cast("long").alias("v"), "w", *none, *_named("e")), WORD),
        placed(c2.join(c1, "w").select("v", "w", *_named("c"), *_named("e")), BIGRAM),
    ]
    out = land(reduce(DataFrame.unionAll, side), "round")
    for df in (*landed, c1, c2):
        drop(df)
    return out


def _postings(plan: Plan, rounds: int, now: int) -> Callable:
    """Per part and block: trigrams with their document and its code in the upper bits; words and
    frequent words' bigrams by their keys; and a row of the block's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("kneser")
        task = TaskContext.get().partitionId()
        for made, (uids, codes, flat, n) in enumerate(_blocks(batches)):
            block = task << 32 | made
            yield _message(HEAD - block % plan.parts, block, np.array(uids, "<i8").tobytes(), codes.astype("<u2").tobytes(), n.astype("<u4").tobytes(), b"", b"")
            gram, doc = trigrams(flat, n), np.repeat((codes << 13 | np.arange(len(n))).astype("<u2"), n)
            first, times = _squeezed(*gram, doc)
            key = plan.keys(*(gram if len(first) == len(flat) else [g[first] for g in gram]))
            order = _sorted(key, np.flatnonzero(plan.part(key) % rounds == now))
            part, times, order = plan.part(key[order]), times[order], first[order]
            u, v, w, docs = (x[order] for x in (*gram, doc))
            for part, s in _slices(part):
                value, run = _grouped(v[s])
                yield _message(part, block, _near(u[s]), value, _near(w[s]), _planes(docs[s]), run, _times(times[s]))
            key, split = keys(flat), np.flatnonzero(plan.frequent(gram[1])[1])
            key, doc = np.concatenate([key, keys(gram[1][split], flat[split])]), np.concatenate([doc, doc[split]])
            mine = np.flatnonzero(plan.flat(key) % rounds == now)
            order = _sorted(key, mine)
            first, times = _squeezed(key[order], doc[order])
            key, docs = key[order[first]], doc[order[first]]
            for part, s in _slices(plan.flat(key)):
                value, run = _grouped(key[s])
                yield _message(part, block, b"", value, b"", _planes(docs[s]), run, _times(times[s]))

    return run


def _lower(plan: Plan, e: np.ndarray) -> np.ndarray:
    """p(w) per model."""
    return (e - _left(e, plan.d1)) / np.array([[max(d[3], 1.0)] for d in plan.d1]) + np.array(plan.base)[:, None]


def _weights(counts: np.ndarray, left: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per context and model the total and what the discounts leave to the lower order."""
    return tuple(np.stack([np.bincount(place, x, n) for x in y]) for y in (counts, left))


def _shared(t: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.where(t > 0, k / np.maximum(t, 1.0), 1.0)


def _above(n: np.ndarray, left: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What a known n-gram's own count gives."""
    return np.where(t > 0, (n - left) / np.maximum(t, 1.0), 0.0)


Side = dict[str, np.ndarray]
Told = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _side(table: pa.Table) -> Side:
    got = {c: table.column(c).to_numpy() for c in ("kind", "v", "w")}
    return got | {x: np.stack([table.column(f"{x}{m}").to_numpy() for m in MODELS]) for x in "ce"}


def _told(plan: Plan, side: Side) -> Told:
    """Sorted words, as they are known in parts, with p(w), and sorted keys of frequent words' bigrams with their counts."""
    w = side["w"] & SEEN
    ours = np.flatnonzero(side["kind"] == WORD)
    ours = ours[np.argsort(w[ours])]
    both = np.flatnonzero(side["kind"] == BIGRAM)
    key = keys(side["v"][both], w[both])
    order = np.argsort(key)
    return w[ours], _lower(plan, side["e"][:, ours]), key[order], side["c"][:, both[order]]


def _known_words(plan: Plan, side: Side) -> tuple[np.ndarray, np.ndarray]:
    """What known words, and known bigrams of frequent words, add to log p, by sorted keys."""
    word = side["kind"] == WORD
    base = np.log(plan.base)[:, None]
    p = _lower(plan, side["e"])
    at, split = plan.frequent(side["v"])
    logs = np.log(p) - base
    some = np.flatnonzero(~word & split)
    if len(some):
        t, k, b = plan.t2[:, at[some]], plan.k2[:, at[some]], side["c"][:, some]
        low = _shared(t, k) * p[:, some]
        logs[:, some] = np.log((_above(b, _left(b, plan.d2), t) + low) / low)
    key = np.where(word, keys(side["w"]), keys(side["v"], side["w"]))
    order = np.argsort(key)
    return key[order], logs[:, order]


def _known(plan: Plan, told: Told, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each known context v, bigram vw, context uv and trigram uvw of a part adds to log p,
    by sorted keys. The bigrams of frequent words add nothing here, and the words themselves always do."""
    key3, u, v, w, a = _models(u, v, w, n)
    key2, first, b = _ends(keys(v, w), a)
    place2 = _place(key2, keys(v, w))
    v2, w2 = v[first], w[first]
    at, split = plan.frequent(v2)
    words, lower, both, counts = told
    if split.any():
        b[:, split] = counts[:, _place(both, key2[split])]
    p = lower[:, _place(words, w2)]
    left = _left(b, plan.d2)
    known_v, place = np.unique(v2, return_inverse=True)
    t, k = _weights(b, left, place, len(known_v))
    t, k = t[:, place], k[:, place]
    t[:, split], k[:, split] = plan.t2[:, at[split]], plan.k2[:, at[split]]
    g = _shared(t, k)
    q = _above(b, left, t) + g * p
    bigrams = np.where(split, 0.0, np.log(q / (g * p)))
    contexts = np.zeros((len(MODELS), len(known_v)))
    contexts[:, place] = np.log(g)
    words, logs = np.concatenate([plan.words, known_v]), np.concatenate([np.log(_shared(plan.t2, plan.k2)), contexts], 1)
    known_v, first = np.unique(words, return_index=True)

    left = _left(a, plan.d3)
    known_x, place = np.unique(keys(u, v), return_inverse=True)
    t, k = _weights(a, left, place, len(known_x))
    at, hit = _find(plan.pairs, known_x)
    t[:, hit], k[:, hit] = plan.t3[:, at[hit]], plan.k3[:, at[hit]]
    g = _shared(t, k)
    low = g[:, place] * q[:, place2]
    grams = np.log((_above(a, left, t[:, place]) + low) / low)
    pairs, logs3 = np.concatenate([plan.pairs, known_x]), np.concatenate([np.log(_shared(plan.t3, plan.k3)), np.log(g)], 1)
    known_x, first3 = np.unique(pairs, return_index=True)
    return [(known_v, logs[:, first]), (key2, bigrams), (known_x, logs3[:, first3]), (key3, grams)]


SUMS = "block long, part long, docs binary, s binary, f binary"


def _views(table: pa.Table, column: str) -> list[memoryview]:
    """Binary entries without copies."""
    out = []
    for chunk in table.column(column).chunks:
        _, ends, raw = chunk.buffers()
        ends = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        raw = memoryview(raw or b"")
        out += [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]
    return out


def _sums(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "part", "docs", "s", "f"])


def _summed(block: int, part: int, docs: np.ndarray, times: np.ndarray, s: np.ndarray, f: np.ndarray) -> tuple:
    doc, s, f = docs & 8191, s * times, f * times
    n = int(doc.max()) + 1
    seen = np.flatnonzero(np.bincount(doc, minlength=n))
    return block, part, seen.astype("<u2").tobytes(), np.bincount(doc, s, n)[seen].tobytes(), np.bincount(doc, f, n)[seen].tobytes()


def _judged(plan: Plan, told: Told, u: np.ndarray, v: np.ndarray, w: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts and known n-grams add to log p of trigrams of a part: all of a middle word, if
    that is frequent all of a context, if that is frequent all that are equal. Under the model of all trusted documents, and for trusted
    documents under the one without their fold."""
    good = np.flatnonzero(code > 0)
    words, bigrams, contexts, grams = _known(plan, told, u[good], v[good], w[good], (code[good, None] == 1 + np.arange(FOLDS)) * times[good, None].astype(np.int64))
    s, f = np.zeros(len(u)), np.zeros(len(u))

    def add(known: tuple[np.ndarray, np.ndarray], asked: np.ndarray, where: np.ndarray) -> np.ndarray:
        at, hit = _find(known[0], asked)
        where, at = where[hit], at[hit]
        s[where] += known[1][0, at]
        some = np.flatnonzero(code[where] > 0)
        f[where[some]] += known[1][code[where[some]], at[some]]
        return where

    seen = add(words, v, np.arange(len(u)))
    both = np.zeros(len(u), np.int8)
    both[add(bigrams, keys(v[seen], w[seen]), seen)] += 1
    both[add(contexts, keys(u[seen], v[seen]), seen)] += 1
    some = np.flatnonzero(both == 2)
    add(grams, keys(u[some], v[some], w[some]), some)
    return s, f


def _scored(plan: Plan) -> Callable:
    """Sums of log-probabilities per document, of one part: under the model of all trusted
    documents, and for trusted documents under the one without their fold."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        claim("kneser")
        if not table.num_rows:
            return _sums([])
        part = table.column("part")[0].as_py()
        if part < 0:
            return _sums([(r["block"], HEAD, r["u"], r["v"], r["w"]) for r in table.to_pylist()])
        names, raw, side = table.column("block").to_pylist(), {c: _views(table, c) for c in ("u", "v", "w", "docs", "n", "times")}, _side(told)
        often = _often(raw["times"], raw["docs"])
        if part >= plan.parts:
            out, (known, logs) = [], _known_words(plan, side)
            every, hits = _find(known, np.concatenate([_entries(x, "<u8") for x in raw["v"]]))
            ends = np.cumsum([len(x) // 8 for x in raw["v"]])
            rest = np.split(often, np.cumsum([len(x) // 2 for x in raw["docs"]])[:-1])
            for block, lo, hi, doc, n, times in zip(names, [0, *ends], ends, raw["docs"], raw["n"], rest):
                docs, runs = _entries(doc, "<u2").astype(np.int64), _entries(n, "<u4")
                at, hit, code = np.repeat(every[lo:hi], runs), np.repeat(hits[lo:hi], runs), docs >> 13
                some = np.flatnonzero(hit)
                if len(some):
                    at, docs, code = at[some], docs[some], code[some]
                    out.append(_summed(block, part, docs, times[some], logs[0, at], np.where(code > 0, logs[code, at], 0.0)))
            return _sums(out)
        u, w = _neighbours(raw["u"]), _neighbours(raw["w"])
        value, runs = (np.concatenate([_entries(x, t) for x in raw[c]]) for c, t in (("v", "<i8"), ("n", "<u4")))
        docs = np.concatenate([_entries(x, "<u2") for x in raw["docs"]])
        v, code, known = np.repeat(value, runs), (docs >> 13).astype(np.int8), _told(plan, side)
        slices = math.ceil(len(u) / SLICE)
        mine = np.repeat((keys(value) % np.uint64(slices)).astype(np.int32), runs)
        split = np.flatnonzero(np.repeat(plan.frequent(value)[1], runs))
        mine[split] = keys(u[split]) % np.uint64(slices)
        split = split[plan.crowded(u[split], v[split])[1]]
        mine[split] = keys(u[split], w[split]) % np.uint64(slices)
        s, f = np.zeros(len(u)), np.zeros(len(u))
        for k in range(slices):
            some = np.flatnonzero(mine == k)
            s[some], f[some] = _judged(plan, known, u[some], v[some], w[some], code[some], often[some])
        ends = np.cumsum([len(x) // 2 for x in raw["docs"]])
        return _sums([_summed(block, part, docs[lo:hi], often[lo:hi], s[lo:hi], f[lo:hi]) for block, lo, hi in zip(names, [0, *ends], ends)])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums of a block's documents over the parts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    uid, code, n = (np.frombuffer(rows[0][c], t) for c, t in (("docs", "<i8"), ("s", "<u2"), ("f", "<u4")))
    sums = np.zeros((2, len(uid)))
    for row in rows[1:]:
        docs = np.frombuffer(row["docs"], "<u2")
        sums[0, docs] += np.frombuffer(row["s"])
        sums[1, docs] += np.frombuffer(row["f"])
    return pa.table({"uid": uid, "code": code.astype(np.int64), "n_words": n.astype(np.int64), "s": sums[0], "f": sums[1]})


def scores(marked: DataFrame) -> DataFrame:
    """(uid, code, n_words, logp, held_out), landed, of (uid, text, code): code 0 for documents
    that are not trusted, 1 + fold for those that are. ``held_out`` is under the model without
    the document's fold, null for those that are not trusted."""
    with tidied(marked.sparkSession):
        chars = F.length("text")
        every, trusted = marked.agg(F.coalesce(F.sum(chars), F.lit(0)), F.coalesce(F.sum(F.when(F.col("code") > 0, chars)), F.lit(0))).first()
        rounds = min(ROUNDS, max(1, every // ROUND_CHARS))
        plan = planned(marked, rounds * max(PARTS, 2 * math.ceil(every / PART_CHARS / rounds / 2)))
        side = counted(marked.where("code > 0"), plan, rounds, max(1, math.ceil(rounds * trusted / max(1, every))))
        done = []
        for now in range(rounds):
            sent = marked.mapInArrow(_postings(plan, rounds, now), MESSAGE)
            told = side.where(F.col("round") == now).drop("round")
            sums = sent.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_scored(plan), SUMS)
            done.append(land(sums.groupBy("block").applyInArrow(_added, "uid long, code long, n_words long, s double, f double")))
        drop(side)
        every = reduce(DataFrame.unionAll, [df.withColumn("round", F.lit(now)) for now, df in enumerate(done)])
        in_order = {c: reduce(Column.__add__, [F.max(F.when(F.col("round") == now, F.col(c))) for now in range(rounds)]).alias(c) for c in "sf"}
        docs = every.groupBy("uid").agg(F.max("code").alias("code"), F.max("n_words").alias("n_words"), *in_order.values())
        base = [math.log(b) for b in plan.base]
        unknown = F.element_at(F.array(*map(F.lit, base)), (F.col("code") + 1).cast("int"))
        out = land(docs.select("uid", "code", "n_words", (F.col("s") + F.col("n_words") * base[0]).alias("logp"), F.when(F.col("code") > 0, F.col("f") + F.col("n_words") * unknown).alias("held_out")))
        for df in done:
            drop(df)
    return out


def quality(df: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, uid, n_words, perplexity, cut, kept) per row of ``df``.

    ``trusted``: one column ``id``, the documents whose text trains the model; all of them
    count. The perplexity takes in ``PRIOR`` words of the trusted documents' mean. A document is
    kept if its perplexity is at most ``margin`` times its language's ``quantile`` over the
    trusted documents, each judged by a model counted on the other folds. A language without
    trusted documents (null
    counts as one) takes the quantile over all of them; without any, all documents with
    words are kept. Null and empty texts have no perplexity and are not kept. Repeated rows
    are rows of their own and ids that trust names several times count once; an empty table
    gives no rows; other columns are left out, whatever their names.
    """
    rows = with_uid(df, id_col, text_col, {"lang": F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))})
    good = sized(land(trusted.select(F.col("id").alias("id")).where("id is not null").distinct().withColumn("good", F.lit(1).cast("long"))))
    code = F.when(F.col("good") == 1, 1 + F.pmod(F.xxhash64("uid"), F.lit(FOLDS))).otherwise(0).cast("long")
    docs = scores(rows.join(good, "id", "left").select("uid", "text", code.alias("code")))
    out = land(rows.select("id", "uid", "lang").join(docs, "uid"))
    mean = out.where("code > 0").agg(F.sum("logp") / F.nullif(F.sum("n_words"), F.lit(0))).first()[0]

    def perplexity(logp: str) -> Column:
        return F.when(F.col("n_words") > 0, F.exp(-(F.col(logp) + PRIOR * (mean or 0.0)) / (F.col("n_words") + PRIOR)))

    high = F.percentile_approx(perplexity("held_out"), F.lit(quantile), F.lit(100_000))
    every = out.where("code > 0").agg(high).first()[0]
    cuts = out.where("code > 0").groupBy("lang").agg((high * margin).alias("cut"))
    out = out.withColumn("perplexity", perplexity("logp")).join(sized(cuts), "lang", "left").withColumn("cut", F.coalesce("cut", F.lit(None if every is None else every * margin).cast("double")))
    kept = F.coalesce(F.col("perplexity") <= F.coalesce("cut", F.lit(float("inf"))), F.lit(False))
    return out.select("id", "uid", "n_words", "perplexity", "cut", kept.alias("kept"))
