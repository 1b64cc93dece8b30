"""MinHash near-duplicates by chosen paths: a set-similarity join over random branching trees.

Every document's set of word shingles has a signature of minwise tokens. A tree branches
documents by one minwise token a level, so two sets of Jaccard similarity J stay together
with probability J a level. Nodes of at most ``NODE`` members compare all their members;
larger ones compare every member with the node's leaders and branch on. Nodes that are still
large at the last level are solved exactly, in pairs of bounded blocks of members. Independent
trees repeat this: pairs at the threshold that part at level l are missed with probability
(1 - J**l)**TREES. Members are compared by sketches, one bit of each of ``BITS`` further
minwise tokens; candidates whose sketches agree enough are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cached, claim, cuts, drop, land, packed_texts, sized, text_batches, with_uid
from barline.llm.graph import components
from barline.llm.vocab import spread

TREES, LEVELS, TOKENS, BITS = 12, 5, 64, 512
DEVIATIONS = 4
SCOUTS = 3
NODE = 32
LARGE = 100_000  # most large nodes (300 bytes each) that are broadcast
MEMBERS, SHINGLES, BYTES = 1024, 1 << 19, 4 << 20  # about the most documents, shingles and bytes of a block of a large node
WORDS = 200_000
_rng = np.random.default_rng(20)
FLIP = _rng.integers(0, 1 << 32, TOKENS + BITS, dtype=np.uint32)
SCALE = _rng.integers(0, 1 << 31, TOKENS + BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * M1
    x += b
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_words = Words()
cached("minhash", _words.clear)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    A-Z are lower-cased; words are runs of other characters than ASCII white space. Fewer
    words than ``size`` are one shingle; no words give an empty set.
    """
    if len(_words) > WORDS:
        _words.clear()
    split = [t.encode().lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((h for words in split for h in map(_words.__getitem__, words)), np.uint64, int(n.sum()))
    starts = np.cumsum(n) - n
    h = flat
    for k in range(1, size):
        h = _mix(h[: max(0, len(flat) - k)], flat[k:])
    out = []
    for a, m in zip(starts.tolist(), n.tolist()):
        if m >= size:
            out.append(np.unique(h[a : a + m - size + 1]))
        else:
            short = np.full(min(m, 1), m, np.uint64)
            for k in range(m):
                short = _mix(short, flat[a + k : a + k + 1])
            out.append(short)
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens, and one bit of each of the others, packed."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(TOKENS + BITS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        low = np.minimum(low, ((x[i : i + 256, None] ^ FLIP) * SCALE).min(0))
    return low[:TOKENS], np.packbits(low[TOKENS:] >> np.uint32(12) & np.uint32(1))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch, texts in text_batches(batches, "text"):
            sets = shingle_sets(texts, size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signs = [tuple(x.tobytes() for x in signature(s)) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *[pa.array([s[i] for s in signs], pa.binary()) for i in (0, 1)]], names=["uid", "n", "key", "sign", "short"])

    return run


def _paths(sign: np.ndarray, tree: int) -> list[np.ndarray]:
    """The tree's nodes of each signature, one a level."""
    at, out = np.full(len(sign), tree + 1, np.uint64), []
    for level in range(LEVELS):
        at = _mix(at, sign[:, (tree * LEVELS + level) % TOKENS].astype(np.uint64))
        out.append(at)
    return out


def _signs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(-1, TOKENS)


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign, rep = _signs(batch), batch.column("rep").to_numpy()
            for tree in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(rep), tree, np.int32)), pa.array(_paths(sign, tree)[0].view(np.int64))], names=["rep", "tree", "p0"])

    return run


PATHS = ", ".join(f"p{i} long" for i in range(LEVELS))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the trees whose root node has company: all levels' nodes and short tokens."""
    names = ["rep", "comp", "n", "short", *[f"p{i}" for i in range(LEVELS)]]
    for batch in batches:
        sign, rep, comp, n = _signs(batch), *(batch.column(c).to_numpy() for c in ("rep", "comp", "n"))
        short = batch.column("short")
        trees = batch.column("trees").to_pylist()
        for tree in range(TREES):
            at = np.array([i for i, t in enumerate(trees) if tree in t], np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(comp[at]), pa.array(n[at]), short.take(pa.array(at)), *[pa.array(p[at].view(np.int64)) for p in _paths(sign, tree)]], names=names)


def _least(percent: int) -> float:
    """Bits that agree in sketches of sets at the threshold, less ``DEVIATIONS`` deviations: a
    token in common gives an equal bit, another one does so half the time."""
    p = (1 + percent / 100) / 2
    return BITS * (p - DEVIATIONS * np.sqrt(p * (1 - p) / BITS))


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that agree in rows of packed sketches."""
    return BITS - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _close(percent: int, shared: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Sketches agree enough for the threshold, and sizes allow it."""
    return (shared >= _least(percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _words_of(column: pa.Array) -> np.ndarray:
    """Packed sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _members(column: pa.Array) -> tuple[np.ndarray, ...]:
    return *(column.field(c).to_numpy() for c in ("rep", "comp", "n")), _words_of(column.field("short"))


def _forest(i: np.ndarray, j: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """Positions of the closest pairs that connect what all pairs connect."""
    up, keep = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in np.argsort(-shared, kind="stable").tolist():
        x, y = top(int(i[k])), top(int(j[k]))
        if x != y:
            up[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _compare(percent: int, thin: bool):
    """Pairs inside small nodes, of different components so far: ``members`` holds at most
    NODE of them. ``thin``: only pairs that connect what all of the node's pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            members = batch.column("members")
            every = _members(members.flatten())
            ends = cuts(members.value_lengths().to_pylist())
            for x, y in zip(ends, ends[1:]):
                rep, comp, n, short = (c[x:y] for c in every)
                i, j = np.triu_indices(y - x, 1)
                shared = _agree(short[i], short[j])
                ok = np.flatnonzero(_close(percent, shared, n[i], n[j]) & (comp[i] != comp[j]))
                if thin and len(ok) > 1:
                    ok = ok[_forest(i[ok], j[ok], shared[ok], y - x)]
                a.append(np.minimum(rep[i], rep[j])[ok]), b.append(np.maximum(rep[i], rep[j])[ok]), s.append(shared[ok])
            yield _pairs(a, b, s)

    return run


def _against(percent: int):
    """Members of large nodes against the node's leaders, of different components so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, comp, n = (batch.column(c).to_numpy() for c in ("rep", "comp", "n"))
            short, a, b, s = _words_of(batch.column("short")), [], [], []
            for lead in ("lead", "other"):
                r, c, m, other = _members(batch.column(lead))
                shared = _agree(short, other)
                ok = _close(percent, shared, n, m) & (comp != c)
                a.append(np.minimum(rep, r)[ok]), b.append(np.maximum(rep, r)[ok]), s.append(shared[ok])
            yield _pairs(a, b, s)

    return run


def _pairs(a: list, b: list, s: list) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (a, b, s))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "shared"])


def _meet(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of large nodes beside the node's leaders, but for rows that are of both leaders'
    component: they have no pair there."""
    leaders = sized(nodes.where("lo < hi").select(F.col("p").alias("node"), "lead", "other"), LARGE)
    apart = (F.col("comp") != F.col("lead.comp")) | (F.col("comp") != F.col("other.comp"))
    return rows.join(leaders, (F.col("p") == F.col("node")) & apart).select("rep", "comp", "n", "short", "lead", "other")


def _nodes(rows: DataFrame, percent: int, thin: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, shared) from the nodes ``p`` of ``rows`` (rep, comp, n, short, p, ...), the
    rows of nodes that are too large to compare all members, and the table of these nodes.
    Large nodes of a single component have no pair that is still looked for, nor have the
    nodes below; their rows are left.

    Few nodes are large: they are found by an aggregate, and their rows meet them by broadcast
    while they are few enough, so that no task gets all rows of a node. Rows go down by a semi
    join, and only those that have a leader of another component meet their leaders."""
    member, mark = F.struct("rep", "comp", "n", "short"), F.xxhash64("rep", "p")
    nodes = rows.groupBy("p").agg(F.count("*").alias("c"), F.min_by(member, mark).alias("lead"), F.max_by(member, mark).alias("other"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    nodes = land(nodes.where(F.col("c") > NODE))
    small = rows.join(sized(nodes.select("p"), LARGE), "p", "left_anti").groupBy("p").agg(F.collect_list(member).alias("members"))
    large = rows.join(sized(nodes.where("lo < hi").select("p"), LARGE), "p", "left_semi")
    pair = "a long, b long, shared long"
    inside = small.where(F.size("members") > 1).select("members").mapInArrow(_compare(percent, thin), pair)
    across = _meet(rows, nodes).mapInArrow(_against(percent), pair)
    return land(inside.union(across)), large, nodes


def candidates(classes: DataFrame, percent: int, trees: int, thin: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b, shared) of the first ``trees`` trees, and the members (p, rep, comp, n) of nodes
    ``p`` that stay large at the last level; ``classes``: landed (rep, comp, n, sign, short).

    The trees' roots come first. Only rows of roots that are too large go further down, to
    all of their lower nodes at once; a node repeats pairs of the node above it, never others.
    Pairs of one component ``comp`` are left out, and so are large nodes of one component.
    """
    roots = land(classes.select("rep", "sign").mapInArrow(_roots(trees), "rep long, tree int, p0 long"))
    company = roots.groupBy("p0").agg(F.count("*").alias("c")).where("c > 1").select("p0")
    kept = roots.join(company, "p0", "left_semi").groupBy("rep").agg(F.collect_list("tree").alias("trees"))
    rows = land(classes.join(kept, "rep").mapInArrow(_branches, f"rep long, comp long, n long, short binary, {PATHS}"))
    first, large, roots_ = _nodes(rows.withColumnRenamed("p0", "p"), percent, thin)
    below = F.explode(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(k == LEVELS - 1).alias("last")) for k in range(1, LEVELS)]))
    lower = land(large.select("rep", "comp", "n", "short", below.alias("at")).select("rep", "comp", "n", "short", "at.p", "at.last"))
    second, large, nodes = _nodes(lower, percent, thin)
    last = large.where(F.col("last")).select("p", "rep", "comp", "n")
    last = land(last.where("false") if thin else last)
    out = land(first.union(second).distinct())
    for df in (roots, rows, lower, first, second, roots_, nodes):
        drop(df)
    return out, last


def _shares(one: list[np.ndarray], two: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``one``: its number of common members with every set of ``two``."""
    each = np.fromiter(map(len, two), np.int64, len(two))
    flat = np.concatenate(two)
    values, at = np.unique(flat, return_inverse=True)
    starts = np.cumsum(each) - each
    has = np.zeros(len(values), np.int32)
    for i, s in enumerate(one):
        place = np.minimum(np.searchsorted(values, s), len(values) - 1)
        place = place[values[place] == s]
        has[place] = 1
        yield i, np.add.reduceat(has[at], starts)
        has[place] = 0


def _solve(size: int, percent: int):
    """Links between two blocks of a node's members (or inside one), of different components
    so far, on full sets: only those that connect what all links connect."""

    def run(table: pa.Table) -> pa.Table:
        claim("minhash")
        tool = zstandard.ZstdDecompressor()
        rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "comp", "block"))
        sets = shingle_sets([tool.decompress(b).decode() for b in table.column("blob").to_pylist()], size)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if len(np.unique(comp[left])) > len(np.unique(comp[right])):
            left, right = right, left
        a, b, s = [], [], []
        for c in np.unique(comp[left]).tolist():
            x, y = left[comp[left] == c], right[comp[right] != c]
            if not len(x) or not len(y):
                continue
            if len(x) > len(y):
                x, y = y, x
            for i, both in _shares([sets[k] for k in x.tolist()], [sets[k] for k in y.tolist()]):
                union = n[x[i]] + n[y] - both
                ok = np.flatnonzero(100 * both >= percent * union)
                a.append(np.full(len(ok), x[i])), b.append(y[ok]), s.append(both[ok] / union[ok])
        a, b = (np.concatenate(z).astype(np.int64) if z else np.empty(0, np.int64) for z in (a, b))
        if len(a):
            keep = _forest(a, b, np.concatenate(s), len(rep))
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.minimum(rep[a], rep[b]), pa.int64()), "b": pa.array(np.maximum(rep[a], rep[b]), pa.int64())})

    return run


def solved(members: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) inside large nodes, landed; ``members``: landed (p, rep, comp, n). Every
    pair of blocks of a node is a group of its own, so no task holds a node."""
    own = rows.join(members.select(F.col("rep").alias("uid")).distinct(), "uid", "left_semi")
    texts = land(packed_texts(own).select(F.col("uid").alias("rep"), "blob"))
    lengths = own.select(F.col("uid").alias("rep"), F.octet_length("text").alias("bytes"))
    blocks = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / SHINGLES), F.ceil(F.sum("bytes") / BYTES))
    nodes = members.join(lengths, "rep").groupBy("p").agg(blocks.alias("blocks"))
    here = members.join(nodes, "p").withColumn("block", F.expr("pmod(xxhash64(rep, p), blocks)"))
    here = here.join(texts, "rep").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    here = here.select("p", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "comp", "blob")
    out = land(here.groupBy("p", "i", "j").applyInArrow(_solve(size, percent), "a long, b long").distinct())
    drop(texts)
    return out


def _confirm(size: int, percent: int):
    """Pairs whose full sets reach the threshold; sets met lately are kept for the next pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        tool, lately = zstandard.ZstdDecompressor(), OrderedDict()

        def of(uid: int, blob: bytes) -> np.ndarray:
            if uid not in lately:
                lately[uid] = shingle_sets([tool.decompress(blob).decode()], size)[0]
                if len(lately) > 64:
                    lately.popitem(last=False)
            return lately[uid]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                s, t = of(a, x), of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, landed."""
    ends = land(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct())
    texts = land(packed_texts(rows.join(sized(ends), "uid", "left_semi")).select("uid", "blob"))
    one, two = texts.select(F.col("uid").alias("a"), F.col("blob").alias("x")), texts.select(F.col("uid").alias("b"), F.col("blob").alias("y"))
    out = land(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(_confirm(size, percent), "a long, b long"))
    drop(texts)
    return out


def near_documents(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, uid, n_shingles, component_id, first) per row: components of sets with Jaccard
    >= percent / 100; ``first`` marks the row of smallest uid in each.

    Equal sets are one class; links are found between classes and confirmed on full sets of
    64-bit shingle hashes. ``SCOUTS`` trees come first: each class is confirmed with its
    closest candidate there. All trees follow; every candidate pair that is not yet connected
    is confirmed, and all pairs of the nodes that stay large are, so the result is that of
    confirming all candidates. ``component_id`` is the
    smallest id that links reach. Null and empty texts, and texts without words, have no
    shingles and are alone. Repeated rows and equal or null ids are rows of their own; an
    empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = with_uid(df, id_col, text_col)
    signs = land(rows.select("uid", "text").mapInArrow(_sign(size), "uid long, n long, key binary, sign binary, short binary"))
    classes = land(signs.where("n > 0").groupBy("key", "n").agg(F.min("uid").alias("rep"), F.first("sign").alias("sign"), F.first("short").alias("short")))
    plain = classes.select("rep", F.col("rep").alias("comp"), "n", "sign", "short")
    scouted, _ = candidates(plain, percent, SCOUTS, True)
    both = scouted.union(scouted.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    best = land(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sure = confirmed(best, rows, size, percent)
    comp = land(components(sure))
    known = classes.join(comp, F.col("rep") == comp["node"], "left").select("rep", F.coalesce("component", "rep").alias("comp"), "n", "sign", "short")
    pairs, last = candidates(known, percent, TREES, False)
    pairs = pairs.join(best, ["a", "b"], "left_anti")
    comp = components(sure.union(confirmed(pairs, rows, size, percent)).union(solved(last, rows, size, percent)))
    named = classes.select("key", "n", "rep").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("first"))
    out = land(signs.select("uid", "n", "key").join(named, ["key", "n"], "left").select("uid", "n", F.coalesce("first", "uid").alias("first")))
    for old in (signs, classes, scouted, best):
        drop(old)
    ids = rows.select("uid", "id")
    out = out.join(ids, "uid").join(ids.select(F.col("uid").alias("first"), F.col("id").alias("component_id")), "first")
    return out.select("id", "uid", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("first")).alias("first"))
