"""Embedding near-duplicates: dual traversal of cover trees, exact for a cosine threshold.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). Vectors are
dealt to blocks around sampled centres; each block holds a tree of nested levels with
halving radii. Two trees are walked together: a pair of nodes is dropped when their centres
lie farther apart than the threshold plus both covering radii, and counted whole when even
their farthest members lie within it. Only what is left comes down to pairs of vectors.

Blocks are walked in tiles, some blocks against some, so that a block is sent once per tile and
not once per block. Tiles go in rounds of bounded size, and a round's shuffle files go with it.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import drop, land, sized, tidied
from barline.llm.graph import components
from barline.llm.vocab import spread

BLOCK = 4096
CENTRES = 1024
TOP = 0.5
LEVELS = 4
SLACK = 1e-7
TILE = 8  # blocks on a side of a tile
ROUND_TIMES, ROUND_BYTES = 2, 200_000_000  # a round sends all blocks so often, or at least so much


@dataclass
class Tree:
    """Levels of nodes; the last level is the vectors themselves. ``child[l]`` gives, for every
    node of level l, the run of its children at level l + 1 (nodes lie in tree order)."""

    ids: np.ndarray
    weight: np.ndarray
    unit: np.ndarray
    centre: list[np.ndarray]
    radius: list[np.ndarray]
    first: list[np.ndarray]
    last: list[np.ndarray]


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net: each point's centre, an earlier point within ``radius`` or itself."""
    n, owner, centres = len(points), np.empty(len(points), np.int64), np.empty(0, np.int64)
    least = 1 - radius * radius / 2
    for lo in range(0, n, 512):
        part = points[lo : lo + 512]
        own = np.full(len(part), -1, np.int64)
        if len(centres):
            cos = part @ points[centres].T
            best = cos.argmax(1)
            near = cos[np.arange(len(part)), best] >= least
            own[near] = centres[best[near]]
        inner = part @ part.T >= least
        fresh = []
        for i in np.flatnonzero(own < 0):
            if own[i] < 0:
                take = inner[i] & (own < 0)
                own[take] = lo + i
                own[i] = lo + i
                fresh.append(lo + i)
        owner[lo : lo + 512] = own
        centres = np.concatenate([centres, np.array(fresh, np.int64)])
    return owner


def build(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> Tree:
    return _built(ids, weight, unit)[1]


def _built(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, Tree, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The places of the vectors in tree order, the tree, and its levels for ``_tree``."""
    n = len(ids)
    labels, rows = [], np.arange(n)
    groups = [rows]
    for level in range(LEVELS):
        label, nxt = np.empty(n, np.int64), []
        for g in groups:
            if len(g) == 1:
                label[g] = g
                nxt.append(g)
                continue
            owner = g[net(unit[g], TOP / 2**level)]
            label[g] = owner
            order = np.argsort(owner, kind="stable")
            nxt += np.split(g[order], np.flatnonzero(np.diff(owner[order])) + 1)
        labels.append(label)
        groups = nxt
    order = np.concatenate(groups) if n else rows
    unit, ids, weight = unit[order], ids[order], weight[order]
    levels = []
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for label in labels:
        own = place[label[order]]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        mid = own[start]
        size = np.diff(np.append(start, n))
        cos = np.einsum("ij,ij->i", unit, unit[np.repeat(mid, size)])
        far = np.sqrt(np.maximum(0, 2 - 2 * np.minimum.reduceat(cos, start)))
        levels.append((start, mid, np.where(size > 1, far + SLACK, 0.0)))
    return order, _tree(ids, weight, unit, levels), levels


def _tree(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Tree:
    """From where the nodes of each level start, their centres and radii."""
    n = len(ids)
    starts, centre, radius = map(list, zip(*levels, (np.arange(n), np.arange(n), np.zeros(n))))
    first = [np.searchsorted(starts[k + 1], starts[k]) for k in range(LEVELS)]
    last = [np.append(f[1:], len(starts[k + 1])) for k, f in enumerate(first)]
    spans = [(s, np.append(s[1:], n)) for s in starts]
    return Tree(ids, weight, unit, centre, radius, first + [spans], last)


def dual(a: Tree, b: Tree, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight of each vector of ``a`` and ``b``, and edges that connect all linked ones."""
    reach = np.sqrt(2 - 2 * least)
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    cum = [np.concatenate([[0], np.cumsum(t.weight)]) for t in (a, b)]
    da, db = np.zeros(len(a.ids) + 1, np.int64), np.zeros(len(b.ids) + 1, np.int64)
    ex, ey = [], []

    def whole(level: int, i: np.ndarray, j: np.ndarray) -> None:
        """All members of node i link with all of node j: sums by difference arrays."""
        for (s, e), (s2, e2), delta, c in ((np.array(a.first[-1][level])[:, i], np.array(b.first[-1][level])[:, j], da, cum[1]), (np.array(b.first[-1][level])[:, j], np.array(a.first[-1][level])[:, i], db, cum[0])):
            w = c[e2] - c[s2]
            np.add.at(delta, s, w)
            np.add.at(delta, e, -w)
        ex.append(a.centre[level][i]), ey.append(b.centre[level][j])
        for tree, nodes, out, other, at in ((a, i, ex, ey, b.centre[level][j]), (b, j, ey, ex, a.centre[level][i])):
            s, e = np.array(tree.first[-1][level])[:, nodes]
            if len(s) and (e - s).max() > 1:
                key = np.unique(nodes, return_index=True)[1]  # one bridge a node is enough
                size = e[key] - s[key]
                out.append(spread(s[key], size)), other.append(np.repeat(at[key], size))

    def within(level: int, i: np.ndarray) -> None:
        """All members of node i link with each other."""
        s, e = np.array(a.first[-1][level])[:, i]
        np.add.at(da, s, cum[0][e] - cum[0][s])
        np.add.at(da, e, cum[0][s] - cum[0][e])
        member = spread(s, e - s)
        na[member] -= a.weight[member]
        ex.append(member), ey.append(np.repeat(a.centre[level][i], e - s))

    def visit(level: int, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            cos = np.einsum("ij,ij->i", a.unit[a.centre[level][i]], b.unit[b.centre[level][j]])
            if level == LEVELS:
                hit = cos >= least
                i, j = i[hit], j[hit]
                if same:
                    i, j = i[i < j], j[i < j]
                np.add.at(na, i, b.weight[j])
                np.add.at(nb, j, a.weight[i])
                ex.append(i), ey.append(j)
                return
            d = np.sqrt(np.maximum(0, 2 - 2 * cos))
            r = a.radius[level][i] + b.radius[level][j]
            near = d <= reach + r + SLACK
            full = near & (d + r + SLACK <= reach)
            own = full & (i == j) if same else np.zeros(len(i), bool)
            if own.any():
                within(level, i[own])
            if (full & ~own).any():
                whole(level, i[full & ~own], j[full & ~own])
            near &= ~full
            i, j = i[near], j[near]
            ni, nj = a.last[level][i] - a.first[level][i], b.last[level][j] - b.first[level][j]
            size = ni * nj
            if not len(size):
                return
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(nj, size)
            i2, j2 = np.repeat(a.first[level][i], size) + k // width, np.repeat(b.first[level][j], size) + k % width
            level += 1
            if same:
                keep = i2 <= j2
                i2, j2 = i2[keep], j2[keep]
            if len(i2) > 2_000_000:
                for lo in range(0, len(i2), 1_000_000):
                    visit(level, i2[lo : lo + 1_000_000], j2[lo : lo + 1_000_000])
                return
            i, j = i2, j2

    top_a, top_b = a.unit[a.centre[0]].astype(np.float32), b.unit[b.centre[0]].astype(np.float32)
    wide_a, wide_b = (np.flatnonzero(t.radius[0] > 0) for t in (a, b))
    thin_a, thin_b = (np.flatnonzero(t.radius[0] == 0) for t in (a, b))
    # Nodes of one vector have one bound; only nodes with a radius need their own.
    for rows, cols in ((thin_a, thin_b), (thin_a, wide_b), (wide_a, thin_b), (wide_a, wide_b)):
        right, r_right = np.ascontiguousarray(top_b[cols].T), b.radius[0][cols]
        for lo in range(0, len(rows) if len(cols) else 0, 1024):
            part = rows[lo : lo + 1024]
            cos = top_a[part] @ right
            if r_right.any() or a.radius[0][part].any():
                bound = reach + a.radius[0][part, None] + r_right[None] + 1e-3
                hit = cos >= np.where(bound < 2, 1 - bound * bound / 2, -2.0)
            else:
                hit = cos >= np.float32(least - 1e-3)
            at = np.flatnonzero(hit)
            i, j = part[at // len(cols)], cols[at % len(cols)]
            if same:
                i, j = i[i <= j], j[i <= j]
            visit(0, i, j)
    na += np.cumsum(da[:-1])
    nb += np.cumsum(db[:-1])
    x, y = (np.concatenate(v).astype(np.int64) if v else np.empty(0, np.int64) for v in (ex, ey))
    return na, nb, a.ids[x], b.ids[y]


def _thin(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components: every vector's smallest reachable one in this task."""
    nodes, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v, low = back[: len(x)], back[len(x) :], np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, u, low[v])
        np.minimum.at(low, v, low[u])
        low = low[low]
        if (low == before).all():
            keep = low != np.arange(len(nodes))
            return nodes[keep], nodes[low[keep]]


def near_vectors(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id): every vector's links with a cosine of at least ``least``.

    Cosine in double precision over all rows. Vectors that are null, zero, empty or hold
    null or non-finite components link with nothing; so do vectors of different lengths with
    each other. Equal vectors are one weighted point with the smallest id; repeated rows of
    one id are that many points of the same component. Rows with a null id are left out.
    An empty table gives no rows; other columns are left out, whatever their names.
    """
    with tidied(df.sparkSession):
        return _near_vectors(df, least, id_col, vector_col)


def _near_vectors(df: DataFrame, least: float, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    kind = df.select(v).schema[0].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vectors = land(df.select(F.col(f"`{id_col}`").alias("id"), (v if single else v.cast("array<double>")).alias("v")).where("id is not null"))
    wide = F.col("v").cast("array<double>")
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    point = F.when(fine, F.unhex(F.sha2(F.to_binary(F.concat_ws(",", F.transform(wide, lambda x: (x + 0.0).cast("string"))), F.lit("utf-8")), 256)))
    keyed = vectors.withColumn("key", point)
    points = land(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v")))
    classes = keyed.where("key is not null").select("id", "key").join(points.select("key", F.col("id").alias("rep"), "w"), "key").select("id", "rep", "w")
    none = F.lit(None).cast("long")
    classes = land(classes.union(keyed.where("key is null").select("id", none.alias("rep"), none.alias("w"))))
    drop(vectors)
    total = points.count()
    # A sample of fixed size, the smallest hashes, gives the centres: at most CENTRES vectors.
    k = max(1, min(CENTRES, total // BLOCK))
    sample = [r["v"] for r in points.orderBy(F.xxhash64("key")).limit(k).select("v").collect()]
    dims = {len(v) for v in sample}
    centres = {d: np.array([v for v in sample if len(v) == d]) for d in dims}

    def deal(batches):
        for batch in batches:
            rows = batch.column("v").to_pylist()
            node = np.zeros(len(rows), np.int64)
            for d in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == d]
                x = np.array([rows[i] for i in at], np.float64)
                c = centres.get(d)
                node[at] = -d if c is None else (_unit(x) @ _unit(c).T).argmax(1) * 1_000_000 + d
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), batch.column("v"), pa.array(node)], names=["id", "w", "v", "node"])

    dealt = land(points.select("id", "w", "v").mapInArrow(deal, T.StructType(points.select("id", "w", "v").schema.fields + [T.StructField("node", T.LongType())])))
    drop(points)
    sizes = dealt.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.first(F.size("v")).alias("dim"))
    parted = dealt.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = land(parted.groupBy("node", "part", "dim").applyInArrow(_pack, "node long, part long, dim int, size long, tree binary"))
    drop(dealt)
    found = _found(blocks, least)
    comp = components(found.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")))
    linked = found.where("y is null").groupBy("x").agg(F.sum("n").alias("n"))
    out = classes.where("rep is not null").join(linked, F.col("rep") == linked["x"], "left").join(comp, F.col("rep") == comp["node"], "left")
    out = out.select("id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = classes.where("rep is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone)


def _found(blocks: DataFrame, least: float) -> DataFrame:
    """What ``_walk`` finds in all pairs of blocks of one length, landed; ``blocks`` go."""
    each = Window.partitionBy("dim")
    names = blocks.select("node", "part", "dim", F.count("*").over(each).alias("all"), F.row_number().over(each.orderBy("node", "part")).alias("k"))
    side = F.ceil(F.col("all") / F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.col("all") / TILE))))
    names = land(names.withColumn("side", side.cast("int")).select("node", "part", "side", (F.col("k") % F.col("side")).cast("int").alias("at")))
    sizes = blocks.select("node", "part", "size").join(names, ["node", "part"])
    once, sent = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("side")), F.lit(0))).first()
    rounds = max(1, -(-sent // max(ROUND_TIMES * once, ROUND_BYTES)))
    other = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    tiles = names.withColumn("other", other).select("node", "part", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    number = (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("long")
    tiles = land(tiles.withColumn("round", (number % rounds).cast("int")))
    done = []
    for now in range(rounds):
        grid = blocks.join(sized(tiles.where(F.col("round") == now)), ["node", "part"]).select("dim", "i", "j", "at", "node", "part", "tree")
        done.append(land(grid.groupBy("dim", "i", "j").applyInArrow(lambda t: _walk(t, least), "x long, y long, n long")))
    for df in (blocks, names, tiles):
        drop(df)
    return reduce(DataFrame.unionAll, done)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big  # keeps the squares in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _pack(t: pa.Table) -> pa.Table:
    ids, w, raw = t["id"].to_numpy(), t["w"].to_numpy(), np.array(t["v"].to_pylist(), np.float64)
    first = np.argsort(ids)
    ids, w, raw = ids[first], w[first], raw[first]
    order, tree, levels = _built(ids, w, _unit(raw))
    blob = pickle.dumps(_small(tree, raw[order], levels))
    return pa.table({"node": t["node"][:1], "part": t["part"][:1], "dim": t["dim"][:1], "size": [len(blob)], "tree": [blob]})


def _small(tree: Tree, raw: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple:
    """A tree in few bytes: vectors as they came, in single precision if that keeps them; no
    weights of one; no levels of single vectors."""
    with np.errstate(over="ignore"):
        single = raw.astype(np.float32)
    n = len(raw)
    return tree.ids, None if (tree.weight == 1).all() else tree.weight, single if (single == raw).all() else raw, [None if len(start) == n else (start.astype(np.int32), mid.astype(np.int32), radius) for start, mid, radius in levels]


def _large(blob: bytes) -> Tree:
    ids, weight, raw, levels = pickle.loads(blob)
    n = len(ids)
    alone = np.arange(n), np.arange(n), np.zeros(n)
    levels = [alone if x is None else (x[0].astype(np.int64), x[1].astype(np.int64), x[2]) for x in levels]
    return _tree(ids, np.ones(n, np.int64) if weight is None else weight, _unit(raw.astype(np.float64)), levels)


def _walk(t: pa.Table, least: float) -> pa.Table:
    """All pairs of a tile's blocks, each pair once: those of one side with those of the other, or
    all of the only side."""
    i, j, at = t["i"][0].as_py(), t["j"][0].as_py(), t["at"].to_numpy()
    order = np.lexsort([t["part"].to_numpy(), t["node"].to_numpy()])
    trees = {int(k): _large(t["tree"][int(k)].as_py()) for k in order}
    one, two = ([trees[int(k)] for k in order if at[k] == side] for side in (i, j))
    xs, ys, ids, ns = [], [], [], []
    for k, a in enumerate(one):
        for b in two[k:] if i == j else two:
            na, nb, x, y = dual(a, b, least, a is b)
            xs.append(x), ys.append(y), ids.extend((a.ids, b.ids)), ns.extend((na, nb))
    none = np.empty(0, np.int64)
    x, y = _thin(np.concatenate([none, *xs]), np.concatenate([none, *ys]))
    known, place = np.unique(np.concatenate([none, *ids]), return_inverse=True)
    n = np.zeros(len(known), np.int64)
    np.add.at(n, place, np.concatenate([none, *ns]))
    known, n = known[n > 0], n[n > 0]
    return pa.table({"x": np.concatenate([x, known]), "y": pa.concat_arrays([pa.array(y, pa.int64()), pa.nulls(len(known), pa.int64())]), "n": np.concatenate([np.zeros(len(x), np.int64), n])})
