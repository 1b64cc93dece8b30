"""Merkle manifest of a dataset, with a proof for every row, by octopus multiproofs.

Rows are leaves; those of a group, in id order, form a tree, and the groups' roots, in group
order, form one more. All rows are put in one order and cut into chunks of ``CHUNK`` leaves,
whatever the groups: a large group lies in many chunks, many small ones in one.

A chunk builds every node that it covers whole and hands on only the topmost of them; the few
nodes above are built level by level. For the proofs a chunk lists the smallest set of nodes
that it can't derive (a few at its two ends), fetches each once, derives the nodes that its
leaves share, and writes out the proof of each leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import drop, land

FANOUT = 3
CHUNK = 2187
ROWS = 100_000  # most (short) rows of a side that is broadcast
LOW = (1 << 33) - 1
TOP = -1  # the tree of the groups' roots


def field(value: Column) -> Column:
    """``-`` if null, else UTF-8 byte count, colon, value: no two rows share a text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(leaf: str, proof: str, sides: bytes) -> str:
    """The root that ``leaf`` and its siblings give. A byte of ``sides`` is a level: 16 times the
    number of siblings to the left, plus that to the right."""
    at = 0
    for b in sides:
        left, right = 64 * (b >> 4), 64 * (b & 15)
        leaf = _hash(proof[at : at + left] + leaf + proof[at + left : at + left + right])
        at += left + right
    return leaf


def climb(lo: int, hi: int, n: int, nodes: list[str], fanout: int = FANOUT) -> Iterator[tuple[int, int, int, list[str], int, int]]:
    """(level, first place, nodes of the level, nodes known, from, to) upwards from the leaves
    [lo, hi) of a tree of n: the nodes that these cover whole. Places outside [from, to) have a
    parent that isn't covered."""
    level = 0
    while nodes:
        if n == 1:
            yield level, lo, n, nodes, 1, 0
            return
        a, b = -(-lo // fanout), hi // fanout if hi < n else -(-hi // fanout)
        yield level, lo, n, nodes, a * fanout, b * fanout
        nodes = [_hash("".join(nodes[max(0, p * fanout - lo) : (p + 1) * fanout - lo])) for p in range(a, b)]
        lo, hi, n, level = a, b, -(-n // fanout), level + 1


def missing(lo: int, hi: int, n: int, fanout: int = FANOUT) -> Iterator[tuple[int, int]]:
    """(level, place) of the fewest nodes that lead from the leaves [lo, hi) to the root."""
    level = 0
    while n > 1:
        a, b = lo // fanout, -(-hi // fanout)
        yield from ((level, i) for i in range(a * fanout, lo))
        yield from ((level, i) for i in range(hi, min(b * fanout, n)))
        lo, hi, n, level = a, b, -(-n // fanout), level + 1


def placed(df: DataFrame, *by: str) -> DataFrame:
    """``df``, landed in order of ``by``, with ``place`` (from 0) and ``part``, its part of the
    order. Only one count a partition reaches the driver."""
    spark = df.sparkSession
    rows = land(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int")
    before, starts = 0, []
    for p, n in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    rows = rows.withColumn("part", part).join(starts, "part")
    return rows.withColumn("place", F.col("before") + F.col("at").bitwiseAND(LOW)).drop("at", "before")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= ROWS else df


NODE = "tree long, level int, idx long, n long, hash binary"


def _tops(table: pa.Table) -> pa.Table:
    """The topmost nodes that a chunk covers whole, of every tree in it."""
    table = table.sort_by("place")
    tree, idx, n = (table.column(c).to_pylist() for c in ("tree", "idx", "n"))
    leaf = [x.hex() for x in table.column("leaf").to_pylist()]
    out = []
    for a, z in _runs(tree):
        for level, lo, size, nodes, inner, outer in climb(idx[a], idx[z - 1] + 1, n[a], leaf[a:z]):
            out += [(tree[a], level, i, size, bytes.fromhex(h)) for i, h in enumerate(nodes, lo) if not inner <= i < outer]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "level", "idx", "n", "hash"])


def _runs(values: list) -> Iterator[tuple[int, int]]:
    a = 0
    for z in range(1, len(values) + 1):
        if z == len(values) or values[z] != values[a]:
            yield a, z
            a = z


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes above those of ``level``; all children of a parent are there, FANOUT at most."""
    children = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    text = F.array_join(F.transform(children, lambda x: F.lower(F.hex(x["hash"]))), "")
    up = nodes.where((F.col("level") == level) & (F.col("n") > 1)).groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx"), F.ceil(F.col("n") / FANOUT).alias("n"))
    return up.agg(F.unhex(F.sha2(text, 256)).alias("hash")).select("tree", F.lit(level + 1).alias("level"), "idx", "n", "hash")


def _grown(nodes: DataFrame, largest: int) -> DataFrame:
    """``nodes`` with all that they are children of; the largest tree has ``largest`` leaves."""
    level, every = 0, nodes
    while largest > 1:
        every = every.union(land(_parents(every, level)))
        largest, level = -(-largest // FANOUT), level + 1
    return every


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(c, t, level, i) for c, t, lo, hi, n in zip(*(batch.column(k).to_pylist() for k in ("chunk", "tree", "lo", "hi", "n"))) for level, i in missing(lo, hi, n)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["chunk", "tree", "level", "idx"])


def _paths(lo: int, nodes: list[str], n: int, got: dict, tree: int) -> tuple[list[tuple[str, bytes]], str]:
    """(proof, sides) of each of the leaves from ``lo`` on, and the tree's root; ``got`` has the
    nodes that were fetched."""
    levels, level, hi = [], 0, lo + len(nodes)
    while n > 1:
        a, b = lo // FANOUT, -(-hi // FANOUT)
        here = [got[tree, level, i] for i in range(a * FANOUT, lo)] + nodes + [got[tree, level, i] for i in range(hi, min(b * FANOUT, n))]
        levels.append((lo, hi, a * FANOUT, here))
        nodes = [_hash("".join(here[i : i + FANOUT])) for i in range(0, len(here), FANOUT)]
        lo, hi, n, level = a, b, -(-n // FANOUT), level + 1
    root, above, low = nodes[0], [("", b"")], 0
    for first, last, start, here in reversed(levels):
        out = []
        for i in range(first, last):
            run, k = (i - start) // FANOUT * FANOUT, (i - start) % FANOUT
            others = here[run : run + FANOUT]
            proof, sides = above[i // FANOUT - low]
            out.append(("".join(others[:k] + others[k + 1 :]) + proof, bytes([16 * k + len(others) - 1 - k]) + sides))
        above, low = out, first
    return above, root


OUT = "subroot string, proof string, sides binary, folded_root string"


def _proofs(groups: int):
    def run(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        got = {(t, level, i): h.hex() for t, level, i, h in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "hash")))}
        tree, idx, n = (rows.column(c).to_pylist() for c in ("tree", "idx", "n"))
        leaf = [x.hex() for x in rows.column("leaf").to_pylist()]
        claim = [None if x is None else x.hex() for x in rows.column("claim").to_pylist()]
        trees = [(a, z, *_paths(idx[a], leaf[a:z], n[a], got, tree[a])) for a, z in _runs(tree)]
        upper, _ = _paths(tree[0], [t[3] for t in trees], groups, got, TOP) if trees else ([], "")
        sub, proof, sides, folded = [], [], [], []
        for (a, z, paths, subroot), (more, turns) in zip(trees, upper):
            for i, (p, s) in enumerate(paths, a):
                sub.append(subroot), proof.append(p + more), sides.append(s + turns)
                folded.append(fold(claim[i] or leaf[i], p + more, s + turns))
        made = [pa.array(leaf, pa.string()), pa.array(sub, pa.string()), pa.array(proof, pa.string()), pa.array(sides, pa.binary()), pa.array(folded, pa.string())]
        return pa.table([rows.column("id").combine_chunks(), *made], names=["id", "leaf", "subroot", "proof", "sides", "folded_root"])

    return run


def manifest(df: DataFrame, columns: Sequence[str], claims: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """(id, leaf, subroot, root, proof, sides, folded_root) per row; digests are lowercase hex.

    A leaf is the SHA-256 of ``columns``. ``proof`` lists the siblings from the leaf to the
    root, left to right, level by level; ``sides`` says where they stand (see ``fold``).
    ``folded_root`` is what the proof gives for the row as claimed: with the expressions
    ``claims`` in place of columns, or as it is.

    Order: groups by UTF-8 bytes, null first; in a group ids ascend, null first, equal ids by
    leaf. Equal rows have equal leaves, so their order doesn't matter. A group of one row has
    its leaf as subroot; a single group its subroot as root. Null and empty values differ. An
    empty table gives no rows; other columns are left out, whatever their names.
    """
    spark, col = df.sparkSession, lambda c: F.col(f"`{c}`")
    claimed = digest([(claims or {}).get(c, col(c)) for c in columns])
    key = F.coalesce(F.concat(F.lit("="), col(group_col).cast("string")), F.lit("-"))
    leaves = df.select(col(id_col).alias("id"), key.alias("key"), F.unhex(digest([col(c) for c in columns])).alias("leaf"), F.unhex(claimed).alias("claim"))
    leaves = land(leaves.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim"))))
    rows = placed(leaves, "key", "id", "leaf")
    runs = land(rows.groupBy("part", "key").agg(F.min("place").alias("lo"), F.count(F.lit(1)).alias("c")))
    groups = placed(runs.groupBy("key").agg(F.min("lo").alias("first"), F.sum("c").alias("n")), "first").withColumnRenamed("place", "tree").drop("part")
    total = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n")).first()
    kind = leaves.schema["id"].dataType.simpleString()
    if not total["groups"]:
        return spark.createDataFrame([], f"id {kind}, leaf string, subroot string, root string, proof string, sides binary, folded_root string")
    where = land(runs.join(_small(groups), "key").select("part", "key", "tree", "first", "n"))
    here = rows.join(_small(where), ["part", "key"]).select("id", "leaf", "claim", "place", "tree", (F.col("place") - F.col("first")).alias("idx"), "n", F.floor(F.col("place") / CHUNK).alias("chunk"))
    here = land(here)
    tops = land(here.select("chunk", "place", "tree", "idx", "n", "leaf").groupBy("chunk").applyInArrow(_tops, NODE))
    nodes = _grown(tops, total["n"])
    roots = nodes.where("n = 1").select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.lit(total["groups"]).cast("long").alias("n"), "hash")
    upper = _grown(land(roots), total["groups"])
    root = upper.where("n = 1").select(F.lower(F.hex("hash")).alias("root")).first()["root"]
    spans = here.groupBy("chunk", "tree").agg(F.min("idx").alias("lo"), (F.max("idx") + 1).alias("hi"), F.max("n").alias("n"))
    over = here.groupBy("chunk").agg(F.lit(TOP).cast("long").alias("tree"), F.min("tree").alias("lo"), (F.max("tree") + 1).alias("hi"), F.lit(total["groups"]).cast("long").alias("n"))
    wanted = spans.union(over).mapInArrow(_wanted, "chunk long, tree long, level int, idx long")
    held = land(nodes.union(upper).select("tree", "level", "idx", "hash"))
    fetched = wanted.join(_small(held), ["tree", "level", "idx"])
    out = here.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(_proofs(total["groups"]), f"id {kind}, leaf string, {OUT}")
    drop(leaves)
    return out.select("id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "sides", "folded_root")
