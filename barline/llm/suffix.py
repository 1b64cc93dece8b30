"""Suffix-array dedup of byte strings: longest previous factors of at least ``width`` bytes.

Two suffixes with a common prefix of ``width`` bytes share the k-gram of smallest hash in
that prefix, at the same place. So every window of ``width`` bytes is dealt to the group of
its smallest k-gram (its anchor), and only windows under anchors that occur more than once
go on. In each group the window suffixes are sorted; in that order, runs with a common
prefix of ``width`` or more hold all factors of interest, and the previous and next smaller
positions in a run tell whether a suffix has an earlier or a later match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import claim, drop, land, packed_texts, sized, with_uid
from barline.llm.vocab import spread

GRAM = 32
SEGMENT = 1 << 20
HOT = 20_000
CHUNK = 2 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces from their hashes; not linear, so no structure cancels."""
    x = left * M1
    x += right
    x ^= x >> np.uint64(29)
    x *= M2
    return x


def prefix_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of raw[i : i + length] for every i, by joining hashes of doubled length."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * M3
    out, have, size = None, 0, 1
    while True:
        if length & size:
            n = len(raw) - have - size + 1
            out, have = (h[: max(0, n)] if out is None else _join(out[: max(0, n)], h[have : have + max(0, n)])), have + size
        if have == length:
            return out
        h, size = _join(h[: max(0, len(h) - size)], h[size:]), size * 2


def anchors(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, first window, last window, anchor's hash).

    ``raw``: texts end to end, fewer than 2**24 bytes. Of equal hashes the rightmost is taken.
    """
    grams = width - GRAM + 1
    h = prefix_hashes(raw, GRAM)
    if len(h) < grams:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    place = np.uint64(0xFFFFFF)
    low = (h & ~place) | (place - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size * 2 <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < grams:
        low = np.minimum(low[: len(low) - (grams - size)], low[grams - size :])
    n = np.maximum(0, lens - width + 1)
    at = spread(starts, n)
    who = (place - (low[at] & place)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), n)
    new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.empty(0, np.int64)
    last = np.append(new[1:], len(at)) - 1
    return text[new], (at - starts[text])[new], (at - starts[text])[last] if len(at) else new, h[who[new]]


def matched(windows: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which suffixes have another match: ``windows`` holds a value per suffix, in position
    order, that is equal exactly for suffixes with the same first bytes. Sorting keeps
    position order inside a run, so the previous entry of a run is the previous smaller
    position; without ``keep_first`` the next entry counts as well."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    if not keep_first:
        hit[order[:-1][same]] = True
    return hit


def _text_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """Batches of (uid, bytes, offset); very long texts come in segments that overlap."""
    uids, parts, offsets, held = [], [], [], 0
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            for lo in range(0, max(1, len(raw) - width + 1), SEGMENT):
                part = raw[lo : lo + SEGMENT + width - 1]
                uids.append(uid), parts.append(part), offsets.append(lo)
                held += len(part)
                if held >= SEGMENT:
                    yield uids, parts, offsets
                    uids, parts, offsets, held = [], [], [], 0
    if uids:
        yield uids, parts, offsets


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for uids, parts, offsets in _text_rows(batches, width):
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            text, lo, hi, h = anchors(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens, width)
            base = np.array(offsets, np.int64)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.array(uids, np.int64)[text]), pa.array((lo + base).astype(np.int32)), pa.array((hi + base).astype(np.int32))],
                names=["h", "uid", "lo", "hi"],
            )

    return run


def _contexts(width: int):
    """Bytes under the windows of every repeated anchor: one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for row in zip(batch.column("uid").to_pylist(), batch.column("blob").to_pylist(), batch.column("runs").to_pylist()):
                raw = tool.decompress(row[1])
                for run in row[2]:
                    piece = raw[run["lo"] : run["hi"] + width]
                    for col, x in zip(cols, (run["h"], row[0], run["lo"], run["n"], piece)):
                        col.append(x)
                    held += len(piece)
                if held >= CHUNK:
                    yield _context_batch(cols)
                    cols, held = ([], [], [], [], []), 0
            if cols[0]:
                yield _context_batch(cols)

    return run


def _context_batch(cols: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["h", "uid", "lo", "n", "bytes"])


def _windows(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A value per window of every piece, end to end, and the number of windows per piece."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = np.maximum(0, lens - width + 1)
    values = prefix_hashes(np.frombuffer(b"".join(pieces), np.uint8), width)
    return values[spread(np.cumsum(lens) - lens, n)], n


def _spans(uid: np.ndarray, lo: np.ndarray, n: np.ndarray, hit: np.ndarray, width: int) -> pa.RecordBatch:
    """Byte spans [start, stop) covered by windows that matched."""
    piece = np.repeat(np.arange(len(n)), n)
    at = spread(lo.astype(np.int64), n)[hit]
    piece = piece[hit]
    if not len(at):
        cut = np.empty(0, np.int64)
        last = cut
    else:
        cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(cut[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(uid[piece[cut]]), pa.array(at[cut]), pa.array(at[last] + width)], names=["uid", "start", "stop"])


def _groups(width: int, keep_first: bool):
    """Rows come sorted by anchor; whole groups are gathered to chunks and solved together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2]))  # position order
        # Equal pieces of one group have equal windows: each distinct piece is sorted once,
        # with its first and its second position.
        first: dict[tuple[int, bytes], int] = {}
        owner = np.fromiter((first.setdefault((r[0], r[3]), len(first)) for r in rows), np.int64, len(rows))
        lead = np.unique(owner, return_index=True)[1]
        values, n = _windows([rows[i][3] for i in lead.tolist()], width)
        hit = matched(values, keep_first)
        ends = np.cumsum(n)
        copies = np.bincount(owner)
        per = spread((ends - n)[owner], n[owner])
        out = hit[per]
        later = np.ones(len(rows), bool)
        later[lead] = False
        again = later if keep_first else copies[owner] > 1
        out |= np.repeat(again, n[owner])
        uid, lo = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        return _spans(uid, lo, n[owner], out, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        rows: list[tuple] = []
        held, key = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "uid", "lo", "bytes"))):
                if row[0] != key:
                    key = row[0]
                    if held >= CHUNK:
                        yield solve(rows)
                        rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield solve(rows)

    return run


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            pieces = batch.column("bytes").to_pylist()
            for i in range(0, len(pieces), 5000):
                values, n = _windows(pieces[i : i + 5000], width)
                uid = np.repeat(batch.column("uid").to_numpy()[i : i + 5000], n)
                at = spread(batch.column("lo").to_numpy()[i : i + 5000].astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(uid), pa.array(at)], names=["w", "uid", "at"])

    return run


def repeated_spans(rows: DataFrame, width: int = 200, keep_first: bool = True, hot: int = HOT) -> DataFrame:
    """(uid, start, stop) of all bytes that a repeated string of ``width`` bytes covers.

    ``rows``: (uid, text) with unique uids, read more than once. With ``keep_first`` only
    matches of an earlier string count, in order of uid and place. Spans of one uid may
    overlap. Texts of fewer than ``width`` bytes give nothing. Of texts that are equal as a
    whole only the first goes into the groups. A group is solved in one task if it has at
    most ``hot`` anchors; the windows of larger ones are aggregated one by one.
    """
    found = land(rows.select("uid", "text").mapInArrow(_anchor_rows(width), "h long, uid long, lo int, hi int"))
    meta = land(rows.select("uid", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("x"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key")))
    whole = meta.where(F.col("size") >= width).groupBy("key", "x", "size").agg(F.min("uid").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    whole = land(meta.join(whole, ["key", "x", "size"]).select("uid", "size", "first"))
    count = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # Anchors that a great part of all rows share are few: they are joined without a shuffle.
    often = sized(land(count.where(F.col("n") > hot)))
    seldom = found.join(often, "h", "left_anti").join(count.where(F.col("n") <= hot), "h")
    repeated = seldom.union(found.join(often, "h").select(*seldom.columns)).groupBy("uid").agg(F.collect_list(F.struct("h", "lo", "hi", "n")).alias("runs"))
    repeated = repeated.join(whole.where("uid != first").select("uid"), "uid", "left_anti")
    texts = packed_texts(rows)
    context = land(texts.join(repeated, "uid").mapInArrow(_contexts(width), "h long, uid long, lo int, n long, bytes binary"))
    small = context.where(F.col("n") <= hot).select("h", "uid", "lo", "bytes")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = small.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_groups(width, keep_first), "uid long, start long, stop long")
    windows = context.where(F.col("n") > hot).select("uid", "lo", "bytes").mapInArrow(_window_rows(width), "w long, uid long, at long")
    seen = windows.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("first")).where("n > 1")
    large = windows.join(seen, "w")
    if keep_first:
        large = large.where(F.struct("uid", "at") != F.col("first"))
    spans = spans.union(large.select("uid", F.col("at").alias("start"), (F.col("at") + width).alias("stop")))
    copies = whole.where("uid != first") if keep_first else whole
    out = land(spans.union(copies.select("uid", F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))))
    drop(found)
    drop(context)
    return out


SPANS = "array<struct<start: bigint, stop: bigint>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of every text to maximal runs and take them out."""
    tool, span = zstandard.ZstdDecompressor(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        sizes, runs, kept, texts = [], [], [], []
        for blob, spans in zip(batch.column("blob").to_pylist(), batch.column("spans").to_pylist()):
            raw, out, at, own = tool.decompress(blob), [], 0, []
            for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                if own and s[0] <= own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], s[1])
                else:
                    own.append({"start": s[0], "stop": s[1]})
            for s in own:
                out.append(raw[at : s["start"]])
                at = s["stop"]
            out.append(raw[at:])
            sizes.append(len(raw)), runs.append(own), kept.append(b"".join(out)), texts.append("".join(x.decode("utf-8", "ignore") for x in out))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], names=["id", "n_bytes", "spans", "kept", "text"])


def remove_repeats(df: DataFrame, width: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept, text) per row: the removed runs of bytes and what is left.

    ``kept`` is binary, as a span can end inside a character; ``text`` leaves such characters
    out. Texts are UTF-8 bytes; matches
    never cross rows and are judged on the input. Null and empty texts stay empty. Repeated
    rows and equal ids are rows of their own (earlier or later in an order that is fixed
    when they are landed); an empty table gives no rows; other columns are left out.
    """
    rows = with_uid(df, id_col, text_col)
    spans = repeated_spans(rows, width, keep_first, hot).groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *spark_fields(f"n_bytes long, spans {SPANS}, kept binary, text string")])
    return packed_texts(rows).join(spans, "uid", "left").select("id", "blob", "spans").mapInArrow(_cut, schema)


def spark_fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields
