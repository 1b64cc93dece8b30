"""Token-id files: static range asymmetric numeral system in independent interleaved blocks.

A file set is a table of blocks in ascending document order. All blocks share one frequency
table, 2**20 in total. Inside a block, id i of the block belongs to lane i mod LANES; every
lane has its own 64-bit state and all lanes step together. Words of 32 bits that the lanes
give off share one stream, in the order in which a decoder needs them. A checkpoint every
STRIDE steps holds all states and the place in the stream, so that parts of a block can be
decoded alone; each block has a checksum of its bytes and one of its ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from barline.llm.common import cuts, land, slim, text_batches
from barline.llm.vocab import merging
from barline.session import checkpoint_root

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 4096
STRIDE = 256
BLOCK = 2_000_000
SMALL = 1_000_000
CHUNKS = 3  # times the usual cache of chunks
MAGIC = b"RANS0001"
HEAD = struct.Struct("<8sQIIIIII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of total 2**SCALE in proportion to ``counts``, at least 1 for every id."""
    total, size = 1 << SCALE, len(counts)
    if size > total // 2:
        raise ValueError(f"{size} ids do not fit a table of {total}")
    free = total - size
    share = counts.astype(np.float64) * (free / max(1, counts.sum()))
    freq = 1 + np.floor(share).astype(np.int64)
    rest = total - int(freq.sum())
    order = np.argsort(-(share - np.floor(share)), kind="stable")
    freq[order[: rest % size]] += 1
    freq[order[0]] += rest - rest % size
    return freq.astype(np.uint32)


class Coder:
    """Encoder and decoder for one shared frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n, steps = len(ids), -(-len(ids) // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        given = 0
        for step in range(steps - 1, -1, -1):
            s = ids[step * LANES : (step + 1) * LANES]
            f, x = self.freq[s], state[: len(s)]
            over = x >= (f << np.uint64(63 - SCALE))
            if over.any():
                out = x[over]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                given += len(out)
                x[over] = out >> np.uint64(32)
            q = x // f
            state[: len(s)] = (q << np.uint64(SCALE)) + (x - q * f) + self.low[s]
            if step % STRIDE == 0:
                marks.append((given, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        marks.reverse()
        places = np.array([given - g for g, _ in marks], "<u8")
        states = np.concatenate([s for _, s in marks]).astype("<u8") if marks else np.empty(0, "<u8")
        body = places.tobytes() + states.tobytes() + stream.tobytes()
        plain = zlib.crc32(ids.astype("<u4").tobytes())
        return HEAD.pack(MAGIC, n, LANES, STRIDE, len(marks), len(stream), plain, zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the block; with ``first`` and ``last``, those from one checkpoint to another."""
        magic, n, lanes, stride, n_marks, n_words, plain, crc = HEAD.unpack_from(block)
        body = memoryview(block)[HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("block is damaged")
        places = np.frombuffer(body, "<u8", n_marks)
        states = np.frombuffer(body, "<u8", n_marks * lanes, 8 * n_marks).reshape(n_marks, lanes)
        stream = np.frombuffer(body, "<u4", n_words, 8 * n_marks * (1 + lanes))
        last = n_marks if last is None else last
        lo, hi = min(n, first * stride * lanes), min(n, last * stride * lanes)
        out = np.empty(hi - lo, np.uint32)
        if hi > lo:
            state, at = states[first].astype(np.uint64), int(places[first])
            mask = np.uint64((1 << SCALE) - 1)
            for a in range(lo, hi, lanes):
                b = min(a + lanes, n)
                x = state[: b - a]
                slot = x & mask
                s = self.symbol[slot]
                out[a - lo : b - lo] = s
                x = self.freq[s] * (x >> np.uint64(SCALE)) + slot - self.low[s]
                short = np.flatnonzero(x < LOW)
                if len(short):
                    # the encoder gave these words off at this step, lowest lane first
                    x[short] = (x[short] << np.uint64(32)) | stream[at : at + len(short)]
                    at += len(short)
                state[: b - a] = x
        if first == 0 and last == n_marks and zlib.crc32(out.astype("<u4").tobytes()) != plain:
            raise ValueError("ids are damaged")
        return out


@lru_cache(maxsize=2)
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, "<u4"))


def ids_of(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids): every document's ids and the end id, as little-endian unsigned 16-bit.

    Null and empty texts give the end id alone. Vocabularies of more than 65,536 ids are refused.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merging(path, CHUNKS)
        if len(encoder.vocab.bytes) > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        end = np.array([end_id], "<u2").tobytes()
        for batch, texts in text_batches(batches, "text"):
            flat, lens = encoder.batch(texts)
            raw, ends = flat.astype("<u2").tobytes(), cuts(lens)
            out = [raw[2 * a : 2 * b] + end for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens + 1), pa.array(out, pa.binary())], names=schema.names)

    return slim(df, id_col, text_col, "text").mapInArrow(run, schema)


def histogram(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: one sparse row of counts per task, summed by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(x for x in batch.column(0).to_pylist() if x)
            total += np.bincount(np.frombuffer(raw, "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["token", "n"])

    rows = ids.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    out[[r["token"] for r in rows]] = [r["n"] for r in rows]
    return out


def write(ids: DataFrame, size: int, path: str) -> None:
    """Write the files of ``ids`` (id, n, ids) under ``path``: a table of blocks in ascending
    order of id and the frequency table.

    ``blocks``: (block, first_id, last_id, n_tokens, doc_ids, lengths, data); block numbers
    rise with the ids. Rows with equal ids stay together in any order; null ids come first.
    A document is never split: a very long one has a block of its own. ``ids`` must be landed.
    """
    spark = ids.sparkSession
    freq = scaled(histogram(ids, size)).astype("<u4").tobytes()
    spark.createDataFrame([(SCALE, freq)], "scale int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    schema = "block long, first_id long, last_id long, n_tokens long, doc_ids binary, lengths binary, nulls long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, made = _coder(freq), TaskContext.get().partitionId(), 0

        def block(docs: list, parts: list[bytes]) -> pa.RecordBatch:
            nulls = sum(d is None for d in docs)
            tokens = np.frombuffer(b"".join(parts), "<u2")
            known = np.array([0 if d is None else d for d in docs], "<i8")
            lengths = np.array([len(p) // 2 for p in parts], "<u4")
            row = (part << 32 | made, docs[0], docs[-1], len(tokens), known.tobytes(), lengths.tobytes(), nulls, coder.encode(tokens))
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=arrow)

        docs, parts, held = [], [], 0
        for batch in batches:
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(d), parts.append(p)
                held += len(p) // 2
                if held >= BLOCK:
                    yield block(docs, parts)
                    made += 1
                    docs, parts, held = [], [], 0
        if docs:
            yield block(docs, parts)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    names = arrow.names
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select("id", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) from the files: every block is decoded by itself.

    ``start`` counts the ids of all documents before; it comes from one running sum over
    blocks, one short row for about BLOCK ids. The sums are broadcast while they are fewer
    than SMALL rows and joined by shuffle beyond. ``ids`` is binary, little-endian unsigned
    32-bit. A damaged block fails the job.
    """
    freq = spark.read.parquet(f"{path}/table").first()["freq"]
    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["data"])
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
                docs[: row["nulls"]] = [None] * row["nulls"]
                ends, raw = cuts(lengths), ids.astype("<u4").tobytes()
                for lo in range(0, len(docs), 2000):
                    hi = min(lo + 2000, len(docs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[lo:hi], pa.int64()), pa.array([row["before"] + e for e in ends[lo:hi]], pa.int64()), pa.array(lengths[lo:hi]), pa.array([raw[4 * a : 4 * b] for a, b in zip(ends[lo:hi], ends[lo + 1 : hi + 1])], pa.binary())],
                        names=["id", "start", "n_tokens", "ids"],
                    )

    columns = ["block", "doc_ids", "lengths", "nulls", "data"]
    starts = F.broadcast(starts) if blocks.select("block").count() < SMALL else starts
    joined = blocks.select(*columns).join(starts, "block").select("before", *columns[1:])
    return joined.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, path: str, vocab_size: int, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode, write under ``folder`` (default: the session's shared folder) and read back."""
    spark = df.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/tokens/{uuid.uuid4().hex}"
    write(land(ids_of(df, path, end_id)), vocab_size, folder)
    return read(spark, folder)
