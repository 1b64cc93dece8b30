"""BPE encoding and decoding: speculate with greedy longest match, verify adjacent pairs.

A sequence of tokens is what merging gives for their text if and only if every token
encodes alone to itself and every two neighbours encode, as one string, to just the two.
So greedy longest match proposes tokens, all neighbours are tested at once against a table
of known pairs, and only words that hold a refuted pair are merged exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barline.llm.common import cuts, slim, text_batches
from barline.llm.vocab import Encoder, Vocab, load

PAIRS = 2_000_000


class Speculator:
    """Greedy proposals and the table of pairs that are known to hold or to fail."""

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        self.longest = max(map(len, vocab.ids))
        words = list(vocab.ids)
        ids, lens = vocab.merge(words)
        alone = lens == 1
        alone[alone] = ids[(np.cumsum(lens) - lens)[alone]] == np.array([vocab.ids[w] for w, ok in zip(words, alone) if ok])
        self.tokens = {w: vocab.ids[w] for w, ok in zip(words, alone) if ok}
        self.known, self.holds = np.empty(0, np.int64), np.empty(0, bool)
        self.failed = 0

    def propose(self, word: bytes) -> list[int]:
        got = self.tokens.get(word)
        if got is not None:
            return [got]
        out, lo, n, tokens, longest = [], 0, len(word), self.tokens, self.longest
        while lo < n:
            hi = min(n, lo + longest)
            while (got := tokens.get(word[lo:hi])) is None:
                hi -= 1
            out.append(got)
            lo = hi
        return out

    def _test(self, keys: np.ndarray) -> np.ndarray:
        """Does each pair (a << 16 | b) encode, as one string, to a and b?"""
        a, b, text = keys >> 16, keys & 0xFFFF, self.vocab.bytes
        ids, lens = self.vocab.merge([text[x] + text[y] for x, y in zip(a.tolist(), b.tolist())])
        two, start = lens == 2, np.cumsum(lens) - lens
        two[two] = (ids[start[two]] == a[two]) & (ids[start[two] + 1] == b[two])
        return two

    def verify(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        if len(self.known) > PAIRS:
            self.known, self.holds = self.known[:0], self.holds[:0]
        at = np.searchsorted(self.known, distinct)
        new = distinct[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != distinct)] if len(self.known) else distinct
        if len(new):
            all_keys = np.concatenate([self.known, new])
            order = np.argsort(all_keys)
            self.known, self.holds = all_keys[order], np.concatenate([self.holds, self._test(new)])[order]
        return self.holds[np.searchsorted(self.known, distinct)][back]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        guess = [self.propose(w) for w in words]
        lens = np.fromiter(map(len, guess), np.int64, len(guess))
        ids = np.fromiter((t for g in guess for t in g), np.int64, int(lens.sum()))
        if len(ids) < 2:
            return ids, lens
        word = np.repeat(np.arange(len(lens)), lens)
        inside = word[1:] == word[:-1]
        keys = ((ids[:-1] << 16) | ids[1:])[inside]
        bad = np.unique(word[1:][inside][~self.verify(keys)]) if len(keys) else np.empty(0, np.int64)
        if not len(bad):
            return ids, lens
        self.failed += len(bad)
        right, n = self.vocab.merge([words[w] for w in bad.tolist()])
        new = lens.copy()
        new[bad] = n
        out, start = np.empty(int(new.sum()), np.int64), np.cumsum(new) - new
        good = np.ones(len(lens), bool)
        good[bad] = False
        out[np.repeat(good, new)] = ids[np.repeat(good, lens)]
        out[np.repeat(~good, new)] = right
        del start
        return out, new


@lru_cache(maxsize=2)
def speculating(path: str) -> Encoder:
    vocab = load(path)
    if vocab.end:
        raise ValueError("decoding needs a byte-level vocabulary")
    return Encoder(vocab, Speculator(vocab).encode)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(id, n_tokens, ids[, decoded]) per row; ``ids`` is binary, little-endian unsigned 32-bit.

    ``path``: a byte-level vocabulary of the tokenizers library, at the same place on every
    machine; special strings inside a text become their ids, as the library does by default.
    A null or empty text has no ids and decodes to the empty string. Rows are independent:
    repeated rows and null ids give a row each, an empty table none. A text of any length
    passes whole; other columns of ``df`` are left out, whatever their names.
    """
    schema = T.StructType([df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decode)
    schema = T.StructType([T.StructField("id", schema[0].dataType)] + schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculating(path)
        table = encoder.vocab.bytes
        for batch, texts in text_batches(batches, "text"):
            flat, lens = encoder.batch(texts)
            ends = cuts(lens)
            raw = flat.astype("<u4").tobytes()
            cols = [batch.column(0), pa.array(lens), pa.array([raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])], pa.binary())]
            if decode:
                cols.append(pa.array([b"".join(map(table.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim(df, id_col, text_col, "text").mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) from binary little-endian unsigned 32-bit ids; null ids decode to ''."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(path).bytes
        for batch in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return slim(df, id_col, ids_col, "ids").mapInArrow(run, schema)
