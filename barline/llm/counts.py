"""Token counts: vocabulary strings that are proved to be one token are counted directly.

The proof is done once, before any text is read: every vocabulary string is merged alone,
and those that come out as their own single id form the shortcut set. A pre-token in the
set counts one; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barline.llm.common import slim, text_batches
from barline.llm.vocab import Encoder, Vocab, load


def prove_whole(vocab: Vocab) -> frozenset[bytes]:
    """The vocabulary strings that encode alone to exactly their own id."""
    words = list(vocab.ids)
    ids, lens = vocab.merge(words)
    first = ids[np.cumsum(lens) - lens]
    return frozenset(w for w, i, n in zip(words, first.tolist(), lens.tolist()) if n == 1 and i == vocab.ids[w])


class Shortcut:
    """Numbers of tokens per word; what the whole-token set holds is never merged."""

    def __init__(self, vocab: Vocab):
        self.vocab, self.whole = vocab, prove_whole(vocab)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rest = [i for i, w in enumerate(words) if w not in self.whole]
        lens = np.ones(len(words), np.int64)
        if rest:
            lens[rest] = self.vocab.merge([words[i] for i in rest])[1]
        return np.zeros(int(lens.sum()), np.int64), lens  # only the numbers are used


@lru_cache(maxsize=2)
def counting(path: str) -> Encoder:
    vocab = load(path)
    if vocab.end:
        raise ValueError("the shortcut set is proved for byte-level vocabularies")
    return Encoder(vocab, Shortcut(vocab).encode)


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row.

    Null and empty texts count zero bytes and tokens. Rows are independent: repeated rows
    and null ids give a row each, an empty table none. Whole texts of any length are
    counted; special strings inside a text count as the library has them by default, one
    token. Other columns of ``df`` are left out, whatever their names.
    """
    schema = T.StructType([
        T.StructField("id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counting(path)
        for batch, texts in text_batches(batches, "text"):
            n = encoder.counts(texts)
            size = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return slim(df, id_col, text_col, "text").mapInArrow(run, schema)
