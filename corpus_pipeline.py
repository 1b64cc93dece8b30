"""Training-corpus pipeline: stages over ``documents``, each landed before the next reads it.

quality classifier -> MinHash near-dedup -> suffix-array dedup -> best-fit packing

Every stage keeps all columns of its input but the last, whatever their names; repeated rows
and null or equal ids are rows of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import kneser, minhash, packing, suffix
from barline.llm.common import free, land, numbered
from barline.llm.queries import BYTE_BPE, trusted
from barline.session import ship


def _only(docs: DataFrame, uid: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number ``uid`` is among ``kept`` (id), without the number."""
    return docs.join(kept.withColumnRenamed("id", uid), uid, "left_semi").drop(uid)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model trained on trusted ones accepts. Texts without words
    go, null and empty ones with them."""
    ship(spark)
    columns, uid = docs.columns, free(docs, "uid")
    docs = numbered(docs, "doc_id", uid)
    good = docs.join(trusted(spark, sf_dir).select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col(uid).alias("id"))
    judged = kneser.quality(docs, good, id_col=uid)
    return _only(docs, uid, judged.where("kept").select("id")).select(*map(quoted, columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of every group of near-duplicates (five words, 0.8).
    Texts without words, null and empty ones too, are alone and stay."""
    ship(spark)
    columns, uid = docs.columns, free(docs, "uid")
    docs = numbered(docs, "doc_id", uid)
    groups = minhash.near_documents(docs, size=5, percent=80, id_col=uid)
    return _only(docs, uid, groups.where("first").select("id")).select(*map(quoted, columns))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes or more that occur earlier. Every document stays;
    a cut inside a character takes the whole character; ``n_chars`` follows the new text. Null
    texts come out empty."""
    ship(spark)
    columns, uid, new = docs.columns, free(docs, "uid"), free(docs, "new")
    docs = numbered(docs, "doc_id", uid)
    cut = suffix.remove_repeats(docs, width=200, keep_first=True, id_col=uid)
    out = docs.join(cut.select(F.col("id").alias(uid), F.col("text").alias(new)), uid)
    changed = {"text": F.col(new), "n_chars": F.length(new).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else quoted(c) for c in columns])


def quoted(name: str):
    return F.col(f"`{name}`")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 2048 tokens; null and empty
    texts are one piece, the end id alone."""
    ship(spark)
    cut = packing.pieces(docs, public_tokenizers.path(BYTE_BPE)).withColumn("crc", F.crc32("ids")).drop("ids")
    out = packing.pack(cut)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", passages), ("best-fit packing", pack)]

# Neither the random trees nor best-fit planning have a SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir))
    return docs
