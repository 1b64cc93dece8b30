"""Registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from barline.llm import bpe, counts, covertree, kneser, merkle, minhash, oracles, packing, secretscan, suffix, tokenfile, topk, urls, whitening
from barline.session import ship

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = oracles.SQL


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.withColumnRenamed("id", "doc_id")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    out = packing.pack(cut.withColumn("crc", F.crc32("ids")).drop("ids"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), 49_408)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = covertree.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(fine).select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_documents(table(spark, sf_dir, "documents"), size=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("first").alias("kept"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser.quality(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.round("perplexity", 6).alias("perplexity"), F.round("cut", 6).alias("cut"), "kept")


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secretscan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secretscan.BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *map(of, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), most=8)
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    claims = {"text": F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claims)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
