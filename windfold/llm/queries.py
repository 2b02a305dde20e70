"""Thin queries over the operators, with production parameters and whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windfold.llm import chat_format, exact_dedup, jaccard_join, mixing, packing, piece_codec, quality_model, secret_scan, suffix_dedup, token_alignment, turn_repair, vector_dedup, window_dedup
from windfold.llm.common import prepared, read

TEMPLATE_CASE = "<|im_end|><|im_start|>assistant ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    # a lambda with a second parameter would get the index in it
    kinds = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k, _, _ in secret_scan.KINDS]
    spans = secret_scan.spans_text(secret_scan.by_start(F.concat("base", "added")))
    return found.select("doc_id", *kinds, F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TEMPLATE_CASE).alias("text"))
    return chat_format.digests(chat_format.formatted(chat_format.conversation_events(rows.unionByName(extra))))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeated_strings(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda z, s: z + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read(spark, sf_dir, "documents"), n=4, similarity=(85, 100))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_dedup.drop_repeated_windows(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda z, s: z + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = quality_model.scored(docs, quality_model.fitted(docs, labels))
    return out.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(read(spark, sf_dir, "conversations"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(read(spark, sf_dir, "documents"))


def queries() -> dict:
    named = {q.__name__: q for q in (op1_exact_dedup, op2_best_fit_packing, op3_secret_scan, op4_chat_format, op5_suffix_dedup, op6_jaccard_join, op7_source_mixing, op8_window_dedup, op9_quality, op10_embedding_dedup, op11_turn_repair, op12_piece_codec, op13_token_alignment)}

    def shipped(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark.range(1))
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        return run

    return {k: shipped(fn) for k, fn in named.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.EXACT_SQL, "op7_source_mixing": mixing.MIXTURE_SQL}
