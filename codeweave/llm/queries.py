"""Registered queries of the training-data operators: each applies one operator
to its whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (ball_tree, chat, decontaminate, exact_dedup, language_id, packing, prefix_trie, quality, resample, sharding,
               simhash, suffix_dedup, token_files)
from .common import partitions_for, store

LITERAL_TURN = "<|im_end|><|im_start|>assistant ok"
SEQUENCE, PACK_END_ID, FILE_END_ID, SHARDS = 1024, 2, 1, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LITERAL_TURN).alias("text"))
    out = chat.format_conversations(turns.unionByName(extra))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.withColumn("turns", chat.read_back(F.col("formatted"))) \
        .withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss"))) \
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
                F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                F.length("formatted").cast("long").alias("formatted_chars"))


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnable = F.coalesce(remainder(4), F.lit(2)) != 2
    return language_id.identify(docs, learnable, keep=["doc_id"]).select("row.doc_id", "lang_pred", "score") \
        .select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, tokenizer_path("word_bpe_49k.json"), FILE_END_ID) \
        .select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), PACK_END_ID, SEQUENCE) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs, keep=["doc_id"]).select(
        "row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep=["doc_id"]).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("row.doc_id", "keep_id", "group_size", "kept",
                                                F.lower(F.hex("digest")).alias("text_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, SHARDS, keep=["doc_id"]).select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    learnable = F.coalesce(remainder(5), F.lit(0)) != 0
    return quality.classify(docs, labels, learnable, keep=["doc_id"]).select("row.doc_id", "score", "predicted") \
        .select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """op11's conversations: the first h turns of conversation c - c % 100, then
    c's own after its first h; (turns, all conv_ids, partitions for their size)."""
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = store(turns.where("conv_id is not null").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
        .select("conv_id", (F.row_number().over(own) - 1).alias("turn"), "role", "text"), "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    ids = placed.select("conv_id").distinct()
    base = placed.where(F.col("turn") < 5).withColumnRenamed("conv_id", "base")
    shared = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(base, "base").where(F.col("turn") < h)
    return shared.select("conv_id", "turn", "role", "text").unionByName(placed.where(F.col("turn") >= h)), ids, partitions_for(placed)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids, partitions = rebuilt_turns(table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.prefix_trie(turns, ids, partitions=partitions)
    digests = prefix_trie.ids_sha256(ends, "node", "conv_id").withColumnRenamed("key", "node")
    return nodes.join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"), percent=10, least_words=20, keep=["doc_id"]) \
        .select("row.doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_language_id, op3_token_files, op4_best_fit_packing, op5_simhash_dedup,
                            op6_suffix_dedup, op7_benchmark_decontamination, op8_exact_dedup, op9_sharding,
                            op10_quality_classifier, op11_prefix_trie, op12_exact_top_k,
                            op13_importance_resampling)}
