"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark
decontamination, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  A stage's output is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweave.llm import decontaminate, exact_dedup, language_id, packing, queries, simhash
from codeweave.llm.common import store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no text, or no letter) go; the others stay, also
    when no row has a label to learn from.  A null ``lang`` becomes the predicted
    language, if one was learned; a given one stays."""
    learnable = F.coalesce(queries.remainder(4), F.lit(2)) != 2
    found = language_id.identify(docs, learnable).where(language_id.has_letter(F.col("row.text")))
    lang = F.coalesce(F.col("row.lang"), F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return found.select(F.col("row").withField("lang", lang).alias("row")).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.simhash_groups(docs).where("kept").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, benchmark).where("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and offset."""
    return packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json"), queries.PACK_END_ID, queries.SEQUENCE) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: Neither the network nor the fingerprints nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents``; the pieces of what stays.
    Null and empty texts go in the first stage; rows with one id and text are
    copies, of which one stays; an empty table gives no pieces."""
    docs = queries.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, f"stage-{name}")
    return docs
