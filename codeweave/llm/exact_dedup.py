"""Exact deduplication as a stateful stream (DataFrame and SQL functions only).

A run stores its rows below the state folder and streams their digest,
identifier and locator (run and place in it) through a Structured Streaming
query.  Its keyed state is a table on disk: each micro-batch looks its digests up
among those of all earlier batches, whatever run they were of, and adds one row
for each digest it met (digest, stable identifier and locator of the row that
stays, number of rows, whether it was a hit), written under the batch's number,
so a repeated batch replaces itself.  Nothing expires; a later run with the same
folder goes on where the last one stopped, and its result covers the rows of all
runs.  A hit is not believed: the full normalised texts behind its digest, found
by their locators, are compared.

Spark's own RocksDB state store was measured first: each of its partitions
reserves 4 MiB of disk before it holds a row, more than the data of a small
table over many partitions.

Defined cases: null text counts as empty; texts are equal when identical after
each run of ASCII white space became one space; the smallest id stays, null
ids last, and among rows with the same id the one with the smaller locator
(earlier runs first); an empty table gives no rows, and adds none to a state.
All runs on one folder have the same columns.  The input's columns are carried in ``row``, so
their names cannot clash with the operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import scratch_path, store, who

WHITE = r"[\x20\x09-\x0D]+"
#: Digests that were hit are broadcast up to this many (32 bytes each); beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 500_000
#: Files of stored records (one for each partition of the input) in a micro-batch, at most.
FILES_PER_BATCH = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def add_run(rows: DataFrame, state_dir: str) -> None:
    """Store ``rows`` as the state's next run; whole or not at all, by a rename."""
    spark = rows.sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    top, draft = path(f"{state_dir}/records"), scratch_path(spark, "run")
    rows.write.parquet(draft)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    run = 1 + max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(top)), default=0)
    if not fs.rename(path(draft), path(f"{state_dir}/records/run={run}")):
        raise OSError(f"could not add run {run} to {state_dir}")


def run_state(spark: SparkSession, schema: StructType, state_dir: str, files_per_batch: int) -> DataFrame | None:
    """Stream the records that the state in ``state_dir`` has not seen into it;
    the state by digest: ``who`` (the row that stays), ``n`` (rows), ``hit`` (met
    more than once).  None while nothing was ever seen."""
    keys_dir = f"{state_dir}/keys"

    def remember(batch: DataFrame, number: int) -> None:
        met = batch.groupBy("digest").agg(F.min("who").alias("who"), F.count(F.lit(1)).alias("n"))
        if number:
            earlier = spark.read.parquet(keys_dir).where(F.col("batch") < number).select("digest").distinct()
            met = met.join(earlier.withColumn("seen", F.lit(True)), "digest", "left")
        else:
            met = met.withColumn("seen", F.lit(None).cast("boolean"))
        met.select("digest", "who", "n", (F.col("seen").isNotNull() | (F.col("n") > 1)).alias("hit")) \
            .write.mode("overwrite").parquet(f"{keys_dir}/batch={number}")

    query = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{state_dir}/records") \
        .select("doc_id", "digest", F.struct("run", "place").alias("at")).select("digest", who(locator="at").alias("who")) \
        .writeStream.foreachBatch(remember).option("checkpointLocation", f"{state_dir}/progress") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    top = spark._jvm.org.apache.hadoop.fs.Path(keys_dir)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    keys = spark.read.parquet(keys_dir)
    if len(fs.listStatus(top)) == 1:  # one batch: no digest is in two
        return keys.select("digest", "who", "n", "hit")
    return keys.groupBy("digest").agg(F.min("who").alias("who"), F.sum("n").alias("n"), F.max("hit").alias("hit"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                digest: Callable[[Column], Column] | None = None, state_dir: str | None = None,
                files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per input row, of all runs on ``state_dir`` (a fresh folder unless
    given): ``row`` (its columns), ``digest``, ``keep_id``, ``group_size``, ``kept``.

    ``digest`` maps the normalised text to the state's key (SHA-256 by default);
    equal digests of different texts are told apart, whatever the digest.
    """
    spark = docs.sparkSession
    digest = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    state_dir = (state_dir or scratch_path(spark, "state")).rstrip("/")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("doc_id"), digest(normalised(F.col(f"row.`{text}`"))).alias("digest"),
        F.monotonically_increasing_id().alias("place"))
    add_run(rows, state_dir)
    schema = StructType([*rows.schema.fields, StructField("run", IntegerType())])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
    at = F.struct("run", "place").alias("at")
    state = run_state(spark, schema, state_dir, files_per_batch)
    records = spark.read.schema(schema).parquet(f"{state_dir}/records").select("row", "doc_id", "digest", at)
    if state is None:
        return records.where("false").select("row", "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                                             F.lit(True).alias("kept"))

    # full bytes of every digest that was hit
    hit = state.where("hit").select("digest")
    n_hit = hit.count()
    collided = None
    if n_hit:
        hit = F.broadcast(hit) if n_hit <= BROADCAST_DIGESTS else hit
        texts = records.join(hit, "digest", "left_semi") \
            .groupBy("digest", normalised(F.col(f"row.`{text}`")).alias("norm")) \
            .agg(F.min(who(locator="at")).alias("who"), F.count(F.lit(1)).alias("n"))
        several = store(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
                        .select("digest"), "collided")
        collided = None if several.isEmpty() else several

    def result(pairs: DataFrame) -> DataFrame:
        same = F.col("who.at") == F.col("at")
        return pairs.select("row", "digest", F.col("who.id").alias("keep_id"), F.col("n").alias("group_size"),
                            same.alias("kept"))

    if collided is None:
        return result(records.join(state.drop("hit"), "digest"))
    apart = records.join(collided, "digest", "left_semi").withColumn("norm", normalised(F.col(f"row.`{text}`")))
    return result(records.join(collided, "digest", "left_anti").join(state.drop("hit"), "digest")).unionByName(
        result(apart.join(texts.join(collided, "digest", "left_semi"), ["digest", "norm"])))

