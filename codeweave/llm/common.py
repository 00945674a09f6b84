"""Helpers shared by the training-data operators: stored tables in the shared
folder, partition counts from data size, numbering without a single task, and
connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def by_value(module: str) -> None:
    """Task functions of ``module`` travel with the task, so executors need no
    installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it has ended, instead of when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, and survives the loss of executors.  Once it is written, nothing
    reads the shuffle files that led to it."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if "/llm-" in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: file sizes, for a scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20, expand: float = 3.0) -> int:
    """Partitions of about ``bytes_each`` for the input's estimated size (file
    sizes times ``expand`` for compression), at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, int(estimated_bytes(df) * expand / bytes_each)))


#: Rows and bytes of the Arrow batches that carry whole texts to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows are whole texts, so Spark's default of 10,000 to a batch is no bound
    on memory: lower the session's limits, never raise them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def text_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The texts of a batch: its column ``t``, else the field of its ``row``."""
    return column_of(batch, "t") if "t" in batch.schema.names else column_of(batch, "row").field(text)


def rows_with_text(docs: DataFrame, text: str, keep: list[str] | None, *more: Column) -> DataFrame:
    """``row`` (the columns ``keep``, all by default), ``more`` and, unless the row has it, the text as ``t``."""
    row = F.struct(*(keep if keep is not None else ["*"])).alias("row")
    return docs.select(row, *more, *([] if keep is None or text in keep else [F.col(f"`{text}`").alias("t")]))


def spread(df: DataFrame, expand: float = 3.0) -> DataFrame:
    """Deal a small input out over the cores when it is one file; a larger one
    keeps its splits.  Bounds the Arrow batches of what follows."""
    spark = df.sparkSession
    bound_batches(spark)
    size = estimated_bytes(df)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < split * cores / 2 and size < (64 << 20) else df


def who(id_col: str = "doc_id", locator: str = "locator"):
    """Sort key that names one row: smallest id first, null ids last."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(locator).alias("at"))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text of an Arrow column, None for null."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None


def emit(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def numbered(df: DataFrame, key: str, name: str = "slot", step: tuple[Task, str] | None = None) -> DataFrame:
    """Add ``name``: numbers 0, 1, 2, ... without gaps among the rows of each
    value of the long column ``key``.  With ``step`` (a task and the columns it
    gives) the rows are what it makes of ``df``: it runs in the worker that counts,
    as two Python steps in a row would hold two workers for each core.

    No task ever holds a whole group: a first pass counts within its own
    partition (the partition's number is stored with each row, so a lost task
    may run again), and only one row per partition and key is summed over
    partitions.  Rows: any order within a key.  An empty input stays empty.
    """
    made = df if step is None else df.mapInArrow(*step)
    names = made.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    make = step[0] if step else iter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), {}
        for batch in make(batches):
            keys = np.asarray(column_of(batch, key).to_numpy(zero_copy_only=False), dtype=np.int64)
            order = np.argsort(keys, kind="stable")
            values, starts, sizes = np.unique(keys[order], return_index=True, return_counts=True)
            ranks = np.empty(len(keys), np.int64)
            base = np.array([seen.get(v, 0) for v in values.tolist()], dtype=np.int64)
            ranks[order] = np.arange(len(keys)) - np.repeat(starts - base, sizes)
            seen.update(zip(values.tolist(), (base + sizes).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), block, np.int64)), pa.array(ranks)],
                names=[*names, "_block", "_rank"])

    local = store(df.mapInArrow(count, f"{fields}, _block long, _rank long"), "numbered")
    counts = local.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(_window(key, "_block")) - F.col("_n")
    base = counts.select(key, "_block", before.alias("_base"))
    return local.join(base, [key, "_block"]).select(*names, (F.col("_base") + F.col("_rank")).alias(name))


def _window(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph ``edges (a long, b long)``: one row
    ``(node, root)`` per node that has a link, the root being its smallest node.

    Alternating large-star and small-star steps: each joins the edges with one
    minimum per node, so that no task holds a node's neighbours (a hot node's
    rows are split by the adaptive skew join).  Each round is a stored table.
    Stops when a round changes nothing; self links are ignored.
    """
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
              "edges")

    def mark(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now, done = mark(new), e
        e = new
        drop_stored(done)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
