"""Parquet tables bucketed by key columns.

A bucketed table is shuffled once, when it is written.  Later windows,
aggregations and joins on its keys find its rows in place, and an equality on
a single key column reads only the buckets that can hold it.

The layout lies beside the data in ``_layout``, so another session can read
the table by its path; the catalog entry that Spark needs for the bucket layout
is named after that path.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import shuffles_freed, written_in_order

#: Estimated bytes of one bucket, and the largest number of buckets Spark takes by default.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def buckets_for(df: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` by the optimizer's estimate, at least one for each core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = df.sparkSession.sparkContext.defaultParallelism
    return least if size >= 1 << 60 else max(least, min(MOST_BUCKETS, size // BUCKET_BYTES))


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at), fs


def _name(spark: SparkSession, path: str) -> str:
    return "codeweave_" + hashlib.sha256(_place(spark, path)[0].toString().encode()).hexdigest()[:32]


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """Store ``df`` in ``path``, a new or an overwritten table, with one exchange
    on ``keys`` and one sorted file for each bucket (and partition); returns it
    read back.

    A partition holds one bucket, and is sorted by the keys themselves: ``sortBy``
    would sort by the bucket's number first and hash both rows' keys in each
    comparison to find it."""
    spark = df.sparkSession
    name = _name(spark, path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.format("parquet").mode("overwrite").option("path", path) \
        .bucketBy(buckets, *keys)
    with shuffles_freed(spark), written_in_order(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    at, fs = _place(spark, f"{path.rstrip('/')}/_layout/layout.json")
    out = fs.create(at, True)
    out.write(json.dumps({"keys": keys, "buckets": buckets, "partition_by": partition_by or [],
                          "schema": spark.table(name).schema.jsonValue()}).encode())
    out.close()
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table in ``path``; one that is missing raises ``AnalysisException``."""
    name = _name(spark, path)
    if not spark.catalog.tableExists(name):
        layout = json.loads(spark.read.text(f"{path.rstrip('/')}/_layout/layout.json", wholetext=True).first()[0])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(layout["schema"]))
        quoted = {k: ", ".join(f"`{c}`" for c in layout[k]) for k in ("keys", "partition_by")}
        place = _place(spark, path)[0].toString().replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet "
                  + (f"PARTITIONED BY ({quoted['partition_by']}) " if layout["partition_by"] else "")
                  + f"CLUSTERED BY ({quoted['keys']}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
        if layout["partition_by"]:
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


def forget_bucketed(spark: SparkSession, path: str) -> None:
    """Drop the catalog entry of a table whose files are deleted."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(spark, path)}")
