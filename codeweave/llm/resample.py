"""Resampling of documents towards the word distribution of a target text set.

Features are runs of 1 to ``most`` words, hashed into ``buckets`` by crc32.  A
256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes, so that
``bytes.split`` yields the words; a longer run's hash goes on from the seed of
the run it extends.  Each task reduces its features to Counters of at most
``buckets`` entries, summed per bucket.  A bucket's gain compares target and
documents; a document's weight is the floored mean of its features' gains.
Gumbel noise from a hash of the id makes the highest scores a draw.

Nothing but thin rows is shuffled: bucket counts, and once the scored rows with
the columns ``keep``, by ranges of their order.  What reaches the driver, and
the tasks from there, are the ``buckets`` gains.

Defined cases: a null or wordless text has no feature, weight 0 and takes no
part in the draw; a null id hashes as an empty one and comes last among ties;
repeated rows are drawn apart, each with its own rank; with no documents the
result is empty, with no target texts all counts of the target are 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_value, column_of, partitions_for, raw_texts, rows_with_text, spread, store, text_of

by_value(__name__)

#: Lower case for A-Z, a blank for what is in no word; 0-9, a-z and bytes from 0x80 on stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
             for b in range(256))
#: Distinct hashes in a task before they are folded into buckets.
DISTINCT = 1 << 18


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def features(words: list[bytes], most: int) -> list[int]:
    """Unsigned crc32 of all runs of 1 to ``most`` words, joined by one space."""
    seeds = list(map(crc32, words))
    out = seeds
    for n in range(1, most):
        seeds = [crc32(word, crc32(b" ", seed)) for seed, word in zip(seeds, words[n:], strict=False)]
        out = out + seeds
    return out


def bucket_counts(docs: DataFrame, text: str, buckets: int, most: int) -> np.ndarray:
    """Features per bucket over all texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = Counter(), Counter()

        def fold() -> None:
            for h, n in seen.items():
                total[h % buckets] += n
            seen.clear()

        for batch in batches:
            for raw in raw_texts(column_of(batch, "t")):
                seen.update(features(words_of(raw), most))
                if len(seen) > DISTINCT:
                    fold()
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         names=["bucket", "n"])

    counts = spread(docs.select(F.col(f"`{text}`").alias("t"))).mapInArrow(task, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, name: str | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{name or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int, buckets: int = 10_000, most: int = 1,
             seed: int = 2024, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (the columns ``keep``, all by default),
    ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score;
    null for what is not drawn).  Of the N documents with ``least_words`` words
    or more, floor(``percent`` * N / 100) are drawn, ties to the smaller id."""
    bound_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text, buckets, most), bucket_counts(target, text, buckets, most))
    rows = rows_with_text(spread(docs), text, keep, F.col(f"`{id_col}`").cast("string").alias("name"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, weights, scores, drawable = [], [], [], []
            for raw, name in zip(raw_texts(text_of(batch, text)), column_of(batch, "name").to_pylist(), strict=True):
                words = words_of(raw)
                found = features(words, most)
                weight = int(gain[np.array(found, np.int64) % buckets].sum()) // len(found) if found else 0
                counts.append(len(found))
                weights.append(weight)
                scores.append(weight + noise(seed, name))
                drawable.append(len(words) >= least_words)
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "row"), *(pa.array(x, pa.int64()) for x in (counts, weights, scores)), pa.array(drawable, pa.bool_())],
                names=["row", "n_features", "weight", "score", "drawable"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_features long, weight long, score long, drawable boolean"
    scored = store(rows.mapInArrow(task, schema).withColumn("k", F.monotonically_increasing_id()), "scored")
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col(f"row.`{id_col}`").asc_nulls_last(), F.col("k")]
    # ranges of the order, also within equal scores and ids; places within a range are stored with the rows
    placed = store(scored.repartitionByRange(partitions_for(scored, 32 << 20), *order).sortWithinPartitions(*order)
                   .select("*", F.spark_partition_id().alias("part"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("drawable").alias("drawable_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    n = sizes.agg(F.sum("drawable_n")).first()[0] or 0
    rank = F.col("base") + F.col("place") + 1
    return placed.join(bases, "part").select(
        "row", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= percent * n // 100), rank).alias("rank"))
