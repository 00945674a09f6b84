"""Quality classifier: random Fourier features of document statistics, ridge
regression by partition-summed normal equations, isotonic calibration.

1. One pass over the texts computes a short vector of statistics of each whole
   text, which is stored.
2. The statistics are standardised with means and deviations over all
   documents, and mapped to random Fourier features of a Gaussian kernel.
3. Every partition sums the normal equations of its labelled rows; the sums are
   added up in a tree (16 at a time, in tasks), so that the driver receives one
   matrix whatever the number of partitions.
4. Part of the labelled rows, which the ridge fit has not seen, calibrates the
   scores: counts and labels by score bin (a fixed number), then pooled
   adjacent violators.  Between the centres of the pooled steps the curve is
   linear, and ``RANK`` of a score is a fixed rising map of the ridge score, so
   that documents of one step keep their order.

Defined cases: null text counts as empty and is scored; labels that repeat for
an id are averaged and null labels ignored; without labelled rows for the ridge
fit all scores are 0.5, and without any for calibration they are the fixed map of
the ridge score alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, column_of, raw_texts, rows_with_text, spread, store, text_of

by_value(__name__)

FEATURES, WIDTH, RIDGE, SEED = 384, 3.0, 1e-3, 11
BINS, FAN_IN = 4096, 16
RANK = 0.01
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 other punctuation, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII, 7 control
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:], _KIND[:0x20], _KIND[0x20], _KIND[0x0A] = 1, 2, 3, 6, 7, 4, 5
_MARKS = b".,;:!?'\"-|%&*$#@/()<>[]{}=_+~\\"


def statistics(raw: bytes | None) -> list[float]:
    """Shape, alphabet, word and repetition statistics of a whole text."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / n
    marks = counts[list(_MARKS)] / n
    words = raw.split()
    w = max(1, len(words))
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = raw.split(b"\n")
    distinct_lines = len(set(lines)) / len(lines)
    again = sum(map(bytes.__eq__, words[1:], words)) / w
    p = counts[counts > 0] / n
    upper_words = sum(map(bytes.isupper, words)) / w
    top = [c for _, c in seen.most_common(3)] + [0] * 3
    endings = Counter(x[-1:] for x in words)
    return [np.log1p(len(raw)), np.log1p(len(words)), *kinds.tolist(), *np.sqrt(marks).tolist(),
            float(sizes.mean()) if len(words) else 0.0, float(sizes.std()) if len(words) else 0.0,
            np.log1p(float(sizes.max())) if len(words) else 0.0, len(seen) / w, top[0] / w, top[1] / w, again, upper_words,
            float(-(p * np.log2(p)).sum()), np.log1p(len(lines)), distinct_lines,
            sum(endings[m] for m in (b".", b",", b"!", b"?", b";", b":")) / w,
            sum(not x.isalnum() for x in seen) / max(1, len(seen)), np.log1p(len(raw) / len(lines))]


def with_statistics(docs: DataFrame, text: str, keep: list[str] | None) -> DataFrame:
    rows = spread(rows_with_text(docs, text, keep))
    row = rows.schema["row"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(raw) for raw in raw_texts(text_of(batch, text))]
            yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(stats, pa.list_(pa.float64()))],
                                             names=["row", "stats"])

    return rows.mapInArrow(measure, f"row {row}, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def projection(n_stats: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((n_stats, FEATURES)) / (WIDTH * np.sqrt(n_stats / 8)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, the standardised statistics themselves and a constant."""
    x = np.clip((stats - mean) / scale, -6, 6)
    w, b = projection(stats.shape[1])
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), x, np.ones((len(x), 1))])


def summed(blobs: DataFrame) -> np.ndarray | None:
    """Add up binary vectors of doubles, ``FAN_IN`` at a time in tasks."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table["v"])
        return pa.table({"k": [table["k"][0].as_py() // FAN_IN], "v": [total.tobytes()]},
                        schema=pa.schema([("k", pa.int64()), ("v", pa.binary())]))

    blobs = store(blobs.select("k", "v"), "sums")
    top = blobs.agg(F.max("k")).first()[0]
    if top is None:
        return None
    while top > 0:
        blobs = store(blobs.withColumn("k", F.expr(f"k div {FAN_IN} * {FAN_IN}")).groupBy("k")
                      .applyInArrow(add, "k long, v binary"), "sums")
        top //= FAN_IN
    return sum(np.frombuffer(r["v"], np.float64) for r in blobs.collect())


def pooled(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic regression by pooling adjacent violators: a value for each bin,
    steps of empty bins filled by their neighbours."""
    blocks: list[list[float]] = []  # weight, sum, bins
    for n, s in zip(total, good, strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n1, s1, b1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n1, blocks[-1][1] + s1, blocks[-1][2] + b1]
    return np.concatenate([np.full(int(b), s / n if n else 0.5) for n, s, b in blocks])


def centres(bins: np.ndarray, total: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean bin and value of each pooled step."""
    first = np.flatnonzero(np.diff(steps, prepend=np.nan) != 0)
    return np.add.reduceat(bins * total, first) / np.add.reduceat(total, first), steps[first]


def rising(raw: np.ndarray) -> np.ndarray:
    """Fixed map of a ridge score (about 0 to 1) to a probability."""
    return 1 / (1 + np.exp(-4 * (raw - 0.5)))


def classify(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", id_col: str = "doc_id",
             label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled rows where ``usable`` (an expression of ``id_col``)
    holds, and score every row: ``row`` (the columns ``keep``, which must
    include ``id_col``; all by default), ``score``, ``predicted``."""
    table = store(with_statistics(docs, text, keep), "statistics")
    row = table.schema["row"].dataType.simpleString()
    first = table.select(F.size("stats").alias("n")).first()
    n_stats = first["n"] if first else 1
    facts = table.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale")).collect()  # one row for each statistic
    mean, scale = np.zeros(n_stats), np.ones(n_stats)
    for r in facts:
        mean[r["i"]], scale[r["i"]] = r["mean"], max(r["scale"], 1e-6)

    marked = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")) \
        .agg(F.avg(F.col(f"`{label}`").cast("double")).alias("y")).where(F.col("id").isNotNull())
    learn = store(table.select("stats", F.col(f"row.`{id_col}`").alias(id_col)).where(usable)
                  .withColumn("calibrates", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(4)) == 0)
                  .join(marked, F.col(f"`{id_col}`") == F.col("id")).select("stats", "y", "calibrates"), "labelled")

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            z = fourier(matrix(column_of(batch, "stats")), mean, scale)
            y = column_of(batch, "y").to_numpy()
            part = np.hstack([z.T @ z, (z.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    size = FEATURES + n_stats + 1
    sums = summed(learn.where("not calibrates").mapInArrow(equations, "k long, v binary"))
    weights, curve = np.zeros(size), None
    if sums is not None:
        sums = sums.reshape(size, size + 1)
        weights = np.linalg.solve(sums[:, :size] + RIDGE * np.trace(sums[:, :size]) / size * np.eye(size), sums[:, size])

    def place(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw + 0.5) / 2 * BINS - 0.5, 0, BINS - 1)

    def ridge(stats: np.ndarray) -> np.ndarray:
        return fourier(stats, mean, scale) @ weights

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.rint(place(ridge(matrix(column_of(batch, "stats"))))).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, column_of(batch, "y").to_numpy(), BINS)
        mine = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n[mine]), pa.array(s[mine])], names=["bin", "n", "s"])

    if sums is not None:
        found = learn.where("calibrates").mapInArrow(count, "bin long, n double, s double") \
            .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()  # at most BINS
        if found:
            at, n, good = (np.array([r[c] for r in found], np.float64) for c in ("bin", "n", "s"))
            curve = centres(at, n, pooled(n, good))

    def probability(stats: np.ndarray) -> np.ndarray:
        if sums is None:
            return np.full(len(stats), 0.5)
        raw = ridge(stats)
        return rising(raw) if curve is None else (1 - RANK) * np.interp(place(raw), *curve) + RANK * rising(raw)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(matrix(column_of(batch, "stats"))) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             names=["row", "score", "predicted"])

    return table.mapInArrow(score, f"row {row}, score double, predicted int")
