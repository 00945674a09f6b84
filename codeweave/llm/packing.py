"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

Only the lengths of pieces matter, and there are at most ``capacity`` different
ones: their counts are a table of bounded size.  On it the packing is planned:
for each bin, a bitset subset-sum over the available lengths (the longest one
is always in) finds the fullest feasible combination, which is then removed,
as many times as the counts allow, until nothing is left.  The plan is a short
list of patterns.  The pieces themselves never leave the executors: each gets
its number among the pieces of its length, and finds its sequence and offset
in the plan by that number.

Defined cases: null text counts as empty (a document of its end id only); a
document longer than ``capacity`` is cut into pieces of ``capacity`` ids, of
which the first holds the remainder; repeated rows are packed as documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Task, by_value, column_of, emit, numbered, spread
from .tokens import encoder

by_value(__name__)

CAPACITY = 1024
TEXTS_AT_ONCE = 256


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that has the longest one
    and does not exceed ``capacity``: length -> times.  Among equally full ones
    long lengths are preferred, so that short ones stay for later bins."""
    first = max(counts)
    room, mask = capacity - first, (1 << (capacity - first + 1)) - 1
    steps, reach = [], 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length) if length <= room else 0
        times = 1
        while left > 0:  # multiples 1, 2, 4, ... of one length reach every count up to the available one
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # not reachable without this step
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(times, {length: how many})`` that use up ``counts``."""
    counts, patterns = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[k] // v for k, v in chosen.items())
        patterns.append((times, chosen))
        for k, v in chosen.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows ``(first number, first sequence, offset in it, how many
    in each sequence)``: piece ``r`` of the length belongs to the last row that
    begins at or before ``r``."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in patterns:
        offset = 0
        for length, each in sorted(chosen.items(), reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), sequence, offset, each))
            used[length] = used.get(length, 0) + times * each
            offset += length * each
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def texts_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")))


def cutter(tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> tuple[Task, str]:
    """The task that makes pieces of ``doc_id, t``, and the columns it gives."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("ids", pa.binary())][: 6 if with_ids else 5]
    schema = pa.schema(fields)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                out: dict[str, list] = {name: [] for name, _ in fields}
                for doc_id, ids in zip(column_of(some, "doc_id").to_pylist(), encode(column_of(some, "t").to_pylist()),
                                       strict=True):
                    ids += tail
                    first = (len(ids) // 4 - 1) % capacity + 1
                    begin = 0
                    for number, end in enumerate(range(first, len(ids) // 4 + 1, capacity)):
                        part = ids[4 * begin:4 * end]
                        for name, value in zip(out, (doc_id, number, begin, end - begin, zlib.crc32(part), part)):
                            out[name].append(value)
                        begin = end
                yield emit(out, schema)

    return cut, kinds


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text",
           id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece, and its ``ids``
    (little-endian unsigned 32-bit) if asked for."""
    return texts_of(docs, text, id_col).mapInArrow(*cutter(tokenizer, end_id, capacity, with_ids))


def pack(found: DataFrame, capacity: int = CAPACITY, step: tuple[Task, str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length``; with
    ``step``, to those that it makes of ``found``."""
    ranked = numbered(found, "length", "_number", step)
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(counts, capacity))  # at most a few rows for each of `capacity` lengths
    names = ranked.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema[:-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = column_of(batch, "length").to_numpy()
            numbers = column_of(batch, "_number").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                rows = table[length]
                row = rows[np.searchsorted(rows[:, 0], numbers[mine], side="right") - 1]
                ahead = numbers[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + ahead // row[:, 3]
                offset[mine] = row[:, 2] + ahead % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(column_of(batch, n) for n in names), pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, text: str = "text",
                   id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    return pack(texts_of(docs, text, id_col), capacity, cutter(tokenizer, end_id, capacity, with_ids))
