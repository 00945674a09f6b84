"""Benchmark decontamination by suffix arrays over the training documents.

Training words become the numbers of benchmark words (0: in no benchmark item).
Each shard, a few megabytes of consecutive documents of a partition, is a
sorted array of its suffixes, cut to the window's length.  A suffix can only
match where a run of benchmark words is as long as the shortest window, so the
others are left out of the array: that loses no match.  Every distinct benchmark
suffix is binary-searched in every shard, which yields the places of its window,
its items, and their longest verbatim match there.

The documents are read without a shuffle.  The benchmark is dealt by hash into
blocks of a checked size, and one block at a time goes to the tasks: a benchmark of
up to ``BLOCK_BYTES`` is one pass, a larger one several, each stored before the
next, whose findings add up.  A prompt template that many items share is one window.

Defined cases: null or empty texts have no words and are clean; an item of
fewer words than a window is one window, of none is no window; a null item_id
counts as the empty string, equal item_ids as one item; an empty benchmark
leaves all documents clean, an empty documents table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, column_of, drop_stored, raw_texts, rows_with_text, spread, store, text_of

by_value(__name__)

WINDOW = 10
#: Bytes of benchmark text sent to the tasks at once (some 16 times that as windows),
#: and of document text in one suffix array.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
#: Bytes of words stay (digits, letters, all beyond ASCII), A-Z in lower case; all others become a space.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
              for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_FOLD).split()


class Benchmark:
    """A block of items as numbered words: their distinct windows (``low`` to
    ``high``, sorted), the items of each, and each item's windows in order."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        texts = [(item, words) for item, words in ((item, words_of(raw)) for item, raw in items) if words]
        self.window = window
        self.number = {w: i for i, w in enumerate(sorted({w for _, words in texts for w in words}), 1)}
        self.items = sorted({item for item, _ in texts})
        place, rows, owner, chains = {item: i for i, item in enumerate(self.items)}, [], [], {}
        for item, words in texts:
            numbers = np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words))
            n = max(1, len(words) - window + 1)
            padded = np.append(numbers, np.zeros(window, np.uint32))
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, window)[:n])
            owner.append(np.full(n, place[item], np.int64))
            # items of equal words have equal matches: one of them is enough for the lengths
            chains.setdefault(numbers.tobytes(), len(rows) - 1)
        rows = np.concatenate(rows).astype(">u4") if rows else np.empty((0, window), ">u4")
        self.low, first, which = np.unique(as_bytes(rows), return_index=True, return_inverse=True)
        self.sizes = (rows[first] != 0).sum(1).astype(np.int64)
        # behind a short window any word may follow
        self.high = as_bytes(np.where(np.arange(window) < self.sizes[:, None], rows[first], 0xFFFFFFFF).astype(">u4"))
        self.shortest = int(self.sizes.min()) if len(first) else 0
        both = np.unique(which * max(1, len(self.items)) + (np.concatenate(owner) if owner else np.empty(0, np.int64)))
        self.owners = both % max(1, len(self.items))
        self.owner_cuts = np.searchsorted(both // max(1, len(self.items)), np.arange(len(first) + 1))
        cuts = np.cumsum([0, *map(len, owner)])
        self.chains = [which[cuts[k]:cuts[k + 1]] for k in chains.values()]

    def items_of(self, windows: np.ndarray) -> set[str]:
        found = [self.owners[self.owner_cuts[w]:self.owner_cuts[w + 1]] for w in windows.tolist()]
        return {self.items[k] for k in np.unique(np.concatenate(found)).tolist()}


def as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1] * 4}").ravel() if len(rows) else np.empty(0, f"S{rows.shape[1] * 4}")


def suffix_array(words: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, sorted by the ``window`` words from there on, and those words as
    bytes.  Only places where a run of known words is at least ``shortest`` long."""
    n = len(words)
    ends = np.append(np.flatnonzero(words == 0), n)
    run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    places = np.flatnonzero(run >= max(1, shortest))
    padded = np.append(words, np.zeros(window, words.dtype))
    rows = padded[places[:, None] + np.arange(window)]
    # what lies behind the run's end belongs to other words or documents
    rows = np.where(np.arange(window) < run[places, None], rows, 0).astype(">u4")
    keys = as_bytes(rows)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def search(words: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every distinct window: ``(window, place)`` of all
    occurrences in this shard.  A place begins at most one window of each size,
    so these are no more than ``window`` times the words."""
    empty = np.empty(0, np.int64)
    if not len(bench.low):
        return empty, empty
    places, keys = suffix_array(words, bench.window, bench.shortest)
    first, last = np.searchsorted(keys, bench.low, "left"), np.searchsorted(keys, bench.high, "right")
    counts = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, places[np.repeat(first, counts) + inside]


def longest_matches(bench: Benchmark, which: np.ndarray, place: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of the longest verbatim match of an item in each document: windows
    of an item that follow each other at following places are one longer match.
    One window of one item is looked at at a time, so nothing holds every pair of
    an item's window and a place."""
    longest = np.zeros(docs, np.int64)
    order = np.lexsort((place, which))
    which, place, doc = which[order], place[order], doc[order]
    cuts = np.searchsorted(which, np.arange(len(bench.low) + 1))
    for chain in bench.chains:
        before, lengths, last = np.empty(0, np.int64), np.empty(0, np.int64), -2
        for k in np.flatnonzero(cuts[chain + 1] > cuts[chain]).tolist():
            w = chain[k]
            here, size = place[cuts[w]:cuts[w + 1]], bench.sizes[w]
            now = np.full(len(here), size, np.int64)
            if k == last + 1:
                at = np.minimum(np.searchsorted(before, here - 1), len(before) - 1)
                now = np.where(before[at] == here - 1, lengths[at] + 1, now)
            np.maximum.at(longest, doc[cuts[w]:cuts[w + 1]], now)
            before, lengths, last = here, now, k
    return longest


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (the columns ``keep``, all by default),
    ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items``
    (ids of the items with occurring windows, sorted as strings), ``spans``
    (maximal runs of hit words: first word, number), ``longest`` (words of the
    longest verbatim match), ``contaminated``.
    """
    out = spread(rows_with_text(docs, text, keep))
    own = "t" in out.columns  # else the text is a field of the row
    row = out.schema["row"].dataType.simpleString()
    found = "n_words long, hits array<struct<start:long,size:long>>, items array<string>, longest long"
    n, block = blocks_of(benchmark, item_id, item_text)
    earlier = None
    for number in range(n):
        final = number == n - 1
        sent = out.sparkSession.sparkContext.broadcast(Benchmark(block(number), window))
        out = out.mapInArrow(_pass(sent, text, final), f"row {row}, {found}" + ", t string" * (own and not final))
        if not final:  # one block is in memory at a time: its pass is stored before the next is fetched
            out = store(out, "decontaminated")
            sent.destroy()
            if earlier is not None:
                drop_stored(earlier)
            earlier = out
    return out.select("row", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["size"]).alias("n_hit"),
                      "items", F.col("hits").alias("spans"), "longest", (F.size("hits") > 0).alias("contaminated"))


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """How many blocks the benchmark's distinct rows are dealt into, and what
    fetches one: about half of ``BLOCK_BYTES`` each, so that an uneven deal stays
    below.  (One item's text is not cut.)"""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"),
                            F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = 1 if size <= BLOCK_BYTES else -(-2 * size // BLOCK_BYTES)

    def fetch(number: int) -> list[tuple[str, bytes]]:
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == number)
        return [(r["i"], r["t"].encode()) for r in mine.collect()]

    return n, fetch


def _pass(sent, text: str, final: bool):
    """A pass over the documents for one block; texts go on to the next pass."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = sent.value

        def shard(part: pa.RecordBatch, words: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1  # a zero after each document
            joined = np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint32))])
            which, place = search(joined, bench)
            doc = np.searchsorted(starts, place, "right") - 1
            before = [column_of(part, n).to_pylist() if n in part.schema.names else itertools.repeat([], len(part))
                      for n in ("hits", "items", "longest")]
            cover = np.zeros(len(joined) + 1, np.int64)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + bench.sizes[which], -1)
            cover = np.cumsum(cover) > 0
            match = longest_matches(bench, which, place, doc, len(words))
            order = np.argsort(doc, kind="stable")
            cuts = np.searchsorted(doc[order], np.arange(len(words) + 1))
            hits, items, longest = [], [], []
            touched = set(np.unique(doc).tolist())
            for i, (old_hits, old_items, old_longest) in enumerate(zip(*before, strict=True)):
                if i not in touched:
                    hits.append(old_hits)
                    items.append(old_items)
                    longest.append(old_longest or 0)
                    continue
                mine = order[cuts[i]:cuts[i + 1]]
                hit = cover[starts[i]:starts[i] + sizes[i]].copy()
                for x in old_hits:
                    hit[x["start"]:x["start"] + x["size"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)))
                hits.append([{"start": a, "size": b - a} for a, b in edge.reshape(-1, 2).tolist()])
                items.append(sorted({*old_items, *bench.items_of(np.unique(which[mine]))}))
                longest.append(max(old_longest or 0, int(match[i])))
            columns = {"row": column_of(part, "row"), "n_words": pa.array(sizes), "hits": pa.array(hits, span),
                       "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, pa.int64())}
            if not final and "t" in part.schema.names:
                columns["t"] = column_of(part, "t")
            return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

        get, zero = bench.number.get, itertools.repeat(0)
        for batch in batches:
            words, begin, size = [], 0, 0
            for i, raw in enumerate(raw_texts(text_of(batch, text))):
                found = words_of(raw)
                words.append(np.fromiter(map(get, found, zero), np.uint32, len(found)))
                size += len(raw or b"")
                if size >= SHARD_BYTES or i == len(batch) - 1:
                    yield shard(batch.slice(begin, i + 1 - begin), words)
                    words, begin, size = [], i + 1, 0

    return scan
