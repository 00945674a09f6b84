"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in 3 bits or fewer have a common variant: one of
them reaches it by at most two flips, the other by at most one.  Every distinct
fingerprint emits its variants, variants are shuffled, and fingerprints that
meet on one are verified and linked.  Which variants must be emitted follows
from parity, without losing a pair:

* a pair at odd distance has one fingerprint of even and one of odd parity.
  The odd one emits its 64 one-flip variants; the even one itself (distance 1)
  and two-flip variants (distance 3).  Of three differing bits two lie in the
  same half of the word, so two flips within a half suffice: 2 * C(32, 2) = 992.
* a pair at distance 2 has equal parity and meets on a one-flip variant.

So an even fingerprint emits 1 + 64 + 992 variants, an odd one 64: 560 on
average, in proportion to the number of distinct fingerprints at every scale.
They travel packed: one row per task and bucket holds the steps between its
sorted variants and their flip codes, compressed (the owner is the variant with
the flips undone).

Fingerprints that meet on a variant are linked to one of them that is at most
one flip away (then all are within 3 bits of it), so a meeting of many gives a
star and never all pairs.  Meetings of two-flip owners only are no links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (by_value, column_of, connected_components, emit, raw_texts, rows_with_text, spread, store, text_of,
                     who)

by_value(__name__)

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Variants that one bucket of the exchange holds on average.
BUCKET_VARIANTS = 1_500_000
#: Shingles hashed at once, and fingerprints expanded at once, in a task.
HASHED_AT_ONCE, EXPANDED_AT_ONCE = 1 << 16, 1 << 11


def words_of(raw: bytes) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return raw.lower().split()


def simhash(raw: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of a text's word shingles, repeats included."""
    words = words_of(raw or b"")
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, votes = len(words) - shingle + 1, np.zeros(64, np.int64)
    grams = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(shingle)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    for at in range(0, n, HASHED_AT_ONCE):
        some = np.fromiter(hashes, np.uint64, min(HASHED_AT_ONCE, n - at))
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                 shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` (all by default) as the struct ``row``, and ``fp``:
    the fingerprint's 64 bits as a signed long.  Null text: no words."""
    rows = rows_with_text(docs, text, keep)
    names, kinds = ["row", "fp"], f"row {rows.schema['row'].dataType.simpleString()}, fp long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(x, shingle, seed) for x in raw_texts(text_of(batch, text))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([column_of(batch, "row"), pa.array(fps.view(np.int64))], names=names)

    return rows.mapInArrow(task, kinds)


def _flip_masks() -> np.ndarray:
    """Flip code -> bits flipped: none, one (codes 1-64), two within a half."""
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for half in (range(32), range(32, 64)) for i, j in itertools.combinations(half, 2)]
    return np.array([0, *one, *two], np.uint64)


_SPREAD, _UNSPREAD = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of their width (high bytes of steps are nearly all zero), compressed."""
    width = numbers.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def variants(fps: DataFrame, buckets: int) -> DataFrame:
    """Packed variants of ``fps (fp)``: ``bucket, variants, codes`` (binary)."""
    schema = pa.schema([("bucket", pa.int64()), ("variants", pa.binary()), ("codes", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _flip_masks()
        codes = np.arange(len(masks), dtype=np.uint16)
        waiting = np.empty(0, np.uint64)

        def expand(some: np.ndarray) -> pa.RecordBatch:
            odd = (np.bitwise_count(some) & 1).astype(bool)
            v = np.concatenate([(some[~odd, None] ^ masks).ravel(), (some[odd, None] ^ masks[1:65]).ravel()])
            c = np.concatenate([np.tile(codes, (~odd).sum()), np.tile(codes[1:65], odd.sum())])
            # a multiplicative hash, which can be undone; its top bits tell the bucket
            x = v * np.uint64(_SPREAD)
            order = np.argsort(x)
            x, c = x[order], c[order]
            to = (x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            ends = np.append(np.flatnonzero(np.diff(to)) + 1, len(to)).tolist()
            starts = [0, *ends[:-1]]
            spans = list(zip(starts, ends, strict=True))
            return emit({"bucket": to[starts].astype(np.int64), "variants": [_packed(np.diff(x[a:b], prepend=np.uint64(0))) for a, b in spans],
                         "codes": [_packed(c[a:b]) for a, b in spans]}, schema)

        for batch in batches:
            waiting = np.concatenate([waiting, column_of(batch, "fp").to_numpy().view(np.uint64)])
            while len(waiting) >= EXPANDED_AT_ONCE:
                yield expand(waiting[:EXPANDED_AT_ONCE])
                waiting = waiting[EXPANDED_AT_ONCE:]
        if len(waiting):
            yield expand(waiting)

    return fps.select("fp").mapInArrow(task, "bucket long, variants binary, codes binary")


def meet(packed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links ``(a, b)`` between fingerprints that meet on a variant."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(table: pa.Table) -> pa.Table:
        v = np.concatenate([np.cumsum(_unpacked(x.as_py(), np.uint64)) for x in table["variants"]]) * np.uint64(_UNSPREAD)
        c = np.concatenate([_unpacked(x.as_py(), np.uint16) for x in table["codes"]])
        order = np.argsort(v)
        v, c = v[order], c[order]
        same = v[1:] == v[:-1]
        member = np.append(same, False) | np.insert(same, 0, False)
        v, c = v[member], c[member]
        if not len(v):
            return schema.empty_table()
        owner, near = v ^ _flip_masks()[c], c <= 64
        start = np.flatnonzero(np.insert(v[1:] != v[:-1], 0, True))
        none = np.uint64(2**64 - 1)
        has_near = np.logical_or.reduceat(near, start)
        centre = np.minimum.reduceat(np.where(near, owner, none), start)
        sizes = np.diff(np.append(start, len(v)))
        centre, has_near = np.repeat(centre, sizes), np.repeat(has_near, sizes)
        good = has_near & (centre != owner)
        good[good] = np.bitwise_count(centre[good] ^ owner[good]) <= radius
        pairs = np.unique(np.stack([centre[good], owner[good]], 1), axis=0) if good.any() else np.empty((0, 2), np.uint64)
        return pa.table({"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64),
                         "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)}, schema=schema)

    return packed.groupBy("bucket").applyInArrow(links, "a long, b long")


def simhash_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None,
                   shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: ``row`` (the columns ``keep``, all by default),
    ``fp``, ``component_id`` (smallest id reachable over links of at most 3
    bits; null only if all ids are null), ``kept`` (true for one row of each
    component: the smallest id's, null ids last, the first stored among equal
    ids).  Null or empty texts have fingerprint 0 and link like any other.
    """
    rows = store(fingerprints(spread(docs), text, keep, shingle, seed)
                 .withColumn("locator", F.monotonically_increasing_id()), "fingerprints")
    named = rows.select("fp", F.col(f"row.`{id_col}`").alias("doc_id"), "locator")
    classes = store(named.groupBy("fp").agg(F.min(who()).alias("who")), "classes")
    n = classes.count()
    links = meet(variants(spread_rows(classes, n), max(1, -(-n * 560 // BUCKET_VARIANTS))))
    roots = connected_components(links)
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = linked.groupBy("root").agg(F.min("who").alias("best"))
    member = store(linked.join(best, "root").select("fp", "best"), "members")
    whole = classes.join(member, "fp", "left").select("fp", F.coalesce("best", "who").alias("best"))
    return rows.join(whole, "fp").select("row", "fp", F.col("best.id").alias("component_id"),
                                         (F.col("best.at") == F.col("locator")).alias("kept"))


def spread_rows(classes: DataFrame, n: int) -> DataFrame:
    """Tasks of at least ``EXPANDED_AT_ONCE`` fingerprints, so that packed rows
    stay large; adaptive execution may merge them."""
    return classes.select("fp").repartition(max(1, min(n // (4 * EXPANDED_AT_ONCE) + 1, 100_000)))
