"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when a string of ``MATCH`` bytes that covers it also starts
elsewhere, in the same document or another.  Sorting every suffix would move
hundreds of bytes for each byte of text, so a content-defined part of them is
sorted, which loses no match:

* Each string of ``MATCH`` bytes (a window) has an anchor: the leftmost of its
  ``GRAM``-byte strings with the smallest hash.  Equal windows have their anchor
  at the same offset, so every repeat shows as two anchors with equal
  surroundings.  There is about one anchor for 69 bytes.
* Anchors whose gram occurs once in all documents cannot repeat.  Only hashes
  travel to find them (a hash met twice in a task travels once).
* The other anchors' surroundings are sorted: the suffix from the anchor, then
  what lies before it.  Each task sorts its own into a run, drops equal ones
  (their windows repeat), and sends the run front-coded (shared prefix length
  and the rest).  Runs meet by gram and are combined, as a stream, with a loser
  tree that keeps, for each contender, the length of the prefix it shares with the last
  winner, and never compares bytes below it.
* The merged order and its prefix lengths tell which suffixes agree in 200 - o
  bytes; the same from the anchor to the left tells which agree in o bytes.  A
  window at offset o repeats when another entry agrees in both.

Entries of one gram meet in one task after equal ones were dropped in each
task.  Texts are shuffled twice, to meet their anchors and their marks.

Defined cases: null text counts as empty; texts shorter than ``MATCH`` bytes
keep all; rows with equal id and text are separate occurrences of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, column_of, drop_stored, raw_texts, rows_with_text, spread, store, text_of

by_value(__name__)

MATCH, GRAM = 200, 64
LEFT = MATCH - GRAM  # an anchor is at most so many bytes behind its window's start
CHUNK = 1 << 18  # bytes hashed at once
TEXTS_AT_ONCE = 500
#: Anchors and entries in a bucket of an exchange, and entries in a run, on average.
ANCHORS, ENTRIES, RUN = 200_000, 25_000, 12_000
#: Merged entries that are looked at together (more only if of one gram).
SLICE = 4_000
HASH_BYTES, ROW = 8, 8 + MATCH + LEFT + 2
_BASE, _INVERSE, _MIX = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


class Anchors:
    """Finds the anchors of texts, many texts at once."""

    def __init__(self) -> None:
        self.powers, self.inverse = _powers(_BASE, CHUNK), _powers(_INVERSE, CHUNK)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hash of the ``GRAM`` bytes from each place on."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        return _mixed((sums[GRAM:] - sums[:-GRAM]) * self.inverse[:n - GRAM + 1])

    def find(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts that lie at ``first`` in ``data``: text, place in ``data``,
        hash, and least and greatest offset of the windows of each anchor."""
        h = self.grams(data)
        place = np.arange(len(h), dtype=np.uint64)
        key = (h & np.uint64(~(CHUNK - 1) & (1 << 64) - 1)) | place
        width = LEFT + 1  # grams in a window
        blocks = -(-len(key) // width)
        padded = np.full(blocks * width, np.uint64(2**64 - 1))
        padded[:len(key)] = key
        table = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(table, 1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
        last = len(data) - MATCH
        least = np.minimum(behind[:last + 1], ahead[width - 1:width + last])
        # windows inside one text, anchor by anchor
        windows = np.maximum(sizes - MATCH + 1, 0)
        text = np.repeat(np.arange(len(sizes)), windows)
        start = np.arange(len(text)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
        anchor = (least[start] & np.uint64(CHUNK - 1)).astype(np.int64)
        new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0)))
        end = np.append(new[1:], len(text)) - 1
        a = anchor[new]
        return text[new], a, h[a], a - start[end], a - start[new]

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """``text, place in it, hash, least offset, greatest offset`` in parts of bounded size."""
        step = CHUNK - MATCH + 1
        pieces = [(i, at, t[at:at + CHUNK]) for i, t in enumerate(texts) for at in range(0, max(0, len(t) - MATCH + 1), step)]
        begin, size = 0, 0
        for j in range(len(pieces) + 1):
            if j == len(pieces) or size + len(pieces[j][2]) > CHUNK:
                some = pieces[begin:j]
                if some:
                    sizes = np.array([len(p) for _, _, p in some])
                    first = np.cumsum(sizes) - sizes
                    which, place, h, lo, hi = self.find(np.frombuffer(b"".join(p for _, _, p in some), np.uint8), first, sizes)
                    owner, base = (np.array([p[k] for p in some]) for k in (0, 1))
                    yield owner[which], place - first[which] + base[which], h, lo, hi
                begin, size = j, 0
            size += len(pieces[j][2]) if j < len(pieces) else 0


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_HASHED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("k", pa.binary()), ("entries", pa.binary())])
_ENTRY = np.dtype([("h", "<u8"), ("place", "<u4"), ("lo", "u1"), ("hi", "u1"), ("twice", "u1")])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def hashed_anchors(keyed: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors by bucket of their hash: kind 0, one of each hash in a
    part; kind 1, anchors whose hash was met before in the part (dealt out by
    row, as nothing remains to be found for them: copies of a text lie apart)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors()
        for batch in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, len(whole), TEXTS_AT_ONCE)):
            k = column_of(batch, "k").to_numpy()
            texts = [t or b"" for t in raw_texts(column_of(batch, "t"))]
            for text, place, h, lo, hi in finder.of(texts):
                order = np.argsort(h, kind="stable")
                text, place, h, lo, hi = (x[order] for x in (text, place, h, lo, hi))
                new = np.append(True, h[1:] != h[:-1])
                runs = np.diff(np.append(np.flatnonzero(new), len(h)))
                twice = np.repeat(runs, runs) > 1
                entry = np.empty(len(h), _ENTRY)
                entry["h"], entry["place"], entry["lo"], entry["hi"], entry["twice"] = h, place, lo, hi, twice
                for kind in (0, 1):
                    # a repeated hash asks once, and all its anchors are told at once
                    mine = np.flatnonzero(new if kind == 0 else twice)
                    if not len(mine):
                        continue
                    to = _bucket(h[mine], buckets) if kind == 0 else k[text[mine]] % buckets
                    order = np.argsort(to, kind="stable")
                    mine, to = mine[order], to[order]
                    cuts = np.append(np.flatnonzero(np.append(True, np.diff(to) != 0)), len(to))
                    out = {n: [] for n in _HASHED.names}
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        part = mine[x:y]
                        for n, v in zip(_HASHED.names, (int(to[x]), kind, k[text[part]].tobytes(), entry[part].tobytes()), strict=True):
                            out[n].append(v)
                    yield pa.RecordBatch.from_pydict(out, schema=_HASHED)

    return keyed.mapInArrow(task, _sql(_HASHED))


_PLACES = pa.schema([("k", pa.int64()), ("places", pa.binary())])
_PLACE = np.dtype([("place", "<u4"), ("lo", "u1"), ("hi", "u1")])


def _by_document(k: np.ndarray, rows: np.ndarray, schema: pa.Schema) -> pa.Table:
    order = np.argsort(k, kind="stable")
    k, rows = k[order], rows[order]
    new = np.flatnonzero(np.append(True, np.diff(k) != 0)) if len(k) else np.empty(0, np.int64)
    cuts = np.append(new, len(k)).tolist()
    return pa.table([pa.array(k[new]), pa.array([rows[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())],
                    schema=schema)


def repeated_anchors(hashed: DataFrame) -> DataFrame:
    """Anchors whose hash occurs more than once, packed by document."""
    def task(table: pa.Table) -> pa.Table:
        read = lambda n, kind, where: np.concatenate([np.empty(0, kind), *(
            np.frombuffer(x.as_buffer(), kind) for x, w in zip(table[n], where, strict=True) if w)])
        kinds = np.array(table["kind"].to_pylist())
        asks, told = kinds == 0, kinds == 1
        e, k = read("entries", _ENTRY, asks), read("k", np.int64, asks)
        order = np.argsort(e["h"], kind="stable")
        h = e["h"][order]
        same = h[1:] == h[:-1]
        again = np.empty(len(h), bool)
        again[order] = np.append(same, False) | np.append(False, same) if len(h) else False
        again &= e["twice"] == 0  # those that their own task met twice are among the told ones
        e, k = (np.concatenate([x[again], y]) for x, y in ((e, read("entries", _ENTRY, told)), (k, read("k", np.int64, told))))
        rows = np.empty(len(e), _PLACE)
        for n in _PLACE.names:
            rows[n] = e[n]
        return _by_document(k, rows, _PLACES)

    return hashed.groupBy("bucket").applyInArrow(task, _sql(_PLACES))


_RUNS = pa.schema([("bucket", pa.int64()), ("k", pa.int64()), ("body", pa.binary())])
_OWNER = np.dtype([("k", "<i8"), ("place", "<u4"), ("twice", "u1")])
_SPAN = np.dtype([("first", "<u4"), ("last", "<u4")])


def front_coded(rows: np.ndarray, owners: np.ndarray) -> bytes:
    """A sorted run: shared prefix lengths, what follows them, and owners."""
    shared = np.zeros(len(rows), "<u2")
    if len(rows) > 1:
        unequal = rows[1:] != rows[:-1]
        shared[1:] = np.where(unequal.any(1), unequal.argmax(1), ROW)
    rest = rows[np.arange(ROW) >= shared[:, None]].tobytes()
    return zstandard.compress(len(rows).to_bytes(4, "little") + shared.tobytes() + owners.tobytes() + rest, 1)


def decoding(body: bytes) -> tuple[Iterator[tuple[int, bytes]], np.ndarray]:
    """A run's rows, one by one (length shared with the row before, row), and its owners."""
    raw = zstandard.decompress(body)
    n = int.from_bytes(raw[:4], "little")
    owners = np.frombuffer(raw, _OWNER, n, 4 + 2 * n)

    def rows() -> Iterator[tuple[int, bytes]]:
        at, row = 4 + 2 * n + _OWNER.itemsize * n, b""
        for k in np.frombuffer(raw, "<u2", n, 4).tolist():
            row = row[:k] + raw[at:at + ROW - k]
            at += ROW - k
            yield k, row

    return rows(), owners


def front_decoded(body: bytes) -> tuple[list[int], list[bytes], np.ndarray]:
    """A whole run: shared lengths, rows, owners."""
    rows, owners = decoding(body)
    found = list(rows)
    return [k for k, _ in found], [row for _, row in found], owners


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Loser tree over sorted runs, as a stream: (run, length of the prefix shared
    with the row before it, row).

    Every contender carries the length it shares with the last winner.  Of two,
    the one that shares more is smaller, without a look at the bytes; only at
    equal lengths are bytes compared, from there on.  One row of each run is held.
    """
    size = 1
    while size < len(runs):
        size *= 2
    share, row, alive = [0] * size, [b""] * size, [False] * size
    losers = [0] * size

    def advance(i: int, share_of_first: int | None = None) -> None:
        found = next(runs[i], None) if i < len(runs) else None
        alive[i] = found is not None
        if alive[i]:
            share[i], row[i] = found
            if share_of_first is not None:
                share[i] = share_of_first

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes the one with the winner."""
        if not alive[a]:
            return b, a
        if not alive[b]:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        at = share[a]
        x, y = row[a], row[b]
        if x == y:
            share[b] = ROW
            return a, b
        differ = int.from_bytes(x[at:], "big") ^ int.from_bytes(y[at:], "big")
        common = ROW - (differ.bit_length() + 7) // 8
        if x[common] < y[common]:
            share[b] = common
            return a, b
        share[a] = common
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    for i in range(size):
        advance(i, 0)
    winner = build(1)
    while alive[winner]:
        yield winner, share[winner], row[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The merged order of whole runs as (run, place), and the lengths of the shared prefixes."""
    seen, order, shared = [0] * len(runs), [], []
    for run, common, _ in merged([zip(*r, strict=True) for r in runs]):
        order.append((run, seen[run]))
        shared.append(common)
        seen[run] += 1
    return order, shared


def sorted_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Front-coded runs by bucket, and spans of windows already known to repeat
    (bucket -1, by document)."""
    def run_of(rows: np.ndarray, owners: np.ndarray) -> Iterator[dict]:
        keys = np.ascontiguousarray(rows).view(f"S{ROW}").ravel()
        order = np.argsort(keys, kind="stable")
        rows, owners, keys = rows[order], owners[order], keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
        twice = np.repeat(counts, counts) > 1
        spans = np.empty(twice.sum(), _SPAN)
        spans["first"] = owners["place"][twice] - rows[twice, -1]
        spans["last"] = owners["place"][twice] - rows[twice, -2]
        known = _by_document(owners["k"][twice], spans, _PLACES)
        for k, body in zip(*(c.to_pylist() for c in known.columns), strict=True):
            yield {"bucket": -1, "k": k, "body": body}
        owners = owners.copy()
        owners["twice"] = twice
        rows, owners = rows[new], owners[new]
        to = _bucket(np.ascontiguousarray(rows[:, :HASH_BYTES]).view(">u8").ravel().astype(np.uint64), buckets)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(to) != 0)), len(to)).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield {"bucket": int(to[x]), "k": 0, "body": front_coded(rows[x:y], owners[x:y])}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(_BASE, GRAM)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        around = np.arange(-LEFT, MATCH)
        for batch in batches:
            k, places = column_of(batch, "k"), column_of(batch, "places")
            for i, raw in enumerate(raw_texts(column_of(batch, "t"))):
                p = np.concatenate([np.frombuffer(x.as_buffer(), _PLACE) for x in places[i].values])
                data = np.frombuffer(bytes(LEFT) + (raw or b"") + bytes(MATCH), np.uint8)
                for at in range(0, len(p), RUN):
                    some = p[at:at + RUN]
                    near = data[some["place"].astype(np.int64)[:, None] + LEFT + around]
                    h = _mixed(((near[:, LEFT:LEFT + GRAM].astype(np.uint64) + np.uint64(1)) * powers).sum(1, dtype=np.uint64))
                    rows = np.hstack([h.astype(">u8").view(np.uint8).reshape(-1, 8), near[:, LEFT:], near[:, :LEFT],
                                      some["lo"][:, None], some["hi"][:, None]])
                    owner = np.zeros(len(some), _OWNER)
                    owner["k"], owner["place"] = k[i].as_py(), some["place"]
                    waiting.append((rows, owner))
                    held += len(some)
                    if held >= RUN:
                        yield from batches_of(run_of(*map(np.concatenate, zip(*waiting, strict=True))), _RUNS)
                        waiting, held = [], 0
        if held:
            yield from batches_of(run_of(*map(np.concatenate, zip(*waiting, strict=True))), _RUNS)

    return texts.mapInArrow(task, _sql(_RUNS))


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    import itertools

    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def repeats(n: int, shared: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(entries, offsets): does the entry's window at the offset occur in another entry?

    ``shared``: bytes of the suffix, from the anchor on, shared with the entry
    before (-1: another gram).  ``left`` (entries, 8 + LEFT): hash and the bytes
    before the anchor, nearest first.
    """
    order = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    unequal = left[order][1:] != left[order][:-1]
    common = np.append(-1, np.where(unequal.any(1), unequal.argmax(1), left.shape[1]) - HASH_BYTES)
    found = np.zeros((n, LEFT + 1), bool)
    class_left = np.empty(n, np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        mine = np.flatnonzero((lo <= o) & (o <= hi))
        class_left[order] = np.cumsum((common < o) | (common < 0))
        both = np.cumsum((shared < MATCH - o))[mine] * (n + 1) + class_left[mine]
        rank = np.argsort(both, kind="stable")
        same = both[rank][1:] == both[rank][:-1]
        found[mine[rank], o] = np.append(same, False) | np.append(False, same)
    return found


def spans_of(rows: list[bytes], shared: list[int], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole grams in merged order: documents and spans of windows that repeat."""
    shared = np.array(shared, np.int64)
    shared[0] = 0
    rows = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, ROW)
    new = shared < ROW  # equal surroundings in two runs: all their windows repeat
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(new)))
    twice = (np.repeat(counts, counts) > 1) & (owners["twice"] == 0)
    lo, hi = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    place = owners["place"].astype(np.int64)
    k, begin, end = [owners["k"][twice]], [(place - hi)[twice]], [(place - lo)[twice]]
    # one of each, also those settled before: they are what others may agree with
    known = (counts > 1) | (owners["twice"][first] == 1)
    u = rows[first]
    suffix = np.where(shared[first] < HASH_BYTES, -1, np.minimum(shared[first] - HASH_BYTES, MATCH))
    left = np.hstack([u[:, :HASH_BYTES], u[:, HASH_BYTES + MATCH:HASH_BYTES + MATCH + LEFT][:, ::-1]])
    found = repeats(len(u), suffix, left, lo[first], hi[first])
    found[known] = False
    step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    which, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)  # offsets low ... high - 1
    k.append(owners["k"][first[which]])
    begin.append(place[first[which]] - high + 1)
    end.append(place[first[which]] - low)
    spans = np.empty(sum(map(len, begin)), _SPAN)
    spans["first"], spans["last"] = np.concatenate(begin), np.concatenate(end)
    return np.concatenate(k), spans


def marks(runs: DataFrame, buckets: int) -> DataFrame:
    """Merge the runs of each bucket as a stream, cut at gram borders into slices
    of about ``SLICE`` entries; spans of windows that repeat, by document."""
    def task(table: pa.Table) -> pa.Table:
        decoded = [decoding(x.as_py()) for x in table["body"]]
        owners = np.concatenate([o for _, o in decoded])
        next_owner = np.cumsum([0, *(len(o) for _, o in decoded)]).tolist()
        rows, shared, mine, out = [], [], [], []

        def settle() -> None:
            if len(rows) > 1:  # an entry alone repeats nowhere
                out.append(spans_of(rows, shared, owners[mine]))
            for held in (rows, shared, mine):
                held.clear()

        for run, common, row in merged([r for r, _ in decoded]):
            if common < HASH_BYTES and len(rows) >= SLICE:
                settle()
            rows.append(row)
            shared.append(common)
            mine.append(next_owner[run])
            next_owner[run] += 1
        settle()
        return _by_document(np.concatenate([np.empty(0, np.int64), *(k for k, _ in out)]),
                            np.concatenate([np.empty(0, _SPAN), *(x for _, x in out)]), _PLACES)

    return runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(task, _sql(_PLACES))


def covered(spans: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs (begin, end) of bytes that the windows of ``spans`` cover."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, spans["first"], 1)
    np.add.at(step, spans["last"].astype(np.int64) + MATCH, -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step)[:size] > 0, [0]]).astype(np.int8))).reshape(-1, 2)


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (the columns ``keep``, all by default),
    ``n_bytes``, ``n_removed``, ``spans`` (removed runs: begin, end), ``kept``
    (the remaining bytes), ``kept_sha256``."""
    # the locator names one row for good, as it is stored: copies of a row have their own
    rows = store(rows_with_text(spread(docs), text, keep, F.monotonically_increasing_id().alias("k")), "rows")
    t = F.col("t") if "t" in rows.columns else F.col(f"row.`{text}`")
    found = rows.where(F.octet_length(t) >= MATCH).select("k", t.alias("t"))
    total = found.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(1, total // (LEFT // 2) // ANCHORS)
    places = store(repeated_anchors(hashed_anchors(found, buckets).repartition(buckets, "bucket")), "places")
    n = places.agg(F.sum(F.octet_length("places").cast("long"))).first()[0] or 0
    per_document = places.groupBy("k").agg(F.collect_list("places").alias("places"))
    buckets = max(1, n // _PLACE.itemsize // ENTRIES)
    runs = store(sorted_runs(found.join(per_document, "k"), buckets), "runs")
    drop_stored(places)
    spans = runs.where("bucket = -1").select("k", F.col("body").alias("places")) \
        .unionByName(marks(runs.where("bucket >= 0"), buckets))
    per_document = spans.groupBy("k").agg(F.collect_list("places").alias("places"))
    row = rows.schema["row"].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "spans", "kept", "kept_sha256")}
                for raw, found in zip(raw_texts(text_of(batch, text)), column_of(batch, "places"), strict=True):
                    raw = raw or b""
                    parts = [np.frombuffer(x.as_buffer(), _SPAN) for x in found.values] if found.is_valid else []
                    runs = covered(np.concatenate(parts) if parts else np.empty(0, _SPAN), len(raw)).tolist()
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
                    for n, v in zip(out, (len(raw), len(raw) - len(kept), [{"begin": a, "end": b} for a, b in runs], kept,
                                          hashlib.sha256(kept).hexdigest()), strict=True):
                        out[n].append(v)
                kinds = (pa.int64(), pa.int64(), span, pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "row"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
                    names=["row", *out])

    return rows.join(per_document, "k", "left").drop("k").mapInArrow(
        cut, f"row {row}, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string")


__all__ = ["Anchors", "covered", "drop_stored", "front_coded", "front_decoded", "merge", "merged", "remove_repeats"]
