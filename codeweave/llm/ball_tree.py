"""Exact top-k inner products by branch and bound over ball trees.

Vectors are ordered by the signs of fixed projections and cut into slots of
bounded size; a slot's task builds ball trees of at most ``SHARD`` vectors over
it.  A query goes down a tree in the order of the nodes' upper bounds (inner
product with the centre, plus the query's length times the radius) and stops
where no bound reaches its current k-th score.

The k-th score is shared: a query is first answered within its own slot, by the
task that builds the trees; then blocks of queries, with the k-th scores found,
are sent to every other slot, where most trees are left at their root, and from
tree to tree within a slot.  A slot's task holds its trees and streams the
blocks, so memory is bounded by the slot and one block.  Each slot returns at
most k rows a query, ranked at the end.

Scores are integers: components are ``floor(scale * x)``, sums are exact in
doubles below 2**53 and are done in integers beyond.  Bounds are widened by
more than their rounding error, and a node whose bound equals the k-th score is
skipped only when none of its ids is smaller.

Defined cases: vectors null or with null or non-finite components take no part;
only vectors of equal length are compared (empty ones score 0); a query's own
row is left out, but other rows with its id count; ties go to the smaller id,
null ids last; an empty table gives an empty result.  A scaled component of
``LIMIT`` or more is an error, as scores would not be exact.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_value, column_of, drop_stored, spread, store

by_value(__name__)

LEAF, SHARD = 256, 8192  # vectors
SLOT_BYTES, SLOT_ROWS = 16 << 20, 2048  # of vectors in a slot: about so much, at least so many
BLOCK = 256  # queries sent together
LIMIT = 1 << 24
SIGNS = 16
NO_ID = np.iinfo(np.int64).max  # a null id sorts last

_VECTOR = "id long, query boolean, dim int, region int, v binary"
_ROWS = pa.schema([("id", pa.int64()), ("query", pa.bool_()), ("dim", pa.int32()), ("region", pa.int32()), ("v", pa.binary())])
_SENT = pa.schema([("home", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("body", pa.binary())])
_SENT_SQL = "home int, kind int, dim int, body binary"
_FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "q long, query_id long, vec_id long, score long"
TREE, QUERIES, ANSWERS = 0, 1, 2


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body)) as z:
        return {n: z[n] for n in z.files}


def scaled(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """Vectors that take part, as integers, with the region their signs give."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids, query = column_of(batch, "v"), column_of(batch, "id"), column_of(batch, "query")
            size = np.diff(lists.offsets.to_numpy())
            first = lists.offsets.to_numpy()[:-1]
            values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            usable = np.array(lists.is_valid())
            for dim in np.unique(size[usable]).tolist():
                rows = np.flatnonzero(usable & (size == dim))
                x = np.floor(values[first[rows][:, None] + np.arange(dim)] * scale)
                fine = np.isfinite(x).all(1)
                rows, x = rows[fine], x[fine]
                if x.size and np.abs(x).max() >= LIMIT:
                    raise ValueError(f"a scaled component reaches {LIMIT}: scores would not be exact")
                signs = x @ np.random.default_rng(dim).standard_normal((dim, SIGNS)) > 0
                region = (signs << np.arange(SIGNS)).sum(1)
                v = x.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), query.take(pa.array(rows)), pa.array(np.full(len(rows), dim), pa.int32()),
                     pa.array(region, pa.int32()), pa.array([r.tobytes() for r in v], pa.binary())], schema=_ROWS)

    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col("query"), F.lit(False)).alias("query"),
                          F.col(f"`{vector}`").alias("v")).mapInArrow(task, _VECTOR)


class BallTree:
    """Arrays of nodes over vectors that are put in the order of the leaves."""

    def __init__(self, x: np.ndarray | None = None, ids: np.ndarray | None = None, at: np.ndarray | None = None,
                 stored: bytes = b"") -> None:
        if x is None:
            z = unpack(stored)
            x, self.ids, self.at, self.nodes, self.centre = z["x"], z["ids"], z["at"], z["nodes"], z["centre"]
            self.radius, self.least = z["radius"], z["least"]
        self.x = x.astype(np.float64)
        if ids is not None:
            self._build(ids, at)
        self.most = np.abs(self.x).max(initial=0)
        self.reach = np.sqrt((self.centre ** 2).sum(1)) + self.radius

    def _build(self, ids: np.ndarray, at: np.ndarray) -> None:
        order = np.arange(len(self.x))
        nodes, centres, radii = [], [], []  # node: begin, end, left child, right child (-1: leaf)
        todo = [(0, len(order), -1, 0)]
        while todo:
            begin, end, above, side = todo.pop()
            here = len(nodes)
            if above >= 0:
                nodes[above][2 + side] = here
            mine = self.x[order[begin:end]]
            centre = mine.mean(0)
            far = ((mine - centre) ** 2).sum(1)
            if not (mine != mine[0]).any():
                centre, far = mine[0], np.zeros(1)  # exact for equal vectors
            nodes.append([begin, end, -1, -1])
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            if end - begin > LEAF:
                a = mine[far.argmax()] if len(far) > 1 else centre
                b = mine[((mine - a) ** 2).sum(1).argmax()]
                middle = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(mine @ (b - a), middle)]
                todo += [(begin, begin + middle, here, 0), (begin + middle, end, here, 1)]
        self.x, self.ids, self.at = self.x[order], ids[order], at[order]
        self.nodes, self.centre, self.radius = np.array(nodes), np.array(centres), np.array(radii)
        self.least = np.array([self.ids[b:e].min() for b, e, *_ in nodes])

    def stored(self) -> bytes:
        return pack(x=self.x.astype("<i4"), ids=self.ids, at=self.at, nodes=self.nodes, centre=self.centre,
                    radius=self.radius, least=self.least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): no vector of the node has a higher score."""
        norm = np.sqrt((queries ** 2).sum(1))[:, None]
        return np.floor(queries @ self.centre.T + norm * self.radius + norm * self.reach * 1e-9 + 1e-6)

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int, int]], k: int,
               floor: int | None) -> None:
        """Put what belongs there into ``best``: at most k of (-score, id, place), sorted.
        ``floor``: a score that the k-th reaches already, if known."""
        exact = len(query) * self.most * np.abs(query).max(initial=0) < 2 ** 53
        heap = [(-bound[0], 0)]
        while heap:
            minus, node = heapq.heappop(heap)
            full = len(best) == k
            least = max([x for x in (floor, -best[-1][0] if full else None) if x is not None], default=None)
            if least is not None and -minus < least:
                return
            if full and -minus == -best[-1][0] and self.least[node] > best[-1][1]:
                continue
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-min(-minus, bound[child]), child))
                continue
            x = self.x[begin:end]
            score = (x @ query).astype(np.int64) if exact else x.astype(np.int64) @ query.astype(np.int64)
            mine = self.at[begin:end] != own
            if least is not None:
                mine &= score >= least
            some = np.flatnonzero(mine)
            if not len(some):
                continue
            some = some[np.lexsort((self.ids[begin:end][some], -score[some]))[:k]]
            best += zip((-score[some]).tolist(), self.ids[begin:end][some].tolist(), self.at[begin:end][some].tolist(), strict=True)
            best.sort()
            del best[k:]


def answer(trees: list[BallTree], queries: dict[str, np.ndarray], k: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """The best of all trees for each query of a block, tree by tree."""
    x = queries["x"].astype(np.float64)
    bounds = [t.bounds(x) for t in trees]
    for i in range(len(x)):
        best: list[tuple[int, int, int]] = []
        floor = int(queries["floor"][i]) if queries["known"][i] else None
        for j in sorted(range(len(trees)), key=lambda j: -bounds[j][i, 0]):
            trees[j].search(x[i], int(queries["at"][i]), bounds[j][i], best, k, floor)
        yield i, best


def found_rows(queries: dict[str, np.ndarray], answers: list[tuple[int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
    no_id = lambda x: None if x == NO_ID else x
    rows = [(int(queries["at"][i]), int(queries["ids"][i]), no_id(name), -minus) for i, best in answers for minus, name, _ in best]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], schema=_FOUND)


def build(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition (a slot): its trees, its queries with the k-th score
    found in the slot, and what was found."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[BallTree, dict[str, np.ndarray]]]:
        """Trees of SHARD vectors of one length, each with the queries among them."""
        held: list[tuple[int, int, int, bool, bytes]] = []

        def made() -> tuple[BallTree, dict[str, np.ndarray]]:
            dim = held[0][0]
            x = np.frombuffer(b"".join(r[4] for r in held), "<i4").reshape(len(held), dim)
            ids, at, asks = (np.array([r[i] for r in held], kind) for i, kind in ((1, np.int64), (2, np.int64), (3, bool)))
            return BallTree(x, ids, at), {"x": x[asks], "ids": ids[asks], "at": at[asks]}

        for batch in batches:
            for row in zip(*(column_of(batch, n).to_pylist() for n in ("dim", "id", "k", "query", "v")), strict=True):
                if held and (row[0] != held[0][0] or len(held) == SHARD):
                    yield made()
                    held.clear()
                held.append((row[0], NO_ID if row[1] is None else row[1], *row[2:]))
        if held:
            yield made()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        home = TaskContext.get().partitionId()
        send = lambda kind, dim, body: pa.RecordBatch.from_pylist(
            [{"home": home, "kind": kind, "dim": dim, "body": body}], schema=_SENT)
        trees: dict[int, list[BallTree]] = {}
        asks: list[tuple[int, dict[str, np.ndarray]]] = []
        for tree, queries in shards(batches):
            dim = tree.x.shape[1]
            trees.setdefault(dim, []).append(tree)
            asks += [(dim, {n: a[i:i + BLOCK] for n, a in queries.items()}) for i in range(0, len(queries["x"]), BLOCK)]
            yield send(TREE, dim, tree.stored())
        for dim, queries in asks:
            n = len(queries["x"])
            queries |= {"floor": np.zeros(n, np.int64), "known": np.zeros(n, bool)}
            answers = list(answer(trees[dim], queries, k))
            for i, best in answers:
                if len(best) == k:
                    queries["floor"][i], queries["known"][i] = -best[-1][0], True
            yield send(QUERIES, dim, pack(**queries))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, _FOUND) as out:
                out.write_batch(found_rows(queries, answers))
            yield send(ANSWERS, dim, sink.getvalue())

    return rows.mapInArrow(task, _SENT_SQL)


def top_k(vectors: DataFrame, query: F.Column, k: int, scale: int = 1024, id_col: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """The k best-scoring other rows of every row for which ``query`` holds:
    ``query_id, rank`` (from 1), ``vec_id, score``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = store(scaled(spread(vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector}`"), query.alias("query"))), id_col, vector, scale)
                 .withColumn("k", F.monotonically_increasing_id()), "vectors")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("v").cast("long"))).first()
    slots = max(1, -(-(size or 0) // SLOT_BYTES), min(2 * spark.sparkContext.defaultParallelism, n // SLOT_ROWS))
    order = ["dim", "region", "id", "k"]
    built = store(build(rows.repartitionByRange(slots, *order).sortWithinPartitions(*order), k), "trees")
    trees, asks = built.where(F.col("kind") == TREE), built.where(F.col("kind") == QUERIES)
    homes = built.agg(F.max("home")).first()[0] or 0
    sent = asks.select(F.explode(F.sequence(F.lit(0), F.lit(homes))).alias("slot"), "kind", "dim", "body", "home") \
        .where("slot <> home").drop("home")
    streams = trees.select(F.col("home").alias("slot"), "kind", "dim", "body").unionByName(sent) \
        .repartition(slots, "slot").sortWithinPartitions("slot", "kind")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, {}
        for batch in batches:
            for at, kind, dim, body in zip(*(column_of(batch, n) for n in ("slot", "kind", "dim", "body")), strict=True):
                if at.as_py() != slot:
                    slot, held = at.as_py(), {}
                if kind.as_py() == TREE:
                    held.setdefault(dim.as_py(), []).append(BallTree(stored=body.as_py()))
                elif dim.as_py() in held:
                    queries = unpack(body.as_py())
                    yield found_rows(queries, list(answer(held[dim.as_py()], queries, k)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in column_of(batch, "body"):
                with pa.ipc.open_stream(body.as_py()) as found:
                    yield from found

    found = streams.mapInArrow(task, _FOUND_SQL).unionByName(
        built.where(F.col("kind") == ANSWERS).select("body").mapInArrow(read, _FOUND_SQL))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


__all__ = ["BallTree", "drop_stored", "top_k"]
