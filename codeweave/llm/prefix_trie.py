"""Prefix trie of conversations by hashes of fixed-length blocks of turns.

Every conversation is read once, in order, as a stream: each block of ``BLOCK``
turns leaves one row with the digest of all turns up to the block's end, the
digests at the turns inside, and running text lengths.  Conversations are then
grouped by successive block digests, which counts equal blocks before anything
else is done with them.  Where all conversations that go on from a block go on
with the same next block, its turns are nodes as they stand; only where
siblings diverge are the turns inside grouped by their own digests, over the
distinct blocks.

Sums over subtrees need no walk by depth.  A node's owner is its smallest
member; a conversation owns a run of nodes that ends with its last turn.  So the
sum over the distinct nodes of a subtree is a sum over its members, of what each
of them owns, and goes through the same two groupings.

A hot parent's children (all conversations that share a prompt) meet in no
task: parents with more than a thousandth of all children, at most a thousand,
are broadcast to them.

Defined cases: null role or text counts as empty; rows of one conversation are
ordered by turn (null first), then role and text, and repeated rows are turns of
their own; rows without a conversation are left out; a conversation without
turns (``conversations``) ends at the root; no conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_value, column_of, drop_stored, partitions_for, raw_texts, store

by_value(__name__)

BLOCK = 4
ROOT = hashlib.blake2b(digest_size=16).digest()
#: Parents with more than this part of all children are heavy.
HEAVY = 1000
CHUNK = 1 << 20  # bytes of joined ids in a row

_BLOCKS = pa.schema([("conv_id", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("start", pa.int64()),
                     ("nodes", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64())), ("before", pa.int64()), ("last", pa.bool_())])
_BLOCKS_SQL = ("conv_id long, parent binary, node binary, start long, nodes array<binary>, chars array<long>, "
               "before long, last boolean")


def blocks_of(turns: DataFrame, block: int, partitions: int) -> DataFrame:
    """One row per conversation and block: digests of all turns up to each turn
    of the block, and code points of all texts up to it."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, open_block = None, None, None
        out: list[dict] = []

        def begin(parent: bytes, start: int, before: int) -> dict:
            return {"conv_id": conv, "parent": parent, "node": parent, "start": start, "nodes": [], "chars": [],
                    "before": before, "last": False}

        for batch in batches:
            rows = zip(column_of(batch, "conv_id").to_pylist(), raw_texts(column_of(batch, "role")),
                       raw_texts(column_of(batch, "text")), column_of(batch, "n").to_pylist(), strict=True)
            for name, role, text, n in rows:
                if name != conv or state is None:
                    if open_block:
                        out.append(open_block | {"last": True})
                    conv, state = name, hashlib.blake2b(digest_size=16)
                    open_block = begin(ROOT, 0, 0)
                elif len(open_block["nodes"]) == block:
                    out.append(open_block)
                    open_block = begin(open_block["node"], open_block["start"] + block, open_block["chars"][-1])
                for part in (role, text):
                    state.update(len(part).to_bytes(8, "little"))
                    state.update(part)
                open_block["node"] = state.copy().digest()
                open_block["nodes"].append(open_block["node"])
                open_block["chars"].append((open_block["chars"][-1] if open_block["chars"] else open_block["before"]) + n)
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
            out = []
        if open_block:
            yield pa.RecordBatch.from_pylist([open_block | {"last": True}], schema=_BLOCKS)

    ordered = turns.repartition(partitions, "conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text", F.length("text").cast("long").alias("n")).mapInArrow(task, _BLOCKS_SQL)


def with_parent(children: DataFrame, parents: DataFrame, size: str) -> DataFrame:
    """Join ``parents`` (unique ``parent``, with ``size`` children) to ``children``;
    heavy parents, fewer than ``HEAVY``, by broadcast."""
    total = parents.agg(F.sum(size)).first()[0] or 0
    is_heavy = F.col(size) > total // HEAVY
    heavy, light = F.broadcast(parents.where(is_heavy)), parents.where(~is_heavy)
    return children.join(heavy, "parent").unionByName(
        children.join(heavy.select("parent"), "parent", "left_anti").join(light, "parent"))


def turn_nodes(groups: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Nodes of single turns from distinct blocks (``diverges``: the parent goes
    on with other blocks as well): ``at, parent, depth, chars, before`` and measures."""
    names = list(measures)
    i = F.col("i")
    turns = groups.select("*", F.posexplode("nodes").alias("i", "at")).select(
        "at", F.when(i == 0, F.col("parent")).otherwise(F.get("nodes", i - 1)).alias("parent"),
        (F.col("start") + i + 1).alias("depth"), F.get("chars", i).alias("chars"),
        F.when(i == 0, F.col("before")).otherwise(F.get("chars", i - 1)).alias("before"), "diverges", *names)
    same = [F.first(c).alias(c) for c in ("parent", "depth", "chars", "before")]
    columns = ["at", "parent", "depth", "chars", "before", *names]
    return turns.where("not diverges").select(*columns).unionByName(
        turns.where("diverges").groupBy("at").agg(*same, *[m.alias(n) for n, m in measures.items()]).select(*columns))


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK,
                partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``turns (conv_id long, turn, role, text)`` and, if some may have no turn, all
    ``conversations (conv_id)`` (``partitions`` of the exchange of turns: unless
    given, the turns are stored first and sized):

    * nodes: ``node`` (digest of the turns up to it), ``parent`` (null: root),
      ``depth``, ``conv_id`` (smallest member; the node's text is its turn
      ``depth``), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
      ``chars`` (of the node's own text), ``saved_tokens`` (summed over the
      subtree: one less than the members, times the code points of the text);
    * ends: ``conv_id, node, depth`` of every conversation's last turn."""
    bound_batches(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = turns.where("conv_id is not null").select("conv_id", "turn", text("role"), text("text"))
    if partitions is None:
        turns = store(turns, "turns")
        partitions = partitions_for(turns)
    blocks = store(blocks_of(turns, block, partitions), "blocks")
    ends = blocks.where("last").select("conv_id", "node", (F.col("start") + F.size("nodes")).alias("depth"),
                                       F.element_at("chars", -1).alias("total"))
    if conversations is not None:
        ids = conversations.where("conv_id is not null").select("conv_id").distinct()
        ends = ends.unionByName(ids.join(ends, "conv_id", "left_anti").select(
            "conv_id", F.lit(ROOT).alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("total")))
    ends = store(ends, "ends")
    # first grouping: equal blocks; then, which of them have siblings
    groups = store(blocks.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("parent", "start", "nodes", "chars", "before")],
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first_id")), "groups")
    siblings = groups.groupBy("parent").agg(F.count(F.lit(1)).alias("n_blocks"))
    groups = store(with_parent(groups, siblings, "n_blocks").withColumn("diverges", F.col("n_blocks") > 1), "siblings")
    nodes = store(turn_nodes(groups, {"n_convs": F.sum("n_convs"), "first_id": F.min("first_id")}), "nodes")
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(nodes.join(kids.select(F.col("parent").alias("at"), "n_children"), "at", "left")
                  .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # what each conversation owns, and its sums over the members of blocks
    owners = nodes.groupBy(F.col("first_id").alias("conv_id")).agg(
        F.min("before").alias("above"), F.sum(F.col("chars") - F.col("before")).alias("own"),
        F.count_if(F.col("n_children") == 0).alias("leaves"))
    members = store(ends.join(owners, "conv_id", "left").na.fill(0, ["above", "own", "leaves"]), "members")
    sums = {c: F.sum(c) for c in ("total", "own", "leaves")}
    per_block = blocks.select("conv_id", "node").join(members.select("conv_id", *sums), "conv_id") \
        .groupBy("node").agg(*[m.alias(c) for c, m in sums.items()])
    summed = turn_nodes(groups.join(per_block, "node"), sums).select("at", *sums)
    nodes = nodes.join(summed, "at").join(members.select(F.col("conv_id").alias("first_id"), "above"), "first_id")
    # the root, from all members
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first_id"),
                       *[m.alias(c) for c, m in sums.items()]).where("n_convs > 0")
    n_top = nodes.where("depth = 1").count()
    zero = F.lit(0).cast("long")
    root = root.withColumn("n_children", F.lit(n_top).cast("long")).select(
        F.lit(ROOT).alias("at"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("chars"), zero.alias("before"),
        "n_convs", "first_id", "n_children", "total", "own", F.greatest("leaves", (F.col("n_children") == 0).cast("long")).alias("leaves"),
        zero.alias("above"))
    nodes = store(nodes.select(*root.columns).unionByName(root), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("at").alias("parent"), F.col("first_id").alias("parent_conv_id"),
                                                   F.col("n_children").alias("size"))
    whole = with_parent(nodes.where("parent is not null"), parents, "size").drop("size").unionByName(
        nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    # (n - 1) * text summed over the subtree: of all members, less the distinct nodes
    saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("own") - (F.col("before") - F.col("above")))
    drop_stored(blocks)
    return whole.select(F.col("at").alias("node"), "parent", "depth", F.col("first_id").alias("conv_id"), "parent_conv_id", "n_convs",
                        "n_children", F.col("leaves").alias("n_leaves"), (F.col("chars") - F.col("before")).alias("chars"),
                        saved.alias("saved_tokens")), ends.drop("total")


_JOINED = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])


def ids_sha256(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """SHA-256 (lowercase hex) of the decimal ids of each ``key``, ascending,
    comma-joined: ``key, sha256``.  Ranges of the order are joined into chunks,
    and a key's chunks are hashed as a stream."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, None, [], 0
        for batch in batches:
            out = []
            for k, i in zip(column_of(batch, "key").to_pylist(), column_of(batch, "id").to_pylist(), strict=True):
                if k != now or size > CHUNK:
                    if held:
                        out.append({"key": now, "first": first, "ids": ",".join(held).encode()})
                    now, first, held, size = k, i, [], 0
                held.append(str(i))
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_pylist(out, schema=_JOINED)
        if held:
            yield pa.RecordBatch.from_pylist([{"key": now, "first": first, "ids": ",".join(held).encode()}], schema=_JOINED)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        schema = pa.schema([("key", pa.binary()), ("sha256", pa.string())])
        for batch in batches:
            out = []
            for k, ids in zip(column_of(batch, "key").to_pylist(), column_of(batch, "ids").to_pylist(), strict=True):
                if k != now:
                    if state:
                        out.append({"key": now, "sha256": state.hexdigest()})
                    now, state = k, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"key": now, "sha256": state.hexdigest()}], schema=schema)

    rows = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"))
    n = partitions_for(rows, 32 << 20)
    chunks = rows.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(joined, "key binary, first long, ids binary")
    return chunks.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, sha256 string")
