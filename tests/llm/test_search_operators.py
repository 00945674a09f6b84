"""Prefix trie, exact top-k and importance resampling against brute force, and on odd tables."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweave.llm import ball_tree, prefix_trie, queries, resample

TURNS = "conv_id long, turn long, role string, text string"


# --- prefix trie -------------------------------------------------------------
def brute_trie(turns, ids):
    """{prefix: (smallest member, parent's, members, children, leaves, saved)} and {prefix: ids ending there}."""
    talk = {c: [] for c in ids}
    for c, turn, role, text in sorted(turns, key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        talk[c].append((role or "", text or ""))
    members = defaultdict(list)
    for c in sorted(talk):
        for d in range(len(talk[c]) + 1):
            members[tuple(talk[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = defaultdict(list)
    for c in sorted(talk):
        ends[tuple(talk[c])].append(c)
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=str)


def spark_trie(spark, turns, ids=None, block=prefix_trie.BLOCK):
    df = spark.createDataFrame(turns, TURNS)
    known = None if ids is None else spark.createDataFrame([(c,) for c in ids], "conv_id long")
    nodes, ends = prefix_trie.prefix_trie(df, known, block)
    hashes = {bytes(r["key"]): r["sha256"] for r in prefix_trie.ids_sha256(ends, "node", "conv_id").collect()}
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                    hashes.get(bytes(r["node"]), hashlib.sha256(b"").hexdigest())) for r in nodes.collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_brute_force(spark, block):
    rng = random.Random(block)
    turns = [(c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(["", "ja", "nein é", "x" * 50]))
             for c in range(60) for t in range(rng.randrange(1, 12))]
    turns += [(c, t, "user", f"hello {t}") for c in range(100, 140) for t in range(9 if c % 2 else 6)]  # hot group of copies
    assert spark_trie(spark, turns, block=block) == brute_trie(turns, {t[0] for t in turns})


def test_trie_defined_cases(spark):
    turns = [(1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (2, 1, "", ""), (2, 5, "user", "a"),
             (3, 1, "user", "long " * 50_000), (4, 9, "user", "long " * 50_000), (5, 0, "us", "era")]
    ids = [1, 2, 3, 4, 5, 6, 7]  # 6 and 7 have no turn
    assert spark_trie(spark, [*turns, (None, 1, "user", "nobody")], ids) == brute_trie(turns, ids)
    assert spark_trie(spark, []) == []
    assert spark_trie(spark, [], [4]) == brute_trie([], [4])


def test_one_long_conversation(spark):
    turns = [(7, t, "user", f"turn {t}") for t in range(3_000)] + [(8, t, "user", f"turn {t}") for t in range(2_500)]
    got = spark_trie(spark, turns)
    assert len(got) == 3_001 and (7, 2_500, 7, 2, 1, 1, len("turn 2499"), hashlib.sha256(b"8").hexdigest()) in got


def test_trie_ignores_other_columns(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(turns, TURNS)
    for name in ("node", "parent", "n", "at", "size", "diverges", "first_id"):
        df = df.withColumn(name, F.lit("x"))
    assert prefix_trie.prefix_trie(df)[0].count() == 2


def test_chunks_of_joined_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    rows = spark.range(1000).select(F.lit(b"k").alias("node"), "id")
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert [(bytes(r[0]), r[1]) for r in prefix_trie.ids_sha256(rows, "node", "id").collect()] == [(b"k", want)]


def test_rebuilt_turns(spark):
    turns = [(c, t, "user", f"{c} {t}") for c in (0, 3, 100, 250) for t in (range(3) if c else range(5))]
    got = defaultdict(list)
    for r in queries.rebuilt_turns(spark.createDataFrame(turns, TURNS))[0].orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append(r["text"])
    for c in (0, 3, 100, 250):
        h, base = crc32(str(c).encode()) % 6, c - c % 100
        own = lambda x: [t[3] for t in turns if t[0] == x]
        assert got.get(c, []) == own(base)[:h] + own(c)[h:]


# --- exact top-k -------------------------------------------------------------
def brute_top(rows, k, is_query):
    fit = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in fit]
    out = []
    for a, (qid, q) in enumerate(whole):
        if is_query(qid):
            found = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i is None, i or 0) for b, (i, v) in enumerate(whole)
                           if a != b and len(v) == len(q))
            out += [(qid, r, None if none else i, -s) for r, (s, none, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def spark_top(spark, rows, k=3, every=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ball_tree.top_k(df, F.col("vec_id") % every == 0, k, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def as_float(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("LEAF", 8), ("SHARD", 60), ("SLOT_ROWS", 100), ("BLOCK", 7)):
        monkeypatch.setattr(ball_tree, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = [(i, as_float(centres[i % 6] + rng.standard_normal(12) * 0.2)) for i in range(500)]
    rows += [(500 + i, as_float(centres[0])) for i in range(300)]  # a hot group of equal vectors: ties
    assert spark_top(spark, rows, k=10, every=20) == brute_top(rows, 10, lambda i: i % 20 == 0)


def test_top_k_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [-3.0, 0.5]), (None, [1.0, 2.0]), (7, None), (10, [nan, 1.0]),
            (15, [inf, 1.0]), (20, [None, 1.0]), (25, [1.0]), (30, [2.0]), (35, []), (40, []), (45, [0.0, 0.0, 0.0]), (8, [-0.0001, 0.0])]
    assert spark_top(spark, rows) == brute_top([(i, as_float(v)) for i, v in rows], 3, lambda i: i is not None and i % 5 == 0)
    assert spark_top(spark, []) == []
    assert spark_top(spark, [(1, [1.0])]) == []
    with pytest.raises(Exception, match="would not be exact"):
        spark_top(spark, [(0, [1e6]), (1, [2.0])])


def test_large_components_are_summed_in_integers(spark):
    rows = [(i, [16000.0 + i / 1024, 15999.0, 15000.0 + i, 16000.0]) for i in range(40)]
    rows = [(i, as_float(v)) for i, v in rows]
    assert spark_top(spark, rows) == brute_top(rows, 3, lambda i: i % 5 == 0)


def test_shared_scores_leave_nodes_out(monkeypatch):
    """A known k-th score and the order by bounds keep most leaves unread."""
    monkeypatch.setattr(ball_tree, "LEAF", 16)
    rng = np.random.default_rng(1)
    x = np.floor(np.repeat(rng.standard_normal((20, 8)) * 2000, 50, 0) + rng.standard_normal((1000, 8)) * 20)
    tree = ball_tree.BallTree(x, np.arange(1000), np.arange(1000))
    scores = x @ x[0]
    kth = int(np.sort(scores[1:])[-10])
    bound = tree.bounds(x[:1])[0]
    nodes = tree.nodes
    for node in range(len(nodes)):  # bounds hold
        assert (tree.x[nodes[node][0]:nodes[node][1]] @ x[0]).max() <= bound[node]
    leaves = np.array([n[2] < 0 for n in nodes])
    assert (bound[leaves] >= kth).sum() < leaves.sum() / 3
    best = []
    tree.search(x[0], 0, bound, best, 10, kth)
    assert [-b[0] for b in best] == sorted(scores[1:].astype(int).tolist())[-10:][::-1]


def test_stored_tree_is_the_same(spark):
    x = np.arange(3000).reshape(1000, 3) % 97
    tree = ball_tree.BallTree(x, np.arange(1000), np.arange(1000))
    again = ball_tree.BallTree(stored=tree.stored())
    assert (again.x == tree.x).all() and (again.nodes == tree.nodes).all() and (again.reach == tree.reach).all()


# --- importance resampling -----------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, percent, least, buckets, most):
    def feats(text):
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return words, [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in feats(t)[1])
    t = Counter(bucket(f) for x in target for f in feats(x)[1])
    s0, t0 = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s0 + buckets) / ((s[b] + 1) * (t0 + buckets))))
    rows = []
    for i, (name, text) in enumerate(docs):
        words, found = feats(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        rows.append((name, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words), i))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[5]: n for n, r in enumerate(order[:percent * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(r[5])) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resample_equals_brute_force(spark, odd, most):
    docs = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).repartition(5)
    target = ["The quick brown FOX, straße 12", "élève", None, ""]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 40, 5, buckets=64, most=most)
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], target, 40, 5, 64, most)
    # rows with equal id and text share their score: which of them has which rank is open
    rows = sorted(((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    assert rows == want


def test_resample_defined_cases(spark, odd, none, clashing):
    target = odd.select("text")
    assert resample.resample(none, target, 50, 1).count() == 0
    empty = resample.resample(odd, target.where("false"), 100, 1)
    assert empty.where("rank is not null").count() == odd.where("text rlike '[0-9A-Za-z\\\\x80-\\\\x{10ffff}]'").count()
    out = resample.resample(clashing, target, 50, 2)
    assert out.select("row.*").columns == clashing.columns and out.count() == clashing.count()


def test_ranks_are_gapless_within_a_hot_id(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    ranks = sorted(r["rank"] for r in resample.resample(docs, docs, 50, 1).where("rank is not null").collect())
    assert ranks == list(range(1, 1501))


def test_features_chain_seeds():
    words = resample.words_of("Der große HUND, 12x".encode())
    assert words == [b"der", "große".encode(), b"hund", b"12x"]
    grams = [b" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert resample.features(words, 3) == [crc32(g) for g in grams]
