"""Exact, near and substring duplicates; decontamination; sharding."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeweave.llm import decontaminate, exact_dedup, sharding, simhash, suffix_dedup
from codeweave.llm.common import connected_components, numbered


def first_of(group):
    return min((d for d in group if d is not None), default=None)


def test_exact_dedup(odd, none, clashing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for table in (odd, clashing):
        rows = exact_dedup.exact_dedup(table).collect()
        groups = defaultdict(list)
        for r in rows:
            groups[norm(r["row"]["text"])].append(r)
            assert bytes(r["digest"]).hex() == hashlib.sha256(norm(r["row"]["text"]).encode()).hexdigest()
        assert len(rows) == odd.count()
        for g in groups.values():
            assert sum(r["kept"] for r in g) == 1
            assert {(r["keep_id"], r["group_size"]) for r in g} == {
                (first_of(r["row"]["doc_id"] for r in g), len(g))}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_compares_full_texts_when_digests_collide(odd):
    weak = exact_dedup.exact_dedup(odd, digest=lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary"))
    key = lambda r: (str(r["row"]), r["keep_id"], r["group_size"], r["kept"])
    assert sorted(map(key, weak.collect()), key=str) == sorted(map(key, exact_dedup.exact_dedup(odd).collect()), key=str)


def slow_simhash(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprints(odd):
    for r in simhash.fingerprints(odd).collect():
        assert r["fp"] & (1 << 64) - 1 == slow_simhash(r["row"]["text"])


def test_ball_hashing_finds_all_links(spark):
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):  # clusters with members at all distances, and chains
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << bit
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.meet(simhash.variants(frame.repartition(3), 5)).collect()
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    mask = (1 << 64) - 1
    for r in links:
        assert ((r["a"] ^ r["b"]) & mask).bit_count() <= 3
    assert components(fps, want) == components(fps, [(r["a"] & mask, r["b"] & mask) for r in links])


def test_simhash_groups(spark, odd, none, clashing):
    rows = simhash.simhash_groups(clashing).collect()
    assert len(rows) == odd.count()
    fps = {r["fp"] for r in rows}
    links = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    root = components(fps, links)
    for x in set(root.values()):
        group = [r for r in rows if root[r["fp"]] == x]
        assert {r["component_id"] for r in group} == {first_of(r["row"]["doc_id"] for r in group)}
        assert sum(r["kept"] for r in group) == 1
    assert simhash.simhash_groups(none).count() == 0


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_removal(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removal_rows(table):
    return sorted((r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])
                  for r in suffix_dedup.remove_repeats(table).collect())


def test_repeated_strings_go(spark, odd, none, clashing):
    short = clashing.where("length(text) < 5000 or text is null")
    assert removal_rows(short) == sorted(slow_removal([r["text"] for r in short.collect()]))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings_of_random_pieces(spark, seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcdefg é") for _ in range(rng.choice([60, 150, 199, 200, 201, 260, 700]))) for _ in range(60)]
    texts = []
    for _ in range(150):
        t = "".join(rng.choice([rng.choice(pieces)[rng.randrange(40):], "".join(rng.choice("xyz") for _ in range(rng.randrange(150))),
                                "", "qrs" * rng.randrange(90)]) for _ in range(rng.randrange(6)))
        texts += [t] * rng.choice([1, 1, 1, 3])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert removal_rows(table) == sorted(slow_removal(texts))


def test_copies_of_a_text_cost_in_proportion_and_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHORS", 50)
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    entries, told = [], []
    runs, repeated = suffix_dedup.sorted_runs, suffix_dedup.repeated_anchors

    def seen_runs(texts, buckets):
        entries.append(texts.select(F.expr("aggregate(places, 0L, (n, p) -> n + octet_length(p))").alias("n")).agg(F.sum("n")).first()[0])
        return runs(texts, buckets)

    def seen_repeated(hashed):
        told.append([r["n"] for r in hashed.where("kind = 1").groupBy("bucket").agg(F.sum(F.octet_length("entries")).alias("n")).collect()])
        return repeated(hashed)

    monkeypatch.setattr(suffix_dedup, "sorted_runs", seen_runs)
    monkeypatch.setattr(suffix_dedup, "repeated_anchors", seen_repeated)
    for copies in (16, 64):
        table = spark.createDataFrame([(None, text)] * copies + [(1, "x" + text[:500])], "doc_id long, text string").coalesce(1)
        assert removal_rows(table) == sorted(slow_removal([text] * copies + ["x" + text[:500]]))
    assert entries[1] < 5 * entries[0]
    assert max(told[1]) < sum(told[1]) / 4


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh") for _ in range(6000))
    texts = [common + "x" * 300 + common[:2500], "".join(rng.choice("abcdefgh") for _ in range(9000)) + common[1000:5000], common[300:900]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert removal_rows(table) == sorted(slow_removal(texts))


def test_merge_is_looked_at_in_slices(spark, monkeypatch):
    """Small slices give the same result, and only a gram's own entries stay together."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 3)
    monkeypatch.setattr(suffix_dedup, "RUN", 20)
    rng = random.Random(11)
    pieces = ["".join(rng.choice("abcdefgh") for _ in range(260)) for _ in range(12)]
    texts = ["".join(rng.sample(pieces, 4)) + str(i) for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert removal_rows(table) == sorted(slow_removal(texts))


def test_loser_tree_and_front_coding():
    rng = random.Random(3)
    runs, everything = [], []
    for _ in range(7):
        rows = sorted({bytes(rng.choice(b"ab") for _ in range(7)).ljust(suffix_dedup.ROW, b"x") for _ in range(rng.randrange(40))})
        owners = np.zeros(len(rows), suffix_dedup._OWNER)
        table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, suffix_dedup.ROW)
        shared, decoded, _ = suffix_dedup.front_decoded(suffix_dedup.front_coded(table, owners))
        assert decoded == rows
        runs.append((shared, decoded))
        everything += rows
    order, shared = suffix_dedup.merge(runs)
    out = [runs[r][1][i] for r, i in order]
    assert out == sorted(everything)
    common = lambda a, b: next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    assert shared[1:] == [common(a, b) for a, b in zip(out, out[1:])]


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(text, items):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found, longest = set(), set(), 0
    for item, t in items:
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(10, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for i in range(len(words) - size + 1):
                if words[i:i + size] == own[k:k + size]:
                    hit.update(range(i, i + size))
                    found.add("" if item is None else str(item))
                    n = size
                    while size == 10 and i + n < len(words) and k + n < len(own) and words[i + n] == own[k + n]:
                        n += 1
                    longest = max(longest, n)
    return len(words), len(hit), sorted(found), longest


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontamination(spark, odd, none, clashing, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1000)
    items = [(1, "seven small birds watch from a tall green tree in the park the"), (10, "Hello world"), (2, "ELEVE"), (3, None),
             (4, "wort5 und5 wort6 und6 wort7 und7 wort8 und8 wort9 und9 wort10 und10"), (None, "straße"), (2, "12, 34"), (5, "!!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.decontaminate(clashing.where("length(text) < 5000 or text is null"), benchmark).collect():
        n, hit, found, longest = slow_hits(r["row"]["text"], items)
        assert (r["n_words"], r["n_hit"], r["items"], r["longest"], r["contaminated"]) == (n, hit, found, longest, hit > 0)
    assert decontaminate.decontaminate(none, benchmark).count() == 0
    assert decontaminate.decontaminate(odd, benchmark.where("false")).where("contaminated").count() == 0


def test_a_template_of_many_items_and_documents_stays_in_proportion(spark):
    template = "answer the following question with one word and give no reason for it at all please thank you"
    n = 600
    items = [(i, f"{template} item{i} asks{i} what{i}") for i in range(n)]
    docs = [(i, f"intro{i} {template} item{i} end") for i in range(n)] + [(n, "nothing of it")]
    bench = decontaminate.Benchmark([(str(i), t.encode()) for i, t in items])
    # windows inside the template are there once; the three behind it are each item's own
    assert len(bench.low) == len(template.split()) - 9 + 3 * n
    words = np.concatenate([[*(bench.number.get(w, 0) for w in decontaminate.words_of(t.encode())), 0] for _, t in docs]).astype(np.uint32)
    which, place = decontaminate.search(words, bench)
    assert len(which) <= len(words)  # not one for each item and place
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string")).collect()
    size = len(template.split())
    assert {(r["n_hit"], r["longest"], len(r["items"])) for r in out if r["row"]["doc_id"] < n} == {(size + 1, size + 1, n)}
    assert [(r["contaminated"], r["items"]) for r in out if r["row"]["doc_id"] == n] == [(False, [])]


def test_longest_match_in_periodic_texts(spark):
    items = [(1, "a b " * 30), (2, "a " * 12), (3, "a b " * 30), (4, "b a")]
    docs = [(1, "a b " * 500), (2, "a " * 11 + "b a"), (3, "c " + "b a " * 9)]
    got = {r["row"]["doc_id"]: r for r in decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for doc_id, text in docs:
        r = got[doc_id]
        assert (r["n_words"], r["n_hit"], r["items"], r["longest"]) == slow_hits(text, items)


def test_sharding(spark, odd, none, clashing):
    for table, shards in ((clashing, 3), (odd, 24)):
        rows = sharding.assign_shards(table, shards).collect()
        assert len(rows) == odd.count()
        by_text, slots = defaultdict(set), defaultdict(list)
        for r in rows:
            text = r["row"]["text"]
            assert r["size"] == len((text or "").encode()) + 8
            by_text[text].add(r["shard"])
            slots[r["shard"]].append(r["slot"])
        assert all(len(s) == 1 for s in by_text.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(none, 24).count() == 0


def test_shards_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    loads = [r["b"] for r in sharding.assign_shards(docs, 8, keep=["doc_id"]).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = docs.groupBy("text").agg((F.count(F.lit(1)) * (F.octet_length("text") + 8)).alias("b")).agg(F.max("b")).first()[0]
    assert len(loads) == 8 and max(loads) - min(loads) <= largest


def test_numbered(spark):
    table = spark.range(1000).selectExpr("id", "id % 3 AS k").repartition(7)
    rows = numbered(table, "k").collect()
    for k in range(3):
        assert sorted(r["slot"] for r in rows if r["k"] == k) == list(range(sum(r["k"] == k for r in rows)))


def outcome(df, *columns):
    return sorted((tuple(r) for r in df.select("row.doc_id", "row.text", "keep_id", "group_size", "kept").collect()), key=str)


@pytest.mark.parametrize("key", [None, lambda t: F.substring(t, 1, 1).cast("binary")])
def test_state_goes_on_over_batches_and_runs(spark, odd, tmp_path, key):
    """Several micro-batches and two runs on one folder give the rows of one run, also when digests collide."""
    docs = odd.repartition(7)
    want = outcome(exact_dedup.exact_dedup(docs, digest=key))
    assert outcome(exact_dedup.exact_dedup(docs, digest=key, files_per_batch=1)) == want
    folder = str(tmp_path / "state")
    ids = F.coalesce("doc_id", F.lit(0)) % 2
    first = exact_dedup.exact_dedup(docs.where(ids == 1), digest=key, state_dir=folder, files_per_batch=2)
    assert outcome(first) == outcome(exact_dedup.exact_dedup(docs.where(ids == 1), digest=key))
    assert outcome(exact_dedup.exact_dedup(docs.where(ids == 0), digest=key, state_dir=folder, files_per_batch=2)) == want
    assert outcome(exact_dedup.exact_dedup(docs.where("false"), digest=key, state_dir=folder)) == want  # an empty run adds nothing


def test_batches_look_up_earlier_keys(spark, tmp_path):
    """A digest met once in each of two batches is a hit of the second one."""
    folder = str(tmp_path / "state")
    for run in (1, 2):
        exact_dedup.exact_dedup(spark.createDataFrame([(run, "same"), (run + 10, f"own {run}")], "doc_id long, text string"), state_dir=folder)
    keys = spark.read.parquet(f"{folder}/keys")
    assert sorted((r.batch, r.n, r.hit) for r in keys.collect())[-2:] == [(keys.agg(F.max("batch")).first()[0], 1, False),
                                                                          (keys.agg(F.max("batch")).first()[0], 1, True)]
