"""Language identification and quality: held-out accuracy, odd input; the pipeline."""
import zlib

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from codeweave.llm import language_id, quality, queries


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.train([(b"abc def", "x"), (b"\xc3\xa9t\xc3\xa9", "y")], hidden=3)
    for k in ("tables", "recurrent", "bias", "out", "out_bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    data, mask = language_id.pad([b"abca", b"de"], 4)
    labels = np.array([0, 1])
    _, g = language_id.gradients(net, data, mask, labels)
    for name in ("recurrent", "bias", "out", "tables"):
        value = getattr(net, name)
        at = tuple(rng.integers(0, n) for n in value.shape)
        if name == "tables":
            at = (0, 2, ord("a"), 1)
        kept, step = value[at], 1e-2
        losses = []
        for move in (step, -step):
            value[at] = kept + move
            losses.append(language_id.gradients(net, data, mask, labels)[0])
        value[at] = kept
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 2e-3


def test_pooling_against_a_plain_loop():
    """The network byte by byte with the same weights, in doubles and without batches."""
    net = language_id.train([(b"abc def " * 8, "x"), ("\u00e9t\u00e9 ".encode() * 8, "y"), (b"zz 12", "z")], hidden=3)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def slow(text):
        total = np.zeros(len(net.langs))
        for at in range(0, len(text), language_id.SEGMENT):
            part = text[at:at + language_id.SEGMENT]
            padded = part.ljust(language_id.SEGMENT, b"\0")
            seen = []
            for d in (0, 1):
                h, found = np.zeros(3), {}
                for t in range(len(padded)) if d == 0 else reversed(range(len(padded))):
                    x = padded[t]
                    tables, u = net.tables[d].astype(float), net.recurrent[d].astype(float)
                    r, z = (sig(tables[g, x] + h @ u[g]) for g in (0, 1))
                    n = np.tanh(tables[2, x] + r * (h @ u[2] + net.bias[d]))
                    h = (1 - z) * n + z * h
                    found[t] = h
                seen.append(found)
            for t in range(len(part)):
                logit = seen[0][t] @ net.out[0] + seen[1][t] @ net.out[1] + net.out_bias
                total += logit - np.log(np.exp(logit).sum())
        p = np.exp(total / len(text))
        return p / p.sum()

    texts = [b"a", b"abc def", "l'\u00e9t\u00e9 dernier, ".encode() * 9, bytes(range(1, 200)), b"x" * 64, b"y" * 65]
    got = language_id.pool(net, texts)
    assert np.allclose(got, [slow(t) for t in texts], atol=1e-4) and got.shape == (6, 3)


def test_language_id(spark, odd, none, clashing, sf):
    rows = queries.op2_language_id(spark, sf.replace("0.001", "0.01")).join(
        spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    got = language_id.identify(clashing, F.lit(True)).collect()
    assert len(got) == odd.count()
    for r in got:
        letter = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
    assert language_id.identify(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, F.lit(False)).collect()} == {"und"}


def test_the_sample_does_not_vanish_in_a_large_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 4)  # with 1,200 the same share is met at 2.4 billion rows
    docs = spark.range(8_000_000).selectExpr("id AS doc_id", "'some words' AS text", "'en' AS lang")
    assert 1 <= len(language_id.training_rows(docs, F.lit(True), "text", "lang", "doc_id")) <= 4


def test_an_unlabelled_corpus_keeps_its_documents(spark, odd, sf):
    want = sorted(str(r["doc_id"]) for r in odd.collect() if any(c.isalpha() for c in r["text"] or ""))
    other = F.coalesce(queries.remainder(4), F.lit(2)) != 2
    for lang in (F.lit(None).cast("string"), F.when(other, F.lit(None)).otherwise(F.col("lang"))):
        got = corpus_pipeline.identify_language(spark, odd.withColumn("lang", lang), sf).collect()
        assert sorted(str(r["doc_id"]) for r in got) == want


def test_the_prediction_fills_a_missing_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("lang is not null and text rlike '[a-z]{3}'")
    hidden = known.withColumn("lang", F.when(queries.remainder(4) != 2, F.col("lang")))
    got = corpus_pipeline.identify_language(spark, hidden, "").select("doc_id", F.col("lang").alias("filled"))
    pairs = got.join(known, "doc_id").where(queries.remainder(4) == 2).select("filled", "lang").collect()
    assert len(pairs) > 50 and all(r["filled"] for r in pairs)
    assert np.mean([r["filled"] == r["lang"] for r in pairs]) > 0.9
    rest = got.join(known, "doc_id").where(queries.remainder(4) != 2).where("filled <> lang")
    assert rest.count() == 0  # a given language stays


def test_stages_on_the_odd_table(spark, odd, sf):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    texts = Counter()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*odd.columns, "n_chars"]
        now = Counter(r["text"] for r in docs.collect())
        assert not texts or all(texts[t] >= n for t, n in now.items())
        texts = now
    assert None not in texts and "" not in texts and max(texts.values()) == 1
    assert sorted(r["doc_id"] for r in docs.where("text like '%Hello%'").collect()) == [3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_quality(spark, odd, none, clashing, sf):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    rows = queries.op10_quality_classifier(spark, sf.replace("0.001", "0.01")).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    some = spark.createDataFrame([(14, 1), (14, 0), (16, 1), (13, 0), (None, 1), (20, None)], "doc_id long, quality int")
    assert quality.classify(clashing, some, F.lit(True)).count() == odd.count()
    assert {r["score"] for r in quality.classify(odd, some.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality.classify(none, some, F.lit(True)).count() == 0


def test_quality_against_a_plain_fit(spark, sf):
    """Normal equations row by row, isotonic values by their max-min formula, scores by hand."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").where("doc_id % 3 <> 0")
    usable = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    got = {r["row"]["doc_id"]: r["score"] for r in quality.classify(docs, labels, usable).collect()}
    rows = docs.select("*", usable.alias("u"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("c")).collect()
    y = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    stats = np.array([quality.statistics((r["text"] or "").encode()) for r in rows])
    z = quality.fourier(stats, stats.mean(0), np.maximum(stats.std(0), 1e-6))
    size = z.shape[1]
    a, b = np.zeros((size, size)), np.zeros(size)
    for r, v in zip(rows, z, strict=True):
        if r["u"] and not r["c"] and r["doc_id"] in y:
            a, b = a + np.outer(v, v), b + v * y[r["doc_id"]]
    raw = z @ np.linalg.solve(a + quality.RIDGE * np.trace(a) / size * np.eye(size), b)
    place = np.clip((raw + .5) / 2 * quality.BINS - .5, 0, quality.BINS - 1)
    by_bin: dict[int, list[float]] = {}
    for r, p in zip(rows, place, strict=True):
        if r["u"] and r["c"] and r["doc_id"] in y:
            by_bin.setdefault(int(np.rint(p)), []).append(y[r["doc_id"]])
    at = sorted(by_bin)
    mean = lambda i, j: np.mean([v for k in at[i:j + 1] for v in by_bin[k]])
    fit = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    xs, ys = [], []
    for value in sorted(set(np.round(fit, 9))):
        inside = [at[k] for k in range(len(at)) if abs(fit[k] - value) < 1e-8 for _ in by_bin[at[k]]]
        xs.append(np.mean(inside))
        ys.append(value)
    want = 0.99 * np.interp(place, xs, ys) + 0.01 / (1 + np.exp(2 - 4 * raw))
    assert len(ys) > 1 and len(got) == len(rows)
    assert max(abs(got[r["doc_id"]] - w) for r, w in zip(rows, want, strict=True)) < 1e-4


def test_quality_keeps_an_order_without_calibration(spark, sf):
    """No labelled row falls to calibration: the ridge score orders the documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = docs.where("text is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0).select(
        "doc_id", (F.col("doc_id") % 2).alias("quality")).orderBy("doc_id").limit(6)
    rows = quality.classify(docs, labels, F.lit(True)).collect()
    texts = {r["text"] for r in docs.collect()}
    assert len({r["score"] for r in rows}) > len(texts) / 2 and all(0 < r["score"] < 1 for r in rows)


def test_pooling_of_violators():
    y = np.array([0, 1, 0, 1, 1, 0, 1.0])
    steps = quality.pooled(np.ones(7), y)
    assert (np.diff(steps) >= 0).all() and np.allclose(steps, [0, .5, .5, 2 / 3, 2 / 3, 2 / 3, 1])


def test_pipeline_keeps_the_right_documents(spark, sf):
    """Against the single steps done plainly on the driver."""
    import re

    from tests.llm.test_duplicate_operators import components, slow_hits, slow_simhash

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    first = {}
    for d in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[d]), d)
    docs = {d: docs[d] for d in first.values()}
    fp = {d: slow_simhash(t) for d, t in docs.items()}
    root = components(set(docs), [(a, b) for a in docs for b in docs if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    docs = {d: docs[d] for d in docs if root[d] == d}
    docs = {d: t for d, t in docs.items() if not slow_hits(t, items)[1]}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_of_an_empty_table(spark, sf, none):
    docs = none.withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0


def test_queries_match_their_sql(spark, sf):
    import duckdb

    from codeweave.llm.oracle import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r) for r in df.select(names).collect()))) == sorted(map(str, want.fetchall())), name
