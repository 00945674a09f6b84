"""Corpus sources: folder scan, eligibility, decoding, snapshots."""
import glob
import os
import random

from pyspark.sql import functions as F

import pytest
from codeweave.functions.config import EXCLUDED_PARTS, EXTENSIONS
from codeweave.operators.tables import build_index, load_index, save_index
from codeweave.plans import report as X
from codeweave.sources import corpus
from codeweave.sources.corpus import classify, read_folder


def test_read_folder_and_eligibility(spark, tmp_path):
    root = tmp_path / "proj"
    for rel, body in {"a.py": b"import os\n", "src/b.JS": b"function f() { g(); }\n",
                      "build/c.py": b"x = 1\n", "x.egg-info/d.py": b"y = 2\n",
                      "notes.txt": b"hi", ".py": b"z = 3\n",
                      "bad.py": b"s = '\xff\xfe'\n"}.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    corpus = read_folder(spark, str(root), repo="proj")
    reasons = {r.path: r.skip_reason for r in classify(corpus).collect()}
    assert reasons["a.py"] is None and reasons["src/b.JS"] is None
    # excluded folders, other extensions and a dot-file without a suffix are not even listed
    assert not {"build/c.py", "notes.txt", ".py"} & set(reasons)
    assert reasons["x.egg-info/d.py"] is None                 # the glob entry never matches
    idx = build_index(corpus)
    langs = {r.path: r.lang for r in idx.files.collect()}
    assert langs["src/b.JS"] == "js"
    bad = idx.variables.where(F.col("path") == "bad.py").first()
    assert bad.value == repr("\ufffd\ufffd")                    # invalid UTF-8 replaced


def test_hidden_names_and_relative_roots(spark, tmp_path, monkeypatch):
    names = ["pkg/__init__.py", "pkg/_private.py", "__tests__/a.js", ".eslintrc.js", ".hidden/b.py", "m.py", "build/out.py"]
    for rel in names:
        p = tmp_path / "build" / "proj" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    want = sorted(n for n in names if not n.startswith("build/"))
    root = tmp_path / "build" / "proj"       # the root itself may lie below a folder with an excluded name
    assert sorted(r.path for r in read_folder(spark, str(root)).collect()) == want
    assert sorted(r.path for r in read_folder(spark, f"file://{root}/").collect()) == want
    assert {r.repo for r in read_folder(spark, str(root)).collect()} == {"proj"}
    import os.path
    relative = os.path.relpath(root, spark._jvm.java.lang.System.getProperty("user.dir"))
    assert sorted(r.path for r in read_folder(spark, relative).collect()) == want
    (tmp_path / "empty").mkdir()
    assert read_folder(spark, str(tmp_path / "empty")).count() == 0


def test_a_tree_is_listed_in_tasks(spark, tmp_path, monkeypatch):
    """Against the file system's own walk: odd names, deep and wide folders, several rounds, nothing on the driver."""
    root = tmp_path / "my proj%20 #1"
    rng = random.Random(5)
    parts = ["a", "_b", ".c", "d e", "f#g", "h%41", "ñandú", "build", "node_modules", "x.py"]
    for i in range(150):
        place = root.joinpath(*rng.choices(parts, k=rng.randrange(7)))
        place.mkdir(parents=True, exist_ok=True)
        for name in rng.sample(["m.py", "_p.js", ".q.ts", "r s.cpp", "t%.dart", "u#.PY", "notes.md", "v.py.gz", "plain", ".py"], 3):
            if not (place / name).is_dir():
                (place / name).write_bytes(b"" if name == "m.py" else f"{i} {name}\n".encode())
    want = {}
    for at, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in EXCLUDED_PARTS]
        for n in names:
            if "." in n[1:] and "." + n.rsplit(".", 1)[1].lower() in EXTENSIONS:
                want[os.path.relpath(os.path.join(at, n), root)] = open(os.path.join(at, n)).read()
    assert len(want) > 100
    for folders in (1, 1000):
        monkeypatch.setattr(corpus, "TASK_FOLDERS", folders)
        rows = read_folder(spark, str(root)).collect()
        assert len(rows) == len(want) and {r.path: r.content for r in rows} == want
        assert {r.repo for r in rows} == {"my proj%20 #1"}
    p = corpus.list_files(spark, str(root))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in p and "LogicalRDD" not in p
    with pytest.raises(ValueError):
        read_folder(spark, "har:///x")
    with pytest.raises(Exception):
        read_folder(spark, str(tmp_path / "missing"))


def test_snapshot_roundtrip(spark, sample_index, tmp_path):
    out = str(tmp_path / "snap")
    save_index(sample_index, out)
    back = load_index(spark, out)
    assert back.callables.count() == sample_index.callables.count()
    assert back.nested.count() == back.files.count() == sample_index.nested.count()


def test_rebuild_is_a_new_version(spark, sample_index, tmp_path, monkeypatch):
    from codeweave.operators import snapshot
    from codeweave.plans import structure as Q

    out = str(tmp_path / "snap")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_index(spark, out)
    save_index(sample_index, out, "2024-05-01T10:00:00Z")
    first = load_index(spark, out)
    assert first.analyzed_at == Q.status(first).first().analyzed_at == "2024-05-01T10:00:00Z"
    assert Q.status(first, analyzed_at="now").first().analyzed_at == "now"
    few = build_index(spark.createDataFrame([("r", "a.py", "X = 1\n")], "repo string, path string, content string"))
    # a rebuild that fails before it is whole leaves the old answer
    with monkeypatch.context() as m:
        m.setattr(snapshot, "nested_files", lambda tables: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            save_index(few, out)
    assert load_index(spark, out).files.count() == first.files.count()
    save_index(few, out)
    now = load_index(spark, out)
    assert now.files.count() == 1 and now.analyzed_at.endswith("Z") and now.analyzed_at > first.analyzed_at
    assert first.files.count() > 1  # who has loaded the old version still reads it
    assert load_index(spark, out, version=1).files.count() == first.files.count()
    assert sorted(r.number for r in snapshot.versions(spark, out).collect()) == [1, 2]
    snapshot.drop_old(spark, out, keep=1)
    assert [r.number for r in snapshot.versions(spark, out).collect()] == [2]
    assert load_index(spark, out).files.count() == 1 and len(glob.glob(out + "/version-*")) == 2  # and the failed one


def test_json_and_symbol_counts_read_nested_records_only(spark, sample_index, tmp_path):
    from codeweave.plans import scope as V

    out = str(tmp_path / "snap")
    save_index(sample_index, out)
    back = load_index(spark, out)
    for df, same in ((X.file_json(back), X.file_json(sample_index)), (V.symbols_per_file(back), V.symbols_per_file(sample_index))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert sorted(df.collect()) == sorted(same.collect())
    counts = {r.path: (r.n_classes, r.n_functions, r.n_variables, r.n_imports) for r in V.symbols_per_file(back).collect()}
    flat = sample_index.variables.where("path = 'app/service.py'").count()
    assert counts["app/service.py"][2] == flat and counts["app/broken.py"] == (0, 0, 0, 0)


def test_markdown_subset_counts_selected_files(sample_index, spark):
    active = spark.createDataFrame([("demo", "app/service.py")], "repo string, path string")
    lines = X.report_lines(sample_index, "estructura", fmt="md", active=active)
    text = [r.text for r in lines.orderBy("part", "path", "line_no").collect()]
    assert "**Archivos:** 1 | **Clases:** 1 | **Metodos:** 4 | **Funciones:** 2" in text[2]
    assert [t for t in text if t.startswith("## ")] == ["## `app/service.py`"]


def test_hidden_variables_filter(sample_index):
    blk = X.file_blocks(sample_index, "firmas", filters={"variables": False}).where(
        "path = 'app/service.py'").first().block
    assert "var TIMEOUT" not in blk and "  .kind" in blk.replace("    .kind", "  .kind")


def test_calls_of_orders_split_over_methods(spark, monkeypatch):
    """Every call site of an order is answered, also those of its methods ``..._<part>``."""
    import re
    from collections import defaultdict

    from codeweave import suite
    from codeweave.sources import generated
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(generated, "METHOD_MAX_SITES", 2)
    monkeypatch.setattr(suite, "_CACHE", {})
    orders = {r["o_orderkey"]: r for r in spark.read.parquet(f"{sf}/orders.parquet").collect()
              if r["o_custkey"] % 23 != 7 and r["o_custkey"] % 50 != 9 and r["o_custkey"] % 40 != 16}
    want = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        if r["l_orderkey"] in orders:  # a Dart call is named by the part alone
            want[r["l_orderkey"]].add(r["l_partkey"])

    def sites(df):
        got = defaultdict(set)
        for r in df.where("symbol LIKE 'Cust%'").collect():
            got[int(re.search(r"order_(\d+)", r["symbol"])[1])] |= {
                int(p) for p in re.findall(r"part_(\d+)", r["calls"])}
        return {o: found for o, found in got.items() if found}
    assert any(len(x) > 4 for x in want.values())
    assert sites(suite.calls_of_symbols(spark, sf)) == want
    top = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_totalprice", "o_orderkey", ascending=[False, True]).first()[0]
    assert sites(suite.calls_of_symbol(spark, sf)) == {o: x for o, x in want.items() if o == top}


def test_buckets_of_the_corpus_follow_the_tables(spark, tmp_path):
    from codeweave.operators import brace
    from codeweave.sources.generated import corpus_bytes
    for t in ("customer", "orders", "lineitem"):
        one = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").coalesce(1)
        one.write.parquet(f"{tmp_path}/a/{t}.parquet")
        for _ in range(3):
            one.write.mode("append").parquet(f"{tmp_path}/b/{t}.parquet")
    assert corpus_bytes(spark, f"{tmp_path}/b") == 3 * corpus_bytes(spark, f"{tmp_path}/a")
    least = brace.cpu_partitions(spark, size=0)
    assert brace.cpu_partitions(spark, size=5 * least * brace.LINE_BYTES) == 5 * least


def test_buckets_are_written_in_the_order_of_their_keys(spark, tmp_path):
    """Every file is in order, without a sort that hashes the keys at each comparison."""
    from codeweave.sources import bucketed
    rows = spark.range(3000).select(F.concat(F.lit("key_"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("string")).alias("key"), "id",
                                    F.pmod("id", F.lit(3)).alias("p"))
    seen = []
    for parts in ([], ["p"]):
        table = bucketed.write_bucketed(rows, f"{tmp_path}/t{len(parts)}", ["key"], 4, parts)
        assert table.count() == 3000 and table.select(*rows.columns).exceptAll(rows).count() == 0
        info = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {bucketed._name(spark, f'{tmp_path}/t{len(parts)}')}").collect()}
        assert info["Num Buckets"] == "4" and info.get("Sort Columns", "[]") == "[]"
        files = sorted(glob.glob(f"{tmp_path}/t{len(parts)}/**/*.parquet", recursive=True))
        seen.append(len(files))
        for f in files:
            keys = [r.key for r in spark.read.parquet(f).coalesce(1).collect()]
            assert keys == sorted(keys)
    assert seen == [4, 12]


def test_the_corpus_reads_the_call_sites_once(spark):
    import re

    from codeweave.sources.generated import generate_corpus
    plan = generate_corpus(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") and len(re.findall(r"Relation \[l_orderkey", plan)) == 1
