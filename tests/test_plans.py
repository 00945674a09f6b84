"""Plan-shape guards for the scale properties the design relies on."""
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from codeweave import suite
from codeweave.operators import brace
from codeweave.plans import structure as Q
from codeweave.sources.bucketed import forget_bucketed
from codeweave.sources.corpus import eligible_files, read_bucketed_corpus, read_table, write_corpus

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_plan_has_one_exchange_and_linear_frames(spark, tmp_path):
    suite.corpus_for(spark, SF).write.partitionBy("lang").parquet(f"{tmp_path}/flat")
    files = eligible_files(read_table(spark, f"{tmp_path}/flat")).where(F.col("lang") != "python")
    p = plan(brace.annotate(files))
    assert len(re.findall(r"Exchange hashpartitioning\(repo", p)) == 1
    assert "UnboundedFollowing" not in p and "unboundedfollowing" not in p.lower()


def test_a_bucketed_corpus_is_not_shuffled_again(spark, tmp_path):
    corpus = suite.corpus_for(spark, SF)
    files = eligible_files(corpus).where(F.col("lang") != "python")
    p = plan(brace.annotate(files))
    assert "Exchange" not in p and "Bucketed: true" in p
    # another session finds the buckets by the path alone
    write_corpus(corpus, f"{tmp_path}/c", partitions=3)
    forget_bucketed(spark, f"{tmp_path}/c")
    again = read_bucketed_corpus(spark, f"{tmp_path}/c")
    assert brace.in_place(eligible_files(again)) and not brace.in_place(eligible_files(read_table(spark, f"{tmp_path}/c")))
    assert again.exceptAll(corpus.select(*again.columns)).count() == 0 and again.count() == corpus.count()
    lines = [brace.annotate(eligible_files(c).where(F.col("lang") != "python")) for c in (again, read_table(spark, f"{tmp_path}/c"))]
    sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("repo", "path", "ln", "line", "s_after").cast("decimal(38,0)"))).first() for x in lines]
    assert sums[0] == sums[1] and sums[0][0] > 0


def test_symbols_are_looked_up_without_moving_the_index(spark):
    idx = suite.index_for(spark, SF)
    flat = replace(idx, definitions=None, details=None)
    names = idx.callables.select(F.concat_ws(".", "class_name", "name").alias("symbol")).unionByName(
        spark.createDataFrame([("none.such",), (".crear_cust_1",), (None,)], "symbol string"))
    classes = idx.classes.select("name").unionByName(spark.createDataFrame([("NoClass",), (None,)], "name string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, wanted in ((Q.calls_of, names), (Q.class_detail, classes)):
            found = query(idx, wanted)
            # each exchange lies below the wanted side of the join
            scan = next(x for x in re.split(r"(?=SortMergeJoin|ShuffledHashJoin)", plan(found)) if "Bucketed: true" in x)
            at = scan.index("Bucketed: true")
            branch = scan[:at].rsplit("Exchange", 1)
            assert len(branch) == 1 or "Scan" in branch[1].split("FileScan")[0]
            rows = [sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in (found, query(flat, wanted))]
            assert rows[0] == rows[1] and rows[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for query, one in ((Q.calls_of, "Cust5.get_order_1"), (Q.calls_of, "crear_cust_4"), (Q.class_detail, "Cust5")):
        assert "SelectedBucketsCount" in query(idx, one)._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(str, query(idx, one).select(*sorted(query(idx, one).columns)).collect())) == sorted(
            map(str, query(flat, one).select(*sorted(query(flat, one).columns)).collect()))
    assert Q.calls_of(idx, ".crear_cust_4").count() == 0


def test_line_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(brace, "LINE_BYTES", 1 << 12)
    counts = []
    for n in (200, 2000):
        rows = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.col("id"), F.lit(".js")).alias("path"),
                                     F.sha2(F.col("id").cast("string"), 512).alias("content"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/c{n}")
        files = eligible_files(spark.read.parquet(f"{tmp_path}/c{n}"))
        counts.append(int(re.search(r"Exchange hashpartitioning\(repo[^)]*, (\d+)\)", plan(brace.line_table(files))).group(1)))
    assert counts[1] > 5 * counts[0] or counts[0] == 2 * spark.sparkContext.defaultParallelism < counts[1]
    made = spark.createDataFrame([("r", "a.js", "x")], "repo string, path string, content string")
    assert brace.cpu_partitions(spark, made) == max(2 * spark.sparkContext.defaultParallelism, 8)


def test_language_branches_prune_partitions(spark):
    files = eligible_files(suite.corpus_for(spark, SF)).where(F.col("lang") == "python")
    p = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in p and "= python" in p


def test_first_match_is_combined_map_side(spark):
    idx = replace(suite.index_for(spark, SF), definitions=None)
    p = plan(Q.calls_of(idx, "Cust5.get_order_1"))
    assert "partial_min" in p


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cartesian_or_nested_loop_joins(spark, name):
    p = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_snapshot_is_pruned_by_language(spark):
    idx = suite.index_for(spark, SF)
    p = plan(idx.callables.where(F.col("lang") == "js").select("calls"))
    assert "PartitionFilters: [isnotnull(lang" in p and "ReadSchema: struct<calls:array<string>>" in p


def test_a_single_symbol_is_filtered_at_the_scan(spark):
    p = plan(Q.calls_of(suite.index_for(spark, SF), "Cust5.get_order_1"))
    assert "EqualTo(name,get_order_1)" in p


def test_rollup_counts_folders_before_it_expands_them(spark):
    p = plan(queries()["folder_rollup"](spark, SF))
    assert p.index("Generate") < p.rindex("HashAggregate")


def test_the_index_is_built_without_methods_that_are_never_compiled(spark, monkeypatch):
    from codeweave.operators import tables
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(key)
    written = tables._written
    monkeypatch.setattr(tables, "_written", lambda *a: seen.append(spark.conf.get(key)) or written(*a))
    rows = spark.createDataFrame([("r", "a.js", "function f() {\n  g();\n}\n")], "repo string, path string, content string")
    idx = tables.build_index(rows, save_to=f"{suite.checkpoint_dir(spark)}/compiled")
    assert idx.callables.first().calls == ["f", "g"]
    assert set(seen) == {"8000"} and spark.conf.get(key) == before
