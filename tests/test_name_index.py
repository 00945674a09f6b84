"""The dictionary of names: the rows of the scans, and plans that read names and places only."""
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweave import suite
from codeweave.operators import name_index
from codeweave.operators.tables import load_index, save_index, with_names
from codeweave.plans import scope as V
from codeweave.plans import search as S
from codeweave.plans import structure as Q

SF = "/root/testdata/sf0.001"
LONG = "long_" * 200


@pytest.fixture(scope="module")
def odd_index(spark, sample_index):
    """The sample index with odd names: not ASCII, very long, short, null, with a NUL or a star."""
    names = ["straße_Ünï", "MASSE_ſet", "K_kelvin", "İstanbul_x", LONG, "a", "", None, "nul\0name", "star*[x]y", "UPPER_set", "ab\ncde"]
    extra = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    one = sample_index.callables.limit(1).drop("name", "calls", "path")
    rows = extra.select(F.concat(F.lit("odd/"), "i").alias("path"), F.col("n").alias("name"), F.array("n", F.lit("Get_Set")).alias("calls"))
    made = rows.join(one.repartition(1), F.lit(True)).select(*sample_index.callables.columns)
    return replace(sample_index, callables=sample_index.callables.unionByName(made).persist())


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(cols) == sorted(b.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_the_rows_of_the_scans(odd_index, tmp_path):
    named = with_names(odd_index, f"{tmp_path}/names")
    for pattern in ("Set", "e", "", "*set", "stra?e*", "k_kel*", "İst", LONG[:300], "*ong_lon*", "nul\0n", "*[xyz]y", "no such name", "???"):
        assert same(S.search(named, pattern), S.search(odd_index, pattern)), pattern
    for term in ("set", "os", "star*[x]y"):
        assert same(Q.usages(named, term), Q.usages(odd_index, term)), term
        assert same(V.library_hits_by_file(named, term), V.library_hits_by_file(odd_index, term)), term
    assert same(V.library_union_files(named, ["os", "Set"]), V.library_union_files(odd_index, ["os", "Set"]))


def test_many_names_meet_their_places(odd_index, tmp_path, monkeypatch):
    named = with_names(odd_index, f"{tmp_path}/names")
    monkeypatch.setattr(name_index, "FEW", 1)
    assert same(S.search(named, "e"), S.search(odd_index, "e"))


@given(st.text(st.sampled_from("abAB*?[]!_ſİé"), max_size=9))
@settings(max_examples=300, deadline=None)
def test_runs_are_held_by_every_match(pattern):
    """Brute force: a match in plain ASCII holds every run of the pattern."""
    import itertools
    import re

    from codeweave.functions.text import glob_to_regex, is_glob
    runs = name_index.runs_of(pattern)
    if not runs:
        return
    rx = re.compile(glob_to_regex(pattern).replace("(?isu)", "(?is)").replace("\\z", "\\Z")) if is_glob(pattern) else None
    low = pattern.lower()
    for fill in itertools.product(["", "a", "B_"], repeat=2):
        name = fill[0].join(re.sub(r"[*?]", lambda m: fill[1] or "b", pattern)) if fill[0] == "" else fill[0] + pattern + fill[1]
        if name.isascii() and (rx.search(name) if rx else low in name.lower()):
            assert all(r in name.lower() for r in runs)


def test_a_rare_term_reads_names_and_places_only(spark):
    idx = suite.names_for(spark, SF)
    for df in (S.search(idx, "get_order_17"), Q.usages(idx, "part_17"), S.library_usage(idx, "lib_1")):
        p = df._jdf.queryExecution().sparkPlan().toString()
        assert "SelectedBucketsCount" in p and "calls:array" not in p and "/places" in p and "/callables" not in p
    names = idx.names.matching("get_order_17", S.name_matcher("get_order_17"))
    p = names._jdf.queryExecution().sparkPlan().toString()
    assert "/postings" in p and "SelectedBucketsCount" in p and "/names]" not in p


def test_a_snapshot_keeps_its_names(spark, sample_index, tmp_path):
    save_index(sample_index, f"{tmp_path}/s", search_names=True)
    back = load_index(spark, f"{tmp_path}/s")
    assert back.names is not None and same(S.search(back, "get"), S.search(sample_index, "get"))
    empty = replace(sample_index, **{t: df.where("false") for t, df in sample_index.tables().items()})
    save_index(empty, f"{tmp_path}/e", search_names=True)
    assert S.search(load_index(spark, f"{tmp_path}/e"), "get").count() == 0


def test_runs_take_less_room_than_names(spark, tmp_path):
    """Names of a block that share a run post it once, and shuffles of the writing are freed."""
    made = spark.range(20_000).select(F.lit("r").alias("repo"), F.lit("p.py").alias("path"), F.lit(0).alias("class_ord"),
                                      F.concat(F.lit("shared_prefix_of_"), F.col("id").cast("string")).alias("name"),
                                      F.lit("s").alias("signature"), F.lit(1).alias("line"))
    none = made.where("false")
    tables = name_index.write(spark, made, none.selectExpr(*none.columns, "'' kind", "'' class_name", "0 call_ord", "array('') calls"),
                              none.selectExpr(*none.columns, "'' module", "0 ord"), f"{tmp_path}/n")
    assert tables["grams"].count() < 20_000 and "name" not in tables["places"].columns
    index = name_index.NameIndex(**tables)
    for pattern in ("_of_1234", "*_199?9", "no_such"):
        match = S.name_matcher(pattern)
        found = [r["name"] for r in index.places_of(pattern, match).collect()]
        assert sorted(found) == sorted(r["name"] for r in made.where(match(F.col("name"))).collect())


def test_runs_of_a_name_are_read_in_one_pass(spark):
    names = ["", "ab", "abc", "ABCabc", "a\nb\nc", "part_1.PART_10", "straße", "x" * 600, "nul\0name", None]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", name_index.runs(F.col("name")).alias("r"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for n, r in df.collect():
        if n is None or not n.isascii() or len(n) > name_index.LONGEST:
            assert r == [""]
        else:
            low = n.lower()
            assert r == list(dict.fromkeys(low[i:i + 3] for i in range(len(low) - 2)))
