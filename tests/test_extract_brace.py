"""JS / C++ / Dart extraction on the sample sources (native line plan)."""
from conftest import rows_of
from pyspark.sql import functions as F


def callables(idx, path):
    return {r["name"]: r for r in idx.callables.where(idx.callables.path == path).collect()}


def test_eligibility(sample_index):
    paths = {r[0] for r in rows_of(sample_index.files, "path")}
    assert "node_modules/x/skip.js" not in paths and "app/readme.md" not in paths
    assert rows_of(sample_index.files, "folder", path="top.py") == [(".",)]


def test_js_imports(sample_index):
    got = rows_of(sample_index.imports.orderBy("ord"), "module", "names", "is_from",
                  path="app/inventory.js")
    assert got == [("fs/promises", ["readFile", "writeFile"], True), ("path", [], True),
                   ("./util.js", [], True), ("side-effect.css", [], False),
                   ("./types", ["Config"], True)]


def test_js_class_members(sample_index):
    c = callables(sample_index, "app/inventory.js")
    order = rows_of(sample_index.callables.where("kind = 'method'").orderBy("call_ord"), "name",
                    path="app/inventory.js")
    assert [o[0] for o in order] == ["constructor", "total", "load", "parse"]
    assert c["constructor"]["calls"] == []
    assert c["load"]["calls"] == ["load", "fetch", "this.parse"]   # default-param braces ignored
    assert c["load"]["is_async"] is True
    assert c["parse"]["calls"] == ["parse", "console.log", "transform", "apply"]
    attrs = rows_of(sample_index.variables.where("scope = 'class'").orderBy("ord"),
                    "name", "type", "value", path="app/inventory.js")
    assert attrs == [("count", None, "0"), ("cache", "Map<string, number>", "new Map()"),
                     ("items", None, None), ("options", None, "options"), ("size", None, "10")]


def test_js_functions_and_variables(sample_index):
    c = callables(sample_index, "app/inventory.js")
    assert c["helper"]["signature"] == "const helper = (x) =>" and c["helper"]["calls"] == ["format"]
    assert c["main"]["calls"] == ["main", "Store", "s.load"]
    assert c["worker"]["signature"] == "async function worker()"
    mv = rows_of(sample_index.variables.where("scope = 'module'").orderBy("ord"), "name", "value",
                 path="app/inventory.js")
    assert mv == [("MAX_ITEMS", "250"), ("counter", "0"), ("label", "")]


def test_cpp_keywords_and_literals_by_default_and_as_the_original(spark):
    from codeweave.operators.tables import build_index

    text = "enum Plain { A };\nenum class Scoped { B };\nclass Uses : structure {\n};\nint a() {\n  char c = 'x\n';\n}\nint late() {\n}\n"
    corpus = spark.createDataFrame([("r", "a.cpp", text)], "repo string, path string, content string")
    signatures, lines = {}, {}
    for quirks in (False, True):
        idx = build_index(corpus, ref_compat=quirks)
        signatures[quirks] = [r.signature for r in idx.classes.orderBy("class_ord").collect()]
        lines[quirks] = {r.name: r.line for r in idx.callables.collect()}["late"]
    assert signatures[False] == ["enum Plain", "enum class Scoped", "class Uses : structure"]
    assert signatures[True] == ["enum class Plain", "enum class Scoped", "struct Uses : structure"]
    assert lines == {False: 9, True: 8}  # it stands on line 9


def test_cpp(sample_index):
    p = "app/geometry.cpp"
    cls = rows_of(sample_index.classes.orderBy("class_ord"), "name", "signature", "bases", path=p)
    assert cls == [("Color", "enum class Color", []), ("Point", "struct Point", []),
                   ("Shape", "class Shape : Drawable", ["Drawable"])]
    c = callables(sample_index, p)
    assert c["Point"]["calls"] == ["Point", "x", "y"]
    assert c["draw"]["signature"] == "void draw()"
    assert c["draw"]["calls"] == ["draw", "render", "helpers::outline"]
    assert c["area"]["kind"] == "function" and c["area"]["calls"] == ["area", "compute"]
    mv = rows_of(sample_index.variables.where("scope = 'module'").orderBy("ord"),
                 "name", "type", "value", "ref_line", path=p)
    assert mv == [("SCALE", "#define", "3", 0), ("NAME", "#define", '"geo"', 0),
                  ("EMPTY", "#define", None, 0), ("PI_VALUE", "double", "3.14159", 6),
                  ("global_count", "int", None, 7), ("banner", "char*", "", 8)]
    assert rows_of(sample_index.imports.orderBy("ord"), "module", path=p) == [
        ("vector",), ("shapes/point.h",)]


def test_dart(sample_index):
    p = "app/widgets.dart"
    cls = rows_of(sample_index.classes.orderBy("class_ord"), "name", "signature", "bases", "line",
                  path=p)
    assert cls == [
        ("Status", "enum Status", [], 10),
        ("Loggable", "mixin Loggable", ["Base"], 12),
        ("NumberParsing", "extension NumberParsing on String", ["String"], 19),
        ("Panel", "class Panel extends Widget with Loggable implements Drawable",
         ["Widget", "Loggable", "Drawable"], 25)]
    c = callables(sample_index, p)
    assert c["empty"]["signature"] == "Panel()" and c["empty"]["calls"] == ["empty", "reset"]
    assert c["refresh"]["is_async"] and c["refresh"]["signature"] == "Future<void> refresh(int level)"
    assert c["log"]["signature"] == "log(String msg)" and c["log"]["ref_line"] == 2
    assert c["runApp"]["calls"] == ["runApp", "refresh", "startLoop"]
    imps = rows_of(sample_index.imports.orderBy("ord"), "module", "names", path=p)
    assert imps == [("package:flutter/material.dart", ["Widget", "BuildContext"]),
                    ("dart:async", []), ("export:src/extra.dart", [])]
    mv = rows_of(sample_index.variables.where("scope = 'module'").orderBy("ord"), "name", "type",
                 "value", path=p)
    assert mv == [("maxRetries", "int", "3"), ("title", "String", None), ("counter", None, "0")]


def test_calls_unique_per_callable(sample_index):
    for r in sample_index.callables.collect():
        assert len(r["calls"]) == len(set(r["calls"]))


def test_every_symbol_has_a_file(sample_index):
    files = sample_index.files.select("repo", "path")
    for t in (sample_index.classes, sample_index.callables, sample_index.variables,
              sample_index.imports):
        assert t.join(files, ["repo", "path"], "left_anti").count() == 0


def test_drop_self_call_option(spark):
    from codeweave.operators.tables import build_index
    src = "function run(a) {\n  run(a - 1);\n  go();\n}\n"
    c = spark.createDataFrame([("r", "a.js", src)], "repo string, path string, content string")
    assert build_index(c).callables.first().calls == ["run", "go"]
    assert build_index(c, drop_self_call=True).callables.first().calls == ["go"]


def test_bodies_and_values_are_whole(spark):
    """Nested default parameters, arrow bodies and values over several lines, long values."""
    from codeweave.operators.tables import build_index
    js = ("function four(a = { k: f(g(h(i(1)))) }) {\n  gamma();\n}\n"
          "function one(a = {b: 1}) { return z(); }\nconst LONG = " + "k" * 120 + ";\n")
    dart = ("final List<String> names = [\n  1,\n];\nfinal x = 3;\n"
            "Widget build(x) =>\n    Container(child: Text(x),\n      onTap: (y) {\n        tap(y);\n      });\n"
            "int plain(a) {\n  return foo(a);\n}\nclass A extends B {\n  Widget draw(ctx) =>\n    Row(children: [\n"
            "      Cell(1),\n    ]);\n  int two() => 2;\n  void three() {\n    local(q) =>\n      inner(q);\n"
            "    after();\n  }\n}\n")
    idx = build_index(spark.createDataFrame([("r", "a.js", js), ("r", "b.dart", dart)],
                                            "repo string, path string, content string"))
    calls = {r["name"]: r["calls"] for r in idx.callables.collect()}
    assert calls == {"four": ["four", "f", "g", "h", "i", "gamma"], "one": ["one", "z"],
                     "build": ["build", "Container", "Text", "tap"], "plain": ["plain", "foo"],
                     "draw": ["draw", "Row", "Cell"], "two": ["two"], "three": ["three", "local", "inner", "after"]}
    values = {r["name"]: r["value"] for r in idx.variables.collect()}
    assert values == {"LONG": "k" * 120, "names": "[\n  1,\n]", "x": "3"}


def bucketed(spark, rows, path):
    from codeweave.sources.corpus import read_bucketed_corpus, write_corpus
    write_corpus(spark.createDataFrame(rows, "repo string, path string, content string"), path, partitions=3)
    return read_bucketed_corpus(spark, path)


def test_a_long_body_is_few_rows_and_whole(spark, tmp_path):
    """Lines without braces deep in a body are one row; their calls and the lines after them are right."""
    from codeweave.operators import brace
    from codeweave.operators.tables import build_index
    from codeweave.sources.corpus import eligible_files
    body = "".join(f"    go{i}(x);\n" for i in range(400))
    js = f"class A {{\n  m(x) {{\n{body}  }}\n  n() {{\n    last();\n  }}\n}}\n"
    cpp = f"class A {{\n  int m(int x) {{\n{body}  }}\n  int n() {{\n    last();\n  }}\n}};\n"
    dart = f"class A {{\n  int m(int x) {{\n{body}  }}\n  int n() {{\n    last();\n  }}\n}}\n"
    corpus = bucketed(spark, [("r", "a.js", js), ("r", "a.cpp", cpp), ("r", "a.dart", dart)], f"{tmp_path}/c")
    rows = brace.annotate(eligible_files(corpus)).groupBy("path").count().collect()
    assert len(rows) == 3 and max(r["count"] for r in rows) < 12
    for r in build_index(corpus).callables.collect():
        calls, line = {"m": (["m", *[f"go{i}" for i in range(400)]], 2), "n": (["n", "last"], 404)}[r["name"]]
        assert (r["calls"], r["line"]) == (calls, line)


def test_runs_give_what_single_lines_give(spark, tmp_path, monkeypatch):
    """Odd blocks of every dialect, also in files that share (repo, path), read by runs and line by line."""
    import random

    from codeweave.operators import brace
    from codeweave.operators.tables import build_index
    common = ["{", "}", "}}", "{{", "", "foo(a);", "  a.b(c);", "    return x;", "  } else {", "if (x) {", "foo({", "});", "(", ")",
              "/* a {", "*/ b(", "\x0b  k(1);", "q\x85 (w);", "y = {a: 1};", "  this.x = 1;", "#define N 3", "a(); b();", "}{"]
    pools = {"js": ["class K extends B {", "class M { m() { q(); } }", "  constructor(a) {", "  m1(a, b = {c: d()}) {", "function f(a) {",
                    "let g = (a) => {", "  cnt;", "const A = 1;", "className.foo();"],
             "cpp": ["class K : public B {", "struct P { int f() {", "  K(int a) {", "  int m1(int a) const {", "int f1(int a) {", "  int cnt;",
                     "static int t = 3;", "};"],
             "dart": ["class K extends B {", "  K(int a) {", "  int m1(int a) {", "int f1(a) => g(", "  int f2(b) =>", "final int A = 1;",
                      "const list = [", "  ];", "var m = {", "    h(b);"]}
    rng, rows = random.Random(3), [("r", "null.js", None), ("r", "empty.js", ""), ("r", "line.js", "\n")]
    for ext, pool in pools.items():
        for k in range(60):
            lines = [rng.choice(pool if rng.random() < 0.5 else common) for _ in range(rng.randint(1, 40))]
            rows += [("r", f"f{k}.{ext}", "\n".join(lines))] * (2 if k % 10 == 0 else 1)
    corpus = bucketed(spark, rows, f"{tmp_path}/c")
    got = []
    for runs in (brace.RUNS, brace.LINES):
        monkeypatch.setattr(brace, "RUNS", runs)
        idx = build_index(corpus)
        got.append({t: sorted(map(str, x.collect())) for t, x in idx.tables().items()})
    assert got[0] == got[1] and got[0]["callables"] and got[0]["variables"]


def test_a_body_and_its_closing_brace_are_one_row(spark, tmp_path):
    """A method is its header and one row; the lines after it and the ends of blocks are right."""
    from codeweave.operators import brace
    from codeweave.operators.tables import build_index
    from codeweave.sources.corpus import eligible_files
    methods = lambda head: "".join(f"  {head}m{i}(x) {{\n    go{i}(x);\n\n    last();\n  }}\n" for i in range(20))
    after = {"js": "}\nfunction f(a) {\n  h();\n}\nconst A = 1;\n", "cpp": "};\nint f(int a) {\n  h();\n}\nconst int A = 1;\n",
             "dart": "}\nint f(int a) {\n  h();\n}\nfinal int A = 1;\n"}
    rows = [("r", f"a.{x}", "class K {\n" + methods("" if x == "js" else "int ") + rest) for x, rest in after.items()]
    corpus = bucketed(spark, rows, f"{tmp_path}/c")
    counts = brace.annotate(eligible_files(corpus)).groupBy("path").count().collect()
    assert len(counts) == 3 and max(r["count"] for r in counts) <= 2 * 20 + 7
    idx = build_index(corpus)
    for r in idx.callables.collect():
        assert (r.calls, r.line) == ((["f", "h"], 103) if r.name == "f" else ([r.name, f"go{r.name[1:]}", "last"], 2 + 5 * int(r.name[1:])))
    assert idx.callables.count() == 63
    assert [(r.name, r.line) for r in idx.variables.collect()] == [("A", 106)] * 3


def test_found_calls_are_filtered_in_one_step(spark):
    from codeweave.operators import brace
    rows = [("js", "a$.b (c)\nd\n(e) if (x) f(f(1))"), ("c", "A::b(1); while (y) c (2); c(3)"), ("dart", "é_1(a).b (c); switch (d) {}")]
    df = spark.createDataFrame(rows, "d string, body string")
    found = df.select("d", brace._calls_of(F.col("body"), F.col("d")).alias("calls"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "btrim" not in plan and "transform" not in plan
    assert {r.d: r.calls for r in found.collect()} == {"js": ["a$.b", "d", "f"], "c": ["A::b", "c"], "dart": ["é_1", "b"]}


def test_lines_after_the_last_import_are_not_taken_apart(spark):
    """Imports and defines of any place, with odd line separators; lines that follow the last one never become rows."""
    from codeweave.operators import brace
    from codeweave.sources.corpus import eligible_files
    body = "".join(f"int f{i}(int a) {{\n  g(a);\n}}\n" for i in range(50))
    texts = {"a.cpp": f"#include <x.h>\n{body}#define LAST 3\x0b{body}", "b.cpp": body, "c.cpp": "", "d.cpp": "\x0b#define A 1 \x0b\x0b\n", "e.cpp": "#",
             "f.js": f"import 'p';\n{body}import {{ q }} from 'r';", "g.js": "x" * 200_000}
    files = eligible_files(spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string"))
    imports, defines = brace._raw_branch(files, tuple(brace.DIALECTS))
    assert sorted((r.path, r.ord, r.module) for r in imports.collect()) == [("a.cpp", 0, "x.h"), ("f.js", 0, "p"), ("f.js", 1, "r")]
    assert sorted((r.path, r.name, r.value, r.line) for r in defines.collect()) == [("a.cpp", "LAST", "3", 152), ("d.cpp", "A", "1", 2)]
    assert brace.MARKED in imports._jdf.queryExecution().optimizedPlan().toString()
    heads = files.select("path", brace._rx(F.col("text"), brace.MARKED, 0).alias("head")).collect()
    assert {r.path: r["head"].count("\n") for r in heads} == {"a.cpp": 151, "b.cpp": 0, "c.cpp": 0, "d.cpp": 0, "e.cpp": 0, "f.js": 151, "g.js": 0}
