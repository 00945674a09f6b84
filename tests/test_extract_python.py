"""Python extraction: sources through the node records to the symbol tables."""
import pytest

from codeweave.operators.python_nodes import node_records, python_nodes
from codeweave.operators.python_symbols import python_tables
from conftest import rows_of


@pytest.fixture(scope="session")
def rec(spark):
    def tables_of(src):
        t = python_tables(python_nodes(spark.createDataFrame([("r", "m.py", src)], "repo string, path string, text string")))
        order = lambda r: tuple(-1 if r.get(c) is None else r[c] for c in ("class_ord", "call_ord", "ord"))
        got = {k: sorted((r.asDict(recursive=True) for r in v.collect()), key=order) for k, v in t.items()}
        for c in got["classes"]:
            mine = lambda rows: [r for r in rows if r["class_ord"] == c["class_ord"]]
            c["methods"], c["attributes"] = mine(got["callables"]), mine(got["variables"])
        return {"error": got["files"][0]["error"], "classes": got["classes"], "imports": got["imports"],
                "functions": [r for r in got["callables"] if r["kind"] == "function"],
                "variables": [r for r in got["variables"] if r["scope"] == "module"]}
    return tables_of


def test_node_records_give_parents_and_extents():
    import ast
    nodes = node_records(ast.parse("class A(B):\n    if x:\n        y = 1\n    def f(self): g()\nz = 2\n"))
    by = {(n["kind"], n["name"]): n for n in nodes}
    assert by["Name", "B"]["parent"] == by["ClassDef", "A"]["at"] and by["Name", "B"]["field"] == "bases"
    inner = next(n for n in nodes if n["kind"] == "Assign" and n["line"] == 3)
    assert (inner["parent"], inner["field"]) == (by["ClassDef", "A"]["at"], "If.body")
    last = next(n for n in nodes if n["kind"] == "Assign" and n["line"] == 5)
    assert last["parent"] == -1 and by["ClassDef", "A"]["upto"] == last["at"] - 1


def test_plain_and_dotted_names_go_without_the_unparser(monkeypatch):
    import ast
    tree = ast.parse("import q\nclass A(b.C):\n    x: t.U = v\n    def f(self, p: w.Q): supp_1.part_2(); g()\n")
    want = node_records(tree)
    monkeypatch.setattr(ast, "unparse", lambda node: pytest.fail("unparsed"))
    assert node_records(tree) == want
    assert [n["name"] for n in want if n["kind"] == "Call"] == ["supp_1.part_2", "g"]


def test_source_of_an_expression_is_that_of_the_unparser():
    import ast
    from codeweave.operators.python_nodes import _source
    for text in ("a", "a.b.c", "a().b", "a[0].b", "(1).real", "'x'.join", "(a + b).c", "(await_).d", "año.x", "-a.b", "a" + ".b" * 60):
        node = ast.parse(text, mode="eval").body
        assert _source(node) == ast.unparse(node)


def test_syntax_error_is_reported_not_raised(rec):
    r = rec("def broken(:\n")
    assert r["error"].startswith("SyntaxError:")
    assert r["classes"] == [] and r["functions"] == []


def test_empty_file(rec):
    r = rec("")
    assert r["error"] is None and r["imports"] == [] and r["variables"] == []


def test_method_signature_drops_first_parameter_even_for_staticmethod(rec):
    r = rec("class A:\n    @staticmethod\n    def f(a, b=1):\n        pass\n")
    m = r["classes"][0]["methods"][0]
    assert m["signature"] == "f(b = 1)"
    assert m["decorators"] == ["@staticmethod"]


def test_positional_only_defaults_align_from_the_right(rec):
    r = rec("def f(a, b=1, /, c=2, *, d, e=3, **kw) -> int:\n    pass\n")
    assert r["functions"][0]["signature"] == "f(a, b = 1, /, c = 2, *, d, e = 3, **kw) -> int"


def test_non_literal_default_is_ellipsis(rec):
    r = rec("def f(a=g()):\n    pass\n")
    assert r["functions"][0]["signature"] == "f(a = ...)"


def test_calls_unique_in_preorder_and_exclusions(rec):
    r = rec("def f():\n    a.b(c(), len(x))\n    a.b()\n    print(1)\n    g().h()\n")
    assert r["functions"][0]["calls"] == ["a.b", "c", "h", "g"]


def test_class_signature_from_init_and_bfs_attributes(rec):
    src = ("class K(B):\n    x = 1\n    def __init__(self, p, q=2):\n"
           "        self.p = p\n        if q:\n            self.q = q\n        self.x = 5\n")
    c = rec(src)["classes"][0]
    assert c["signature"] == "K(p, q = 2)"
    assert [a["name"] for a in c["attributes"]] == ["x", "p", "q"]


def test_module_variables_first_wins_and_tuples(rec):
    r = rec("A: int = 1\nB = [1, 2]\nc, d = 1, 2\nA = 3\nN = -4\n")
    vs = [(v["name"], v["type"], v["value"]) for v in r["variables"]]
    assert vs == [("A", "int", "1"), ("B", None, "[1, 2]"), ("c", None, None),
                  ("d", None, None), ("N", None, "-4")]


def test_relative_import_loses_level(rec):
    r = rec("from . import x\nfrom ..a import b as c\nimport m, n\n")
    assert [(i["module"], i["names"], i["is_from"]) for i in r["imports"]] == [
        ("", ["x"], True), ("a", ["b"], True), ("m", [], False), ("n", [], False)]


def test_nested_definitions_are_ignored(rec):
    r = rec("if True:\n    def hidden():\n        pass\nclass A:\n    class Inner:\n        pass\n")
    assert r["functions"] == [] and [c["name"] for c in r["classes"]] == ["A"]


def test_docstring_collapsed(rec):
    r = rec('def f():\n    """a\n    b   c"""\n')
    assert r["functions"][0]["docstring"] == "a b c"


def test_spark_branch(sample_index):
    idx = sample_index
    calls = rows_of(idx.callables, "name", "calls", path="app/service.py", kind="method")
    assert ("build", ["send", "connect", "Client"]) in calls
    assert ("fetch", ["self.session.get", "resp.json"]) in calls
    sig = rows_of(idx.classes, "signature", path="app/service.py")
    assert sig == [("Client(host, port = 80, *, secure: bool = False)",)]
    attrs = rows_of(idx.variables.orderBy("ord"), "name", path="app/service.py", scope="class")
    assert attrs == [("kind",), ("port",), ("host",), ("cert",)]
    err = rows_of(idx.files, "error", path="app/broken.py")[0][0]
    assert err.startswith("SyntaxError")


def _seconds(spark, text):
    """(variables, seconds) of one file: parsing, symbols and all, without the planning."""
    import time

    from codeweave.operators.python_nodes import python_nodes
    from codeweave.operators.python_symbols import python_tables

    files = spark.createDataFrame([("r", "m.py", text)], "repo string, path string, text string")
    found = python_tables(python_nodes(files))["variables"]
    found.collect()
    start = time.perf_counter()
    rows = sorted(found.collect(), key=lambda r: (r.scope, r.ord))
    return rows, time.perf_counter() - start


def test_many_assignments_in_one_file(spark):
    """Time grows with the file, not with its square: 10,000 assignments in seconds."""
    text = lambda n: "".join(f"V{i % (n - 5)} = {i}\n" for i in range(n))
    rows, _ = _seconds(spark, text(10_000))
    assert [(r.ord, r.name, r.value, r.line) for r in rows] == [(i, f"V{i}", str(i), i + 1) for i in range(9_995)]
    _, small = _seconds(spark, text(5_000))
    _, large = _seconds(spark, text(20_000))
    assert large < 20 and large < 4 * small * 2


def test_many_attributes_in_one_class(spark):
    text = lambda n: ("class A:\n" + "".join(f"    a{i} = {i}\n" for i in range(n)) + "    def __init__(self):\n"
                      + "".join(f"        self.b{i} = {i}\n        self.a{i} = 0\n" for i in range(n)))
    rows, _ = _seconds(spark, text(2_000))
    assert [(r.name, r.value) for r in rows] == [(f"{k}{i}", str(i)) for k in "ab" for i in range(2_000)]
    _, small = _seconds(spark, text(1_000))
    _, large = _seconds(spark, text(4_000))
    assert large < 20 and large < 4 * small * 2


def test_a_callable_row_carries_its_own_records_only(spark):
    n = 1_500
    text = "class A:\n" + "".join(f"    def m{i}(self, a, b=1):\n        return f{i}(a)\n" for i in range(n))
    text += "".join(f"def g{i}(a):\n    return h{i}(a)\n" for i in range(n))
    from codeweave.operators.python_nodes import python_nodes
    from codeweave.operators.python_symbols import python_tables

    files = spark.createDataFrame([("r", "m.py", text)], "repo string, path string, text string")
    rows = sorted(python_tables(python_nodes(files))["callables"].collect(), key=lambda r: (r.kind, r.call_ord))
    assert [(r.name, r.calls) for r in rows] == [(f"g{i}", [f"h{i}"]) for i in range(n)] + [(f"m{i}", [f"f{i}"]) for i in range(n)]


def test_constants_go_without_the_unparser_and_records_are_built_by_column(monkeypatch):
    import ast

    from codeweave.operators import python_nodes as P
    for text in ("1", "-1", "True", "None", "'a\\'b'", "u'x'", "1.5", "1e999", "2j", "b'x'", "..."):
        node = ast.parse(text, mode="eval").body
        assert P._source(node) == ast.unparse(node), text
    texts = ["", "x = 1\nclass A(B):\n    'doc'\n    y = 'z'\n    def f(self, p: int = 3, *a): g(1).h(p.q())\n", "from . import a as b, c\n"]
    want = [node_records(ast.parse(t)) for t in texts]
    assert P._node_arrays([P._rows(ast.parse(t)) for t in texts]).to_pylist() == want and want[1] and P._node_arrays([]).to_pylist() == []
    monkeypatch.setattr(ast, "unparse", lambda node: pytest.fail("unparsed"))
    assert [n["text"] for n in node_records(ast.parse("A = 1\nB: int = 'x'\n")) if n["field"] == "value"] == ["1", "'x'"]


def test_the_records_below_a_callable_are_looked_through_once_for_its_children(spark):
    """The parts of a signature look through the children alone, which are found in one step before."""
    files = spark.createDataFrame([("r", "m.py", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    'Doc.'\n    g()\n")],
                                  "repo string, path string, text string")
    found = python_tables(python_nodes(files))["callables"]
    parts = found._jdf.queryExecution().optimizedPlan().toString().split(" AS signature#")[0].rsplit(" AS ", 1)[-1]
    assert "kids#" in parts and "sub#" not in parts
    assert [(r.signature, r.docstring, r.calls) for r in found.collect()] == [("f(a, /, b = 1, *c, d: int = 2, **e) -> int", "Doc.", ["g"])]
