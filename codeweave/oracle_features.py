"""DuckDB SQL for the feature corpus (``sources.features``): what each template
defines, written by hand; ``%s`` is the supplier's key, ``%n`` its nation's."""

from __future__ import annotations

LONG = "9" * 100

# per language: class_ord, name, signature, bases, line
CLASSES = {
    "py": [(0, "Shared", "Shared(año, *rest)", "Base%n|mix.Part", 16)],
    "ts": [(0, "Shared", "class Shared extends Base%n", "Base%n", 16)],
    "cpp": [(0, "Shared", "struct Shared : Base%n", "Base%n", 7), (1, "Tone_%s", "enum class Tone_%s", "", 18)],
    "dart": [(0, "Tone_%s", "enum Tone_%s", "", 10), (1, "Mix_%s", "mixin Mix_%s", "Base%n", 12),
             (2, "Ext_%s", "extension Ext_%s on String", "String", 16),
             (3, "Shared", "class Shared extends Base%n with Mix_%s implements Face", "Base%n|Mix_%s|Face", 20)],
}

# class_name, call_ord, kind, name, signature, docstring, decorators, is_async, calls, line
CALLABLES = {
    "py": [("Shared", 0, "method", "__init__", "__init__(año, *rest)", "", "", False, "", 20),
           ("Shared", 1, "method", "title", "title()", "", "@property", False, "strip|self.año.title", 27),
           ("Shared", 2, "method", "fetch_%s", "async fetch_%s(n: int = 2)", "", "@staticmethod|@cached(size=%s)", True,
            "get_%s|cached", 32),
           (None, 0, "function", "lead_%s", "lead_%s(a, b = 1, /, c = -2, *, d, e = ..., **kw) -> int", "Leads the file.", "",
            False, "alpha|outer|inner_%s", 10)],
    "ts": [(None, 0, "function", "arrow_%s", "export const arrow_%s = async (x) =>", "", "", True, "deep_%s", 6),
           (None, 1, "function", "lead_%s", "function lead_%s(a = { k: f(g(h(i(1)", "", "", False, "lead_%s|f|g|h|i|body_%s", 12),
           ("Shared", 0, "method", "constructor", "constructor(a)", "", "", False, "", 20),
           ("Shared", 1, "method", "size_%s", "size_%s()", "", "", False, "size_%s|this.calc", 23),
           ("Shared", 2, "method", "run_%s", "run_%s(a)", "", "", True, "run_%s|go_%s", 26)],
    "cpp": [(None, 0, "function", "lead_%s", "int lead_%s(int a)", "", "", False, "lead_%s|Shared|ns_%s::go", 20),
            ("Shared", 0, "method", "Shared", "Shared(int x)", "", "", False, "Shared|init_%s", 10),
            ("Shared", 1, "method", "area_%s", "const int area_%s(int a)", "", "", False, "area_%s|std::max|side", 13)],
    "dart": [(None, 0, "function", "lead_%s", "Future<int> lead_%s(int x)", "", "", True, "lead_%s|work_%s", 31),
             ("Ext_%s", 0, "method", "twice_%s", "int twice_%s()", "", "", False, "twice_%s|length_%s", 17),
             ("Shared", 0, "method", "named_%s", "Shared(int x)", "", "", False, "named_%s|setUp", 22),
             ("Shared", 1, "method", "draw_%s", "Widget draw_%s(ctx)", "", "", False, "draw_%s|Row|Cell", 25)],
}

# scope, class_name, ord, name, type, value, line
VARIABLES = {
    "py": [("module", None, 0, "NAMES_%s", None, "[1, 'two', -3]", 5), ("module", None, 1, "LEFT_%s", None, None, 6),
           ("module", None, 2, "right_%s", None, None, 6), ("module", None, 3, "WIDE_%s", "int", LONG, 7),
           ("class", "Shared", 0, "kind", "str", "'x'", 17), ("class", "Shared", 1, "size", None, "(1, 2)", 18),
           ("class", "Shared", 2, "año", None, None, 21), ("class", "Shared", 3, "tail_%s", None, "[1]", 23)],
    "ts": [("module", None, 0, "LONG_%s", "string", LONG, 9), ("class", "Shared", 0, "rate_%s", "number", "%s", 17),
           ("class", "Shared", 1, "count", "string", None, 18), ("class", "Shared", 2, "plain_%s", None, "5", 19),
           ("class", "Shared", 3, "late_%s", None, "make(a)", 20)],
    "cpp": [("module", None, 0, "WIDE_%s", "#define", LONG, 3), ("module", None, 1, "SEP_%s", "int", "1'000", 5),
            ("class", "Shared", 0, "width", "int", "%s", 8), ("class", "Shared", 1, "next_%s", "T*", None, 9)],
    "dart": [("module", None, 0, "names_%s", "List<int>", "[\n  %s,\n  2,\n]", 5), ("class", "Mix_%s", 0, "mixed", "int", "1", 13),
             ("class", "Shared", 0, "rate", "int", "%s", 21)],
}

# ord, module, names, is_from
IMPORTS = {
    "py": [(0, "lib_%n", "alpha|beta", True), (1, "side_%s", "", False), (2, "other.part", "", False), (3, "", "near", True)],
    "ts": [(0, "dlib_%n", "", True), (1, "alib", "", True), (2, "./near", "one|two", True), (3, "side_%s", "", False)],
    "cpp": [(0, "vector", "", False), (1, "part_%n.h", "", False)],
    "dart": [(0, "lib_%n.dart", "one|two", True), (1, "other.dart", "", False), (2, "export:part_%s.dart", "", False)],
}

FILES = """WITH f AS (SELECT s_suppkey AS s, s_nationkey AS n, s_suppkey % 4 AS k,
  CASE WHEN s_suppkey % 8 < 4 THEN 'left' ELSE 'right' END AS repo,
  'feat/f_' || s_suppkey || '.' || ['py', 'ts', 'cpp', 'dart'][s_suppkey % 4 + 1] AS path FROM supplier)"""


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _table(rows: dict[str, list[tuple]], columns: list[tuple[str, str]]) -> str:
    """The rows of every file, placeholders filled in; (name, SQL type) of each column."""
    values = ", ".join(f"({i}, {', '.join(map(_value, r))})" for i, k in enumerate(("py", "ts", "cpp", "dart")) for r in rows[k])
    filled = ", ".join(f"replace(replace(t.{c}, '%s', f.s::VARCHAR), '%n', f.n::VARCHAR) AS {c}" if kind == "VARCHAR"
                       else f"CAST(t.{c} AS {kind}) AS {c}" for c, kind in columns)
    return f"SELECT f.repo, f.path, {filled} FROM f JOIN (VALUES {values}) t(k, {', '.join(c for c, _ in columns)}) ON t.k = f.k"


def feature_sql() -> dict[str, str]:
    text, number, flag = "VARCHAR", "BIGINT", "BOOLEAN"
    members = _table({k: [("method", *r) for r in CALLABLES[k] if r[0] == "Shared"] for k in CALLABLES}, [
        ("member_kind", text), ("c", text), ("member_ord", number), ("kind", text), ("name", text), ("g", text), ("h", text),
        ("i", text), ("j", flag), ("l", text), ("line", number)])
    attributes = _table({k: [r for r in VARIABLES[k] if r[1] == "Shared"] for k in VARIABLES}, [
        ("scope", text), ("c", text), ("member_ord", number), ("name", text), ("t", text), ("v", text), ("line", number)])
    return {
        "classes_all_kinds": f"{FILES} " + _table(CLASSES, [
            ("class_ord", number), ("name", text), ("signature", text), ("bases", text), ("line", number)]),
        "callables_all_kinds": f"{FILES} " + _table(CALLABLES, [
            ("class_name", text), ("call_ord", number), ("kind", text), ("name", text), ("signature", text), ("docstring", text),
            ("decorators", text), ("is_async", flag), ("calls", text), ("line", number)]),
        "variables_all_kinds": f"{FILES} " + _table(VARIABLES, [
            ("scope", text), ("class_name", text), ("ord", number), ("name", text), ("type", text), ("value", text), ("line", number)]),
        "imports_all_kinds": f"{FILES} " + _table(IMPORTS, [
            ("ord", number), ("module", text), ("names", text), ("is_from", flag)]),
        "class_detail_by_repo": f"""{FILES}, m AS ({members}), a AS ({attributes}),
first AS (SELECT repo, min(path) AS path FROM f GROUP BY repo)
SELECT m.repo, m.path, member_kind, member_ord, name, line FROM m JOIN first USING (repo, path)
UNION ALL SELECT a.repo, a.path, 'attribute', member_ord, name, line FROM a JOIN first USING (repo, path)""",
    }
