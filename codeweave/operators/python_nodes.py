"""Python sources as node tables (P1, P14): the only Python code per file.

The grammar has no Catalyst expression, so an Arrow step parses each text with
the standard ``ast`` module.  It decides nothing about symbols: it emits one
array of plain node records per file, in source order, and everything else
(signatures, attributes, calls, imports, ...) is derived from that array in
Spark (``operators.python_symbols``).
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Files parsed before a batch of records leaves the task.
SLICE = 64
NODE = ("struct<at:int,upto:int,parent:int,depth:int,field:string,pos:int,kind:string,name:string,"
        "line:int,text:string>")
NODES_SCHEMA = f"repo string, path string, error string, nodes array<{NODE}>"
_NODE = pa.struct([("at", pa.int32()), ("upto", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
                   ("field", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
                   ("line", pa.int32()), ("text", pa.string())])
_BATCH = pa.schema([("repo", pa.string()), ("path", pa.string()), ("error", pa.string()), ("nodes", pa.list_(_NODE))])

# what is recorded: these kinds of nodes, and the expressions in these fields of a recorded node
_KINDS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign, ast.Import,
          ast.ImportFrom, ast.alias, ast.arg, ast.Call)
_FIELDS = {"decorator_list", "bases", "returns", "annotation", "targets", "target", "value", "elts",
           "arguments.defaults", "arguments.kw_defaults"}
# nothing is below these, and outside those fields they are not recorded
_LEAVES = (ast.Name, ast.Constant, ast.expr_context)


#: Where the name of a node other than a call may stand.
_NAMED = ("name", "arg", "id", "attr", "module")


class _Shapes(dict):
    """What a walk asks of a kind of nodes: (its name, always recorded, an expression, a leaf, where its name may
    stand, its fields); None for a kind of other values.  A field is (name, the way over it from a record, whether
    expressions on that way are recorded, the same two from a node that is no record)."""

    def __missing__(self, kind: type) -> tuple | None:
        name = kind.__name__
        self[kind] = shape = (
            name, issubclass(kind, _KINDS), issubclass(kind, ast.expr), issubclass(kind, _LEAVES),
            tuple(a for a in _NAMED if a in kind._fields),
            tuple((f, f, f in _FIELDS, f"{name}.{f}", f"{name}.{f}" in _FIELDS) for f in kind._fields)) \
            if issubclass(kind, ast.AST) else None
        return shape


_SHAPES = _Shapes()


def _rows(tree: ast.Module) -> list[tuple]:
    """The records as (parent, depth, field, pos, kind, name, line, text), in source order."""
    out: list[tuple] = []
    shapes = _SHAPES
    todo: list[tuple] = [(tree, shapes[type(tree)], -1, 0, "", 0, False)]
    while todo:
        node, (kind, always, expr, _, named, fields), parent, depth, way, pos, wanted = todo.pop()
        # the root's fields are named as those of a record
        plain = way == ""
        string = (pos == 0 and way == "body" and kind == "Expr" and isinstance(node.value, ast.Constant)
                  and isinstance(node.value.value, str))
        if always or string or wanted and expr:
            if kind == "Call":
                name = _source(node.func)
            else:
                name = next((x for a in named if isinstance(x := getattr(node, a, None), str)), None) if named else None
            if string:
                kind, text = "Docstring", node.value.value
            elif kind == "arg":
                text = _source(node.annotation) if node.annotation else None
            else:
                text = _source(node) if wanted and expr else None
            out.append((parent, depth, way, pos, kind, name, getattr(node, "lineno", None), text))
            parent, plain = len(out) - 1, True
        depth += 1
        first = len(todo)
        for field, way, kept, longer, kept_longer in fields:
            value = getattr(node, field, None)
            if value is None:
                continue
            if not plain:
                way, kept = longer, kept_longer
            if type(value) is list:
                for i, child in enumerate(value):
                    shape = shapes[type(child)]
                    if shape and (kept or not shape[3]):
                        todo.append((child, shape, parent, depth, way, i, kept))
            else:
                shape = shapes[type(value)]
                if shape and (kept or not shape[3]):
                    todo.append((value, shape, parent, depth, way, 0, kept))
        if len(todo) > first + 1:
            todo[first:] = todo[first:][::-1]
    return out


def _extents(parents: list[int]) -> list[int]:
    """The last descendant of each record, or itself."""
    upto = list(range(len(parents)))
    for at in range(len(parents) - 1, -1, -1):
        above = parents[at]
        if above >= 0 and upto[at] > upto[above]:
            upto[above] = upto[at]
    return upto


def node_records(tree: ast.Module) -> list[dict]:
    """Records in source order.  ``parent`` is the nearest recorded ancestor
    (-1: the module) and ``field`` the way from it (``body``, ``If.body``,
    ``arguments.args``); the descendants of a record are those after it up to
    ``upto``.  ``text`` is the source of an expression or of an argument's
    annotation, or a leading string statement's value; a call's ``name`` is the
    source of its function."""
    rows = _rows(tree)
    return [dict(zip(_NODE.names, (at, upto, *row), strict=True))
            for at, (upto, row) in enumerate(zip(_extents([r[0] for r in rows]), rows, strict=True))]


def _source(node: ast.expr) -> str:
    """``ast.unparse``; plain and dotted names and plain constants, most of all expressions, without its visitor."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and (type(node.value) in (int, bool) or type(node.value) is str and node.kind is None):
        return repr(node.value)
    ends, at = [], node
    while isinstance(at, ast.Attribute) and len(ends) < 50:  # the visitor rejects names of some hundred parts
        ends.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(ends)]) if isinstance(at, ast.Name) else ast.unparse(node)


def parse(text: str, path: str) -> tuple[str | None, list[tuple]]:
    """(error, records): a file that cannot be parsed is an error row, never a failed job."""
    try:
        return None, _rows(ast.parse(text, filename=path))
    except SyntaxError as e:
        return f"SyntaxError: {e}", []
    except Exception as e:  # null bytes, nesting too deep, ...
        return str(e), []


def _node_arrays(files: list[list[tuple]]) -> pa.ListArray:
    """The records of each file as one list, built column by column."""
    at, upto, offsets, flat = [], [], [0], []
    for rows in files:
        at.extend(range(len(rows)))
        upto.extend(_extents([r[0] for r in rows]))
        flat.extend(rows)
        offsets.append(len(flat))
    columns = [at, upto, *(zip(*flat, strict=True) if flat else [()] * (len(_NODE) - 2))]
    nodes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], fields=list(_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def python_nodes(files: DataFrame) -> DataFrame:
    """``files(repo, path, text)`` of Python sources -> ``repo, path, error, nodes``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), SLICE):
                part = whole.slice(start, SLICE)
                found = [parse(t or "", p) for t, p in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), pa.array([e for e, _ in found], pa.string()),
                     _node_arrays([n for _, n in found])], schema=_BATCH)

    return files.select("repo", "path", "text").mapInArrow(task, NODES_SCHEMA)


# the functions travel with the task, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
