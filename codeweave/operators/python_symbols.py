"""Python symbol tables from node records (P2-P13), in Spark expressions.

Every step is narrow: a class or callable row carries the slice of the node
array below it, and its columns are array expressions over that slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import EXCLUDED_CALLS
from ..sources.corpus import folder_of, name_of

CALLABLE = ("FunctionDef", "AsyncFunctionDef")
def null_string() -> Column:
    return F.lit(None).cast("string")


STRINGS = "array<string>"


def below(nodes: Column, node: Column) -> Column:
    """The records of a node's descendants."""
    return F.slice(nodes, node["at"] + 2 - _first(nodes), node["upto"] - node["at"])


def _first(nodes: Column) -> Column:
    """``at`` of a slice's first record."""
    return F.coalesce(F.get(nodes, F.lit(0))["at"], F.lit(0))


def children(nodes: Column, node: Column, *fields: str) -> Column:
    return F.filter(nodes, lambda n: (n["parent"] == node["at"]) & n["field"].isin(*fields))


def direct(nodes: Column, node: Column) -> Column:
    """The records of a node's children: what asks for several fields looks through these alone."""
    return F.filter(nodes, lambda n: n["parent"] == node["at"])


def one(found: Column) -> Column:
    """The only record of a list, or null."""
    return F.get(found, F.lit(0))


def literal(v: Column) -> Column:
    """The source of a plain literal, else null."""
    minus = (v["kind"] == "UnaryOp") & v["text"].rlike(r"^-(?:[\d.]|True|False|None|')")
    return F.when(v["kind"].isin("Constant", "List", "Tuple", "Dict", "Set") | minus, v["text"])


def with_default(arg: Column, default: Column) -> Column:
    """``name: annotation = default``; a default that is no literal is ``...``."""
    return F.concat(arg["name"], F.coalesce(F.concat(F.lit(": "), arg["text"]), F.lit("")),
                    F.when(default.isNull(), "").otherwise(
                        F.concat(F.lit(" = "), F.coalesce(literal(default), F.lit("...")))))


def parameters(nodes: Column, fn: Column, drop: int) -> Column:
    """The parameter list, without the first ``drop`` positional ones.
    Defaults belong to the last of the positional-only and plain parameters."""
    parts = {f: children(nodes, fn, f"arguments.{f}") for f in
             ("posonlyargs", "args", "vararg", "kwonlyargs", "kw_defaults", "kwarg", "defaults")}
    positional = F.concat(parts["posonlyargs"], parts["args"])
    bare = F.size(positional) - F.size(parts["defaults"])
    written = F.transform(positional, lambda a, i: with_default(
        a, F.when(i >= bare, F.get(parts["defaults"], F.greatest(i - bare, F.lit(0))))))
    n_only = F.size(parts["posonlyargs"])
    plain = lambda a: with_default(a, F.lit(None).cast(NODE_TYPE))
    keyword = F.transform(parts["kwonlyargs"], lambda a: with_default(
        a, one(F.filter(parts["kw_defaults"], lambda d: d["pos"] == a["pos"]))))
    empty = F.array().cast(STRINGS)
    return F.array_join(F.concat(
        F.slice(written, F.lit(1 + drop), F.greatest(n_only - drop, F.lit(0))),
        F.when(n_only > drop, F.array(F.lit("/"))).otherwise(empty),
        F.slice(written, F.greatest(n_only, F.lit(drop)) + 1, F.greatest(F.size(written), F.lit(1))),
        F.when(F.size(parts["vararg"]) > 0, F.transform(parts["vararg"], lambda a: F.concat(F.lit("*"), plain(a))))
        .when(F.size(keyword) > 0, F.array(F.lit("*"))).otherwise(empty),
        keyword, F.transform(parts["kwarg"], lambda a: F.concat(F.lit("**"), plain(a)))), ", ")


NODE_TYPE = ("struct<at:int,upto:int,parent:int,depth:int,field:string,pos:int,kind:string,name:string,"
             "line:int,text:string>")


def docstring(nodes: Column, node: Column) -> Column:
    """The leading string, white space collapsed."""
    text = one(F.filter(children(nodes, node, "body"), lambda n: n["kind"] == "Docstring"))["text"]
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x1C-\x1F\x{85}\p{Z}]+"), lambda w: w != "")
    return F.array_join(words, " ")


def texts(nodes: Column, node: Column, field: str, before: str = "") -> Column:
    return F.transform(children(nodes, node, field), lambda n: F.concat(F.lit(before), n["text"]))


def calls(nodes: Column) -> Column:
    """Names of the calls below, each once, in source order.  A name is the
    dotted end of the function's source: nothing for a call of a call."""
    names = F.transform(F.filter(nodes, lambda n: n["kind"] == "Call"),
                        lambda n: F.regexp_extract(n["name"], r"(?U)([^\W\d]\w*(?:\.\w+)*)$", 1))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*EXCLUDED_CALLS)))


def first_of_name(found: Column) -> Column:
    """The first of each name, in order.  Sorted by name and position, an element
    stays when the one before it has another name; each list is derived twice,
    whatever its length (a reference from inside a lambda would derive it again
    for every element)."""
    by_name = F.array_sort(F.transform(found, lambda v, i: F.struct(v["name"].alias("name"), i.alias("at"), v.alias("v"))))
    before = F.concat(F.array(F.lit("")), F.transform(by_name, lambda x: x["name"]))
    firsts = F.filter(F.zip_with(by_name, before, lambda x, name: F.struct(
        x["at"].alias("at"), x["v"].alias("v"), ((x["at"].isNotNull()) & ~x["name"].eqNullSafe(name)).alias("new"))),
        lambda x: x["new"])
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"], x["v"]))), lambda x: x["v"])


def variable(name: Column, kind: Column, value: Column, line: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("type"), value.alias("value"), line.alias("line"))


def assigned(nodes: Column, statement: Column, target, unpack: bool) -> Column:
    """The variables that a statement assigns; ``target`` says which
    targets count, ``unpack`` also takes the names of a tuple (without a value).
    Only the statement's own slice of ``nodes`` is looked at."""
    inside = below(nodes, statement)
    kids = F.filter(inside, lambda n: n["parent"] == statement["at"])
    value = literal(one(F.filter(kids, lambda n: n["field"] == "value")))
    kind = F.when(statement["kind"] == "AnnAssign", one(F.filter(kids, lambda n: n["field"] == "annotation"))["text"])
    mine = F.filter(kids, lambda n: n["field"].isin("targets", "target"))
    single = lambda t: F.array(variable(t["name"], kind, value, statement["line"]))
    none = F.array().cast("array<struct<name:string,type:string,value:string,line:int>>")

    def of(t: Column) -> Column:
        out = F.when(target(t), single(t))
        if unpack:
            inner = F.filter(children(inside, t, "elts"), lambda n: n["kind"] == "Name")
            out = out.when(t["kind"] == "Tuple", F.transform(
                inner, lambda n: variable(n["name"], null_string(), null_string(), statement["line"])))
        return out.otherwise(none)

    return F.flatten(F.transform(mine, of))


def statements(found: Column) -> Column:
    return F.filter(found, lambda n: n["kind"].isin("Assign", "AnnAssign"))


def attributes(sub: Column, kids: Column, cls: Column) -> Column:
    """Names assigned in the class body, then ``self.x`` of the constructors
    (outer statements first); the first of each name.  ``kids``: the class's children."""
    own = F.flatten(F.transform(statements(children(kids, cls, "body")),
                                lambda s: assigned(sub, s, lambda t: t["kind"] == "Name", False)))
    inits = F.filter(children(kids, cls, "body"), lambda n: n["kind"].isin(*CALLABLE) & (n["name"] == "__init__"))

    def in_init(fn: Column) -> Column:
        order = F.array_sort(F.transform(statements(below(sub, fn)), lambda s: F.struct(s["depth"], s["at"], s.alias("s"))))
        is_self = lambda t: (t["kind"] == "Attribute") & (t["text"] == F.concat(F.lit("self."), t["name"]))
        return F.flatten(F.transform(order, lambda o: assigned(sub, o["s"], is_self, False)))

    return first_of_name(F.concat(own, F.flatten(F.transform(inits, in_init))))


def python_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """``repo, path, error, nodes`` -> the flat tables (narrow, no shuffle)."""
    key = ["repo", "path", F.lit("python").alias("lang")]
    top = F.filter("nodes", lambda n: (n["parent"] == -1) & (n["field"] == "body"))
    no_class = [F.lit(None).cast("int").alias("class_ord"), null_string().alias("class_name")]

    def callables(rows: DataFrame, kind: str, drop: int) -> DataFrame:
        """``m``: the callable's node, ``sub``: the nodes below it."""
        m, sub, kids = F.col("m"), F.col("sub"), F.col("kids")
        prefix = F.when(m["kind"] == "AsyncFunctionDef", "async ").otherwise("")
        returns = F.coalesce(F.concat(F.lit(" -> "), one(children(kids, m, "returns"))["text"]), F.lit(""))
        return rows.withColumn("kids", direct(sub, m)).select(
            "repo", "path", "lang", "class_ord", "class_name", "call_ord", F.lit(kind).alias("kind"), m["name"].alias("name"),
            F.concat(prefix, m["name"], F.lit("("), parameters(kids, m, drop), F.lit(")"), returns).alias("signature"),
            docstring(kids, m).alias("docstring"), texts(kids, m, "decorator_list", "@").alias("decorators"),
            (m["kind"] == "AsyncFunctionDef").alias("is_async"), calls(sub).alias("calls"), m["line"].alias("line"),
            m["line"].alias("ref_line"))

    is_callable = lambda n: n["kind"].isin(*CALLABLE)
    c, sub, kids = F.col("c"), F.col("sub"), F.col("kids")

    def exploded(rows: DataFrame, columns: list, found: Column, nodes: Column, order: str, name: str) -> DataFrame:
        """One row per node of ``found`` with the slice below it: no row carries its file's or class's whole array."""
        each = F.transform(found, lambda n: F.struct(n.alias("n"), below(nodes, n).alias("sub")))
        return rows.select(*columns, F.posexplode(each).alias(order, "x")) \
            .withColumn(name, F.col("x.n")).withColumn("sub", F.col("x.sub")).drop("x")

    classes_x = exploded(parsed, key, F.filter(top, lambda n: n["kind"] == "ClassDef"), F.col("nodes"), "class_ord", "c") \
        .withColumn("kids", direct(sub, c))
    init = one(F.filter(children(kids, c, "body"), lambda n: is_callable(n) & (n["name"] == "__init__")))
    classes = classes_x.withColumn("init", init).withColumn("init_kids", direct(below(sub, F.col("init")), F.col("init"))).select(
        "repo", "path", "lang", "class_ord", c["name"].alias("name"),
        F.concat(c["name"], F.lit("("), F.when(F.col("init").isNotNull(), parameters(F.col("init_kids"), F.col("init"), 1)).otherwise(""),
                 F.lit(")")).alias("signature"),
        docstring(kids, c).alias("docstring"), texts(kids, c, "bases").alias("bases"), c["line"].alias("line"),
        c["line"].alias("ref_line"))
    methods = exploded(classes_x, ["repo", "path", "lang", "class_ord", c["name"].alias("class_name")],
                       F.filter(children(kids, c, "body"), is_callable), sub, "call_ord", "m")
    functions = exploded(parsed, [*key, *no_class], F.filter(top, is_callable), F.col("nodes"), "call_ord", "m")
    attrs = classes_x.select("repo", "path", "lang", "class_ord", c["name"].alias("class_name"),
                             F.posexplode(attributes(sub, kids, c)).alias("ord", "v"), F.lit("class").alias("scope"))
    named = first_of_name(F.flatten(F.transform(
        statements(top), lambda s: assigned(F.col("nodes"), s, lambda t: t["kind"] == "Name", True))))
    module = parsed.select(*key, *no_class, F.posexplode(named).alias("ord", "v"), F.lit("module").alias("scope"))
    variables = module.unionByName(attrs).select(
        "repo", "path", "lang", "class_ord", "class_name", "ord", "v.name", "v.type", "v.value", "scope", "v.line",
        F.col("v.line").alias("ref_line"))
    found = F.flatten(F.transform(F.filter(top, lambda n: n["kind"].isin("Import", "ImportFrom")), lambda s: F.when(
        s["kind"] == "Import", F.transform(children(below(F.col("nodes"), s), s, "names"), lambda a: F.struct(
            a["name"].alias("module"), F.array().cast(STRINGS).alias("names"), F.lit(False).alias("is_from")))).otherwise(
        F.array(F.struct(F.coalesce(s["name"], F.lit("")).alias("module"),
                         F.transform(children(below(F.col("nodes"), s), s, "names"), lambda a: a["name"]).alias("names"),
                         F.lit(True).alias("is_from"))))))
    imports = parsed.select(*key, F.posexplode(found).alias("ord", "i")).select(
        "repo", "path", "lang", "ord", "i.module", "i.names", "i.is_from")
    files = parsed.select("repo", "path", folder_of(F.col("path")).alias("folder"), name_of(F.col("path")).alias("name"),
                          F.lit("python").alias("lang"), "error")
    return {"files": files, "imports": imports, "classes": classes, "variables": variables,
            "callables": callables(methods, "method", 1).unionByName(callables(functions, "function", 0))}
