"""Structure queries (R1–R9) over a :class:`~codeweave.operators.tables.CodeIndex`.

Every function returns a DataFrame; nothing is collected.  Results are flat
rows (one per folder/file/symbol) instead of one nested document, so no
answer ever gathers an unbounded group into one row.  "Not found" is an
empty DataFrame.

Walk order (the order "first match" refers to) is ``(repo, path, repo)`` then the
source position; first matches use ``min(struct(...))`` aggregates, which
Spark combines map-side, so a symbol defined in millions of files costs one
partial aggregate per task, not one task holding all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.tables import CodeIndex


def _file_filter(df: DataFrame, path: str | None, repo: str | None = None) -> DataFrame:
    """equality filter on the file (and its repository), skipped when None."""
    df = df if path is None else df.where(F.col("path") == path)
    return df if repo is None else df.where(F.col("repo") == repo)


# --- R1 / A8 ---------------------------------------------------------------
def folder_tree(idx: CodeIndex) -> DataFrame:
    """Folder → files: one row per (repo, folder, path, repo); ``\\`` normalised."""
    return idx.files.select(
        "repo",
        F.replace(F.coalesce(F.nullif("folder", F.lit("")), F.lit(".")), F.lit("\\"), F.lit("/"))
        .alias("folder"),
        F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))


def folder_summary(idx: CodeIndex) -> DataFrame:
    """Per folder: number of files and the first/last path (sorted)."""
    return (folder_tree(idx).groupBy("repo", "folder")
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.min("path").alias("first_path"), F.max("path").alias("last_path")))


# --- R2 / K1 ---------------------------------------------------------------
def imports_by_file(idx: CodeIndex, path: str | None = None, repo: str | None = None) -> DataFrame:
    """Imports per file; files without imports keep one row of NULLs (Q8)."""
    files = _file_filter(idx.files.select("repo", "path"), path, repo)
    imps = _file_filter(idx.imports, path, repo).select("repo", "path", "ord", "module", "names",
                                                  "is_from")
    return files.join(imps, ["repo", "path"], "left")


# --- R3 / A7 ---------------------------------------------------------------
def classes_by_file(idx: CodeIndex, path: str | None = None, repo: str | None = None) -> DataFrame:
    """Classes without their methods, with member counts (Q8: files without
    classes keep one NULL row)."""
    files = _file_filter(idx.files.select("repo", "path"), path, repo)
    n_meth = (_file_filter(idx.callables, path, repo).where(F.col("kind") == "method")
              .groupBy("repo", "path", "class_ord").agg(F.count(F.lit(1)).alias("n_methods")))
    n_attr = (_file_filter(idx.variables, path, repo).where(F.col("scope") == "class")
              .groupBy("repo", "path", "class_ord").agg(F.count(F.lit(1)).alias("n_attributes")))
    cls = (_file_filter(idx.classes, path, repo)
           .join(n_meth, ["repo", "path", "class_ord"], "left")
           .join(n_attr, ["repo", "path", "class_ord"], "left")
           .select("repo", "path", "class_ord", "name", "signature", "docstring", "bases",
                   F.coalesce("n_methods", F.lit(0)).alias("n_methods"),
                   F.coalesce("n_attributes", F.lit(0)).alias("n_attributes"), "line"))
    return files.join(cls, ["repo", "path"], "left")


# --- R4 / K2 / L1 ----------------------------------------------------------
def first_class(idx: CodeIndex, names: DataFrame) -> DataFrame:
    """For each wanted class name (column ``name``) its first definition in
    walk order in each repository: (name, repo, path, class_ord).  Definitions
    are reduced to one per repository and name before they meet the names, so a
    name that is defined everywhere is combined map-side."""
    return first_of_each(idx.classes).join(names.select("name").distinct(), "name", "left_semi")


def first_of_each(classes: DataFrame) -> DataFrame:
    return (classes.groupBy("repo", "name").agg(F.min(F.struct("path", "class_ord")).alias("f"))
            .select("name", "repo", "f.path", "f.class_ord"))


def class_detail(idx: CodeIndex, classes: str | DataFrame) -> DataFrame:
    """Methods (with calls) and attributes of each repository's first class of each name.

    One row per member: ``member_kind`` is ``method`` or ``attribute``.
    ``classes`` is one name or a DataFrame with a ``name`` column.
    """
    if idx.details is not None:
        return _stored_detail(idx.details, classes)
    if isinstance(classes, str):  # one name is a filter on the scan
        first = first_of_each(idx.classes.where(F.col("name") == classes))
    else:
        first = first_class(idx, classes)
    key = ["repo", "path", "class_ord"]
    cls = idx.classes.join(first.select(*key), key, "left_semi").select(
        *key, F.col("name").alias("class_name"), F.col("signature").alias("class_signature"),
        F.col("bases").alias("class_bases"), F.col("docstring").alias("class_docstring"))
    meths = idx.callables.where(F.col("kind") == "method").select(
        *key, F.lit("method").alias("member_kind"), F.col("call_ord").alias("member_ord"),
        "name", "signature", "docstring", "decorators", "is_async", "calls",
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"),
        "line")
    attrs = idx.variables.where(F.col("scope") == "class").select(
        *key, F.lit("attribute").alias("member_kind"), F.col("ord").alias("member_ord"),
        "name", F.lit(None).cast("string").alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("array<string>").alias("decorators"),
        F.lit(None).cast("boolean").alias("is_async"),
        F.lit(None).cast("array<string>").alias("calls"), "type", "value", "line")
    members = meths.unionByName(attrs)
    return cls.join(members, key, "left")


def _stored_detail(details: DataFrame, classes: str | DataFrame) -> DataFrame:
    """The same from a snapshot's lookup table: without an exchange of the index."""
    if isinstance(classes, str):
        found = lookup.at_keys(details.where(F.col("name") == classes), classes)
    else:
        found = details.join(lookup.salted(classes.select("name").distinct(), F.col("name")).select("key"), "key", "left_semi")
    members = F.concat(
        F.transform("c.methods", lambda m: F.struct(
            F.lit("method").alias("member_kind"), m["call_ord"].alias("member_ord"), m["name"].alias("name"),
            m["signature"].alias("signature"), m["docstring"].alias("docstring"), m["decorators"].alias("decorators"),
            m["is_async"].alias("is_async"), m["calls"].alias("calls"), F.lit(None).cast("string").alias("type"),
            F.lit(None).cast("string").alias("value"), m["line"].alias("line"))),
        F.transform("c.attributes", lambda m: F.struct(
            F.lit("attribute").alias("member_kind"), m["ord"].alias("member_ord"), m["name"].alias("name"),
            F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"),
            F.lit(None).cast("array<string>").alias("decorators"), F.lit(None).cast("boolean").alias("is_async"),
            F.lit(None).cast("array<string>").alias("calls"), m["type"].alias("type"), m["value"].alias("value"),
            m["line"].alias("line"))))
    return found.select("repo", "path", F.col("c.class_ord").alias("class_ord"), F.col("name").alias("class_name"),
                        F.col("c.signature").alias("class_signature"), F.col("c.bases").alias("class_bases"),
                        F.col("c.docstring").alias("class_docstring"), F.explode_outer(members).alias("m")) \
        .select("repo", "path", "class_ord", "class_name", "class_signature", "class_bases", "class_docstring", "m.*")


# --- R5 --------------------------------------------------------------------
def functions_by_file(idx: CodeIndex, path: str | None = None, repo: str | None = None) -> DataFrame:
    files = _file_filter(idx.files.select("repo", "path"), path, repo)
    fns = _file_filter(idx.callables, path, repo).where(F.col("kind") == "function").select(
        "repo", "path", "call_ord", "name", "signature", "docstring", "decorators",
        "is_async", "calls", "line")
    return files.join(fns, ["repo", "path"], "left")


# --- R6 / U1 / F2 ----------------------------------------------------------
def variables_by_file(idx: CodeIndex, path: str | None = None,
                      scope: str | None = None, repo: str | None = None) -> DataFrame:
    """Module variables and ``Class.attr`` rows; files with none are absent.

    ``scope``: ``module``, ``class`` or None (both).
    """
    v = _file_filter(idx.variables, path, repo)
    if scope is not None:
        v = v.where(F.col("scope") == scope)
    return v.select(
        "repo", "path",
        F.when(F.col("scope") == "class", F.concat_ws(".", "class_name", "name"))
        .otherwise(F.col("name")).alias("name"),
        "type", "value", "scope", "line",
        # module variables first, then attributes class by class
        F.when(F.col("scope") == "module", F.lit(-1)).otherwise(F.col("class_ord")).alias("group_ord"),
        "ord")


# --- R7 / L1 / V12 ---------------------------------------------------------
def split_symbol(symbol: Column) -> tuple[Column, Column]:
    """``Class.method`` → (class, method) split at the first dot; no dot →
    (NULL, symbol)."""
    has_dot = symbol.contains(".")
    cls = F.when(has_dot, F.substring_index(symbol, ".", 1))
    meth = F.when(has_dot, F.regexp_extract(symbol, r"(?s)^[^.]*\.(.*)$", 1)).otherwise(symbol)
    return cls, meth


def calls_of(idx: CodeIndex, symbols: str | DataFrame) -> DataFrame:
    """Calls of ``Class.method`` or of a free function, first match of each repository (Q6/Q7).

    ``symbols`` is one symbol or a DataFrame with a ``symbol`` column; many
    symbols are answered with one equi-join.
    """
    if isinstance(symbols, str):  # one symbol is a filter on the scan
        owner, dot, member = symbols.partition(".")
        cls, member = (owner, member) if dot else ("", symbols)
        if idx.definitions is not None:
            first = lookup.at_keys(idx.definitions.where(F.col("name") == member), cls, member)
        else:
            first = lookup.first_callables(idx.callables.where(
                (F.col("name") == member) & ((F.col("kind") == "method") & (F.col("class_name") == cls) if dot else F.col("kind") == "function")))
        found = first.where(F.lit(not dot or cls != ""))
        return found.select(F.lit(symbols).alias("symbol"), "repo", "path", "calls")
    cls, member = split_symbol(F.col("symbol"))
    wanted = symbols.where(~F.col("symbol").startswith(".")).select("symbol").distinct().select("symbol", F.coalesce(cls, F.lit("")).alias("cls"), member.alias("name"))
    if idx.definitions is not None:
        # the key alone: names hold no separator, and a join on more columns would move the index
        found = idx.definitions.join(lookup.salted(wanted, F.col("cls"), F.col("name")).select("key", "symbol"), "key")
    else:
        found = lookup.first_callables(idx.callables).join(wanted, ["cls", "name"])
    return found.select("symbol", "repo", "path", "calls")


# --- R8 / F3 / U2 ----------------------------------------------------------
def usages(idx: CodeIndex, name: str) -> DataFrame:
    """Calls whose name contains ``name`` (case-insensitive), with context
    ``Class.method`` or the function name."""
    term = name.lower()
    if idx.names is not None:
        found = idx.names.places_of(term, lambda c: F.lower(c).contains(term)).where(F.col("role") == "usage")
        return found.select("repo", "path", "context", F.col("name").alias("call"), "class_ord", "call_ord", "ord")
    return (idx.calls.where(F.lower("callee").contains(term))
            .select("repo", "path",
                    F.when(F.col("kind") == "method", F.concat_ws(".", "class_name", "caller"))
                    .otherwise(F.col("caller")).alias("context"),
                    F.col("callee").alias("call"),
                    "class_ord", "call_ord", "ord"))


# --- R9 / A1–A5 / F5 / V13 -------------------------------------------------
def _totals(idx: CodeIndex) -> DataFrame:
    """Partial totals: one conditional aggregate per table and repository."""
    n = lambda cond=None: F.count(F.lit(1) if cond is None else F.when(cond, 1))
    names = ["total_files", "total_classes", "total_methods", "total_functions", "total_variables", "total_attributes",
             "error_files"]
    parts = [(idx.files, {"total_files": n(), "error_files": n(F.col("error").isNotNull())}),
             (idx.classes, {"total_classes": n()}),
             (idx.callables, {"total_methods": n(F.col("kind") == "method"), "total_functions": n(F.col("kind") == "function")}),
             (idx.variables, {"total_variables": n(F.col("scope") == "module"), "total_attributes": n(F.col("scope") == "class")})]
    out = None
    for df, found in parts:
        some = df.groupBy("repo").agg(*[c.alias(k) for k, c in found.items()])
        some = some.select("repo", *[F.col(k) if k in found else F.lit(0).cast("long").alias(k) for k in names])
        out = some if out is None else out.unionByName(some)
    return out


def status_by_repo(idx: CodeIndex) -> DataFrame:
    """R9 of every repository: one row of totals each."""
    t = _totals(idx)
    return t.groupBy("repo").agg(*[F.sum(c).alias(c) for c in t.columns[1:]])


def status(idx: CodeIndex, root: str | None = None, analyzed_at: str | None = None) -> DataFrame:
    """One row of totals over all repositories; the time of analysis is the snapshot's unless given."""
    t = _totals(idx)
    return t.agg(F.lit(root).cast("string").alias("root"), F.lit(analyzed_at or idx.analyzed_at).cast("string").alias("analyzed_at"),
                 *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in t.columns[1:]])


def error_files(idx: CodeIndex) -> DataFrame:
    return idx.files.where(F.col("error").isNotNull()).select("repo", "path", "error")


def is_empty(idx: CodeIndex) -> bool:
    """A1: emptiness without counting everything."""
    return idx.files.isEmpty()
