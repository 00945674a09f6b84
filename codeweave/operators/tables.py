"""Symbol tables (the index) and the corpus job that builds them.

The index is a set of flat DataFrames keyed by ``(repo, path)``:

* ``files(repo, path, folder, name, lang, error)``
* ``imports(repo, path, lang, ord, module, names, is_from)``
* ``classes(repo, path, lang, class_ord, name, signature, docstring, bases, line, ref_line)``
* ``callables(repo, path, lang, class_ord, class_name, call_ord, kind, name,
  signature, docstring, decorators, is_async, calls, line, ref_line)``
* ``variables(repo, path, lang, class_ord, class_name, ord, name, type, value,
  scope, line, ref_line)``
* ``calls(repo, path, lang, class_ord, class_name, call_ord, caller, kind, ord, callee)``

``*_ord`` columns are 0-based source-order positions; several answers depend
on list order.  ``line`` is 1-based and absolute for every dialect,
``ref_line`` keeps the per-dialect numbering of the original tool.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import methods_compiled, shuffles_freed
from ..sources.bucketed import buckets_for, write_bucketed
from ..sources.corpus import eligible_files
from . import brace, lookup, name_index, snapshot
from .python_nodes import python_nodes
from .python_symbols import python_tables

FILE_COLS = ["repo", "path", "folder", "name", "lang", "error"]
IMPORT_COLS = ["repo", "path", "lang", "ord", "module", "names", "is_from"]
CLASS_COLS = ["repo", "path", "lang", "class_ord", "name", "signature", "docstring",
              "bases", "line", "ref_line"]
CALLABLE_COLS = ["repo", "path", "lang", "class_ord", "class_name", "call_ord", "kind",
                 "name", "signature", "docstring", "decorators", "is_async", "calls",
                 "line", "ref_line"]
VAR_COLS = ["repo", "path", "lang", "class_ord", "class_name", "ord", "name", "type",
            "value", "scope", "line", "ref_line"]
TABLES = ["files", "imports", "classes", "callables", "variables"]


@dataclass
class CodeIndex:
    files: DataFrame
    imports: DataFrame
    classes: DataFrame
    callables: DataFrame
    variables: DataFrame
    #: One record per file with its symbols nested; stored in a snapshot, else derived.
    stored_nested: DataFrame | None = None
    #: Time of analysis (UTC) of a snapshot's version.
    analyzed_at: str | None = None
    #: Tables of a snapshot bucketed by symbol, see :mod:`operators.lookup`.
    definitions: DataFrame | None = None
    details: DataFrame | None = None
    #: Dictionary of names with their places, see :mod:`operators.name_index`.
    names: name_index.NameIndex | None = None

    @property
    def nested(self) -> DataFrame:
        return self.stored_nested if self.stored_nested is not None else snapshot.nested_files(self.tables())

    @property
    def calls(self) -> DataFrame:
        """One row per (callable, unique callee) with its position."""
        return self.callables.select(
            "repo", "path", "lang", "class_ord", "class_name", "call_ord",
            F.col("name").alias("caller"), "kind",
            F.posexplode("calls").alias("ord", "callee"))

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}

    def register(self, prefix: str = "") -> None:
        """Temp views, so that Spark SQL works on the index as well."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
        self.calls.createOrReplaceTempView(prefix + "calls")

    def persist(self) -> "CodeIndex":
        from pyspark import StorageLevel
        for df in self.tables().values():
            # lost blocks are recomputed, which parses again unless the index is a snapshot
            df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for df in self.tables().values():
            df.unpersist()


def build_index(corpus: DataFrame, persist: bool = False,
                save_to: str | None = None, drop_self_call: bool = False, ref_compat: bool = False,
                search_names: bool = False) -> CodeIndex:
    """The corpus job: ``(repo, path, content)`` → :class:`CodeIndex`.

    Python files go through the Arrow extractor; JS/TS, C/C++ and Dart files
    through the native line-table plans of :mod:`operators.brace`, dialect by
    dialect where the corpus is bucketed.  Each
    dialect branch filters the eligible files on ``lang`` so Parquet scans
    are pruned per branch.

    ``drop_self_call`` removes a brace-language callable's own name from its
    calls (kept by default, as the original tool does).  ``ref_compat`` restores
    two quirks of C/C++: ``enum class`` for a plain enum (Q20) and character
    literals that swallow newlines (Q32).  ``persist`` keeps
    the tables cached; ``save_to`` writes them as Parquet
    (a snapshot in shared storage, e.g. below ``spark.checkpoint.dir``) and
    returns the index read back from there — lineage cut, durable against
    executor loss, and queries plan against a plain scan.  ``search_names`` adds
    the dictionary of names to the snapshot, so that searches read only what can
    match.
    """
    with methods_compiled(corpus.sparkSession):
        return _built(corpus, persist, save_to, drop_self_call, ref_compat, search_names)


def _built(corpus: DataFrame, persist: bool, save_to: str | None, drop_self_call: bool, ref_compat: bool, search_names: bool) -> CodeIndex:
    from pyspark import StorageLevel

    files = eligible_files(corpus)
    nested = python_nodes(files.where(F.col("lang") == "python"))
    other = files.where(F.col("lang") != "python")
    lines = [(part, brace.narrow(brace.annotate(part, ref_compat, dialect)), dialect) for part, dialect in brace.by_dialect(other)]
    staged = persist or save_to is not None
    if staged:
        # both intermediate results feed several tables: evaluate them once
        nested = nested.persist(StorageLevel.MEMORY_AND_DISK)
        lines = [(part, rows.persist(StorageLevel.MEMORY_AND_DISK), dialect) for part, rows, dialect in lines]
    py = python_tables(nested)
    parts = [py, *[brace.extract_all(part, lines=rows, drop_self_call=drop_self_call, dialect=dialect)[0] for part, rows, dialect in lines]]
    parts[1]["files"] = other.select("repo", "path", "folder", "name", "lang",
                                     F.lit(None).cast("string").alias("error"))

    def union(name, cols):
        out = None
        for p in parts:
            if p[name] is None:  # the files of all brace languages are listed together
                continue
            df = p[name].select(*cols)
            out = df if out is None else out.unionByName(df)
        return out

    idx = CodeIndex(
        files=union("files", FILE_COLS),
        imports=union("imports", IMPORT_COLS),
        classes=union("classes", CLASS_COLS),
        callables=union("callables", CALLABLE_COLS),
        variables=union("variables", VAR_COLS),
    )
    if save_to is not None:
        save_index(idx, save_to, search_names=search_names)
        for _, rows, _ in lines:
            rows.unpersist()
        nested.unpersist()
        idx = load_index(corpus.sparkSession, save_to)
        return idx.persist() if persist else idx
    if persist:
        # materialise every table while the annotated lines are cached, then
        # release them: the windows over the line table run once per build
        idx.persist()
        for df in idx.tables().values():
            df.count()
        for _, rows, _ in lines:
            rows.unpersist()
        nested.unpersist()
    return idx


def save_index(idx: CodeIndex, path: str, analyzed_at: str | None = None, search_names: bool = False) -> None:
    """Full rebuild, no merge — a new version beside the old ones, current
    once it is whole.  Tables are partitioned by language, so a language filter
    prunes whole folders; the nested records and the lookup tables are derived from
    the written tables."""
    spark = idx.files.sparkSession
    folder = snapshot.new_version(path)
    written = {}
    for name, df in idx.tables().items():
        written[name] = _written(df.select(*_COLUMNS[name]), f"{folder}/{name}")
    with shuffles_freed(spark):
        written["nested"] = _written(snapshot.nested_files(written), f"{folder}/nested")
    for name, df in (("definitions", lookup.definitions(written["callables"])), ("details", lookup.details(written["nested"]))):
        written[name] = write_bucketed(df, f"{folder}/{name}", ["key"], buckets_for(df))
    if search_names:
        written |= name_index.write(spark, written["classes"], written["callables"], written["imports"], folder)
    schemas = {name: df.schema for name, df in written.items()}
    snapshot.commit(spark, path, folder, schemas, analyzed_at)


_COLUMNS = {"files": FILE_COLS, "imports": IMPORT_COLS, "classes": CLASS_COLS, "callables": CALLABLE_COLS,
            "variables": VAR_COLS}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("lang").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_index(spark: SparkSession, path: str, version: int | None = None) -> CodeIndex:
    """A saved snapshot, the newest version or the one of a number; a
    missing snapshot raises ``AnalysisException``.  The tables stay those of the
    version that was current when it was loaded.  A dictionary of names in the
    older layout (a row for each run and name) is not read; searches then scan."""
    tables, analyzed_at = snapshot.current(spark, path, version)
    return CodeIndex(**{t: tables[t].select(*_COLUMNS[t]) for t in TABLES}, stored_nested=tables["nested"],
                     analyzed_at=analyzed_at, definitions=tables.get("definitions"), details=tables.get("details"),
                     names=name_index.NameIndex(**{t: tables[t] for t in name_index.TABLES}) if "places" in tables and "names" not in tables else None)


def with_names(idx: CodeIndex, folder: str) -> CodeIndex:
    """``idx`` with a dictionary of names written to ``folder``, a new one; for
    a snapshot that was saved without."""
    made = name_index.write(idx.files.sparkSession, idx.classes, idx.callables, idx.imports, folder.rstrip("/"))
    return replace(idx, names=name_index.NameIndex(**made))
