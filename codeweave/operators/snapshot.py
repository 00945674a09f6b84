"""Versioned index snapshots (S8, S10) and nested file records.

A snapshot folder holds one folder per version and, below ``manifests``, one
small JSON file per committed version with its number, folder, time of analysis
and the schemas of its tables (one without rows has no file).  A rebuild writes a new version beside the old ones and commits it
last, by renaming its manifest into place: a reader sees the old version or the
new one, never a mix, and a failed rebuild leaves the old answer.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.bucketed import forget_bucketed, read_bucketed

#: Tables of a version that are bucketed.
BUCKETED = ("definitions", "details", "grams", "postings", "places")
MANIFEST = "number long, folder string, analyzed_at string, schemas map<string,string>"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_version(path: str) -> str:
    """A fresh folder for a version's tables."""
    return f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, folder: str, schemas: dict[str, StructType], analyzed_at: str | None = None) -> str:
    """Make the version in ``folder`` the current one; returns its time of
    analysis (UTC, now unless given).  Of two rebuilds that end together, each
    gets a number of its own, as a manifest is never replaced."""
    stamp = analyzed_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    top = f"{path.rstrip('/')}/manifests"
    draft, fs = _fs(spark, f"{top}/_draft-{uuid.uuid4().hex}")
    fs.mkdirs(draft.getParent())
    number = 1 + max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(draft.getParent())
                      if s.getPath().getName()[0] not in "._"), default=0)
    while True:
        out = fs.create(draft, True)
        out.write((json.dumps({"number": number, "folder": folder.rsplit("/", 1)[-1], "analyzed_at": stamp,
                              "schemas": {t: schema.json() for t, schema in schemas.items()}}) + "\n").encode())
        out.close()
        final = _fs(spark, f"{top}/{number:09d}.json")[0]
        if not fs.exists(final) and fs.rename(draft, final):
            return stamp
        number += 1


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``number, folder, analyzed_at, schemas`` of every committed version; a folder
    without any raises ``AnalysisException``."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifests")


def current(spark: SparkSession, path: str, number: int | None = None) -> tuple[dict[str, DataFrame], str]:
    """(tables, analyzed_at) of the newest version, or of ``number``."""
    found = versions(spark, path)
    found = found if number is None else found.where(F.col("number") == number)
    row = found.orderBy(F.col("number").desc()).first()
    if row is None:
        raise LookupError(f"no committed version in {path}")
    folder = f"{path.rstrip('/')}/{row['folder']}"
    return {t: read_bucketed(spark, f"{folder}/{t}") if t in BUCKETED
            else spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder}/{t}")
            for t, schema in row["schemas"].items()}, row["analyzed_at"]


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions (at least one), manifests first."""
    rows = versions(spark, path).orderBy(F.col("number").desc()).collect()[max(keep, 1):]
    for row in rows:
        for t in BUCKETED:
            forget_bucketed(spark, f"{path.rstrip('/')}/{row['folder']}/{t}")
        for name in (f"manifests/{row['number']:09d}.json", row["folder"]):
            at, fs = _fs(spark, f"{path.rstrip('/')}/{name}")
            fs.delete(at, True)


#: Fields of the nested records, the order of their list first.
PARTS = {
    "imports": ["ord", "module", "names", "is_from"],
    "classes": ["class_ord", "name", "signature", "docstring", "bases", "line"],
    "functions": ["call_ord", "name", "signature", "docstring", "decorators", "is_async", "calls", "line"],
    "methods": ["class_ord", "call_ord", "name", "signature", "docstring", "decorators", "is_async", "calls", "line"],
    "variables": ["ord", "name", "type", "value", "line"],
    "attributes": ["class_ord", "ord", "name", "type", "value", "line"],
}


def nested_files(tables: dict[str, DataFrame]) -> DataFrame:
    """One record per file with its symbols nested (methods and attributes in
    their class), from the flat tables.  One exchange: the rows of all tables
    meet once by file, and everything else is an expression over one file."""
    callables, variables = tables["callables"], tables["variables"]
    head = ["folder", "name", "lang", "error"]
    source = {
        "file": (tables["files"], head), "imports": (tables["imports"], PARTS["imports"]),
        "classes": (tables["classes"], PARTS["classes"]),
        "functions": (callables.where(F.col("kind") == "function"), PARTS["functions"]),
        "methods": (callables.where(F.col("kind") == "method"), PARTS["methods"]),
        "variables": (variables.where(F.col("scope") == "module"), PARTS["variables"]),
        "attributes": (variables.where(F.col("scope") == "class"), PARTS["attributes"]),
    }
    rows = None
    for part, (df, fields) in source.items():
        some = df.select("repo", "path", F.struct(*fields).alias(part))
        rows = some if rows is None else rows.unionByName(some, allowMissingColumns=True)
    by_file = rows.groupBy("repo", "path").agg(
        F.first("file", ignorenulls=True).alias("file"),
        *[F.sort_array(F.collect_list(part)).alias(part) for part in PARTS])

    def of_class(part: str, c: Column) -> Column:
        inner = PARTS[part][1:]
        return F.transform(F.filter(part, lambda m: m["class_ord"] == c["class_ord"]),
                           lambda m: F.struct(*[m[f].alias(f) for f in inner]))

    classes = F.transform("classes", lambda c: F.struct(
        *[c[f].alias(f) for f in PARTS["classes"]], of_class("methods", c).alias("methods"),
        of_class("attributes", c).alias("attributes")))
    return by_file.where(F.col("file").isNotNull()).select(
        "repo", "path", *[F.col(f"file.{c}").alias(c) for c in head], classes.alias("classes"), "functions", "variables", "imports")
