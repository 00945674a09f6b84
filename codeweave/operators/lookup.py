"""Lookup tables of a snapshot (R4, R7, K2, K3): symbols by name.

* ``definitions``: the first callable of each (repository, class, name), with its calls;
* ``details``: the first class of each (repository, name), with its members nested.

Both are bucketed by ``key``: the symbol and one of ``SALTS`` numbers derived
from the repository, so that a name which every repository defines is spread
over several buckets.  Many symbols are joined without an exchange of the index
(the symbols move, each ``SALTS`` times), and one symbol reads its buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that one symbol's repositories are spread over, at most 10 (a salt is one digit).
SALTS = 8


def key_of(salt: Column, *names: Column) -> Column:
    return F.concat_ws("\0", *[F.coalesce(n, F.lit("")) for n in names], salt.cast("string"))


def name_in(key: str) -> Column:
    """The one name of a key: what stands before the separator and the digit of its salt."""
    return F.expr(f"left({key}, length({key}) - 2)")


def _salt() -> Column:
    return F.pmod(F.xxhash64("repo"), F.lit(SALTS))


def first_callables(callables: DataFrame) -> DataFrame:
    """First definition of each repository, class and name; ``cls`` is empty for
    functions, so a dotted symbol never matches one (Q7).  Combines map-side: a
    name defined in millions of files is one partial row per task."""
    found = callables.select(
        "repo", F.coalesce(F.when(F.col("kind") == "method", F.col("class_name")), F.lit("")).alias("cls"), "name",
        F.struct("path", F.coalesce("class_ord", F.lit(-1)).alias("co"), "call_ord", "calls").alias("h"))
    return found.groupBy("repo", "cls", "name").agg(F.min("h").alias("h")).select("repo", "cls", "name", "h.path", "h.calls")


def definitions(callables: DataFrame) -> DataFrame:
    return first_callables(callables).select(key_of(_salt(), F.col("cls"), F.col("name")).alias("key"), "*")


def details(nested: DataFrame) -> DataFrame:
    """First class of each repository and name, from the nested records."""
    found = nested.select("repo", "path", F.explode("classes").alias("c"))
    first = found.groupBy("repo", F.col("c.name").alias("name")).agg(
        F.min_by(F.struct("path", "c"), F.struct("path", "c.class_ord")).alias("f"))
    return first.select(key_of(_salt(), F.col("name")).alias("key"), "name", "repo", "f.path", "f.c")


def salted(wanted: DataFrame, *names: Column) -> DataFrame:
    """The wanted symbols with each key they may be stored under."""
    return wanted.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))) \
        .withColumn("key", key_of(F.col("salt"), *names)).drop("salt")


def at_keys(table: DataFrame, *names: str) -> DataFrame:
    """The rows of one symbol, from its buckets."""
    return table.where(F.col("key").isin(["\0".join([*names, str(i)]) for i in range(SALTS)]))
