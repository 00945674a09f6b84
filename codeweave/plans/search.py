"""Search filters (R10–R12): library usage, definition/usage search and the
naming-language vote.

Per-callable matching filters the ``calls`` array of each callable row
(``filter`` higher-order function), so a usage search is a narrow scan with
no shuffle; only the vote aggregates (map-side combined).  An index with a
name index (:mod:`operators.name_index`) answers the same from the names and
places that can match, without scanning the call arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import WORDS_EN, WORDS_ES
from ..functions.text import glob_to_regex, identifier_tokens, is_glob
from ..operators.tables import CodeIndex


def _context(kind: Column | None = None) -> Column:
    return (F.when(F.col("kind") == "method", F.concat_ws(".", "class_name", "name"))
            .otherwise(F.col("name")))


def name_matcher(pattern: str):
    """glob when the pattern has ``*`` or ``?`` (``[seq]`` then works
    too), else a substring; both case-insensitive (Q25)."""
    if is_glob(pattern):
        rx = glob_to_regex(pattern)
        return lambda c: c.rlike(rx)
    term = pattern.lower()
    return lambda c: F.lower(c).contains(term)


# --- R10 / U4 / A10 / A11 --------------------------------------------------
def library_usage(idx: CodeIndex, lib: str) -> DataFrame:
    """Files importing ``lib`` (first matching module) and callables whose
    calls mention it (matching calls in order).  ``detail`` is an array:
    size 1 for imports (Q28)."""
    term = lib.lower()
    if idx.names is not None:
        return _library_places(idx.names.places_of(term, lambda c: F.lower(c).contains(term)))
    imp = (idx.imports.where(F.lower("module").contains(term))
           .groupBy("repo", "path")
           .agg(F.min_by("module", "ord").alias("m"))
           .select("repo", "path", F.lit("import").alias("type"),
                   F.lit(None).cast("string").alias("symbol"),
                   F.array("m").alias("detail"),
                   F.lit(-1).alias("class_ord"), F.lit(-1).alias("call_ord")))
    calls = (idx.callables
             .select("repo", "path", "kind", "class_name", "name", "class_ord", "call_ord",
                     F.filter("calls", lambda x: F.lower(x).contains(term)).alias("detail"))
             .where(F.size("detail") > 0)
             .select("repo", "path", F.lit("call").alias("type"), _context().alias("symbol"),
                     "detail", F.coalesce("class_ord", F.lit(1 << 30)).alias("class_ord"),
                     "call_ord"))
    return imp.unionByName(calls)


def _library_places(places: DataFrame) -> DataFrame:
    imp = (places.where(F.col("role") == "import").groupBy("repo", "path").agg(F.min_by("name", "ord").alias("m"))
           .select("repo", "path", F.lit("import").alias("type"), F.lit(None).cast("string").alias("symbol"),
                   F.array("m").alias("detail"), F.lit(-1).alias("class_ord"), F.lit(-1).alias("call_ord")))
    return imp.unionByName(_callers(places).select(
        "repo", "path", F.lit("call").alias("type"), F.col("context").alias("symbol"), F.col("found").alias("detail"),
        F.coalesce("class_ord", F.lit(1 << 30)).alias("class_ord"), "call_ord"))


def _callers(places: DataFrame) -> DataFrame:
    """Callables with their matching calls in order, from the places of calls
    (one callable's calls form a group)."""
    one = ["repo", "path", "kind", "context", "signature", "line", "class_ord", "call_ord"]
    return (places.where(F.col("role") == "usage").groupBy(*one)
            .agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("c"))
            .select(*one, F.col("c.name").alias("found")))


# --- R11 / U3 / F4 ---------------------------------------------------------
def search(idx: CodeIndex, pattern: str) -> DataFrame:
    """Definitions (classes, methods, functions) whose name matches and
    callables that call something matching (``calls_to``).  ``class_ord`` and
    ``call_ord`` keep the source order (functions have no class)."""
    match = name_matcher(pattern)
    if idx.names is not None:
        return _search_places(idx.names.places_of(pattern, match))
    cls = idx.classes.where(match(F.col("name"))).select(
        "repo", "path", F.lit("class").alias("type"), "name", "signature", "line",
        F.lit("definition").alias("category"),
        F.lit(None).cast("array<string>").alias("calls_to"), "class_ord", F.lit(-1).alias("call_ord"))
    defs = idx.callables.where(match(F.col("name"))).select(
        "repo", "path", "kind", _context().alias("name"), "signature", "line",
        F.lit("definition").alias("category"),
        F.lit(None).cast("array<string>").alias("calls_to"), "class_ord", "call_ord"
    ).withColumnRenamed("kind", "type")
    uses = (idx.callables
            .select("repo", "path", "kind", "class_name", "name", "signature", "line",
                    F.filter("calls", match).alias("calls_to"), "class_ord", "call_ord")
            .where(F.size("calls_to") > 0)
            .select("repo", "path", F.col("kind").alias("type"), _context().alias("name"),
                    "signature", "line", F.lit("usage").alias("category"), "calls_to", "class_ord", "call_ord"))
    return cls.unionByName(defs).unionByName(uses)


def _search_places(places: DataFrame) -> DataFrame:
    shown = ["repo", "path", F.col("kind").alias("type"), F.col("context").alias("name"), "signature", "line"]
    defs = places.where(F.col("role") == "definition").select(
        *shown, F.lit("definition").alias("category"), F.lit(None).cast("array<string>").alias("calls_to"),
        "class_ord", "call_ord")
    return defs.unionByName(_callers(places).select(
        *shown, F.lit("usage").alias("category"), F.col("found").alias("calls_to"), "class_ord", "call_ord"))


# --- R12 / A12 / K4 --------------------------------------------------------
def _name_tokens(idx: CodeIndex) -> DataFrame:
    return _tokens_of(idx.classes.select("repo", "path", "name")
                      .unionByName(idx.callables.select("repo", "path", "name")))


def _tokens_of(names: DataFrame) -> DataFrame:
    # IN-lists of literals become hash-set lookups (InSet) in Catalyst
    t = F.col("t")
    return (names.select("repo", "path", F.explode(identifier_tokens(F.col("name"))).alias("t"))
            .select("repo", "path",
                    # Spanish is tested first: a word in both lists counts as Spanish
                    F.when(t.isin(*WORDS_ES), F.lit("es"))
                    .when(t.isin(*WORDS_EN), F.lit("en")).alias("lang"))
            .where(F.col("lang").isNotNull()))


def naming_language_by_file(idx: CodeIndex) -> DataFrame:
    """Per file: Spanish and English token counts and whether it mixes."""
    return _vote_per_file(_name_tokens(idx))


def _vote_per_file(tokens: DataFrame) -> DataFrame:
    return (tokens.groupBy("repo", "path")
            .agg(F.count(F.when(F.col("lang") == "es", 1)).alias("es"),
                 F.count(F.when(F.col("lang") == "en", 1)).alias("en"))
            .withColumn("mixed", (F.col("es") > 0) & (F.col("en") > 0)))


def naming_language(idx: CodeIndex) -> DataFrame:
    """One row: dominant language (ties → ``es``), both counts, number of
    mixed files."""
    return _vote_totals(naming_language_by_file(idx))


def naming_language_of(names: DataFrame) -> DataFrame:
    """The vote for any ``(repo, path, name)`` frame of identifiers."""
    return _vote_totals(_vote_per_file(_tokens_of(names)))


def _vote_totals(per: DataFrame) -> DataFrame:
    tot = per.agg(F.coalesce(F.sum("es"), F.lit(0)).cast("long").alias("count_es"),
                  F.coalesce(F.sum("en"), F.lit(0)).cast("long").alias("count_en"),
                  F.count(F.when(F.col("mixed"), 1)).alias("mixed_files"))
    return tot.select(
        F.when(F.col("count_es") + F.col("count_en") == 0, F.lit("indeterminado"))
        .when(F.col("count_es") >= F.col("count_en"), F.lit("es"))
        .otherwise(F.lit("en")).alias("dominant"),
        "count_es", "count_en", "mixed_files")


def mixed_files(idx: CodeIndex) -> DataFrame:
    return naming_language_by_file(idx).where("mixed").select("repo", "path")
