"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group, run on the corpus that Spark renders from the given tables.

Every query scans the whole generated corpus (all customers, orders and
line items); parameters such as a search term are the feature being
exercised, never a row filter to keep the check cheap.  Arrays are
flattened with ``array_join(..., '|')`` and counts are BIGINT so that the
DuckDB oracle (``codeweave.oracle``) hashes to the same values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.brace import cpu_partitions
from .operators.tables import CodeIndex, build_index, with_names
from .plans import report as X
from .plans import scope as V
from .plans import search as S
from .plans import structure as Q
from .session import checkpoint_dir, spread
from .sources.corpus import classify, read_bucketed_corpus, write_corpus
from .sources.features import feature_corpus
from .sources.generated import call_sites, corpus_bytes, generate_corpus, site_parts

# Parameters of the parameterised operators (the search terms themselves).
USAGE_NAME = "part_1"
LIBRARY = "lib_1"
LIBRARIES = ["lib_2", "lib_3"]
HIT_LIBRARIES = ["lib_2", "supp_1"]
SEARCH_TERM = "order_1"
SEARCH_GLOB = "*_order_1?"
SUBTREE = "src/nation_1"
EXCLUDED_REGION = "AMERICA"

_CACHE: dict[tuple, object] = {}


def features_for(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The index of the feature corpus, a snapshot below the checkpoint folder."""
    key = ("features", spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        snap = f"{checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
        _CACHE[key] = build_index(feature_corpus(spark, sf_dir), save_to=snap)
    return _CACHE[key]


def corpus_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered corpus, written once as Parquet below the session's
    checkpoint folder, by language and in buckets by file whose number follows
    the size of the tables (cuts the rendering lineage; every extractor branch
    then scans the table, without an exchange)."""
    key = ("corpus", spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        out = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
        write_corpus(generate_corpus(spark, sf_dir), out,
                     partitions=cpu_partitions(spark, size=corpus_bytes(spark, sf_dir)))
        _CACHE[key] = read_bucketed_corpus(spark, out)
    return _CACHE[key]


def index_for(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The index of the corpus rendered from ``sf_dir``, built once per
    session, written as a snapshot below ``spark.checkpoint.dir`` by language
    and read from there: a query scans the columns and languages it needs."""
    key = ("index", spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        snap = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        _CACHE[key] = build_index(corpus_for(spark, sf_dir), save_to=snap)
    return _CACHE[key]


def names_for(spark: SparkSession, sf_dir: str) -> CodeIndex:
    """The same index with its dictionary of names, built once per session."""
    key = ("names", spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        out = f"{checkpoint_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
        _CACHE[key] = with_names(index_for(spark, sf_dir), out)
    return _CACHE[key]


def _j(c) -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, "|")


def _big(c: str) -> F.Column:
    return F.col(c).cast("bigint").alias(c)


# ---------------------------------------------------------------- sources
def extension_language(spark, d):
    return index_for(spark, d).files.select("repo", "path", "lang")


def excluded_paths(spark, d):
    return (classify(corpus_for(spark, d)).where(F.col("skip_reason").isNotNull())
            .select("repo", "path", F.col("skip_reason").alias("reason")))


def error_files(spark, d):
    return Q.error_files(index_for(spark, d)).select(
        "repo", "path", F.substring_index("error", ":", 1).alias("error_kind"))


def _calls(lang):
    def q(spark, d):
        return (index_for(spark, d).calls.where(F.col("lang") == lang)
                .select("repo", "path", "class_name", "caller", "kind", _big("ord"), "callee"))
    return q


# ------------------------------------------------------------- structure
def files_by_folder(spark, d):
    return Q.folder_tree(index_for(spark, d))


def folder_summary(spark, d):
    return Q.folder_summary(index_for(spark, d)).select(
        "repo", "folder", _big("n_files"), "first_path", "last_path")


def folder_rollup(spark, d):
    idx = index_for(spark, d)
    active = idx.files.where(F.col("lang") != "cpp").select("repo", "path")
    return V.folder_rollup(idx, active).select(
        "repo", "folder", _big("n_files"), _big("n_active"), _big("depth"))


def folder_subtree(spark, d):
    return V.subtree_files(index_for(spark, d), SUBTREE)


def visible_files(spark, d):
    idx = index_for(spark, d)
    nation = spark.read.parquet(f"{d}/nation.parquet")
    region = spark.read.parquet(f"{d}/region.parquet")
    hidden = (nation.join(region.where(F.col("r_name") == EXCLUDED_REGION),
                          nation.n_regionkey == region.r_regionkey, "left_semi")
              .select(F.concat(F.lit("src/nation_"), F.col("n_nationkey").cast("string"))
                      .alias("folder")))
    excluded = idx.files.select("repo", "folder").distinct().join(hidden, "folder", "left_semi")
    return V.visible_files(idx, excluded).select("repo", "path")


def imports_by_file(spark, d):
    return Q.imports_by_file(index_for(spark, d)).select(
        "repo", "path", _big("ord"), "module", _j("names").alias("names"), "is_from")


def import_labels(spark, d):
    return V.import_labels(index_for(spark, d)).select("repo", "path", _big("ord"), "label")


def classes_by_file(spark, d):
    return Q.classes_by_file(index_for(spark, d)).select(
        "repo", "path", _big("class_ord"), "name", "signature",
        _j("bases").alias("bases"), _big("n_methods"), _big("n_attributes"), _big("line"))


def _class_names(spark, d) -> DataFrame:
    cust = spark.read.parquet(f"{d}/customer.parquet")
    return cust.select(F.concat(F.lit("Cust"), F.col("c_custkey").cast("string")).alias("name"))


def class_detail(spark, d):
    out = Q.class_detail(index_for(spark, d), _class_names(spark, d))
    return out.select("class_name", "repo", "path", "class_signature", "member_kind",
                      _big("member_ord"), "name", "signature", _j("calls").alias("calls"),
                      "type", "value", _big("line"))


def functions_by_file(spark, d):
    return Q.functions_by_file(index_for(spark, d)).select(
        "repo", "path", _big("call_ord"), "name", "signature", "is_async",
        _j("calls").alias("calls"), _big("line"))


def _vars(scope):
    def q(spark, d):
        return Q.variables_by_file(index_for(spark, d), scope=scope).select(
            "repo", "path", "name", "type", "value", "scope")
    return q


def _method_symbols(orders: DataFrame, sites: DataFrame) -> DataFrame:
    """``Cust<c>.<method>`` for every method that the generator writes for
    ``orders``: one for each part of an order's call sites."""
    verb = (F.when(F.col("o_orderstatus") == "F", "get_")
            .when(F.col("o_orderstatus") == "O", "obtener_").otherwise("run_"))
    parts = site_parts(sites).select("l_orderkey", "mpart").distinct()
    suffix = (F.when(F.col("mpart") > 0, F.concat(F.lit("_"), F.col("mpart").cast("string")))
              .otherwise(F.lit("")))
    return (orders.join(parts, orders.o_orderkey == parts.l_orderkey, "left")
            .select(F.concat(F.lit("Cust"), F.col("o_custkey").cast("string"), F.lit("."), verb,
                             F.lit("order_"), F.col("o_orderkey").cast("string"), suffix)
                    .alias("symbol")))


def _order_symbols(spark, d) -> DataFrame:
    """The methods of every order plus every free function, from the base
    tables."""
    meth = _method_symbols(spark.read.parquet(f"{d}/orders.parquet"), call_sites(spark, d))
    cust = spark.read.parquet(f"{d}/customer.parquet")
    fns = cust.select(F.concat(F.lit("crear_cust_"), F.col("c_custkey").cast("string"))
                      .alias("symbol"))
    return meth.unionByName(fns)


def calls_of_symbols(spark, d):
    return Q.calls_of(index_for(spark, d), _order_symbols(spark, d)).select(
        "symbol", "repo", "path", _j("calls").alias("calls"))


def calls_of_symbol(spark, d):
    """The form for a few symbols: the methods of the most expensive order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    top = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1)
    sites = call_sites(spark, d)
    sym = _method_symbols(top, sites.join(top, sites.l_orderkey == top.o_orderkey, "left_semi"))
    return Q.calls_of(index_for(spark, d), sym).select(
        "symbol", "repo", "path", _j("calls").alias("calls"))


def _usages(index):
    def q(spark, d):
        return Q.usages(index(spark, d), USAGE_NAME).select("repo", "path", "context", "call")
    return q


def usages_by_file(spark, d):
    return V.usages_by_file(index_for(spark, d), USAGE_NAME).select(
        "repo", "path", _big("n_refs"), _big("n_contexts"), _big("n_calls"))


def status_totals(spark, d):
    return Q.status(index_for(spark, d)).select(
        *[_big(c) for c in ("total_files", "total_classes", "total_methods",
                            "total_functions", "total_variables", "total_attributes",
                            "error_files")])


def symbols_per_file(spark, d):
    return V.symbols_per_file(index_for(spark, d)).select(
        "repo", "path", *[_big(c) for c in ("n_classes", "n_functions", "n_variables",
                                            "n_imports", "n_symbols")])


# ---------------------------------------------------------------- search
def _library_usage(index):
    def q(spark, d):
        return S.library_usage(index(spark, d), LIBRARY).select(
            "repo", "path", "type", "symbol", _j("detail").alias("detail"))
    return q


def library_usage_by_file(spark, d):
    return V.library_hits_by_file(index_for(spark, d), LIBRARY).select(
        "repo", "path", "import_module", _big("n_calls"),
        _j("first_calls").alias("first_calls"), _big("more_calls"))


def library_hits_multi(spark, d):
    return V.library_hits_multi(index_for(spark, d), HIT_LIBRARIES).select(
        "lib", "repo", "path", "import_module", _big("n_calls"),
        _j("first_calls").alias("first_calls"), _big("more_calls"))


def status_by_repo(spark, d):
    return Q.status_by_repo(index_for(spark, d))


def _library_union(index):
    return lambda spark, d: V.library_union_files(index(spark, d), LIBRARIES)


def _search(pattern, index=index_for):
    def q(spark, d):
        return S.search(index(spark, d), pattern).select(
            "repo", "path", "type", "name", "signature", "category",
            _j("calls_to").alias("calls_to"), _big("line"))
    return q


def search_category_counts(spark, d):
    return V.search_category_counts(index_for(spark, d), SEARCH_TERM).select(
        "category", "type", _big("n"))


def suggestions(spark, d):
    return V.suggestions(index_for(spark, d), SEARCH_TERM).select(
        "repo", "path", "type", "name", "category", _big("line"))


def naming_language_totals(spark, d):
    return S.naming_language(index_for(spark, d)).select(
        "dominant", _big("count_es"), _big("count_en"), _big("mixed_files"))


def naming_language_mixed_files(spark, d):
    return S.mixed_files(index_for(spark, d))


def naming_language_by_file(spark, d):
    return S.naming_language_by_file(index_for(spark, d)).select(
        "repo", "path", _big("es"), _big("en"), "mixed")


# ------------------------------------------------------ the feature corpus
def classes_all_kinds(spark, d):
    return features_for(spark, d).classes.select(
        "repo", "path", _big("class_ord"), "name", "signature", _j("bases").alias("bases"), _big("line"))


def callables_all_kinds(spark, d):
    return features_for(spark, d).callables.select(
        "repo", "path", "class_name", _big("call_ord"), "kind", "name", "signature", "docstring",
        _j("decorators").alias("decorators"), "is_async", _j("calls").alias("calls"), _big("line"))


def variables_all_kinds(spark, d):
    return features_for(spark, d).variables.select(
        "repo", "path", "scope", "class_name", _big("ord"), "name", "type", "value", _big("line"))


def imports_all_kinds(spark, d):
    return features_for(spark, d).imports.select(
        "repo", "path", _big("ord"), "module", _j("names").alias("names"), "is_from")


def class_detail_by_repo(spark, d):
    """L1: the class ``Shared`` is defined in every file; each repository answers its first."""
    return Q.class_detail(features_for(spark, d), "Shared").select(
        "repo", "path", "member_kind", _big("member_ord"), "name", _big("line"))


# ------------------------------------------------------ real-data checks
URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)"


def url_folder_rollup(spark, d):
    """V1/V2 on real paths: every page URL is a file ``host`` / ``path``; one without a path lies in the top folder."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    path = F.regexp_replace(F.regexp_extract("url", URL_PARTS, 2), r"^/+|/+$", "")
    tree = pages.select(F.regexp_extract("url", URL_PARTS, 1).alias("repo"),
                        path.alias("path"), F.col("url").startswith("https:").alias("https")).where(F.col("path").isNotNull())
    # a path counts as active when any of its URLs is https
    paths = tree.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.max("https").alias("active"))
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    per_folder = paths.groupBy("repo", folder.alias("folder")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("active"), F.col("n")).otherwise(0)).alias("a"))
    return V.rollup_counts(per_folder).select(
        "repo", "folder", _big("n_files"), _big("n_active"), _big("depth"))


def naming_language_documents(spark, d):
    """R12's tokenizer and vote on real text: each word of a document is a
    name, each document a file."""
    docs = spread(spark.read.parquet(f"{d}/documents.parquet"))
    names = docs.select(F.lit("documents").alias("repo"), F.col("doc_id").cast("string").alias("path"),
                        F.explode(F.split("text", "[ \t\n\r]+")).alias("name"))
    return S.naming_language_of(names).select(
        "dominant", _big("count_es"), _big("count_en"), _big("mixed_files"))


# --------------------------------------------------------------- reports
def _report(level):
    def q(spark, d):
        return X.file_blocks(index_for(spark, d), level, fmt="text").select(
            "repo", "path", F.md5("block").alias("block_md5"), _big("n_lines"))
    return q


def report_markdown(spark, d):
    idx = index_for(spark, d)
    return X.report_lines(idx, "firmas", fmt="md").select(
        "repo", _big("part"), "path", _big("line_no"), "text")


def report_json(spark, d):
    return X.file_json(index_for(spark, d)).select("repo", "path", F.md5("json").alias("json_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "extension_language": extension_language,
    "excluded_paths": excluded_paths,
    "error_files": error_files,
    "extract_py_calls": _calls("python"),
    "extract_js_calls": _calls("js"),
    "extract_cpp_calls": _calls("cpp"),
    "extract_dart_calls": _calls("dart"),
    "files_by_folder": files_by_folder,
    "folder_summary": folder_summary,
    "folder_rollup": folder_rollup,
    "folder_subtree": folder_subtree,
    "visible_files": visible_files,
    "imports_by_file": imports_by_file,
    "import_labels": import_labels,
    "classes_by_file": classes_by_file,
    "class_detail": class_detail,
    "functions_by_file": functions_by_file,
    "variables_module": _vars("module"),
    "variables_class": _vars("class"),
    "variables_all": _vars(None),
    "calls_of_symbol": calls_of_symbol,
    "calls_of_symbols": calls_of_symbols,
    "usages_of_name": _usages(index_for),
    "usages_by_file": usages_by_file,
    "status_totals": status_totals,
    "symbols_per_file": symbols_per_file,
    "library_usage": _library_usage(index_for),
    "library_usage_by_file": library_usage_by_file,
    "library_hits_multi": library_hits_multi,
    "status_by_repo": status_by_repo,
    "classes_all_kinds": classes_all_kinds,
    "callables_all_kinds": callables_all_kinds,
    "variables_all_kinds": variables_all_kinds,
    "imports_all_kinds": imports_all_kinds,
    "class_detail_by_repo": class_detail_by_repo,
    "library_union_files": _library_union(index_for),
    "search_substring": _search(SEARCH_TERM),
    "search_glob": _search(SEARCH_GLOB),
    "search_names_substring": _search(SEARCH_TERM, names_for),
    "search_names_glob": _search(SEARCH_GLOB, names_for),
    "usages_by_names": _usages(names_for),
    "library_usage_by_names": _library_usage(names_for),
    "library_union_by_names": _library_union(names_for),
    "search_category_counts": search_category_counts,
    "suggestions": suggestions,
    "naming_language_totals": naming_language_totals,
    "naming_language_mixed_files": naming_language_mixed_files,
    "naming_language_by_file": naming_language_by_file,
    "url_folder_rollup": url_folder_rollup,
    "naming_language_documents": naming_language_documents,
    "report_text_estructura": _report("estructura"),
    "report_text_firmas": _report("firmas"),
    "report_text_completo": _report("completo"),
    "report_markdown": report_markdown,
    "report_json": report_json,
}
