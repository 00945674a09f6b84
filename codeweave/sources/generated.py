"""Generated source corpus rendered from the TPC-H style tables.

The driver's tables hold no source code, so correctness runs on a corpus
*rendered by Spark* from ``customer``, ``orders`` and ``lineitem``; the
extractors must then recover the structure from the text while the oracle
computes it directly from the tables.  Rules (one file per customer chunk):

* repo ``repo_<lower(c_mktsegment)>``; language by ``c_custkey % 4``
  (0 Python, 1 JavaScript, 2 C++, 3 Dart);
* folder ``src/nation_<c_nationkey>``, moved below ``src/node_modules/``
  when ``c_custkey % 23 = 7`` (must be skipped); extension ``.md`` when
  ``c_custkey % 50 = 9`` (must be skipped);
* Python files with ``c_custkey % 40 = 16`` end in a syntax error;
* one class ``Cust<c>`` extends ``Base<n>`` with one attribute ``rate``
  and a constructor; one method per order, named
  ``<verb>order_<o_orderkey>`` with the verb from ``o_orderstatus``
  (F → ``get_``, O → ``obtener_``, else ``run_``), async for 1-URGENT
  orders (not in C++);
* one call per distinct ``(l_partkey, l_suppkey)`` of the order, in order of
  ``(min l_linenumber, l_partkey, l_suppkey)``;
* one free function ``crear_cust_<c>`` that calls the class and
  ``lib_<n>.make``; one import of ``lib_<n>``; one module variable.

Bounded groups: no file and no method collects an unbounded number of rows.
A customer with more than ``FILE_MAX_ORDERS`` orders is split over
``ceil(n / FILE_MAX_ORDERS)`` files by ``pmod(o_orderkey, nfiles)``, an order
with more than ``METHOD_MAX_SITES`` call sites over several methods by
``pmod(l_partkey + l_suppkey, nparts)`` (suffix ``_<part>``).  Call sites are
de-duplicated with a map-side combined aggregate before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_MAX_ORDERS = 1000
METHOD_MAX_SITES = 1000
#: Rendered bytes for each stored byte of the tables (2.0 at sf0.1); it only sets the number of buckets.
TEXT_PER_BYTE = 2

LANG_OF_KEY = "CASE pmod({k}, 4) WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'cpp' ELSE 'dart' END"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Estimated bytes of the rendered sources, from the stored bytes of the tables."""
    return TEXT_PER_BYTE * sum(int(str(_t(spark, sf_dir, t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
                               for t in ("customer", "orders", "lineitem"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct call sites per order: (l_orderkey, l_partkey, l_suppkey, first_ln)."""
    li = _t(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey", "l_partkey", "l_suppkey")
            .agg(F.min("l_linenumber").alias("first_ln")))


def site_parts(sites: DataFrame) -> DataFrame:
    """Call sites with the part ``mpart`` of the order's methods that holds them."""
    of_order = Window.partitionBy("l_orderkey")
    return (
        sites.where(F.col("l_orderkey").isNotNull())
        .withColumn("n_sites", F.count(F.lit(1)).over(of_order))
        .withColumn("mparts", F.greatest(F.lit(1), F.ceil(F.col("n_sites") / METHOD_MAX_SITES)))
        .withColumn("mpart", F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.col("mparts")))
    )


def _method_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        site_parts(call_sites(spark, sf_dir))
        .groupBy("l_orderkey", "mpart")
        .agg(F.sort_array(F.collect_list(F.struct("first_ln", "l_partkey", "l_suppkey")))
             .alias("sites"))
    )


def _render_method(lang: str) -> str:
    """SQL text of one method for a dialect; columns: mname, is_async, sites."""
    call = {
        "py": "concat('        supp_', s.l_suppkey, '.part_', s.l_partkey, '()')",
        "js": "concat('    supp_', s.l_suppkey, '.part_', s.l_partkey, '();')",
        "cpp": "concat('    supp_', s.l_suppkey, '::part_', s.l_partkey, '();')",
        "dart": "concat('    supp_', s.l_suppkey, '.part_', s.l_partkey, '();')",
    }[lang]
    calls = f"array_join(transform(sites, s -> {call}), '\\n')"
    if lang == "py":
        return ("concat(if(is_async, '    async def ', '    def '), mname, '(self, x):\\n', "
                f"if(size(sites) = 0, '        pass', {calls}), '\\n')")
    ret = "    return x;\\n  }\\n"
    if lang == "js":
        head = "concat('  ', if(is_async, 'async ', ''), mname, '(x) {\\n')"
    elif lang == "cpp":
        head = "concat('  int ', mname, '(int x) {\\n')"
    else:
        head = ("concat('  ', if(is_async, 'Future<int> ', 'int '), mname, "
                "'(int x) ', if(is_async, 'async ', ''), '{\\n')")
    return f"concat({head}, if(size(sites) = 0, '', concat({calls}, '\\n')), '{ret}')"


def _render_file(lang: str) -> str:
    """SQL text of a whole file; columns: c (custkey), n (nationkey), methods, broken."""
    if lang == "py":
        return (
            "concat('import lib_', n, '\\nLIMIT = ', c, '\\n# noise { fake_call( }\\n\\n\\n', "
            "'class Cust', c, '(Base', n, '):\\n', "
            "'    \"\"\"Account of customer ', c, '.\"\"\"\\n', "
            "'    rate = ', n, '\\n\\n', "
            "'    def __init__(self, x):\\n        self.rate = x\\n', "
            "array_join(transform(methods, m -> concat('\\n', m)), ''), "
            "'\\n\\ndef crear_cust_', c, '(x):\\n', "
            "'    s = \"{ not_a_call( }\"\\n', "
            "'    return Cust', c, '(lib_', n, '.make(x))\\n', "
            "if(broken, '\\ndef broken(:\\n', ''))"
        )
    if lang == "js":
        return (
            "concat('import { helper } from \\'lib_', n, '\\';\\n', "
            "'const LIMIT = ', c, ';\\n// noise { fake_call( }\\n\\n', "
            "'export class Cust', c, ' extends Base', n, ' {\\n', "
            "'  rate = ', n, ';\\n', "
            "'  constructor(x) {\\n    this.rate = x;\\n  }\\n', "
            "array_join(methods, ''), '}\\n\\n', "
            "'function crear_cust_', c, '(x) {\\n', "
            "'  const s = \"{ not_a_call( }\";\\n', "
            "'  return new Cust', c, '(lib_', n, '.make(x));\\n}\\n')"
        )
    if lang == "cpp":
        return (
            "concat('#include \"lib_', n, '.h\"\\n', "
            "'#define NATION_', c, ' ', n, '\\n', "
            "'const int LIMIT = ', c, ';\\n// noise { fake_call( }\\n\\n', "
            "'class Cust', c, ' : public Base', n, ' {\\npublic:\\n', "
            "'  int rate = ', n, ';\\n', "
            "'  Cust', c, '(int x) {\\n    rate = x;\\n  }\\n', "
            "array_join(methods, ''), '};\\n\\n', "
            "'Cust', c, '* crear_cust_', c, '(int x) {\\n', "
            "'  const char* s = \"{ not_a_call( }\";\\n', "
            "'  return new Cust', c, '(lib_', n, '::make(x));\\n}\\n')"
        )
    return (
        "concat('import \\'lib_', n, '.dart\\' show helper;\\n', "
        "'final int LIMIT = ', c, ';\\n// noise { fake_call( }\\n\\n', "
        "'class Cust', c, ' extends Base', n, ' {\\n', "
        "'  int rate = ', n, ';\\n', "
        "'  Cust', c, '(int x) {\\n    rate = x;\\n  }\\n', "
        "array_join(methods, ''), '}\\n\\n', "
        "'Cust', c, ' crear_cust_', c, '(int x) {\\n', "
        "'  var s = \\'{ not_a_call( }\\';\\n', "
        "'  return Cust', c, '(lib_', n, '.make(x));\\n}\\n')"
    )


def _by_lang(render, lang_col: str = "lang") -> F.Column:
    return F.expr(
        "CASE " + " ".join(f"WHEN {lang_col} = '{lg}' THEN {render(lg)}"
                           for lg in ("py", "js", "cpp", "dart")) + " END")


def generate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render the corpus ``(repo, path, content)`` from the base tables."""
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = _t(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")

    methods = (
        orders.join(_method_bodies(spark, sf_dir),
                    orders.o_orderkey == F.col("l_orderkey"), "left")
        .select(
            "o_orderkey", "o_custkey",
            F.coalesce("mpart", F.lit(0)).alias("mpart"),
            F.expr(LANG_OF_KEY.format(k="o_custkey")).alias("lang"),
            F.expr("concat(CASE o_orderstatus WHEN 'F' THEN 'get_' WHEN 'O' THEN 'obtener_' "
                   "ELSE 'run_' END, 'order_', o_orderkey, "
                   "if(coalesce(mpart, 0) > 0, concat('_', mpart), ''))").alias("mname"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_async"),
            F.coalesce("sites", F.array().cast(
                "array<struct<first_ln:int,l_partkey:bigint,l_suppkey:bigint>>")).alias("sites"),
        )
        .withColumn("mtext", _by_lang(_render_method))
    )
    per_cust = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    file_methods = (
        methods.join(per_cust, "o_custkey")
        .withColumn("fpart", F.pmod(
            F.col("o_orderkey"),
            F.greatest(F.lit(1), F.ceil(F.col("n_orders") / FILE_MAX_ORDERS))))
        .groupBy("o_custkey", "fpart")
        .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "mpart", "mtext")))
             .alias("ms"))
    )
    files = (
        cust.join(file_methods, cust.c_custkey == file_methods.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("c"),
            F.col("c_nationkey").alias("n"),
            F.lower(F.concat(F.lit("repo_"), "c_mktsegment")).alias("repo"),
            F.coalesce("fpart", F.lit(0)).alias("fpart"),
            F.expr(LANG_OF_KEY.format(k="c_custkey")).alias("lang"),
            F.expr("transform(coalesce(ms, array()), m -> m.mtext)").alias("methods"),
        )
        .withColumn("broken", F.expr("lang = 'py' AND pmod(c, 40) = 16"))
    )
    ext = F.expr("CASE WHEN pmod(c, 50) = 9 THEN '.md' WHEN lang = 'py' THEN '.py' "
                 "WHEN lang = 'js' THEN '.js' WHEN lang = 'cpp' THEN '.cpp' ELSE '.dart' END")
    path = F.concat(
        F.lit("src/"),
        F.when(F.expr("pmod(c, 23) = 7"), F.lit("node_modules/")).otherwise(F.lit("")),
        F.lit("nation_"), F.col("n").cast("string"),
        F.lit("/cust_"), F.col("c").cast("string"),
        F.when(F.col("fpart") > 0, F.concat(F.lit("_"), F.col("fpart").cast("string")))
        .otherwise(F.lit("")),
        ext,
    )
    return files.select("repo", path.alias("path"), _by_lang(_render_file).alias("content"))
