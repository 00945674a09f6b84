"""Native extraction for the brace languages (JS/TS, C/C++, Dart).

The whole plan is Catalyst expressions, windows and one aggregation:

1. per file: blank comments/strings (``functions.text.clean_code``);
2. **one exchange** on ``(repo, path)`` (none on a bucketed corpus, where each
   dialect also gets a plan of its own), then ``posexplode`` the cleaned text into
   lines with braces and whole runs of lines without (explode keeps the
   partitioning, so nothing below shuffles again);
3. windows per file ordered by line: the clamped brace depth before each
   line (running sum minus the running minimum) and the last earlier line
   that closed a module-level block (depth 0) or a class member (depth 1);
   a run too deep to hold a header or member stays one row, others are split;
   a line belongs to the block opened on line s iff no block closed in
   between (running frames only — a forward frame would be quadratic);
4. header lines (classes at depth 0, members at class depth 1, functions at
   depth 0) are recognised with the dialect's patterns; every line is
   assigned to the callable whose body contains it;
5. one ``groupBy(repo, path, owner)`` re-assembles each body and extracts
   its unique calls with ``regexp_extract_all``.

Imports, ``#include`` and ``#define`` work on raw lines and need no shuffle.

Body boundaries follow balanced braces; braces inside the parentheses of a
JS header do not count, at any nesting.  A Dart ``=>`` body and a Dart module
variable run on to the line whose ``;`` closes them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import (BRACE_EXCLUDED_CALLS, C_BASE_TYPES, C_KEYWORDS,
                                 C_LANGS, DART_KEYWORDS, JS_KEYWORDS, JS_LANGS)
from ..functions.text import clean_code, count_char, one_newline, py_strip, split_lines

# ---------------------------------------------------------------------------
# fixed values: dialect patterns (Java syntax; (?U) gives Unicode \w like
# Python's str patterns)
# ---------------------------------------------------------------------------
JS_IMPORT_FROM = (r"(?U)import\s+(?:type\s+)?(?:\*\s+as\s+\w+|[\w$]+\s*,\s*\{[^}]*\}|"
                  r"\{[^}]*\}|[\w$]+)\s+from\s+['\"]([^'\"]+)['\"]")
JS_IMPORT_BARE = r"^import\s+['\"]([^'\"]+)['\"]\s*;?\s*$"
JS_CLASS = (r"(?U)^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)"
            r"(?:\s+extends\s+([\w$.]+))?(?:\s+implements\s+[\w$,\s<>]+)?\s*\{")
JS_FUNCTION = (r"(?U)^(?:export\s+)?(?:default\s+)?(?:async\s+)?"
               r"function\*?\s+([\w$]+)\s*(\([^)]*\))")
JS_ARROW = (r"(?U)^(?:export\s+)?(?:const|let)\s+([\w$]+)\s*="
            r"\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*=>")
JS_METHOD = (r"(?U)^(?:(?:public|private|protected|static|async|override|abstract|"
             r"readonly|declare)\s+)*(?:get\s+|set\s+)?"
             r"((?!if|for|while|switch|return|new|typeof|delete|void|throw)\b[\w$]+)\s*"
             r"(\([^)]*\))\s*(?::\s*[\w<>\[\]|&,\s?]+)?\s*\{")
JS_METHOD_ASYNC = (r"^(?:(?:public|private|protected|static|override|abstract|declare)\s+)*"
                   r"async\s+")
JS_ATTR_TS = (r"(?U)^(?:(?:readonly|static|public|private|protected|override|declare|"
              r"abstract)\s+)+([\w$]+)\s*[?!]?\s*:\s*([\w<>\[\]|&,\s?]+?)"
              r"(?:\s*=\s*([^;]+))?\s*;")
JS_ATTR_PLAIN = r"(?U)^(?:static\s+)?([\w$]+)(?:\s*=\s*([^;]+))?\s*;$"
JS_CTOR = r"^constructor\s*\("
JS_THIS_ATTR = r"(?U)^\s*this\.([\w$]+)\s*=\s*(.+?)\s*;?\s*$"
JS_VARIABLE = (r"(?U)^(?:export\s+)?(?:const|let|var)\s+([\w$]+)"
               r"(?:\s*:\s*([\w<>\[\]|&,\s?]+?))?\s*=\s*(.+)")
JS_CALL = r"(?U)([\w$][\w$.]*)\s*\("

C_INCLUDE = r"^#include\s+[<\"]([^>\"]+)[>\"]"
C_DEFINE = r"(?U)^#define\s+(\w+)(?:\s+(.+))?$"
C_CLASS = (r"(?U)^(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)"
           r"(?:\s*:\s*(?:public|protected|private)?\s*([\w:]+))?\s*\{")
C_ENUM = r"(?U)^enum(?:\s+class)?\s+(\w+)(?:\s*:\s*[\w:]+)?\s*\{"
C_FUNCTION = (r"(?U)^(?:(?:static|inline|virtual|explicit|constexpr|extern)\s+)*"
              r"((?:const\s+)?[\w:*&<>]+(?:\s*[*&]+)?)\s+(\w+)\s*\(([^)]*)\)"
              r"(?:\s*const)?(?:\s*override)?(?:\s*noexcept)?\s*\{")
C_CTOR = r"(?U)^(?:(?:explicit|inline)\s+)?(\w+)\s*\(([^)]*)\)(?:\s*:[^{]+)?\s*\{"
C_ATTR = (r"(?U)^(?:(?:static|const|mutable|volatile)\s+)*"
          r"([\w:*&<>]+(?:\s*[*&]+)?)\s+(\w+)\s*(?:=\s*([^;]+))?\s*;$")
C_VARIABLE = (r"(?U)^(?:(?:static|extern|const|constexpr|volatile)\s+)+"
              r"([\w:*&<>]+(?:\s*[*&]+)?)\s+(\w+)\s*(?:=\s*([^;]+))?\s*;")
C_CALL = r"(?U)\b(\w[\w:]*)\s*\("

DART_IMPORT = (r"(?mU)^import\s+['\"]([^'\"]+)['\"]\s*(?:as\s+(\w+)\s*)?"
               r"(?:show\s+([\w\s,]+?))?(?:hide\s+([\w\s,]+?))?\s*;")
DART_EXPORT = r"(?m)^export\s+['\"]([^'\"]+)['\"]\s*;"
DART_CLASS = (r"(?U)^[ \t]*(?:abstract\s+|base\s+|final\s+|sealed\s+|interface\s+)?"
              r"(?:mixin\s+)?class\s+(\w+)(?:\s+extends\s+([\w<>, ]+?))?"
              r"(?:\s+with\s+([\w<>, ]+?))?(?:\s+implements\s+([\w<>, ]+?))?\s*\{")
DART_MIXIN = r"(?U)^[ \t]*mixin\s+(\w+)(?:\s+on\s+([\w<>, ]+?))?\s*\{"
DART_ENUM = r"(?U)^[ \t]*enum\s+(\w+)\s*\{"
DART_EXTENSION = r"(?U)^[ \t]*extension\s+(\w+)\s+on\s+([\w<>?]+)\s*\{"
DART_METHOD = (r"(?U)^[ \t]*(?:([\w<>\[\]?,\s]+?)\s+)?(\w+)\s*(?:<[^>]*>\s*)?"
               r"\(([^)]*)\)\s*(async\s*)?(?:\{|=>)")
DART_CTOR = r"(?U)^[ \t]*(\w+)\s*(?:\.(\w+))?\s*\(([^)]*)\)\s*(?::\s*[^{]+)?(?:\{|;)"
DART_ATTR = (r"(?U)^[ \t]*(?:(?:final|late|static|const|override)\s+)*"
             r"([\w<>\[\]?]+(?:\s*\?)?)\s+(\w+)\s*(?:=\s*([^;]+?))?\s*;")
DART_VARIABLE = r"(?U)^(?:final|const|late|var)\s+(?:([\w<>\[\]?]+)\s+)?(\w+)\s*=\s*([^;]+?)\s*;"
DART_VARIABLE_START = r"(?U)^(?:final|const|late|var)\s+(?:[\w<>\[\]?]+\s+)?\w+\s*="
DART_CALL = r"(?U)\b(\w+)\s*\("

KEY = ["repo", "path"]
DIALECTS = {"js": JS_LANGS, "c": C_LANGS, "dart": ["dart"]}


def _rx(s: Column, pat: str, g: int) -> Column:
    return F.regexp_extract(s, pat, g)


def _nz(c: Column) -> Column:
    """'' (group did not take part) → NULL."""
    return F.when(c != "", c)


def dialect_of(lang: Column) -> Column:
    return F.coalesce(*[F.when(lang.isin(*langs), F.lit(d)) for d, langs in DIALECTS.items()])


# ---------------------------------------------------------------------------
# raw-line branch: imports, includes, defines (narrow, no shuffle)
# ---------------------------------------------------------------------------
#: A text up to the end of its last line with ``#`` or ``import``.
MARKED = r"(?s)\A.*(?:#|import)[^\n]*+"


def _raw_branch(files: DataFrame, dialects: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    d = files.select("repo", "path", "lang", dialect_of(F.col("lang")).alias("d"), "text")
    raw = (d.where(F.col("d").isin("js", "c"))
           # of most files these are the first lines, and the others need not be taken apart
           .select("repo", "path", "lang", "d", F.posexplode(split_lines(_rx(F.col("text"), MARKED, 0)))
                   .alias("ln", "raw"))
           .where(F.col("raw").contains("import") | F.col("raw").contains("#"))
           .withColumn("s", py_strip(F.col("raw"))))
    js = raw.where(F.col("d") == "js")
    js_from = F.col("s").rlike(JS_IMPORT_FROM)
    js_names = F.filter(F.transform(
        F.split(_rx(F.col("s"), r"\{([^}]+)\}", 1), ","),
        lambda n: py_strip(F.element_at(F.split(py_strip(n), " as "), 1))),
        lambda n: n != "")
    js_imp = js.where(js_from | F.col("s").rlike(JS_IMPORT_BARE)).select(
        "repo", "path", "lang", F.col("ln").alias("pos"),
        F.when(js_from, _rx(F.col("s"), JS_IMPORT_FROM, 1))
        .otherwise(_rx(F.col("s"), JS_IMPORT_BARE, 1)).alias("module"),
        F.when(js_from & F.col("s").rlike(r"\{([^}]+)\}"), js_names)
        .otherwise(F.array().cast("array<string>")).alias("names"),
        js_from.alias("is_from"))
    c = raw.where(F.col("d") == "c")
    c_inc = c.where(F.col("s").rlike(C_INCLUDE)).select(
        "repo", "path", "lang", F.col("ln").alias("pos"),
        _rx(F.col("s"), C_INCLUDE, 1).alias("module"),
        F.array().cast("array<string>").alias("names"), F.lit(False).alias("is_from"))
    dval = py_strip(_rx(F.col("s"), C_DEFINE, 2))
    c_def = c.where(~F.col("s").rlike(C_INCLUDE) & F.col("s").rlike(C_DEFINE)).select(
        "repo", "path", "lang", F.col("ln").alias("pos"),
        _rx(F.col("s"), C_DEFINE, 1).alias("name"),
        F.lit("#define").alias("type"),
        F.when(dval != "", dval).alias("value"),
        (F.col("ln") + 1).alias("line"), F.lit(0).alias("ref_line"))
    # Dart: imports then exports, matched over the whole raw text
    dart = d.where(F.col("d") == "dart")
    imps = F.arrays_zip(
        F.regexp_extract_all(F.col("text"), F.lit(DART_IMPORT), 1).alias("m"),
        F.regexp_extract_all(F.col("text"), F.lit(DART_IMPORT), 3).alias("show"))
    dart_imp = dart.select("repo", "path", "lang", F.posexplode(imps).alias("pos", "x")).select(
        "repo", "path", "lang", "pos", F.col("x.m").alias("module"),
        F.filter(F.transform(F.split(F.col("x.show"), ","), lambda n: py_strip(n)),
                 lambda n: n != "").alias("names"))
    dart_imp = dart_imp.withColumn("is_from", F.size("names") > 0)
    dart_exp = dart.select(
        "repo", "path", "lang",
        F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(DART_EXPORT), 1))
        .alias("pos", "m")).select(
        "repo", "path", "lang", (F.col("pos") + F.lit(1 << 30)).alias("pos"),
        F.concat(F.lit("export:"), "m").alias("module"),
        F.array().cast("array<string>").alias("names"), F.lit(False).alias("is_from"))
    found = {"js": [js_imp], "c": [c_inc], "dart": [dart_imp, dart_exp]}
    imports = reduce(DataFrame.unionByName, [x for d in dialects for x in found[d]])
    imports = imports.withColumn(
        "ord", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1).drop("pos")
    return imports, c_def


# ---------------------------------------------------------------------------
# line table with depth
# ---------------------------------------------------------------------------
_BRACE_STATE = (
    "aggregate(regexp_extract_all(line, '[{{}}]', 0), "
    "named_struct('cur', 0, 'mn', 0, 'st', false, 'lc', 0, 'cl', false), "
    "(a, b) -> named_struct("
    "'cur', a.cur + if(b = '{{', 1, -1), "
    "'mn', least(a.mn, a.cur + if(b = '{{', 1, -1)), "
    "'st', a.st OR b = '{{', "
    "'lc', CASE WHEN b = '{{' THEN a.lc + 1 WHEN a.st THEN a.lc - 1 ELSE a.lc END, "
    "'cl', a.cl OR (b = '}}' AND a.st AND a.lc = 1)))"
)


# the same outside parentheses only (default parameters may hold braces at any nesting)
_OUTSIDE_PARENS = (
    "aggregate(regexp_extract_all(line, '[(){}]', 0), "
    "named_struct('p', 0, 'st', false, 'lc', 0, 'cl', false), "
    "(a, b) -> named_struct("
    "'p', CASE WHEN b = '(' THEN a.p + 1 WHEN b = ')' THEN greatest(a.p - 1, 0) ELSE a.p END, "
    "'st', a.st OR (b = '{' AND a.p = 0), "
    "'lc', CASE WHEN a.p > 0 OR b IN ('(', ')') THEN a.lc WHEN b = '{' THEN a.lc + 1 "
    "WHEN a.st THEN a.lc - 1 ELSE a.lc END, "
    "'cl', a.cl OR (b = '}' AND a.p = 0 AND a.st AND a.lc = 1)))"
)


#: Estimated source bytes for one partition of the line stage, and its largest number of partitions.
LINE_BYTES, MOST_PARTITIONS = 32 << 20, 200_000


def cpu_partitions(spark, files: DataFrame | None = None, size: int | None = None) -> int:
    """Partition count for the CPU-bound line stage.

    Per-line regexes and windows cost CPU, not bytes, so this exchange gets an
    explicit count (which AQE does not coalesce into a handful of tasks).  It
    follows the input: one partition for ``LINE_BYTES`` of ``size`` (bytes of
    source), by default the optimizer's size of ``files``, at least two tasks per core; a size that no statistics back
    (rows made on the driver) counts as the session's shuffle partitions.
    ``codeweave.linePartitions`` overrides it.
    """
    forced = spark.conf.get("codeweave.linePartitions", "")
    if forced:
        return int(forced)
    least = 2 * spark.sparkContext.defaultParallelism
    if size is None:
        size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if files is not None else 1 << 62
    if size >= 1 << 60:
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(MOST_PARTITIONS, -(-size // LINE_BYTES)))


def in_place(files: DataFrame) -> bool:
    """Whether the rows of a file are where windows over it need them: the
    source is bucketed by ``(repo, path)``."""
    at = files._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    return re.fullmatch(r"hashpartitioning\(repo#\d+, path#\d+, \d+\)", at) is not None


#: Pieces of a cleaned text: a run of lines without braces, with the line of only a ``}`` that may end it, or one line;
#: and single lines.
RUNS, LINES = r"(?:[^{}\n]*+\n)++(?:[ \t]*+}[ \t]*+\n)?|[^\n]*+\n", r"[^\n]*+\n"


def line_table(files: DataFrame, ref_compat: bool = False, d: Column | None = None, runs: bool = False) -> DataFrame:
    """Cleaned lines with brace depth: no exchange on a corpus bucketed by
    (repo, path), else one.

    The depth changes on lines with braces only, so it is found on these and on
    whole runs of lines without, with the closing brace after them where it is
    alone on its line. ``runs`` leaves a run that is deep inside a block
    in one row, at its first line: no line of it can be a header, a member or a
    ``#define``, set an attribute, or end a Dart statement that began outside,
    and no header stands between its first line and the closing brace.
    ``d`` is the files' dialect where they all have the same."""
    cleaned = files.select("repo", "path", "lang", (dialect_of(F.col("lang")) if d is None else d).alias("d"), "text")
    if not in_place(files):
        cleaned = cleaned.repartition(cpu_partitions(files.sparkSession, files.select(*KEY, "lang", "text")), *KEY)
    d = F.col("d") if d is None else d
    # files that share (repo, path) are read line by line, as their lines interleave
    same = Window.partitionBy(*KEY).orderBy(*KEY)
    cleaned = (cleaned.withColumn("alone", F.lag(F.lit(1)).over(same).isNull() & F.lead(F.lit(1)).over(same).isNull())
               .withColumn("clean", F.when(d == "js", clean_code(F.col("text"), "js"))
                           .when(d == "c", clean_code(F.col("text"), "c", ref_compat))
                           .otherwise(clean_code(F.col("text"), "dart")))
               .drop("text")
               .withColumn("clean", one_newline(F.col("clean"))))
    lines = cleaned.select("repo", "path", "lang", "d", "alone", F.posexplode(
        F.when(F.col("alone"), F.regexp_extract_all("clean", F.lit(RUNS), 0))
        .otherwise(F.regexp_extract_all("clean", F.lit(LINES), 0))).alias("pos", "line"))
    # only lines holding both '{' and '}' need the character-level scan; for
    # the rest the lowest prefix is -closes and the line cannot close itself
    has_b = (F.col("o") > 0) & (F.col("c") > 0)
    lines = (lines
             .withColumn("n", count_char(F.col("line"), "\n"))
             .withColumn("line", F.expr("left(line, length(line) - 1)"))
             .withColumn("o", count_char(F.col("line"), "{"))
             .withColumn("c", count_char(F.col("line"), "}"))
             .withColumn("bst", F.when(has_b, F.expr(_BRACE_STATE.format())))
             .withColumn("pmin", F.coalesce(F.col("bst.mn"), -F.col("c")))
             .withColumn("selfclose", F.coalesce(F.col("bst.cl"), F.lit(False)))
             .withColumn("selfclose_p", F.when(
                 (d == "js") & F.col("line").contains("(") & has_b,
                 F.expr(_OUTSIDE_PARENS)["cl"]).otherwise(F.col("selfclose")))
             .drop("bst"))
    w = Window.partitionBy(*KEY).orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("*", F.sum(F.col("o") - F.col("c")).over(run).alias("s_after"),
                         F.sum("n").over(prev).alias("n_before"))
    lines = (lines
             .withColumn("ln", F.when(F.col("alone"), F.coalesce(F.col("n_before"), F.lit(0))).otherwise(F.col("pos")).cast("int"))
             .withColumn("s_before", F.col("s_after") - (F.col("o") - F.col("c")))
             .withColumn("min_prev", F.least(F.lit(0), F.coalesce(
                 F.min("s_after").over(prev), F.lit(0))))
             .withColumn("depth", F.col("s_before") - F.col("min_prev"))
             .drop("min_prev", "n_before", "alone"))
    # a line closes a block opened at depth b when its lowest point reaches b
    lines = (lines
             .withColumn("end0", (F.col("depth") > 0) & (F.col("depth") + F.col("pmin") <= 0))
             .withColumn("end1", (F.col("depth") > 1) & (F.col("depth") + F.col("pmin") <= 1))
             .drop("pmin"))
    line = F.col("line")
    pieces = F.split(line, "\n", -1)
    if runs:
        # members stand at the level that a class header leaves (Dart: one above it), and
        # a Dart statement ends at the level where it began, on one of the first two
        level = F.when(d == "dart", F.when(F.col("depth") == 0, F.col("s_before") + 1).when(F.col("depth") == 1, F.col("s_before"))) \
            .when((F.col("depth") == 0) & _names_class(line), F.when(F.col("n") > 1, F.col("s_before")).otherwise(F.col("s_after")))
        lines = lines.withColumn("level", F.max(level).over(prev))
        deep = ((F.col("o") == 0) & ((F.col("c") == 0) | (F.col("n") > 1)) & (F.col("depth") > F.when(d == "dart", 1).otherwise(0))
                & (F.coalesce(F.col("level"), F.col("s_before") - 1) < F.col("s_before"))
                & ~F.when(d == "js", line.contains("this.")).when(d == "c", line.contains("#")).otherwise(F.lit(False)))
        pieces = F.when(deep, F.array(line)).otherwise(pieces)
    lines = (lines.withColumn("pieces", F.when(F.col("n") > 1, pieces).otherwise(F.array(line)))
             .withColumn("more", F.size("pieces") - 1)
             .select(*[c for c in lines.columns if c not in ("line", "n", "pos", "level")], "more", F.posexplode("pieces").alias("i", "line")))
    # of a run that is split, only the last line can hold the closing brace
    last = F.col("i") == F.col("more")
    ends = {"c": F.when(last, F.col("c")).otherwise(0), "s_after": F.when(last, F.col("s_after")).otherwise(F.col("s_before")),
            "end0": last & F.col("end0"), "end1": last & F.col("end1"), "ln": F.col("ln") + F.col("i")}
    return (lines.select(*[ends[c].alias(c) if c in ends else c for c in lines.columns if c not in ("i", "more")])
            # nothing is asked of the text of a whole run, other than to be a body's
            .withColumn("s", F.when(line.contains("\n"), F.lit("")).otherwise(py_strip(line))))


def _names_class(line: Column) -> Column:
    return (line.contains("class") | line.contains("struct") | line.contains("enum")
            | line.contains("mixin") | line.contains("extension"))


# ---------------------------------------------------------------------------
# headers
# ---------------------------------------------------------------------------
def _class_header(d: Column, ref_compat: bool = False) -> dict[str, Column]:
    """Columns describing a module-level class header (NULL name otherwise).
    With ``ref_compat`` a C enum is always ``enum class`` or ``enum struct`` (Q20)."""
    s, line = F.col("s"), F.col("line")
    js_m = s.rlike(JS_CLASS)
    c_cls, c_enum = s.rlike(C_CLASS), s.rlike(C_ENUM)
    de, dm, dx, dc = (line.rlike(DART_ENUM), line.rlike(DART_MIXIN),
                      line.rlike(DART_EXTENSION), line.rlike(DART_CLASS))

    def split_list(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, ","), lambda b: py_strip(b)), lambda b: b != "")

    js_base = _rx(s, JS_CLASS, 2)
    c_base = py_strip(_rx(s, C_CLASS, 2))
    c_name = F.when(c_cls, _rx(s, C_CLASS, 1)).otherwise(_rx(s, C_ENUM, 1))
    dart_bases = F.concat(split_list(_rx(line, DART_CLASS, 2)),
                          split_list(_rx(line, DART_CLASS, 3)),
                          split_list(_rx(line, DART_CLASS, 4)))
    is_hdr = (F.col("depth") == 0) & (
        ((d == "js") & js_m) | ((d == "c") & (c_cls | c_enum))
        | ((d == "dart") & (de | dm | dx | dc)))
    kind = (F.when(d != "dart", F.lit("class")).when(de, F.lit("enum")).when(dm, F.lit("mixin"))
            .when(dx, F.lit("extension")).otherwise(F.lit("class")))
    name = (F.when(d == "js", _rx(s, JS_CLASS, 1)).when(d == "c", c_name)
            .when(de, _rx(line, DART_ENUM, 1)).when(dm, _rx(line, DART_MIXIN, 1))
            .when(dx, _rx(line, DART_EXTENSION, 1)).otherwise(_rx(line, DART_CLASS, 1)))
    bases = (F.when(d == "js", F.when(js_base != "", F.array(js_base)))
             .when(d == "c", F.when(c_cls & (c_base != ""), F.array(c_base)))
             .when(de, F.array())
             .when(dm, split_list(_rx(line, DART_MIXIN, 2)))
             .when(dx, F.array(_rx(line, DART_EXTENSION, 2)))
             .otherwise(dart_bases))
    bases = F.coalesce(bases, F.array().cast("array<string>"))
    keyword = F.when(line.contains("struct"), F.lit("struct ")).otherwise(F.lit("class "))
    if not ref_compat:
        keyword = F.when(~c_cls & ~s.rlike(r"^enum\s+(?:class|struct)\s"), F.lit("")) \
            .when(c_cls, F.concat(_rx(s, r"^(?:template\s*<[^>]*>\s*)?(class|struct)\s", 1), F.lit(" "))).otherwise(keyword)
    sig = (F.when(d == "js", F.concat(F.lit("class "), name,
                                      F.when(js_base != "", F.concat(F.lit(" extends "), js_base))
                                      .otherwise(F.lit(""))))
           .when(d == "c", F.concat(
               F.when(c_cls, F.lit("")).otherwise(F.lit("enum ")),
               keyword, name,
               F.when(c_cls & (c_base != ""), F.concat(F.lit(" : "), c_base)).otherwise(F.lit(""))))
           .when(de, F.concat(F.lit("enum "), name))
           .when(dm, F.concat(F.lit("mixin "), name))
           .when(dx, F.concat(F.lit("extension "), name, F.lit(" on "), _rx(line, DART_EXTENSION, 2)))
           .otherwise(py_strip(F.regexp_replace(s, r"\{+$", ""))))
    return {"is_class": is_hdr, "ckind": kind, "cname": name, "cbases": bases, "csig": sig}


def _function_header(d: Column) -> dict[str, Column]:
    s, line = F.col("s"), F.col("line")
    js_f, js_a = s.rlike(JS_FUNCTION), s.rlike(JS_ARROW)
    c_f = s.rlike(C_FUNCTION)
    dm = line.rlike(DART_METHOD)
    js_fname = _rx(s, JS_FUNCTION, 1)
    js_async_f = F.substring(s, F.lit(1), F.position(js_fname, s) - 1).contains("async")
    js_async_a = F.expr("substring(s, 1, greatest(0, locate('=>', s) - 2))").contains("async")
    c_name = _rx(s, C_FUNCTION, 2)
    d_name = py_strip(_rx(line, DART_METHOD, 2))
    d_ret = py_strip(_rx(line, DART_METHOD, 1))
    d_params = py_strip(_rx(line, DART_METHOD, 3))
    is_fn = (F.col("depth") == 0) & ~F.col("is_class") & (
        ((d == "js") & (js_f | js_a))
        | ((d == "c") & c_f & ~c_name.isin(*C_KEYWORDS)
           & ~c_name.isin(*C_BASE_TYPES))
        | ((d == "dart") & dm & ~d_name.isin(*DART_KEYWORDS)
           & ~F.substring(d_name, 1, 1).rlike(r"\p{Lu}")))
    name = (F.when(d == "js", F.when(js_f, js_fname).otherwise(_rx(s, JS_ARROW, 1)))
            .when(d == "c", c_name).otherwise(d_name))
    is_async = (F.when(d == "js", F.when(js_f, js_async_f).otherwise(js_async_a))
                .when(d == "c", F.lit(False))
                .otherwise(_rx(line, DART_METHOD, 4) != ""))
    sig = (F.when(d == "js", F.when(js_f, F.concat(
        F.when(js_async_f, F.lit("async ")).otherwise(F.lit("")), F.lit("function "),
        js_fname, _rx(s, JS_FUNCTION, 2)))
        .otherwise(F.concat(py_strip(F.substring_index(s, "=>", 1)), F.lit(" =>"))))
        .when(d == "c", F.concat(py_strip(_rx(s, C_FUNCTION, 1)), F.lit(" "), c_name,
                                 F.lit("("), _rx(s, C_FUNCTION, 3), F.lit(")")))
        .otherwise(F.concat(
            F.when((d_ret != "") & ~d_ret.isin(*DART_KEYWORDS), F.concat(d_ret, F.lit(" ")))
            .otherwise(F.lit("")),
            d_name, F.lit("("), d_params, F.lit(")"))))
    # a body is scanned only when '{' is on the header line
    has_body = F.col("line").contains("{")
    return {"is_fn": is_fn, "fname": name, "fasync": is_async, "fsig": sig, "fbody": has_body}


def _member_groups(d: Column) -> dict[str, Column]:
    """Stage 1 of member classification: every regex group a member line
    needs, each evaluated once per line ('' or null = no match).  Only the line's own
    dialect is evaluated; a group's name begins with the dialect's letter."""
    s, line, cname = F.col("s"), F.col("line"), F.col("k_name")
    plain_ok = (F.col("o") == 0) & (F.col("c") == 0) & s.endswith(";")
    js, c, dart = d == "js", d == "c", d == "dart"
    # a pattern is tried only where the text that each of its matches holds is there; a constructor holds its class's name
    header = s.contains("(") & s.contains("{")
    j_ctor, j_ts, j_meth = js & s.startswith("constructor"), js & s.contains(";"), js & header
    c_ctor, c_meth = c & header & s.contains(cname), c & header
    d_ctor, d_meth = dart & line.contains("(") & line.contains(cname), dart & line.contains("(") & (line.contains("{") | line.contains("=>"))
    g = {
        # JS
        "j_ctor": F.when(j_ctor, s.rlike(JS_CTOR)),
        "j_ts1": F.when(j_ts, _rx(s, JS_ATTR_TS, 1)),
        "j_ts2": F.when(j_ts, _rx(s, JS_ATTR_TS, 2)),
        "j_ts3": F.when(j_ts, _rx(s, JS_ATTR_TS, 3)),
        "j_pl1": F.when(js & plain_ok, _rx(s, JS_ATTR_PLAIN, 1)),
        "j_pl2": F.when(js & plain_ok, _rx(s, JS_ATTR_PLAIN, 2)),
        "j_m1": F.when(j_meth, _rx(s, JS_METHOD, 1)),
        "j_m2": F.when(j_meth, _rx(s, JS_METHOD, 2)),
        "j_async": F.when(js & s.contains("async"), s.rlike(JS_METHOD_ASYNC)),
        "j_cp": F.when(j_ctor, _rx(s, r"\([^)]*\)", 0)),
        # C / C++
        "c_k1": F.when(c_ctor, _rx(s, C_CTOR, 1)),
        "c_k2": F.when(c_ctor, _rx(s, C_CTOR, 2)),
        "c_a1": F.when(c & plain_ok, _rx(s, C_ATTR, 1)),
        "c_a2": F.when(c & plain_ok, _rx(s, C_ATTR, 2)),
        "c_a3": F.when(c & plain_ok, _rx(s, C_ATTR, 3)),
        "c_f1": F.when(c_meth, _rx(s, C_FUNCTION, 1)),
        "c_f2": F.when(c_meth, _rx(s, C_FUNCTION, 2)),
        "c_f3": F.when(c_meth, _rx(s, C_FUNCTION, 3)),
        # Dart
        "d_k1": F.when(d_ctor, _rx(line, DART_CTOR, 1)),
        "d_k2": F.when(d_ctor, _rx(line, DART_CTOR, 2)),
        "d_k3": F.when(d_ctor, _rx(line, DART_CTOR, 3)),
        "d_a1": F.when(dart & ~s.endswith("{") & s.endswith(";"), _rx(line, DART_ATTR, 1)),
        "d_a2": F.when(dart & ~s.endswith("{") & s.endswith(";"), _rx(line, DART_ATTR, 2)),
        "d_a3": F.when(dart & ~s.endswith("{") & s.endswith(";"), _rx(line, DART_ATTR, 3)),
        "d_m1": F.when(d_meth, _rx(line, DART_METHOD, 1)),
        "d_m2": F.when(d_meth, _rx(line, DART_METHOD, 2)),
        "d_m3": F.when(d_meth, _rx(line, DART_METHOD, 3)),
        "d_m4": F.when(d_meth, _rx(line, DART_METHOD, 4)),
    }
    return g


def _member(d: Column, groups: dict[str, Column]) -> dict[str, Column]:
    """Stage 2: kind, name, signature, flags of a line at class depth 1, from
    the stage-1 groups (column ``g``; one that is not there is null) and the
    enclosing class name (``k_name``)."""
    cname = F.col("k_name")
    s = F.col("s")
    G = lambda x: F.col(f"g.{x}") if x in groups else F.lit(None).cast(
        "boolean" if x in ("j_ctor", "j_async") else "string")
    nz = lambda x: F.coalesce(G(x), F.lit("")) != ""
    # --- JS ---
    js_ctor = F.coalesce(G("j_ctor"), F.lit(False))
    js_ts = nz("j_ts1")
    js_plain = nz("j_pl1") & ~G("j_pl1").isin(*JS_KEYWORDS)
    js_meth = nz("j_m1") & ~G("j_m1").isin(*JS_KEYWORDS)
    js_kind = (F.when(js_ctor, F.lit("ctor")).when(js_ts, F.lit("attr_ts"))
               .when(js_plain, F.lit("attr_plain")).when(js_meth, F.lit("method")))
    # --- C ---
    c_ctor = nz("c_k1") & (G("c_k1") == cname)
    c_attr = nz("c_a2") & ~G("c_a2").isin(*C_KEYWORDS) & ~G("c_a1").isin(*C_KEYWORDS)
    c_meth = nz("c_f2") & ~G("c_f2").isin(*C_KEYWORDS) & ~G("c_f2").isin(*C_BASE_TYPES)
    c_kind = (F.when(c_ctor, F.lit("ctor")).when(c_attr, F.lit("attr"))
              .when(c_meth, F.lit("method")))
    # --- Dart ---
    d_skip = (s == "") | (s == "{") | (s == "}")
    d_ctor = nz("d_k1") & (G("d_k1") == cname)
    d_attr_line = nz("d_a2")
    d_attr_ok = ~G("d_a2").isin(*DART_KEYWORDS) & ~G("d_a1").isin(*DART_KEYWORDS)
    d_mname = py_strip(G("d_m2"))
    d_meth = nz("d_m2") & ~d_mname.isin(*DART_KEYWORDS) & (d_mname != cname)
    d_kind = (F.when(d_skip, F.lit(None)).when(d_ctor, F.lit("ctor"))
              .when(d_attr_line, F.when(d_attr_ok, F.lit("attr")))
              .when(d_meth, F.lit("method")))
    kind = F.when(d == "js", js_kind).when(d == "c", c_kind).otherwise(d_kind)
    d_ret = py_strip(G("d_m1"))
    name = (F.when(d == "js", F.when(js_ctor, F.lit("constructor")).when(js_ts, G("j_ts1"))
                   .when(js_plain, G("j_pl1")).otherwise(G("j_m1")))
            .when(d == "c", F.when(c_ctor, cname).when(c_attr, G("c_a2")).otherwise(G("c_f2")))
            .otherwise(F.when(d_ctor, F.when(G("d_k2") != "", G("d_k2")).otherwise(cname))
                       .when(d_attr_line, G("d_a2")).otherwise(d_mname)))
    sig = (F.when(d == "js", F.when(js_ctor, F.concat(F.lit("constructor"), F.coalesce(
        _nz(G("j_cp")), F.lit("()")))).otherwise(F.concat(G("j_m1"), G("j_m2"))))
        .when(d == "c", F.when(c_ctor, F.concat(cname, F.lit("("), G("c_k2"), F.lit(")")))
              .otherwise(F.concat(py_strip(G("c_f1")), F.lit(" "), G("c_f2"), F.lit("("),
                                  G("c_f3"), F.lit(")"))))
        .otherwise(F.when(d_ctor, F.concat(cname, F.lit("("), py_strip(G("d_k3")), F.lit(")")))
                   .otherwise(F.concat(
                       F.when((d_ret != "") & ~d_ret.isin(*DART_KEYWORDS),
                              F.concat(d_ret, F.lit(" "))).otherwise(F.lit("")),
                       d_mname, F.lit("("), py_strip(G("d_m3")), F.lit(")")))))
    is_async = (F.when(d == "js", js_meth & ~js_ctor & F.coalesce(G("j_async"), F.lit(False)))
                .when(d == "c", F.lit(False))
                .otherwise(F.when(d_ctor, F.lit(False)).otherwise(G("d_m4") != "")))
    a_type = (F.when(d == "js", F.when(js_ts, _nz(py_strip(G("j_ts2")))))
              .when(d == "c", G("c_a1"))
              .otherwise(G("d_a1")))
    a_val = (F.when(d == "js", F.when(js_ts, _nz(py_strip(G("j_ts3"))))
                    .otherwise(_nz(py_strip(G("j_pl2")))))
             .when(d == "c", _nz(py_strip(G("c_a3"))))
             .otherwise(_nz(py_strip(G("d_a3")))))
    return {"mkind": kind, "mname": name, "msig": sig, "masync": is_async,
            "atype": a_type, "aval": a_val}



def _calls_of(body: Column, d: Column) -> Column:
    found = (F.when(d == "js", F.regexp_extract_all(body, F.lit(JS_CALL), 1))
             .when(d == "c", F.regexp_extract_all(body, F.lit(C_CALL), 1))
             .otherwise(F.regexp_extract_all(body, F.lit(DART_CALL), 1)))
    # a found name is never empty and has no white space
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*BRACE_EXCLUDED_CALLS)))


# ---------------------------------------------------------------------------
# the plan
# ---------------------------------------------------------------------------
def extract_all(files: DataFrame, lines: DataFrame | None = None,
                drop_self_call: bool = False, dialect: str | None = None) -> list[dict[str, DataFrame]]:
    """Eligible non-Python files → the flat tables (one dict).

    ``lines`` may pass a cached :func:`narrow` result so that the tables
    derived from it share one evaluation of the windows; ``dialect`` names the
    files' dialect where they all have the same.  A brace-language
    body starts at its signature line, so every callable lists its own name
    as first call (Q1); ``drop_self_call`` removes that entry.
    """
    files = files.where(dialect_of(F.col("lang")).isNotNull())
    dialects = (dialect,) if dialect else tuple(DIALECTS)
    imports, c_defines = _raw_branch(files, dialects)
    L = _opened(lines if lines is not None else narrow(annotate(files)))
    classes = L.where("is_class").select(
        "repo", "path", "lang", "class_ord", F.col("cname").alias("name"),
        F.col("csig").alias("signature"), F.lit("").alias("docstring"),
        F.col("cbases").alias("bases"), (F.col("ln") + 1).alias("line"),
        F.when(F.col("d") == "dart", F.col("ln") + 1).otherwise(F.col("ln")).alias("ref_line"))

    # ---------------- callables (one aggregation, no join) ----------------
    hdr = F.when(F.col("owner") == F.col("ln"), F.struct(
        F.when(F.col("mkind").isNotNull(), F.lit("method")).otherwise(F.lit("function")).alias("kind"),
        F.col("mkind").alias("mkind"),
        F.when(F.col("mkind").isNotNull(), F.col("class_ord")).alias("class_ord"),
        F.when(F.col("mkind").isNotNull(), F.col("k.name")).alias("class_name"),
        F.coalesce(F.col("mname"), F.col("fname")).alias("name"),
        F.coalesce(F.col("msig"), F.col("fsig")).alias("signature"),
        F.coalesce(F.col("masync"), F.col("fasync")).alias("is_async"),
        F.col("ln").alias("ln"),
        F.when(F.col("mkind").isNotNull() & (F.col("d") == "dart"),
               F.col("ln") - F.col("k.s") + 1)
        .when(F.col("d") == "dart", F.col("ln") + 1).otherwise(F.col("ln")).alias("ref_line"),
        F.col("line").contains("{").alias("has_brace")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n")
    bodies = (L.where(F.col("owner").isNotNull() & ~F.col("in_var"))
              .groupBy("repo", "path", "lang", "d", "owner")
              .agg(joined.alias("body"), F.first(hdr, ignorenulls=True).alias("h")))
    calls = _calls_of(F.col("body"), F.col("d"))
    if drop_self_call:
        calls = F.array_remove(calls, F.col("h.name"))
    no_calls = ((F.col("d") == "js") & ((F.col("h.mkind") == "ctor") | ~F.col("h.has_brace")))
    long_variables = (L.where("in_var").groupBy("repo", "path", "lang", "d", F.col("owner").alias("ln")).agg(joined.alias("line"))
                      .where(F.col("line").rlike(DART_VARIABLE)))
    cal = bodies.where(F.col("h").isNotNull()).select(
        "repo", "path", "lang", "d", "h.kind", "h.mkind", "h.class_ord", "h.class_name",
        "h.name", "h.signature", "h.is_async", "h.ln", "h.ref_line",
        F.when(no_calls, F.array().cast("array<string>")).otherwise(calls).alias("calls"))
    return _finish(L, classes, cal, imports, c_defines, long_variables, dialects)


def annotate(files: DataFrame, ref_compat: bool = False, dialect: str | None = None) -> DataFrame:
    """The line table with every per-line decision of the extractors:
    headers, class membership, member kinds and the owning callable.

    Window passes over each file, all after the single exchange and all with
    running (never forward-looking) frames, so each is linear in the file:
    running brace sum; running minimum (clamped depth); enclosing class,
    enclosing function and last closing lines (plus per-file name sets);
    enclosing member.  A body's lines without braces are one row where they are
    deep inside it (see :func:`line_table`).  A bucketed corpus is read
    dialect by dialect, each with the expressions of its own; ``dialect``
    names that of the files where they all have the same.
    """
    parts = [(files, dialect)] if dialect else by_dialect(files)
    return reduce(DataFrame.unionByName, [_annotate(part, ref_compat, only) for part, only in parts])


def by_dialect(files: DataFrame) -> list[tuple[DataFrame, str | None]]:
    """The files of the brace languages: those of each dialect with its name where
    the source is in place, so that none needs an exchange, else all together."""
    if not in_place(files):
        return [(files.where(dialect_of(F.col("lang")).isNotNull()), None)]
    return [(files.where(F.col("lang").isin(*langs)), d) for d, langs in DIALECTS.items()]


def _run_on(L: DataFrame, d: Column) -> DataFrame:
    """Dart: an arrow body and a module variable run on to the line whose `;` closes them."""
    w = Window.partitionBy(*KEY).orderBy("ln")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    # such a statement ends where its parentheses are closed again
    L = L.withColumn("p", F.when(d == "dart", count_char(line, "(") - count_char(line, ")")
                                 + count_char(line, "[") - count_char(line, "]")).otherwise(0))
    L = L.withColumn("p_after", F.sum("p").over(upto))
    opens = (d == "dart") & ~F.col("s").endswith(";") & (F.col("p_after") - F.col("p") <= 0)
    arrow = opens & (F.col("depth") <= 1) & ~line.contains("{") & line.contains("=>") & line.rlike(DART_METHOD)
    variable = opens & (F.col("depth") == 0) & line.rlike(DART_VARIABLE_START) & ~line.contains("=>")
    L = L.withColumn("is_var", F.coalesce(variable, F.lit(False))).withColumn("ao", F.last(
        F.when(arrow | variable, F.struct(F.col("ln").alias("s"), F.col("s_before").alias("sb"), F.col("depth").alias("depth"),
                                          F.coalesce(variable, F.lit(False)).alias("v"))),
        ignorenulls=True).over(upto))
    closes = (F.col("s").endswith(";") & (F.col("p_after") <= 0) & (F.col("s_after") <= F.col("ao.sb")))
    L = L.withColumn("ended", F.coalesce(F.max(F.when(closes, F.col("ln"))).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    return L.withColumn("runs_on", F.coalesce((F.col("ln") > F.col("ao.s")) & (F.col("ended") < F.col("ao.s")), F.lit(False))) \
        .drop("p", "p_after", "ended")


def _annotate(files: DataFrame, ref_compat: bool, dialect: str | None) -> DataFrame:
    d = F.col("d") if dialect is None else F.lit(dialect)
    L = line_table(files, ref_compat, None if dialect is None else d, runs=True)
    w = Window.partitionBy(*KEY).orderBy("ln")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    if dialect in (None, "dart"):
        L = _run_on(L, d)
    else:
        L = L.select("*", F.lit(False).alias("is_var"), F.lit(False).alias("runs_on"),
                     F.lit(None).cast("struct<s:int,depth:bigint,v:boolean>").alias("ao"))
    at_top = F.col("runs_on") & (F.col("ao.depth") == 0)

    cls_pre = (F.col("depth") == 0) & line.contains("{") & _names_class(line)
    ch = _class_header(d, ref_compat)
    L = L.withColumn("is_class", F.coalesce(cls_pre & ch.pop("is_class"), F.lit(False)))
    # what only a header or a member has is one column, null elsewhere, on its way through the windows
    L = L.withColumn("ch", F.when(F.col("is_class"), F.struct(*[v.alias(k) for k, v in ch.items()])))
    fn_pre = (F.col("depth") == 0) & ~F.col("is_class") & ~at_top & ~F.col("is_var") & (line.contains("(") | line.contains("=>"))
    fh = _function_header(d)
    L = L.withColumn("is_fn", F.coalesce(fn_pre & fh.pop("is_fn"), F.lit(False)))
    L = L.withColumn("fh", F.when(F.col("is_fn"), F.struct(*[v.alias(k) for k, v in fh.items()])))
    # Block membership without forward-looking frames: line j lies in the
    # block opened on line s iff no closing line falls in (s, j) — i.e. the
    # last closing line before j is at or before s.  A header that closes on
    # its own line (or has no '{') owns that line only.
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    single_fn = ~F.col("fh.fbody") | F.col("selfclose_p")
    cls_struct = F.when(F.col("is_class"), F.struct(
        F.col("ln").alias("s"), F.col("selfclose").alias("single"),
        F.col("ch.cname").alias("name"), F.col("ch.ckind").alias("kind"),
        F.col("s_after").alias("sa"), F.col("s_before").alias("sb")))
    fn_struct = F.when(F.col("is_fn"), F.struct(F.col("ln").alias("s"), single_fn.alias("single")))
    define = (d == "c") & F.col("s").startswith("#") & F.col("s").rlike(C_DEFINE)
    L = L.withColumn("dname", F.when(define, _rx(F.col("s"), C_DEFINE, 1)))
    L = L.select(
        "*",
        F.last(cls_struct, ignorenulls=True).over(upto).alias("k"),
        F.last(fn_struct, ignorenulls=True).over(upto).alias("fo"),
        (F.sum(F.col("is_class").cast("int")).over(upto) - 1).alias("class_ord"),
        F.coalesce(F.max(F.when(F.col("end0"), F.col("ln"))).over(prev), F.lit(-1)).alias("last0"),
        F.coalesce(F.max(F.when(F.col("end1"), F.col("ln"))).over(prev), F.lit(-1)).alias("last1"))
    in_class = (F.col("k").isNotNull() & (F.col("ln") > F.col("k.s")) & ~F.col("k.single")
                & (F.col("last0") <= F.col("k.s")))
    local = F.when(d == "dart", F.col("s_before") - F.col("k.sb")).otherwise(
        F.lit(1) + F.col("s_before") - F.col("k.sa"))
    L = (L.withColumn("in_class", F.coalesce(in_class, F.lit(False)))
          .withColumn("k_name", F.col("k.name"))
          .withColumn("runs_on", F.col("runs_on") & ((F.col("ao.depth") == 0) | F.col("in_class")))
          .withColumn("is_mline", F.col("in_class") & (local == 1) & (F.col("s") != "") & ~F.col("runs_on")
                      & (F.col("k.kind") != "enum")))
    groups = {k: v for k, v in _member_groups(d).items() if dialect is None or k[0] == dialect[0]}
    L = L.withColumn("g", F.when(F.col("is_mline"), F.struct(*[v.alias(k) for k, v in groups.items()])))
    L = L.withColumn("mh", F.when(F.col("is_mline"), F.struct(*[v.alias(k) for k, v in _member(d, groups).items()]))).drop("g")
    is_callable_member = F.col("mh.mkind").isin("ctor", "method")
    single_m = ~line.contains("{") | F.col("selfclose_p")
    mem_struct = F.when(is_callable_member, F.struct(
        F.col("ln").alias("s"), single_m.alias("single"), F.col("mh.mkind").alias("kind"),
        line.contains("{").alias("open")))
    L = L.select("*", F.last(mem_struct, ignorenulls=True).over(upto).alias("mo"))

    def owns(o: str, last: str) -> Column:
        return F.col(o).isNotNull() & F.when(
            F.col(f"{o}.single"), F.col("ln") == F.col(f"{o}.s")).otherwise(
            F.col(last) <= F.col(f"{o}.s"))

    owner = (F.when(F.col("runs_on"), F.col("ao.s")).when(F.col("is_var"), F.col("ln"))
             .when(F.col("in_class") & owns("mo", "last1") & (F.col("mo.s") > F.col("k.s")),
                    F.col("mo.s"))
             .when(owns("fo", "last0"), F.col("fo.s")))
    return L.withColumn("owner", owner).withColumn("in_var", F.col("is_var") | F.col("runs_on") & F.coalesce("ao.v", F.lit(False))) \
        .select(*NARROW, "s_after")


#: What headers and members have, in a struct by kind (class, function, member): null on all other rows.
HEADERS = {"ch": ["cname", "csig", "cbases"], "fh": ["fname", "fsig", "fasync"],
           "mh": ["mkind", "mname", "msig", "masync", "atype", "aval"]}
NARROW = ["repo", "path", "lang", "d", "ln", "line", "depth", "is_class", "class_ord", "is_fn", "dname", "k",
          *HEADERS, "mo", "owner", "is_var", "in_var"]


def _opened(L: DataFrame) -> DataFrame:
    """The rows of :func:`narrow` with the fields of their headers as columns."""
    return L.select(*[c for c in NARROW if c not in HEADERS], F.col("k.name").alias("k_name"),
                    *[F.col(f"{held}.{c}") for held, fields in HEADERS.items() for c in fields])


def narrow(L: DataFrame) -> DataFrame:
    """The rows and columns of :func:`annotate` that the tables read: body
    lines, headers, members and module-level lines (what is worth caching)."""
    keep = (F.col("owner").isNotNull() | F.col("is_class") | F.col("mh.mkind").isNotNull()
            | (F.col("depth") == 0))
    return L.where(keep).select(*NARROW)


def _finish(L, classes, cal, imports, c_defines, long_variables, dialects):
    # Per-file name sets (class, function and #define names) for the
    # exclusions: a small aggregate over header lines only, joined to the
    # few candidate rows (module variables, C free functions).
    names = (L.where(F.col("is_class") | F.col("is_fn") | F.col("dname").isNotNull())
             .groupBy("repo", "path")
             .agg(F.collect_set(F.when(F.col("is_class"), F.col("cname"))).alias("cnames"),
                  F.collect_set(F.when(F.col("is_fn"), F.col("fname"))).alias("fnames"),
                  F.collect_set("dname").alias("dnames")))
    key_fn = Window.partitionBy("repo", "path", "kind", "class_ord", "name").orderBy("ln")
    # C: a free function named like a class of the file is not a function;
    # Dart: first function/method of a name wins (constructors always kept)
    c = cal.where(F.col("d") == "c").join(names.select("repo", "path", "cnames"), ["repo", "path"], "left")
    c = c.where((F.col("kind") != "function") | ~F.coalesce(F.array_contains("cnames", F.col("name")), F.lit(False))).drop("cnames")
    dart = cal.where(F.col("d") == "dart").withColumn("rk", F.row_number().over(key_fn)).where(
        (F.col("mkind") == "ctor") | (F.col("rk") == 1)).drop("rk")
    found = {"js": cal.where(F.col("d") == "js"), "c": c, "dart": dart}
    cal = reduce(DataFrame.unionByName, [found[d] for d in dialects])
    # member order: JS/C constructors are put in front (last one first)
    order_key = F.when((F.col("d") != "dart") & (F.col("mkind") == "ctor"), -F.col("ln") - (1 << 30)) \
        .otherwise(F.col("ln"))
    cal = cal.withColumn("call_ord", F.row_number().over(
        Window.partitionBy("repo", "path", "kind", "class_ord").orderBy(order_key)) - 1)
    callables = cal.select(
        "repo", "path", "lang", "class_ord", "class_name", "call_ord", "kind", "name",
        "signature", F.lit("").alias("docstring"),
        F.array().cast("array<string>").alias("decorators"),
        F.coalesce("is_async", F.lit(False)).alias("is_async"), "calls",
        (F.col("ln") + 1).alias("line"), "ref_line")

    # ---------------- attributes ----------------
    attr_rows = L.where(F.col("mkind").isin("attr", "attr_ts", "attr_plain")).select(
        "repo", "path", "lang", "d", "class_ord", F.col("k_name").alias("class_name"),
        F.col("ln").alias("pos"), F.col("mname").alias("name"), F.col("atype").alias("type"),
        F.col("aval").alias("value"), F.col("ln").alias("at"), F.col("k.s").alias("ks"))
    this_rows = L.where((F.col("d") == "js") & F.col("mo").isNotNull()
                        & (F.col("mo.kind") == "ctor") & F.col("mo.open")
                        & (F.col("owner") == F.col("mo.s"))
                        & F.col("line").rlike(JS_THIS_ATTR)).select(
        "repo", "path", "lang", "d", "class_ord", F.col("k_name").alias("class_name"),
        F.col("ln").alias("pos"), _rx(F.col("line"), JS_THIS_ATTR, 1).alias("name"),
        F.lit(None).cast("string").alias("type"),
        py_strip(_rx(F.col("line"), JS_THIS_ATTR, 2)).alias("value"),
        F.col("mo.s").alias("at"), F.col("k.s").alias("ks"))
    attrs = attr_rows.unionByName(this_rows) if "js" in dialects else attr_rows
    first = F.row_number().over(Window.partitionBy("repo", "path", "class_ord", "name").orderBy("pos"))
    attrs = attrs.withColumn("fr", first).where((F.col("d") != "js") | (F.col("fr") == 1))
    attrs = attrs.withColumn("ord", F.row_number().over(
        Window.partitionBy("repo", "path", "class_ord").orderBy("pos")) - 1)
    attrs = attrs.select(
        "repo", "path", "lang", "class_ord", "class_name", "ord", "name", "type", "value",
        F.lit("class").alias("scope"), (F.col("at") + 1).alias("line"),
        F.when(F.col("d") == "dart", F.col("at") - F.col("ks") + 1)
        .otherwise(F.col("at")).alias("ref_line"))

    # ---------------- module variables ----------------
    mv = _module_variables(L, long_variables, dialects).join(names, ["repo", "path"], "left")
    excl = (F.coalesce(F.array_contains("cnames", F.col("name")), F.lit(False))
            | F.coalesce(F.array_contains("fnames", F.col("name")), F.lit(False)))
    mv = mv.where(
        F.when(F.col("d") == "js", ~excl)
        .when(F.col("d") == "c", ~excl & ~F.coalesce(F.array_contains("dnames", F.col("name")),
                                                   F.lit(False)))
        .otherwise(F.lit(True)))
    mv = mv.withColumn("fr", F.row_number().over(
        Window.partitionBy("repo", "path", "name").orderBy("pos")))
    mv = mv.where((F.col("d") != "dart") | (F.col("fr") == 1))
    mv = mv.select("repo", "path", "lang", "pos", "name", "type", "value", "line", "ref_line")
    defs = c_defines.select("repo", "path", "lang", (F.col("pos") - (1 << 30)).alias("pos"),
                            "name", "type", "value", "line", "ref_line")
    mvars = mv.unionByName(defs) if "c" in dialects else mv
    mvars = mvars.withColumn("ord", F.row_number().over(
        Window.partitionBy("repo", "path").orderBy("pos")) - 1).select(
        "repo", "path", "lang", F.lit(None).cast("int").alias("class_ord"),
        F.lit(None).cast("string").alias("class_name"), "ord", "name", "type", "value",
        F.lit("module").alias("scope"), "line", "ref_line")

    return [{
        "files": None,
        "imports": imports,
        "classes": classes,
        "callables": callables,
        "variables": mvars.unionByName(attrs),
        "defines": c_defines,
    }]


def _module_variables(L: DataFrame, long_variables: DataFrame, dialects: tuple[str, ...]) -> DataFrame:
    """Module variables of one line, and Dart's of several (their joined lines)."""
    line, d = F.col("line"), F.col("d")
    s = py_strip(line)
    js_m = s.rlike(JS_VARIABLE)
    resto = _rx(s, JS_VARIABLE, 3)
    js_ok = js_m & ~resto.contains("=>") & ~py_strip(resto).startswith("function") & \
        ~py_strip(resto).startswith("class")
    js_val = F.regexp_replace(py_strip(resto), ";+$", "")
    c_m = s.rlike(C_VARIABLE) & ~_rx(s, C_VARIABLE, 2).isin(*C_KEYWORDS)
    c_val = F.when(_rx(s, C_VARIABLE, 3) != "",
                   F.regexp_replace(py_strip(_rx(s, C_VARIABLE, 3)), ";+$", ""))
    d_m = line.rlike(DART_VARIABLE) & ~_rx(line, DART_VARIABLE, 2).isin(*DART_KEYWORDS)
    ok = (F.col("depth") == 0) & F.when(d == "js", js_ok).when(d == "c", c_m).otherwise(d_m)
    cols = ["repo", "path", "lang", "d", "ln", "line"]
    found = L.where(ok & ~F.col("is_var")).select(*cols)
    if "dart" in dialects:
        found = found.unionByName(long_variables.select(*cols))
    s = F.col("s")
    return found.withColumn("s", py_strip(line)).select(
        "repo", "path", "lang", "d", F.col("ln").alias("pos"),
        F.when(d == "js", _rx(s, JS_VARIABLE, 1)).when(d == "c", _rx(s, C_VARIABLE, 2))
        .otherwise(_rx(line, DART_VARIABLE, 2)).alias("name"),
        F.when(d == "js", _nz(py_strip(_rx(s, JS_VARIABLE, 2))))
        .when(d == "c", py_strip(_rx(s, C_VARIABLE, 1)))
        .otherwise(_nz(py_strip(_rx(line, DART_VARIABLE, 1)))).alias("type"),
        F.when(d == "js", js_val).when(d == "c", c_val)
        .otherwise(_nz(py_strip(_rx(line, DART_VARIABLE, 3)))).alias("value"),
        (F.col("ln") + 1).alias("line"),
        F.when(d == "dart", F.col("ln") + 1).otherwise(F.col("ln")).alias("ref_line"))
