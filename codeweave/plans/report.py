"""Reports (X1–X8) and sinks (S11–S13): text, Markdown and JSON.

Every table contributes *line rows* ``(repo, path, sort keys, text)``; a file
block is the ordered lines of one file (a per-file group, bounded by the
file), and a whole report is written as globally sorted rows with the text
writer — the repository-level document is never assembled in one task or on
the driver.

Levels: ``estructura`` (names only), ``firmas`` (signatures, docstrings,
import counts), ``completo`` (adds call lists).  ``filters`` switches
sections off (keys ``firmas``, ``docstrings``, ``llamadas``, ``imports``,
``variables``, ``clases_base``; all default on; ``variables`` hides module
variables only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import REPORT_LEVELS, VALUE_CUT
from ..operators.tables import CodeIndex

TITLE = "codeweave"


def validate_level(level: str) -> None:
    """Rejected before any job starts."""
    if level not in REPORT_LEVELS:
        raise ValueError(f"level must be one of {tuple(REPORT_LEVELS)}, got: '{level}'")


# section -> (the switch that hides it, the levels that have it)
_DETAIL = ("firmas", "completo")
_SECTIONS = {"sig": ("firmas", _DETAIL), "doc": ("docstrings", _DETAIL), "calls": ("llamadas", ("completo",)),
             "imports": ("imports", _DETAIL), "vars": ("variables", ("estructura", *_DETAIL)),
             "bases": ("clases_base", _DETAIL)}


def _switches(level: str, filters: dict | None) -> dict[str, bool]:
    validate_level(level)
    return {section: level in levels and (filters or {}).get(switch, True)
            for section, (switch, levels) in _SECTIONS.items()}


def _opt(prefix: str, c: Column) -> Column:
    """``prefix + c`` when c is a non-empty string, else ''."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(prefix), c)).otherwise(F.lit(""))


def _row(df: DataFrame, sec: int, k1, k2, k3, text: Column) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("repo", "path", F.lit(sec).alias("sec"), lit(k1).cast("int").alias("k1"),
                     lit(k2).cast("int").alias("k2"), lit(k3).cast("int").alias("k3"),
                     text.alias("text"))


def block_lines(idx: CodeIndex, level: str, prefix: str = "",
                filters: dict | None = None, value_cut: int | None = VALUE_CUT) -> DataFrame:
    """The per-file lines of one level, with sort keys (sec, k1, k2, k3).

    ``value_cut``: characters of a value that a line shows (Python literals are
    shown whole); None shows all.  The index itself holds whole values."""
    shown = F.col("value") if value_cut is None else F.when(F.col("lang") == "python", F.col("value")).otherwise(
        F.substring(F.col("value"), 1, value_cut))
    sw = _switches(level, filters)
    p = F.lit(prefix)
    parts: list[DataFrame] = []
    if sw["imports"]:
        n = idx.imports.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_row(n, 0, 0, 0, 0, F.concat(p, F.lit("imports: "), F.col("n").cast("string"))))
    if sw["vars"]:
        v = idx.variables.where(F.col("scope") == "module")
        text = (F.concat(p, F.lit("var "), F.col("name"), _opt(": ", F.col("type")),
                         _opt(" = ", shown))
                if sw["sig"] else F.concat(p, F.lit("var "), F.col("name")))
        parts.append(_row(v, 1, F.col("ord"), 0, 0, text))
    c = idx.classes
    if sw["sig"]:
        bases = (F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "),
                                                      F.lit(")"))).otherwise(F.lit(""))
                 if sw["bases"] else F.lit(""))
        parts.append(_row(c, 2, F.col("class_ord"), 0, 0,
                          F.concat(p, F.lit("class "), F.col("name"), bases)))
        if sw["doc"]:
            parts.append(_row(c.where(F.col("docstring") != ""), 2, F.col("class_ord"), 1, 0,
                              F.concat(p, F.lit('  "'), F.col("docstring"), F.lit('"'))))
    else:
        parts.append(_row(c, 2, F.col("class_ord"), 0, 0, F.concat(p, F.lit("class "), F.col("name"))))
    a = idx.variables.where(F.col("scope") == "class")
    atext = (F.concat(p, F.lit("  ."), F.col("name"), _opt(": ", F.col("type")),
                      _opt(" = ", shown))
             if sw["sig"] else F.concat(p, F.lit("  ."), F.col("name")))
    parts.append(_row(a, 2, F.col("class_ord"), 2, F.col("ord"), atext))
    m = idx.callables.where(F.col("kind") == "method")
    f = idx.callables.where(F.col("kind") == "function")
    for df, sec, ind, lead in ((m, 2, "  ", ""), (f, 3, "", "fn ")):
        k1 = F.col("class_ord") if sec == 2 else F.col("call_ord")
        base = 3 if sec == 2 else 0
        order = F.col("call_ord") * 4 if sec == 2 else F.lit(0)
        if sw["sig"]:
            parts.append(_row(df, sec, k1, F.lit(base) + order, 0,
                              F.concat(p, F.lit(ind + lead), F.col("signature"))))
            sub = "    " if sec == 2 else "   "
            if sw["doc"]:
                parts.append(_row(df.where(F.col("docstring") != ""), sec, k1,
                                  F.lit(base + 1) + order, 0,
                                  F.concat(p, F.lit(sub + '"'), F.col("docstring"), F.lit('"'))))
            if sw["calls"]:
                parts.append(_row(df.where(F.size("calls") > 0), sec, k1, F.lit(base + 2) + order, 0,
                                  F.concat(p, F.lit(sub + "-> llama: "),
                                           F.array_join("calls", ", "))))
        else:
            parts.append(_row(df, sec, k1, F.lit(base) + order, 0,
                              F.concat(p, F.lit(ind + lead),
                                       F.when(F.col("is_async"), F.lit("async ")).otherwise(F.lit("")),
                                       F.col("name"), F.lit("()"))))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _file_header(idx: CodeIndex, fmt: str) -> DataFrame:
    if fmt == "md":
        head = _row(idx.files, -2, 0, 0, 0, F.concat(F.lit("## `"), F.col("path"), F.lit("`")))
        err = _row(idx.files.where(F.col("error").isNotNull()), -1, 0, 0, 0,
                   F.concat(F.lit("> ⚠ Error: "), F.col("error")))
        return head.unionByName(err)
    # the text export never prints file errors
    return _row(idx.files, -2, 0, 0, 0, F.concat(F.lit("["), F.col("path"), F.lit("]")))


def file_blocks(idx: CodeIndex, level: str = "firmas", fmt: str = "text",
                filters: dict | None = None) -> DataFrame:
    """One row per file: its header line and block as one text."""
    lines = _file_header(idx, fmt).unionByName(
        block_lines(idx, level, "  " if fmt == "text" else "", filters))
    return (lines.groupBy("repo", "path")
            .agg(F.sort_array(F.collect_list(F.struct("sec", "k1", "k2", "k3", "text")))
                 .alias("ls"))
            .select("repo", "path",
                    F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("block"),
                    F.size("ls").alias("n_lines")))


def report_lines(idx: CodeIndex, level: str = "firmas", fmt: str = "text",
                 active: DataFrame | None = None, filters: dict | None = None) -> DataFrame:
    """All lines of one report per repository, ``(repo, part, path, line_no,
    text)``; part 0 is the heading, part 1 the file blocks (sorted by path,
    each followed by an empty line).  ``active`` (repo, path) restricts the
    files (Markdown subset, A6/F6); totals then count the selected files."""
    validate_level(level)
    repos = idx.files.select("repo").distinct()
    if active is not None:
        keep = active.select("repo", "path")
        idx = CodeIndex(*(t.join(keep, ["repo", "path"], "left_semi")
                          for t in (idx.files, idx.imports, idx.classes, idx.callables,
                                    idx.variables)))
    lines = _file_header(idx, fmt).unionByName(
        block_lines(idx, level, "  " if fmt == "text" else "", filters))
    lines = lines.unionByName(_row(idx.files, 9, 0, 0, 0, F.lit("")))
    w = F.row_number().over(
        Window.partitionBy("repo", "path").orderBy("sec", "k1", "k2", "k3"))
    body = lines.select("repo", F.lit(1).alias("part"), "path", w.alias("line_no"), "text")

    def cnt(df, name):
        return df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))

    # a repository without a selected file still has its heading
    tot = (repos.join(cnt(idx.files, "nf"), "repo", "left")
           .join(cnt(idx.classes, "nc"), "repo", "left")
           .join(cnt(idx.callables.where(F.col("kind") == "method"), "nm"), "repo", "left")
           .join(cnt(idx.callables.where(F.col("kind") == "function"), "nfn"), "repo", "left")
           .fillna(0))
    if fmt == "md":
        heads = [F.concat(F.lit(f"# {TITLE} — `"), F.col("repo"), F.lit("`")), F.lit(""),
                 F.format_string("**Nivel:** %s | **Archivos:** %d | **Clases:** %d | "
                                 "**Metodos:** %d | **Funciones:** %d",
                                 F.lit(level), "nf", "nc", "nm", "nfn"), F.lit("")]
    else:
        heads = [F.concat(F.lit(f"# {TITLE} — "), F.col("repo")),
                 F.lit(f"# Nivel: {level}"),
                 F.format_string("# Archivos: %d | Clases: %d | Metodos: %d | Funciones: %d",
                                 "nf", "nc", "nm", "nfn"), F.lit("")]
    head = tot.select("repo", F.posexplode(F.array(*heads)).alias("line_no", "text")).select(
        "repo", F.lit(0).alias("part"), F.lit("").alias("path"),
        (F.col("line_no") + 1).alias("line_no"), "text")
    return head.unionByName(body)


def write_report(lines: DataFrame, out: str) -> None:
    """S11/S12 sink: one text report per repository (``repo=<name>/``).
    A global sort keeps heading, files and lines in order across part files."""
    (lines.orderBy("repo", "part", "path", "line_no").select("repo", "text")
     .write.mode("overwrite").partitionBy("repo").text(out))


def file_json(idx: CodeIndex) -> DataFrame:
    """One JSON document per file with its nested symbols (narrow on a snapshot)."""
    return idx.nested.select("repo", "path", F.to_json(F.struct(
        "path", "folder", "name", "lang", "error", "classes", "functions", "variables", "imports")).alias("json"))
