"""Column-expression helpers (all JVM-side Catalyst expressions).

These re-express the string handling of the per-file extractors as Spark
SQL built-ins so that cleaning, line splitting, trimming, glob matching and
identifier tokenising stay inside the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.splitlines() separators (after universal-newline reading has
# already turned \r\n and \r into \n).
LINE_SEP = "[\\n\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"


def universal_newlines(text: Column) -> Column:
    """Text-mode reading: \\r\\n and lone \\r become \\n."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def split_lines(text: Column) -> Column:
    """``str.splitlines()``: no trailing empty element, [] for ''."""
    body = F.regexp_replace(text, f"{LINE_SEP}\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_SEP, -1))


def one_newline(text: Column) -> Column:
    """The lines of ``str.splitlines()`` with a newline after each, '' for ''."""
    same = F.regexp_replace(text, LINE_SEP.replace("\\n", ""), "\n")
    return F.when((text == "") | same.endswith("\n"), same).otherwise(F.concat(same, F.lit("\n")))


# Python's str.strip() whitespace set, as explicit characters for btrim
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(s: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(s, F.lit(WS_CHARS))


def count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


# --- cleaners: blank string literals and comments, keep the newlines -------
#
# A single left-to-right tokeniser (regexp_extract_all with one alternation)
# reproduces a character scanner: the first alternative that matches at the
# current position wins.  Comment and string tokens are then replaced by the
# newlines they contain; other tokens are kept verbatim.  Possessive
# quantifiers keep the JVM regex engine from recursing on long literals.

_BLOCK = "/\\*(?:[^*]|\\*(?!/))*+(?:\\*/)?"
_LINE = "//[^\\n]*+\\n?"


def _str_tok(q: str) -> str:
    return f"{q}(?:[^{q}\\\\]|\\\\[\\s\\S]?)*+{q}?"


_TOKENS = {
    "js": "|".join([_BLOCK, _LINE, _str_tok("`"), _str_tok('"'), _str_tok("'"),
                    "[^/\"'`]++", "/"]),
    "dart": "|".join([_BLOCK, _LINE,
                      "\"\"\"(?:[^\"]|\"(?!\"\"))*+(?:\"\"\")?",
                      "'''(?:[^']|'(?!''))*+(?:''')?",
                      _str_tok('"'), _str_tok("'"), "[^/\"']++", "/"]),
    # a quote between two digits separates them and opens no literal
    "c": "|".join([_BLOCK, _LINE, _str_tok('"'), "(?<=[0-9a-fA-F])'(?=[0-9a-fA-F])", _str_tok("'"),
                   "[^/\"']++", "/"]),
}


def clean_code(text: Column, dialect: str, ref_compat: bool = False) -> Column:
    """Blank comments and string literals (dialect ``js``, ``dart`` or ``c``).

    * block comments and triple-quoted strings keep their newlines;
    * a line comment keeps its terminating newline (none at end of text);
    * in quoted strings an escape pair (backslash + any char) vanishes, so
      an escaped newline is dropped; other newlines are kept;
    * with ``ref_compat``, C character literals drop newlines entirely, which
      shifts the lines after them (Q32).
    """
    toks = F.regexp_extract_all(text, F.lit(f"({_TOKENS[dialect]})"), 1)

    def one(t: Column) -> Column:
        comment = t.startswith("/*") | t.startswith("//")
        if dialect == "dart":
            comment = comment | t.startswith('"""') | t.startswith("'''")
        quoted = t.startswith('"') | t.startswith("'")
        if dialect == "js":
            quoted = quoted | t.startswith("`")
        out = F.when(comment, F.regexp_replace(t, "[^\\n]", ""))
        if dialect == "c":
            out = out.when(t == "'", t)
            if ref_compat:
                out = out.when(t.startswith("'"), F.lit(""))
        no_escapes = F.regexp_replace(t, "\\\\[\\s\\S]", "")
        return out.when(quoted, F.regexp_replace(no_escapes, "[^\\n]", "")) \
            .otherwise(t)

    return F.array_join(F.transform(toks, one), "")


GLOB_PARTS = re.compile(r"(?s)(?P<any>\*+)|(?P<one>\?)|\[(?P<not>!?)(?P<set>\]?[^\]]*)\]|(?P<text>[^*?\[]+|\[)")


def is_glob(pattern: str) -> bool:
    """a pattern with ``*`` or ``?`` is a glob, any other a substring."""
    return "*" in pattern or "?" in pattern


def glob_to_regex(pattern: str) -> str:
    """Shell glob -> anchored Java regex that ignores the case of any letter:
    ``*`` any text, ``?`` one character, ``[seq]`` and ``[!seq]`` sets, all else
    itself (also a ``[`` that nothing closes)."""
    def java(m: re.Match) -> str:
        if m["set"] == "":  # the bracket closes at once, so it opens no set
            return re.sub(r"[^\w\s]", lambda c: "\\" + c[0], m[0])
        if m["any"]:
            return ".*"
        if m["one"]:
            return "."
        if m["text"]:
            return re.sub(r"[^\w\s]", lambda c: "\\" + c[0], m["text"])
        inside = re.sub(r"[\\\[\]^&~]", lambda c: "\\" + c[0], m["set"])
        return f"[{'^' if m['not'] else ''}{inside}]"

    return "(?isu)\\A" + GLOB_PARTS.sub(java, pattern) + "\\z"


def identifier_tokens(name: Column) -> Column:
    """camelCase / snake_case → lower-case tokens; a split before *every*
    capital letter (``MQTT`` → m, q, t, t)."""
    parts = F.split(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "_")
    return F.filter(parts, lambda t: t != "")
