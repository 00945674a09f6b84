"""DuckDB oracle: the expected answers of every registered query, computed
directly from ``customer``, ``orders``, ``lineitem`` (and ``nation``,
``region``) with the rendering rules of ``sources.generated`` — no parsing.

The shared prelude models the corpus as relations: eligible files, methods
(constructor first), call sites per method in first-occurrence order with
the dialect's call-name grammar, free functions, variables and imports.
"""

from __future__ import annotations

from .functions.config import WORDS_EN, WORDS_ES
from .oracle_features import feature_sql

PRELUDE = r"""
WITH cu AS (
  SELECT c_custkey AS c, c_nationkey AS n, 'repo_' || lower(c_mktsegment) AS repo,
         CASE c_custkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'js' WHEN 2 THEN 'cpp'
              ELSE 'dart' END AS lang
  FROM customer),
oc AS (
  SELECT o_custkey, CAST(greatest(1, ceil(count(*) / 1000.0)) AS BIGINT) AS nf
  FROM orders GROUP BY o_custkey),
od AS (
  SELECT o.o_orderkey AS o, o.o_custkey AS c, o.o_orderstatus AS st,
         o.o_orderpriority AS pr, o.o_orderkey % oc.nf AS fpart
  FROM orders o JOIN oc ON oc.o_custkey = o.o_custkey),
fp AS (
  SELECT DISTINCT c, fpart FROM od
  UNION ALL
  SELECT c_custkey, 0 FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
allf AS (
  SELECT cu.repo, cu.c, cu.n, cu.lang, fp.fpart,
         'src/' || CASE WHEN cu.c % 23 = 7 THEN 'node_modules/' ELSE '' END
           || 'nation_' || cu.n AS folder,
         'cust_' || cu.c || CASE WHEN fp.fpart > 0 THEN '_' || fp.fpart ELSE '' END
           || CASE WHEN cu.c % 50 = 9 THEN '.md' WHEN cu.lang = 'python' THEN '.py'
                   WHEN cu.lang = 'js' THEN '.js' WHEN cu.lang = 'cpp' THEN '.cpp'
                   ELSE '.dart' END AS name
  FROM cu JOIN fp ON fp.c = cu.c),
fl AS (
  SELECT repo, folder || '/' || name AS path, folder, name, lang, c, n, fpart,
         (lang = 'python' AND c % 40 = 16) AS broken
  FROM allf WHERE c % 23 <> 7 AND c % 50 <> 9),
ok AS (SELECT * FROM fl WHERE NOT broken),
st AS (
  SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, min(l_linenumber) AS ln
  FROM lineitem GROUP BY 1, 2, 3),
sn AS (
  SELECT o, CAST(greatest(1, ceil(count(*) / 1000.0)) AS BIGINT) AS mp
  FROM st GROUP BY o),
stp AS (
  SELECT st.o, st.p, st.s, st.ln, (st.p + st.s) % sn.mp AS mpart
  FROM st JOIN sn ON sn.o = st.o),
mth AS (
  SELECT od.c, od.fpart, od.o, coalesce(x.mpart, 0) AS mpart, od.pr = '1-URGENT' AS urgent,
         CASE od.st WHEN 'F' THEN 'get_' WHEN 'O' THEN 'obtener_' ELSE 'run_' END
           || 'order_' || od.o
           || CASE WHEN coalesce(x.mpart, 0) > 0 THEN '_' || x.mpart ELSE '' END AS mname
  FROM od LEFT JOIN (SELECT DISTINCT o, mpart FROM stp) x ON x.o = od.o),
meth AS (
  SELECT ok.repo, ok.path, ok.lang, ok.c, ok.n, 'Cust' || ok.c AS class_name,
         CAST(0 AS BIGINT) AS call_ord,
         CASE ok.lang WHEN 'python' THEN '__init__' WHEN 'js' THEN 'constructor'
              ELSE 'Cust' || ok.c END AS name,
         CASE ok.lang WHEN 'python' THEN '__init__(x)' WHEN 'js' THEN 'constructor(x)'
              ELSE 'Cust' || ok.c || '(int x)' END AS signature,
         false AS is_async, CAST(NULL AS BIGINT) AS o, CAST(NULL AS BIGINT) AS mpart
  FROM ok
  UNION ALL
  SELECT ok.repo, ok.path, ok.lang, ok.c, ok.n, 'Cust' || ok.c,
         row_number() OVER (PARTITION BY ok.repo, ok.path ORDER BY m.o, m.mpart),
         m.mname,
         CASE ok.lang
           WHEN 'python' THEN CASE WHEN m.urgent THEN 'async ' ELSE '' END || m.mname || '(x)'
           WHEN 'js' THEN m.mname || '(x)'
           WHEN 'cpp' THEN 'int ' || m.mname || '(int x)'
           ELSE CASE WHEN m.urgent THEN 'Future<int> ' ELSE 'int ' END || m.mname || '(int x)'
         END,
         m.urgent AND ok.lang <> 'cpp', m.o, m.mpart
  FROM ok JOIN mth m ON m.c = ok.c AND m.fpart = ok.fpart),
raw_mcalls AS (
  SELECT me.repo, me.path, me.lang, me.class_name, me.name AS caller, me.name AS callee,
         0 AS k, 0 AS ln, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS s
  FROM meth me
  WHERE me.lang IN ('cpp', 'dart') OR (me.lang = 'js' AND me.o IS NOT NULL)
  UNION ALL
  SELECT me.repo, me.path, me.lang, me.class_name, me.name,
         CASE me.lang WHEN 'cpp' THEN 'supp_' || t.s || '::part_' || t.p
                      WHEN 'dart' THEN 'part_' || t.p
                      ELSE 'supp_' || t.s || '.part_' || t.p END,
         1, t.ln, t.p, t.s
  FROM meth me JOIN stp t ON t.o = me.o AND t.mpart = me.mpart),
mcalls AS (
  SELECT repo, path, lang, class_name, caller, 'method' AS kind, callee,
         CAST(row_number() OVER (PARTITION BY repo, path, caller
                                 ORDER BY k, ln, p, s) - 1 AS BIGINT) AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, caller, callee
                                     ORDER BY k, ln, p, s) AS r
        FROM raw_mcalls) WHERE r = 1),
fcalls AS (
  SELECT repo, path, lang, CAST(NULL AS VARCHAR) AS class_name, 'crear_cust_' || c AS caller,
         'function' AS kind,
         CASE WHEN lang = 'python' THEN 'Cust' || c ELSE 'crear_cust_' || c END AS callee,
         CAST(0 AS BIGINT) AS ord
  FROM ok
  UNION ALL
  SELECT repo, path, lang, NULL, 'crear_cust_' || c, 'function',
         CASE WHEN lang = 'python' THEN 'lib_' || n || '.make' ELSE 'Cust' || c END, 1
  FROM ok
  UNION ALL
  SELECT repo, path, lang, NULL, 'crear_cust_' || c, 'function',
         CASE lang WHEN 'js' THEN 'lib_' || n || '.make' WHEN 'cpp' THEN 'lib_' || n || '::make'
                   ELSE 'make' END, 2
  FROM ok WHERE lang <> 'python'),
calls AS (SELECT * FROM mcalls UNION ALL SELECT * FROM fcalls),
call_lists AS (
  SELECT repo, path, kind, caller, string_agg(callee, '|' ORDER BY ord) AS calls
  FROM calls GROUP BY 1, 2, 3, 4),
fns AS (
  SELECT ok.repo, ok.path, ok.lang, CAST(0 AS BIGINT) AS call_ord, 'crear_cust_' || ok.c AS name,
         CASE ok.lang WHEN 'python' THEN 'crear_cust_' || ok.c || '(x)'
                      WHEN 'js' THEN 'function crear_cust_' || ok.c || '(x)'
                      WHEN 'cpp' THEN 'Cust' || ok.c || '* crear_cust_' || ok.c || '(int x)'
                      ELSE 'Cust' || ok.c || ' crear_cust_' || ok.c || '(int x)' END AS signature,
         false AS is_async, cl.calls
  FROM ok JOIN call_lists cl ON cl.repo = ok.repo AND cl.path = ok.path
    AND cl.kind = 'function' AND cl.caller = 'crear_cust_' || ok.c),
vars AS (
  SELECT repo, path, 'LIMIT' AS name,
         CASE WHEN lang IN ('cpp', 'dart') THEN 'int' END AS type,
         CAST(c AS VARCHAR) AS value, 'module' AS scope
  FROM ok
  UNION ALL
  SELECT repo, path, 'NATION_' || c, '#define', CAST(n AS VARCHAR), 'module'
  FROM ok WHERE lang = 'cpp'
  UNION ALL
  SELECT repo, path, 'Cust' || c || '.rate', CASE WHEN lang IN ('cpp', 'dart') THEN 'int' END,
         CAST(n AS VARCHAR), 'class'
  FROM ok),
imps AS (
  SELECT repo, path, CAST(0 AS BIGINT) AS ord,
         CASE lang WHEN 'cpp' THEN 'lib_' || n || '.h' WHEN 'dart' THEN 'lib_' || n || '.dart'
                   ELSE 'lib_' || n END AS module,
         CASE WHEN lang IN ('js', 'dart') THEN 'helper' ELSE '' END AS names,
         lang IN ('js', 'dart') AS is_from
  FROM ok),
cls AS (
  SELECT ok.repo, ok.path, CAST(0 AS BIGINT) AS class_ord, 'Cust' || ok.c AS name,
         CASE ok.lang WHEN 'python' THEN 'Cust' || ok.c || '(x)'
                      WHEN 'cpp' THEN 'class Cust' || ok.c || ' : Base' || ok.n
                      ELSE 'class Cust' || ok.c || ' extends Base' || ok.n END AS signature,
         'Base' || ok.n AS bases,
         CAST(coalesce(mc.n, 0) AS BIGINT) AS n_methods,
         CAST(1 AS BIGINT) AS n_attributes,
         CAST(CASE WHEN ok.lang IN ('python', 'cpp') THEN 6 ELSE 5 END AS BIGINT) AS line
  FROM ok LEFT JOIN (SELECT repo, path, count(*) AS n FROM meth GROUP BY 1, 2) mc
    ON mc.repo = ok.repo AND mc.path = ok.path),
defs AS (
  SELECT repo, path, 'class' AS type, name, signature, 'definition' AS category,
         CAST(NULL AS VARCHAR) AS calls_to, name AS raw_name
  FROM cls
  UNION ALL
  SELECT repo, path, 'method', class_name || '.' || name, signature, 'definition', NULL, name
  FROM meth
  UNION ALL
  SELECT repo, path, 'function', name, signature, 'definition', NULL, name FROM fns),
callables AS (
  SELECT me.repo, me.path, 'method' AS kind, me.class_name || '.' || me.name AS ctx,
         me.signature, me.name AS raw_name
  FROM meth me
  UNION ALL
  SELECT repo, path, 'function', name, signature, name FROM fns)
"""


def _q(body: str) -> str:
    return PRELUDE + body


LINE_CTES = r"""
, sz AS (SELECT o, mpart, count(*) AS n FROM stp GROUP BY o, mpart),
ml AS (
  SELECT me.*, CASE WHEN me.lang = 'python' THEN 2 + greatest(1, coalesce(sz.n, 0))
                    ELSE 3 + coalesce(sz.n, 0) END AS size
  FROM meth me LEFT JOIN sz ON sz.o = me.o AND sz.mpart = me.mpart),
mlc AS (
  SELECT ml.*, coalesce(sum(CASE WHEN call_ord > 0 THEN size END) OVER (
           PARTITION BY repo, path ORDER BY call_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(CASE WHEN call_ord > 0 THEN size ELSE 0 END) OVER (PARTITION BY repo, path) AS total
  FROM ml),
clines AS (
  SELECT repo, path, 'method' AS kind, name AS raw_name,
         CASE WHEN call_ord = 0 THEN CASE lang WHEN 'python' THEN 10 WHEN 'cpp' THEN 9 ELSE 7 END
              ELSE CASE lang WHEN 'python' THEN 13 WHEN 'cpp' THEN 12 ELSE 10 END + before END AS line
  FROM mlc
  UNION ALL
  SELECT f.repo, f.path, 'function', f.name,
         CASE f.lang WHEN 'python' THEN 14 WHEN 'cpp' THEN 14 ELSE 12 END
         + coalesce(t.total, 0)
  FROM fns f LEFT JOIN (SELECT repo, path, max(total) AS total FROM mlc GROUP BY 1, 2) t
    ON t.repo = f.repo AND t.path = f.path)
"""


def _search_body(cond: str) -> str:
    """cond: SQL predicate on a lower-cased name ``{x}``.  Needs LINE_CTES."""
    d = cond.format(x="lower(d.raw_name)")
    u = cond.format(x="lower(c.callee)")
    return f"""
SELECT d.repo, d.path, d.type, d.name, d.signature, d.category, d.calls_to,
       CAST(coalesce(l.line, k.line) AS BIGINT) AS line
FROM (SELECT * FROM defs d WHERE {d}) d
LEFT JOIN clines l ON l.repo = d.repo AND l.path = d.path AND l.kind = d.type
  AND l.raw_name = d.raw_name
LEFT JOIN cls k ON d.type = 'class' AND k.repo = d.repo AND k.path = d.path
UNION ALL
SELECT k.repo, k.path, k.kind AS type, k.ctx AS name, k.signature, 'usage' AS category, c.calls_to,
       CAST(l.line AS BIGINT) AS line
FROM (SELECT repo, path, kind, caller, string_agg(callee, '|' ORDER BY ord) AS calls_to
      FROM calls c WHERE {u} GROUP BY 1, 2, 3, 4) c
JOIN callables k ON c.repo = k.repo AND c.path = k.path AND c.kind = k.kind AND c.caller = k.raw_name
JOIN clines l ON l.repo = k.repo AND l.path = k.path AND l.kind = k.kind AND l.raw_name = k.raw_name
"""


def _search_sql(cond: str) -> str:
    return _q(LINE_CTES + _search_body(cond).replace("SELECT d.repo", ", q AS (SELECT d.repo", 1)
              + ") SELECT * FROM q")


def _over_search(cond: str, select: str) -> str:
    return PRELUDE + LINE_CTES + ", hits AS (" + _search_body(cond) + ") " + select


SUBSTR = "contains({x}, 'order_1')"
GLOB = "regexp_full_match({x}, '.*_order_1.')"


def _symbols_sql(symbols: str) -> str:
    return _q(f"""
, syms AS ({symbols}),
cand AS (
  SELECT me.class_name || '.' || me.name AS symbol, me.repo, me.path,
         coalesce(cl.calls, '') AS calls, me.call_ord
  FROM meth me LEFT JOIN call_lists cl ON cl.repo = me.repo AND cl.path = me.path
    AND cl.kind = 'method' AND cl.caller = me.name
  UNION ALL
  SELECT name, repo, path, coalesce(calls, ''), call_ord FROM fns)
SELECT symbol, repo, path, calls FROM (
  SELECT cand.*, row_number() OVER (PARTITION BY cand.symbol, cand.repo
                                    ORDER BY cand.path, cand.call_ord) AS r
  FROM cand JOIN syms ON syms.symbol = cand.symbol) WHERE r = 1
""")


_VERB = "CASE o_orderstatus WHEN 'F' THEN 'get_' WHEN 'O' THEN 'obtener_' ELSE 'run_' END"


def _methods_of(orders: str) -> str:
    """Symbols of every method written for ``orders``, one for each part of an order's call sites."""
    return f"""
  SELECT 'Cust' || o_custkey || '.' || {_VERB} || 'order_' || o_orderkey
         || CASE WHEN coalesce(x.mpart, 0) > 0 THEN '_' || x.mpart ELSE '' END AS symbol
  FROM {orders} LEFT JOIN (SELECT DISTINCT o, mpart FROM stp) x ON x.o = o_orderkey"""


ORDER_SYMBOLS = _methods_of("orders") + """
  UNION ALL
  SELECT 'crear_cust_' || c_custkey FROM customer"""

TOP_SYMBOL = _methods_of("(SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)")

NAMING = """
, toks AS (
  SELECT repo, path,
         CASE WHEN starts_with(name, 'obtener_') OR starts_with(name, 'crear_') THEN 'es'
              WHEN starts_with(name, 'get_') THEN 'en' END AS lang
  FROM (SELECT repo, path, name FROM meth UNION ALL SELECT repo, path, name FROM fns)),
per AS (
  SELECT repo, path, CAST(count(*) FILTER (WHERE lang = 'es') AS BIGINT) AS es,
         CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS en
  FROM toks WHERE lang IS NOT NULL GROUP BY repo, path)
"""


def _block_lines(level: str, p: str) -> list[str]:
    """SELECTs of (repo, path, sec, k1, k2, t): the block lines of one level
    with line prefix ``p`` ('  ' for text, '' for Markdown)."""
    sig = level != "estructura"
    calls = level == "completo"
    parts = []
    if sig:
        parts.append(f"SELECT repo, path, 0, 0, 0, '{p}imports: 1' FROM ok")
        parts.append(f"SELECT v.repo, v.path, 1, CASE WHEN v.name = 'LIMIT' AND f.lang = 'cpp' THEN 1 "
                     f"ELSE 0 END, 0, '{p}var ' || v.name || coalesce(': ' || v.type, '') || "
                     "' = ' || v.value FROM vars v JOIN ok f ON f.repo = v.repo AND f.path = v.path "
                     "WHERE v.scope = 'module'")
        parts.append(f"SELECT repo, path, 2, 0, 0, '{p}class Cust' || c || '(Base' || n || ')' FROM ok")
        parts.append(f"SELECT repo, path, 2, 0, 1, '{p}  \"Account of customer ' || c || '.\"' "
                     "FROM ok WHERE lang = 'python'")
        parts.append(f"SELECT repo, path, 2, 0, 2, '{p}  .rate' || CASE WHEN lang IN ('cpp', 'dart') "
                     "THEN ': int' ELSE '' END || ' = ' || n FROM ok")
        parts.append(f"SELECT repo, path, 2, 0, 3 + 4 * call_ord, '{p}  ' || signature FROM meth")
        parts.append(f"SELECT repo, path, 3, 0, 0, '{p}fn ' || signature FROM fns")
    else:
        parts.append(f"SELECT v.repo, v.path, 1, CASE WHEN v.name = 'LIMIT' AND f.lang = 'cpp' THEN 1 "
                     f"ELSE 0 END, 0, '{p}var ' || v.name FROM vars v JOIN ok f ON f.repo = v.repo "
                     "AND f.path = v.path WHERE v.scope = 'module'")
        parts.append(f"SELECT repo, path, 2, 0, 0, '{p}class Cust' || c FROM ok")
        parts.append(f"SELECT repo, path, 2, 0, 2, '{p}  .rate' FROM ok")
        parts.append(f"SELECT repo, path, 2, 0, 3 + 4 * call_ord, '{p}  ' || CASE WHEN is_async "
                     "THEN 'async ' ELSE '' END || name || '()' FROM meth")
        parts.append(f"SELECT repo, path, 3, 0, 0, '{p}fn ' || name || '()' FROM fns")
    if calls:
        parts.append(f"SELECT me.repo, me.path, 2, 0, 5 + 4 * me.call_ord, '{p}    -> llama: ' || "
                     "cl.calls FROM meth me JOIN ccomma cl ON cl.repo = me.repo AND cl.path = me.path "
                     "AND cl.kind = 'method' AND cl.caller = me.name")
        parts.append(f"SELECT f.repo, f.path, 3, 0, 2, '{p}   -> llama: ' || cl.calls FROM fns f "
                     "JOIN ccomma cl ON cl.repo = f.repo AND cl.path = f.path "
                     "AND cl.kind = 'function' AND cl.caller = f.name")
    return parts


CCOMMA = """
, ccomma AS (SELECT repo, path, kind, caller, string_agg(callee, ', ' ORDER BY ord) AS calls
             FROM calls GROUP BY 1, 2, 3, 4)"""


def _report_sql(level: str) -> str:
    """Text-report file blocks (header + block lines) → md5 and line count."""
    parts = ["SELECT repo, path, -2 AS sec, 0 AS k1, 0 AS k2, '[' || path || ']' AS t FROM fl"]
    parts += _block_lines(level, "  ")
    return _q(f"""{CCOMMA},
lines AS ({' UNION ALL '.join(parts)})
SELECT repo, path, md5(string_agg(t, chr(10) ORDER BY sec, k1, k2)) AS block_md5,
       CAST(count(*) AS BIGINT) AS n_lines
FROM lines GROUP BY repo, path""")


def _markdown_sql(level: str = "firmas") -> str:
    """All Markdown report rows (repo, part, path, line_no, text).

    A broken Python file ends in ``def broken(:`` on its last line: 11
    header lines, then per method an empty line, the ``def`` line and its
    body (one line per call, or ``pass``), then 7 closing lines; the parser
    reports ``invalid syntax`` with the base name and that line number.
    """
    parts = ["SELECT repo, path, -2 AS sec, 0 AS k1, 0 AS k2, '## `' || path || '`' AS t FROM fl",
             "SELECT e.repo, e.path, -1, 0, 0, '> ⚠ Error: SyntaxError: invalid syntax (' || e.name "
             "|| ', line ' || e.last_line || ')' FROM err e",
             "SELECT repo, path, 9, 0, 0, '' FROM fl"]
    parts += _block_lines(level, "")
    return _q(f"""{CCOMMA},
err AS (
  SELECT fl.repo, fl.path, fl.name,
         11 + 7 + coalesce(sum(2 + greatest(1, coalesce(s.n, 0))), 0) AS last_line
  FROM fl LEFT JOIN mth m ON m.c = fl.c AND m.fpart = fl.fpart
  LEFT JOIN (SELECT o, mpart, count(*) AS n FROM stp GROUP BY o, mpart) s
    ON s.o = m.o AND s.mpart = m.mpart
  WHERE fl.broken GROUP BY fl.repo, fl.path, fl.name),
lines AS ({' UNION ALL '.join(parts)}),
body AS (
  SELECT repo, CAST(1 AS BIGINT) AS part, path,
         CAST(row_number() OVER (PARTITION BY repo, path ORDER BY sec, k1, k2) AS BIGINT) AS line_no,
         t AS text
  FROM lines),
tot AS (
  SELECT f.repo, count(*) AS nf, count(*) FILTER (WHERE NOT f.broken) AS nc,
         coalesce(sum(mm.n), 0) AS nm, count(*) FILTER (WHERE NOT f.broken) AS nfn
  FROM fl f LEFT JOIN (SELECT repo, path, count(*) AS n FROM meth GROUP BY 1, 2) mm
    ON mm.repo = f.repo AND mm.path = f.path
  GROUP BY f.repo),
head AS (
  SELECT repo, CAST(0 AS BIGINT) AS part, '' AS path, CAST(1 AS BIGINT) AS line_no,
         '# codeweave — `' || repo || '`' AS text FROM tot
  UNION ALL SELECT repo, 0, '', 2, '' FROM tot
  UNION ALL SELECT repo, 0, '', 3, '**Nivel:** {level} | **Archivos:** ' || nf || ' | **Clases:** ' ||
         nc || ' | **Metodos:** ' || nm || ' | **Funciones:** ' || nfn FROM tot
  UNION ALL SELECT repo, 0, '', 4, '' FROM tot)
SELECT * FROM head UNION ALL SELECT * FROM body""")




def _suggestions_sql(cond: str, n: int = 15) -> str:
    d = cond.format(x="lower(k.raw_name)")
    u = cond.format(x="lower(c.callee)")
    return _q(LINE_CTES + f"""
, hits AS (
  SELECT k.repo, k.path, k.kind AS type, k.ctx AS name, 'definition' AS category, k.raw_name
  FROM callables k WHERE {d}
  UNION ALL
  SELECT DISTINCT k.repo, k.path, k.kind, k.ctx, 'usage', k.raw_name
  FROM callables k JOIN calls c ON c.repo = k.repo AND c.path = k.path AND c.kind = k.kind
    AND c.caller = k.raw_name
  WHERE {u})
SELECT h.repo, h.path, h.type, h.name, h.category, CAST(l.line AS BIGINT) AS line
FROM hits h JOIN clines l ON l.repo = h.repo AND l.path = h.path AND l.kind = h.type
  AND l.raw_name = h.raw_name
LEFT JOIN meth m ON m.repo = h.repo AND m.path = h.path AND h.type = 'method' AND m.name = h.raw_name
-- a file's definitions, then its usages; each: methods of the class, then functions
ORDER BY h.repo, h.path, h.category, h.type = 'function', m.call_ord, h.name
LIMIT {n}""")


def _json_sql() -> str:
    """One JSON document per file, rebuilt as text (compact, field order of
    the struct, NULL fields omitted), compared by md5.  Line numbers follow
    the rendering layout: per dialect a fixed header, then each method takes
    ``2 + max(1, sites)`` lines (Python) or ``3 + sites`` lines (braces)."""
    return _q(r"""
, sz AS (SELECT o, mpart, count(*) AS n FROM stp GROUP BY o, mpart),
ml AS (
  SELECT me.*, CASE WHEN me.lang = 'python' THEN 2 + greatest(1, coalesce(sz.n, 0))
                    ELSE 3 + coalesce(sz.n, 0) END AS size
  FROM meth me LEFT JOIN sz ON sz.o = me.o AND sz.mpart = me.mpart),
mlc AS (
  SELECT ml.*, coalesce(sum(CASE WHEN call_ord > 0 THEN size END) OVER (
           PARTITION BY repo, path ORDER BY call_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(CASE WHEN call_ord > 0 THEN size ELSE 0 END) OVER (PARTITION BY repo, path) AS total
  FROM ml),
mj AS (
  SELECT m.repo, m.path, m.call_ord,
         '{"call_ord":' || m.call_ord || ',"name":"' || m.name || '","signature":"' || m.signature ||
         '","docstring":"","decorators":[],"is_async":' || CAST(m.is_async AS VARCHAR) ||
         ',"calls":[' || coalesce(cl.arr, '') || '],"line":' ||
         CASE WHEN m.call_ord = 0 THEN CASE m.lang WHEN 'python' THEN 10 WHEN 'cpp' THEN 9 ELSE 7 END
              ELSE CASE m.lang WHEN 'python' THEN 13 WHEN 'cpp' THEN 12 ELSE 10 END + m.before END
         || '}' AS j,
         m.total, m.lang
  FROM mlc m LEFT JOIN (
    SELECT repo, path, caller, string_agg('"' || callee || '"', ',' ORDER BY ord) AS arr
    FROM calls WHERE kind = 'method' GROUP BY 1, 2, 3) cl
    ON cl.repo = m.repo AND cl.path = m.path AND cl.caller = m.name),
cj AS (
  SELECT k.repo, k.path,
         '[{"class_ord":0,"name":"' || k.name || '","signature":"' || k.signature ||
         '","docstring":"' || CASE WHEN f.lang = 'python' THEN 'Account of customer ' || f.c || '.'
                                   ELSE '' END ||
         '","bases":["' || k.bases || '"],"line":' || k.line || ',"methods":[' ||
         (SELECT string_agg(j, ',' ORDER BY call_ord) FROM mj WHERE mj.repo = k.repo AND mj.path = k.path) ||
         '],"attributes":[{"ord":0,"name":"rate",' ||
         CASE WHEN f.lang IN ('cpp', 'dart') THEN '"type":"int",' ELSE '' END ||
         '"value":"' || f.n || '","line":' || CASE WHEN f.lang IN ('python', 'cpp') THEN 8 ELSE 6 END ||
         '}]}]' AS classes,
         (SELECT max(total) FROM mj WHERE mj.repo = k.repo AND mj.path = k.path) AS total
  FROM cls k JOIN ok f ON f.repo = k.repo AND f.path = k.path),
fj AS (
  SELECT f.repo, f.path,
         '[{"call_ord":0,"name":"' || f.name || '","signature":"' || f.signature ||
         '","docstring":"","decorators":[],"is_async":false,"calls":[' ||
         (SELECT string_agg('"' || callee || '"', ',' ORDER BY ord) FROM calls c
          WHERE c.repo = f.repo AND c.path = f.path AND c.kind = 'function') ||
         '],"line":' || (CASE f.lang WHEN 'python' THEN 14 WHEN 'cpp' THEN 14 ELSE 12 END
                          + coalesce(cj.total, 0)) || '}]' AS functions
  FROM fns f JOIN cj ON cj.repo = f.repo AND cj.path = f.path),
vj AS (
  SELECT repo, path,
         '[' || CASE WHEN lang = 'cpp' THEN '{"ord":0,"name":"NATION_' || c ||
                     '","type":"#define","value":"' || n || '","line":2},{"ord":1,"name":"LIMIT",' ||
                     '"type":"int","value":"' || c || '","line":3}'
                     ELSE '{"ord":0,"name":"LIMIT",' ||
                          CASE WHEN lang = 'dart' THEN '"type":"int",' ELSE '' END ||
                          '"value":"' || c || '","line":2}' END || ']' AS variables,
         '[{"ord":0,"module":"' || CASE lang WHEN 'cpp' THEN 'lib_' || n || '.h'
                                             WHEN 'dart' THEN 'lib_' || n || '.dart'
                                             ELSE 'lib_' || n END ||
         '","names":[' || CASE WHEN lang IN ('js', 'dart') THEN '"helper"' ELSE '' END ||
         '],"is_from":' || CASE WHEN lang IN ('js', 'dart') THEN 'true' ELSE 'false' END ||
         '}]' AS imports
  FROM ok),
err AS (
  SELECT fl.repo, fl.path,
         11 + 7 + coalesce(sum(2 + greatest(1, coalesce(s.n, 0))), 0) AS last_line
  FROM fl LEFT JOIN mth m ON m.c = fl.c AND m.fpart = fl.fpart
  LEFT JOIN sz s ON s.o = m.o AND s.mpart = m.mpart
  WHERE fl.broken GROUP BY fl.repo, fl.path)
SELECT fl.repo, fl.path, md5(
  '{"path":"' || fl.path || '","folder":"' || fl.folder || '","name":"' || fl.name ||
  '","lang":"' || fl.lang || '",' ||
  CASE WHEN fl.broken THEN '"error":"SyntaxError: invalid syntax (' || fl.name || ', line ' ||
       e.last_line || ')",' ELSE '' END ||
  '"classes":' || coalesce(cj.classes, '[]') || ',"functions":' || coalesce(fj.functions, '[]') ||
  ',"variables":' || coalesce(vj.variables, '[]') || ',"imports":' || coalesce(vj.imports, '[]') ||
  '}') AS json_md5
FROM fl
LEFT JOIN cj ON cj.repo = fl.repo AND cj.path = fl.path
LEFT JOIN fj ON fj.repo = fl.repo AND fj.path = fl.path
LEFT JOIN vj ON vj.repo = fl.repo AND vj.path = fl.path
LEFT JOIN err e ON e.repo = fl.repo AND e.path = fl.path""")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["extension_language"] = _q("SELECT repo, path, lang FROM fl")
    q["excluded_paths"] = _q("""
SELECT repo, folder || '/' || name AS path,
       CASE WHEN c % 50 = 9 THEN 'unsupported_extension' ELSE 'excluded_folder' END AS reason
FROM allf WHERE c % 23 = 7 OR c % 50 = 9""")
    q["error_files"] = _q("SELECT repo, path, 'SyntaxError' AS error_kind FROM fl WHERE broken")
    for key, lang in (("py", "python"), ("js", "js"), ("cpp", "cpp"), ("dart", "dart")):
        q[f"extract_{key}_calls"] = _q(f"""
SELECT repo, path, class_name, caller, kind, ord, callee FROM calls WHERE lang = '{lang}'""")
    q["files_by_folder"] = _q("SELECT repo, folder, path FROM fl")
    q["folder_summary"] = _q("""
SELECT repo, folder, CAST(count(*) AS BIGINT) AS n_files, min(path) AS first_path,
       max(path) AS last_path
FROM fl GROUP BY repo, folder""")
    q["folder_rollup"] = _q("""
SELECT repo, folder, CAST(count(*) AS BIGINT) AS n_files,
       CAST(count(*) FILTER (WHERE lang <> 'cpp') AS BIGINT) AS n_active,
       CAST(max(len(string_split(folder, '/'))) AS BIGINT) AS depth
FROM (SELECT repo, lang, '.' AS folder FROM fl
      UNION ALL SELECT repo, lang, 'src' FROM fl
      UNION ALL SELECT repo, lang, folder FROM fl)
GROUP BY repo, folder""")
    q["folder_subtree"] = _q("""
SELECT repo, folder, path FROM fl
WHERE folder = 'src/nation_1' OR starts_with(folder, 'src/nation_1/')""")
    q["visible_files"] = _q("""
SELECT repo, path FROM fl
WHERE folder NOT IN (SELECT 'src/nation_' || n_nationkey FROM nation
                     JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA')""")
    q["imports_by_file"] = _q("""
SELECT fl.repo, fl.path, i.ord, i.module, i.names, i.is_from
FROM fl LEFT JOIN imps i ON i.repo = fl.repo AND i.path = fl.path""")
    q["import_labels"] = _q("""
SELECT repo, path, ord,
       CASE WHEN is_from THEN 'from ' || module || ' import ' || names
            ELSE 'import ' || module END AS label
FROM imps""")
    q["classes_by_file"] = _q("""
SELECT fl.repo, fl.path, k.class_ord, k.name, k.signature, k.bases, k.n_methods,
       k.n_attributes, k.line
FROM fl LEFT JOIN cls k ON k.repo = fl.repo AND k.path = fl.path""")
    q["class_detail"] = _q(LINE_CTES + """
, firsts AS (
  SELECT * FROM (SELECT cls.*, row_number() OVER (PARTITION BY name ORDER BY repo, path) AS r
                 FROM cls WHERE name IN (SELECT 'Cust' || c_custkey FROM customer))
  WHERE r = 1)
SELECT f.name AS class_name, f.repo, f.path, f.signature AS class_signature,
       'method' AS member_kind, me.call_ord AS member_ord, me.name, me.signature,
       coalesce(cl.calls, '') AS calls, CAST(NULL AS VARCHAR) AS type,
       CAST(NULL AS VARCHAR) AS value, CAST(l.line AS BIGINT) AS line
FROM firsts f JOIN meth me ON me.repo = f.repo AND me.path = f.path
LEFT JOIN call_lists cl ON cl.repo = me.repo AND cl.path = me.path AND cl.kind = 'method'
  AND cl.caller = me.name
JOIN clines l ON l.repo = me.repo AND l.path = me.path AND l.kind = 'method' AND l.raw_name = me.name
UNION ALL
SELECT f.name, f.repo, f.path, f.signature, 'attribute', CAST(0 AS BIGINT), 'rate', NULL, NULL,
       v.type, v.value, CAST(CASE WHEN o.lang IN ('python', 'cpp') THEN 8 ELSE 6 END AS BIGINT)
FROM firsts f JOIN vars v ON v.repo = f.repo AND v.path = f.path AND v.scope = 'class'
JOIN ok o ON o.repo = f.repo AND o.path = f.path""")
    q["functions_by_file"] = _q(LINE_CTES + """
SELECT fl.repo, fl.path, f.call_ord, f.name, f.signature, f.is_async, f.calls,
       CAST(l.line AS BIGINT) AS line
FROM fl LEFT JOIN fns f ON f.repo = fl.repo AND f.path = fl.path
LEFT JOIN clines l ON l.repo = f.repo AND l.path = f.path AND l.kind = 'function'
  AND l.raw_name = f.name""")
    q["variables_module"] = _q("SELECT * FROM vars WHERE scope = 'module'")
    q["variables_class"] = _q("SELECT * FROM vars WHERE scope = 'class'")
    q["variables_all"] = _q("SELECT * FROM vars")
    q["calls_of_symbol"] = _symbols_sql(TOP_SYMBOL)
    q["calls_of_symbols"] = _symbols_sql(ORDER_SYMBOLS)
    usage = """
SELECT repo, path, CASE WHEN kind = 'method' THEN class_name || '.' || caller
                        ELSE caller END AS context, callee AS call
FROM calls WHERE contains(lower(callee), 'part_1')"""
    q["usages_of_name"] = _q(usage)
    q["usages_by_file"] = _q(f"""
SELECT repo, path, CAST(count(*) AS BIGINT) AS n_refs,
       CAST(count(DISTINCT context) AS BIGINT) AS n_contexts,
       CAST(count(DISTINCT call) AS BIGINT) AS n_calls
FROM ({usage}) u GROUP BY repo, path""")
    q["status_totals"] = _q("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM fl) AS total_files,
       (SELECT CAST(count(*) AS BIGINT) FROM cls) AS total_classes,
       (SELECT CAST(count(*) AS BIGINT) FROM meth) AS total_methods,
       (SELECT CAST(count(*) AS BIGINT) FROM fns) AS total_functions,
       (SELECT CAST(count(*) AS BIGINT) FROM vars WHERE scope = 'module') AS total_variables,
       (SELECT CAST(count(*) AS BIGINT) FROM vars WHERE scope = 'class') AS total_attributes,
       (SELECT CAST(count(*) AS BIGINT) FROM fl WHERE broken) AS error_files""")
    q["symbols_per_file"] = _q("""
SELECT fl.repo, fl.path,
       CAST(CASE WHEN fl.broken THEN 0 ELSE 1 END AS BIGINT) AS n_classes,
       CAST(CASE WHEN fl.broken THEN 0 ELSE 1 END AS BIGINT) AS n_functions,
       CAST(coalesce(v.n, 0) AS BIGINT) AS n_variables,
       CAST(CASE WHEN fl.broken THEN 0 ELSE 1 END AS BIGINT) AS n_imports,
       CAST(CASE WHEN fl.broken THEN 0 ELSE 3 END + coalesce(v.n, 0) AS BIGINT) AS n_symbols
FROM fl LEFT JOIN (SELECT repo, path, count(*) AS n FROM vars GROUP BY repo, path) v
  ON v.repo = fl.repo AND v.path = fl.path""")
    lib = """
SELECT repo, path, 'import' AS type, CAST(NULL AS VARCHAR) AS symbol, module AS detail,
       CAST(-1 AS BIGINT) AS co
FROM imps WHERE contains(lower(module), 'lib_1')
UNION ALL
SELECT repo, path, 'call', CASE WHEN kind = 'method' THEN class_name || '.' || caller
                                ELSE caller END,
       string_agg(callee, '|' ORDER BY ord), 0
FROM calls WHERE contains(lower(callee), 'lib_1')
GROUP BY repo, path, kind, class_name, caller"""
    q["library_usage"] = _q(f"SELECT repo, path, type, symbol, detail FROM ({lib}) x")
    q["library_usage_by_file"] = _q("""
, ih AS (SELECT repo, path, module FROM imps WHERE contains(lower(module), 'lib_1')),
ch AS (SELECT repo, path, callee, ord FROM calls WHERE contains(lower(callee), 'lib_1')),
cc AS (SELECT repo, path, CAST(count(*) AS BIGINT) AS n,
              string_agg(callee, '|' ORDER BY ord) AS calls FROM ch GROUP BY repo, path)
SELECT coalesce(ih.repo, cc.repo) AS repo, coalesce(ih.path, cc.path) AS path,
       ih.module AS import_module, coalesce(cc.n, 0) AS n_calls,
       coalesce(cc.calls, '') AS first_calls, CAST(0 AS BIGINT) AS more_calls
FROM ih FULL OUTER JOIN cc ON cc.repo = ih.repo AND cc.path = ih.path""")
    q["library_hits_multi"] = _q("""
, lib AS (SELECT unnest(['lib_2', 'supp_1']) AS lib),
ih AS (SELECT lib, repo, path, module FROM imps, lib WHERE contains(lower(module), lib)),
ch AS (SELECT lib.lib, c.repo, c.path, c.callee, coalesce(m.call_ord, 1000000000) AS co, c.ord
  FROM calls c JOIN lib ON contains(lower(c.callee), lib.lib)
  LEFT JOIN meth m ON m.repo = c.repo AND m.path = c.path AND c.kind = 'method' AND m.name = c.caller),
cc AS (SELECT lib, repo, path, count(*) AS n, list(callee ORDER BY co, ord) AS calls FROM ch GROUP BY 1, 2, 3)
SELECT coalesce(ih.lib, cc.lib) AS lib, coalesce(ih.repo, cc.repo) AS repo, coalesce(ih.path, cc.path) AS path,
       ih.module AS import_module, CAST(coalesce(cc.n, 0) AS BIGINT) AS n_calls,
       coalesce(array_to_string(cc.calls[1:4], '|'), '') AS first_calls,
       CAST(greatest(coalesce(cc.n, 0) - 4, 0) AS BIGINT) AS more_calls
FROM ih FULL OUTER JOIN cc ON cc.lib = ih.lib AND cc.repo = ih.repo AND cc.path = ih.path""")
    q["status_by_repo"] = _q("""
, f AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE broken) AS e FROM fl GROUP BY 1),
c AS (SELECT repo, count(*) AS n FROM cls GROUP BY 1), m AS (SELECT repo, count(*) AS n FROM meth GROUP BY 1),
g AS (SELECT repo, count(*) AS n FROM fns GROUP BY 1),
v AS (SELECT repo, count(*) FILTER (WHERE scope = 'module') AS n, count(*) FILTER (WHERE scope = 'class') AS a
  FROM vars GROUP BY 1)
SELECT f.repo, CAST(f.n AS BIGINT) AS total_files, CAST(coalesce(c.n, 0) AS BIGINT) AS total_classes,
  CAST(coalesce(m.n, 0) AS BIGINT) AS total_methods, CAST(coalesce(g.n, 0) AS BIGINT) AS total_functions,
  CAST(coalesce(v.n, 0) AS BIGINT) AS total_variables, CAST(coalesce(v.a, 0) AS BIGINT) AS total_attributes,
  CAST(f.e AS BIGINT) AS error_files
FROM f LEFT JOIN c USING (repo) LEFT JOIN m USING (repo) LEFT JOIN g USING (repo) LEFT JOIN v USING (repo)""")
    q["library_union_files"] = _q("""
SELECT repo, path, folder FROM fl WHERE (repo, path) IN (
  SELECT repo, path FROM imps
  WHERE contains(lower(module), 'lib_2') OR contains(lower(module), 'lib_3')
  UNION
  SELECT repo, path FROM calls
  WHERE contains(lower(callee), 'lib_2') OR contains(lower(callee), 'lib_3'))""")
    q["search_substring"] = _search_sql(SUBSTR)
    q["search_glob"] = _search_sql(GLOB)
    # the dictionary of names gives the rows of the scans
    for pruned, plain in (("search_names_substring", "search_substring"), ("search_names_glob", "search_glob"),
                          ("usages_by_names", "usages_of_name"), ("library_usage_by_names", "library_usage"),
                          ("library_union_by_names", "library_union_files")):
        q[pruned] = q[plain]
    q["search_category_counts"] = _over_search(
        SUBSTR, "SELECT category, type, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY 1, 2")
    q["suggestions"] = _suggestions_sql(SUBSTR)
    q["naming_language_totals"] = _q(NAMING + """
SELECT CASE WHEN sum(es) + sum(en) = 0 THEN 'indeterminado'
            WHEN sum(es) >= sum(en) THEN 'es' ELSE 'en' END AS dominant,
       CAST(sum(es) AS BIGINT) AS count_es, CAST(sum(en) AS BIGINT) AS count_en,
       CAST(count(*) FILTER (WHERE es > 0 AND en > 0) AS BIGINT) AS mixed_files
FROM per""")
    q["naming_language_mixed_files"] = _q(NAMING + """
SELECT repo, path FROM per WHERE es > 0 AND en > 0""")
    q["naming_language_by_file"] = _q(NAMING + """
SELECT repo, path, es, en, es > 0 AND en > 0 AS mixed FROM per""")
    q["url_folder_rollup"] = r"""
WITH u AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)', 1) AS repo,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)', 2),
                        '^/+|/+$', '', 'g') AS path,
         starts_with(url, 'https:') AS https
  FROM pages),
f AS (
  SELECT repo, path, bool_or(https) AS active, count(*) AS n FROM u WHERE path IS NOT NULL
  GROUP BY repo, path),
t AS (
  SELECT repo, path, active, n, string_split(path, '/') AS parts FROM f),
anc AS (
  SELECT repo, path, active, n, '.' AS folder FROM t
  UNION ALL
  SELECT repo, path, active, n, array_to_string(parts[1:i], '/')
  FROM t, range(1, len(parts)) r(i))
SELECT repo, folder, CAST(sum(n) AS BIGINT) AS n_files,
       CAST(sum(CASE WHEN active THEN n ELSE 0 END) AS BIGINT) AS n_active,
       CAST(max(len(string_split(folder, '/'))) AS BIGINT) AS depth
FROM anc GROUP BY repo, folder"""
    q["naming_language_documents"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r]+')) AS word FROM documents),
t AS (
  SELECT doc_id, unnest(string_split(lower(regexp_replace(word, '([A-Z])', '_\1', 'g')), '_')) AS tok
  FROM w),
v AS (
  SELECT doc_id, CASE WHEN tok IN (""" + ", ".join(f"'{x}'" for x in WORDS_ES) + """) THEN 'es'
                      WHEN tok IN (""" + ", ".join(f"'{x}'" for x in WORDS_EN) + """) THEN 'en' END AS lang
  FROM t WHERE tok <> ''),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'en') AS en
  FROM v WHERE lang IS NOT NULL GROUP BY doc_id)
SELECT CASE WHEN coalesce(sum(es), 0) + coalesce(sum(en), 0) = 0 THEN 'indeterminado'
            WHEN coalesce(sum(es), 0) >= coalesce(sum(en), 0) THEN 'es' ELSE 'en' END AS dominant,
       CAST(coalesce(sum(es), 0) AS BIGINT) AS count_es, CAST(coalesce(sum(en), 0) AS BIGINT) AS count_en,
       CAST(count(*) FILTER (WHERE es > 0 AND en > 0) AS BIGINT) AS mixed_files
FROM per"""
    for level in ("estructura", "firmas", "completo"):
        q[f"report_text_{level}"] = _report_sql(level)
    q["report_markdown"] = _markdown_sql("firmas")
    q["report_json"] = _json_sql()
    return q | feature_sql()
