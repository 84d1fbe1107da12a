"""Source-corpus, call-graph and diagnostic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import code, graph, validate
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import cut_lineage, spread

GOOD = "p_partkey % 50 <> 49"
# what the module of part p defines, read off the rule that wrote it
FUNCS = f"""funcs AS (
  SELECT path AS file, 'load_' || p_partkey % 100 AS qualified_name, 'load_' || p_partkey % 100 AS name, NULL AS class_name, 7 AS line_start, 10 AS line_end,
    3 AS complexity, false AS is_async, 'public' AS visibility, 'str' AS return_type, 'a,b' AS params,
    'load_' || p_partkey % 100 || '(a, b: int=' || p_size || ')' AS signature FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'Box' || p_partkey % 10 || '._get', '_get', 'Box' || p_partkey % 10, 13, 16, 2, false, 'protected', NULL, 'self,args', '_get(self, *args)' FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'Box' || p_partkey % 10 || '.put', 'put', 'Box' || p_partkey % 10, 18, 20, 1, true, 'public', NULL, 'self,x', 'put(self, x=None)' FROM v_source WHERE {GOOD})"""
CALLS = f"""calls AS (
  SELECT path AS file, 'load_' || p_partkey % 100 AS caller, 'helper_' || p_size AS callee, 9 AS line FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'load_' || p_partkey % 100, 'os.path.join', 10 FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'Box' || p_partkey % 10 || '._get', 'Box' || p_partkey % 10 || '.put', 15 FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'Box' || p_partkey % 10 || '._get', 'load_' || p_partkey % 100, 16 FROM v_source WHERE {GOOD})"""
IMPORTS = f"""imps AS (
  SELECT path AS file, 'os' AS module, '' AS names, NULL AS alias, 1 AS line FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'mod' || p_partkey % 20, '', 'md', 2 FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'pkg' || p_partkey % 6, 'alpha,beta', NULL, 3 FROM v_source WHERE {GOOD})"""
USES = f"""uses AS (
  SELECT path AS file, 'os' AS module, 'path' AS attribute, 10 AS line FROM v_source WHERE {GOOD}
  UNION ALL SELECT path, 'md', 'name', 10 FROM v_source WHERE {GOOD})"""


def source(spark, sf):
    return spread(view(spark, sf, "v_source"))


def facts(spark, sf):
    return code.syntax_facts(source(spark, sf))


def facts_table(spark, sf):
    """Facts written once, for operators that read them twice."""
    return cut_lineage(facts(spark, sf).where(F.col("kind").isin("import", "attribute")))


def edges(spark, sf):
    return view(spark, sf, "v_edges")


def diagnostics(spark, sf):
    return view(spark, sf, "v_diag")


def funcs(spark, sf):
    return view(spark, sf, "v_funcs")


@query(
    "e01_functions",
    f"""WITH {FUNCS} SELECT file, qualified_name, name, class_name, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end,
    CAST(complexity AS BIGINT) AS complexity, is_async, visibility, return_type, params, signature FROM funcs""",
    ["v_source"],
)
def e01_functions(spark, sf):
    found = code.functions(facts(spark, sf))
    names = F.array_join(F.transform("params", lambda p: p["name"]), ",")
    return found.select(
        "file", "qualified_name", "name", "class_name", "line_start", "line_end", "complexity", "is_async", "visibility",
        "return_type", names.alias("params"), "signature",
    )


@query(
    "e01_classes",
    f"""SELECT path AS file, 'Box' || p_partkey % 10 AS name, CAST(12 AS BIGINT) AS line_start, CAST(20 AS BIGINT) AS line_end, 'Base' AS bases,
    '_get,put' AS methods, false AS is_dataclass FROM v_source WHERE {GOOD}""",
    ["v_source"],
)
def e01_classes(spark, sf):
    return code.classes(facts(spark, sf)).select(
        "file", "name", "line_start", "line_end", F.array_join("bases", ",").alias("bases"),
        F.array_join("methods", ",").alias("methods"), "is_dataclass",
    )


@query(
    "e01_imports",
    f"WITH {IMPORTS} SELECT file, module, names, alias, CAST(line AS BIGINT) AS line FROM imps",
    ["v_source"],
)
def e01_imports(spark, sf):
    return code.imports(facts(spark, sf)).withColumn("names", F.array_join("names", ","))


@query(
    "e01_variables",
    f"SELECT path AS file, 'LIMIT' AS name, CAST(p_size AS VARCHAR) AS value, true AS is_constant FROM v_source WHERE {GOOD}",
    ["v_source"],
)
def e01_variables(spark, sf):
    return code.variables(facts(spark, sf)).select("file", "name", "value", "is_constant")


@query(
    "e01_errors",
    """SELECT path AS file, CAST(7 AS BIGINT) AS line, CAST(length('def load_' || p_partkey % 100 || '(a, b: int = ' || p_size || ' ') + 1 AS BIGINT) AS col,
    'invalid syntax' AS message FROM v_source WHERE p_partkey % 50 = 49""",
    ["v_source"],
)
def e01_errors(spark, sf):
    return code.errors(facts(spark, sf))


@query(
    "e02_calls",
    f"WITH {CALLS} SELECT file, caller, callee, CAST(line AS BIGINT) AS line FROM calls",
    ["v_source"],
)
def e02_calls(spark, sf):
    return code.calls(facts(spark, sf)).select("file", "caller", "callee", "line")


@query(
    "x14_signature",
    f"WITH {FUNCS} SELECT file, name, signature FROM funcs",
    ["v_source"],
)
def x14(spark, sf):
    return code.functions(facts(spark, sf)).select("file", "name", "signature")


@query(
    "j09_module_use",
    f"WITH {USES} SELECT file, module, attribute, CAST(line AS BIGINT) AS line FROM uses",
    ["v_source"],
)
def j09(spark, sf):
    return code.module_uses(facts_table(spark, sf))


@query(
    "a06_corpus_totals",
    f"""WITH {FUNCS} SELECT (SELECT COUNT(*) FROM v_source) AS files, (SELECT CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) FROM v_source) AS lines,
    (SELECT COUNT(*) FROM v_source WHERE {GOOD}) AS classes, COUNT(*) FILTER (class_name IS NULL) AS functions,
    COUNT(*) FILTER (class_name IS NOT NULL) AS methods, CAST(SUM(complexity) AS BIGINT) AS complexity,
    (SELECT COUNT(*) FROM v_source WHERE NOT ({GOOD})) AS errors FROM funcs""",
    ["v_source"],
)
def a06(spark, sf):
    return code.corpus_totals(source(spark, sf), facts(spark, sf))


@query(
    "g03_unified_summary",
    f"""WITH {FUNCS}, {CALLS}, {IMPORTS} SELECT 'functions' AS item, COUNT(*) AS n FROM funcs UNION ALL
    SELECT 'relationships', COUNT(*) FROM (SELECT DISTINCT caller, callee FROM calls) UNION ALL SELECT 'modules', COUNT(DISTINCT module) FROM imps
    UNION ALL SELECT 'errors', COUNT(*) FROM v_source WHERE NOT ({GOOD})""",
    ["v_source"],
)
def g03(spark, sf):
    return code.unified_summary(facts(spark, sf))


@query(
    "k09_analysis_export",
    f"""WITH {FUNCS}, {IMPORTS} SELECT file AS path, SUM(n) AS n FROM (SELECT file, COUNT(*) AS n FROM funcs GROUP BY 1 UNION ALL SELECT file, COUNT(*) FROM imps GROUP BY 1
    UNION ALL SELECT path, 1 FROM v_source) GROUP BY 1""".replace("SUM(n)", "CAST(SUM(n) AS BIGINT)"),
    ["v_source"],
)
def k09(spark, sf):
    exported = code.summary_export(source(spark, sf), facts(spark, sf))
    return exported.select("path", F.json_array_length("value").cast("long").alias("n"))


@query(
    "k09_analysis_sections",
    f"""WITH {FUNCS}, {IMPORTS}, {CALLS}, totals AS (SELECT (SELECT COUNT(*) FROM v_source) AS files, (SELECT CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) FROM v_source) AS lines,
      (SELECT COUNT(*) FROM v_source WHERE {GOOD}) AS classes, COUNT(*) FILTER (class_name IS NULL) AS functions,
      COUNT(*) FILTER (class_name IS NOT NULL) AS methods, CAST(SUM(complexity) AS BIGINT) AS complexity,
      (SELECT COUNT(*) FROM v_source WHERE NOT ({GOOD})) AS errors FROM funcs)
    SELECT 'files' AS section, file AS subject, NULL AS target, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT file, COUNT(*) AS n FROM funcs GROUP BY 1 UNION ALL
      SELECT file, COUNT(*) FROM imps GROUP BY 1 UNION ALL SELECT path, 1 FROM v_source) GROUP BY 2
    UNION ALL SELECT DISTINCT 'graph', caller, callee, 1 FROM calls
    UNION ALL SELECT 'summary', item, NULL, n FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME item VALUE n)""",
    ["v_source"],
)
def k09_sections(spark, sf):
    """The exported texts, read back."""
    exported = code.analysis_export(source(spark, sf), cut_lineage(facts(spark, sf)))
    at = lambda name: F.get_json_object("value", f"$.{name}")
    item = lambda subject, target, n: F.struct(subject.alias("subject"), target.cast("string").alias("target"), n.cast("long").alias("n"))
    totals = F.transform(F.map_entries(F.from_json("value", "map<string,bigint>")), lambda e: item(e["key"], F.lit(None), e["value"]))
    rows = (
        F.when(F.col("section") == "summary", totals)
        .when(F.col("section") == "files", F.array(item(at("path"), F.lit(None), F.json_array_length(at("entries")))))
        .otherwise(F.array(item(at("caller"), at("callee"), F.lit(1))))
    )
    return exported.select("section", F.inline(rows))


@query(
    "e07_syntax_check",
    f"""SELECT path AS file, {GOOD} AS success, CASE WHEN {GOOD} THEN NULL ELSE CAST(7 AS BIGINT) END AS line,
    CASE WHEN {GOOD} THEN NULL ELSE 'invalid syntax' END AS message FROM v_source""",
    ["v_source"],
)
def e07(spark, sf):
    return validate.syntax_check(source(spark, sf)).select("file", "success", "line", "message")


@query(
    "a16_check_summary",
    f"""SELECT path AS file, CAST(2 AS BIGINT) AS total, CAST(CASE WHEN {GOOD} THEN 1 ELSE 0 END + CASE WHEN p_size > 20 THEN 0 ELSE 1 END AS BIGINT) AS passed,
    CAST(CASE WHEN {GOOD} THEN 0 ELSE 1 END + CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS BIGINT) AS failed, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings,
    CAST(CASE WHEN {GOOD} THEN 0 ELSE 1 END + CASE WHEN p_size > 20 THEN 1 ELSE 0 END AS BIGINT) AS errors, {GOOD} AND p_size <= 20 AS overall FROM v_source""",
    ["v_source"],
)
def a16(spark, sf):
    import re

    def limit_check(path, text):
        size = int(re.search(r"LIMIT = (\d+)", text).group(1))
        return validate.outcome(size <= 20, warnings=["even"] if size % 2 == 0 else [], errors=["too big"] if size > 20 else [])

    checks = {"syntax": validate.python_syntax, "limit": limit_check}
    return validate.summarize(validate.run_checks(source(spark, sf), checks))


@query("a10_edges", "SELECT DISTINCT caller, callee FROM v_calls", ["v_calls"])
def a10(spark, sf):
    return graph.distinct_edges(view(spark, sf, "v_calls"))


@query(
    "a11_degrees",
    """SELECT name, CAST(SUM(o) AS BIGINT) AS calls, CAST(SUM(i) AS BIGINT) AS called_by FROM (SELECT caller AS name, 1 AS o, 0 AS i FROM v_edges
    UNION ALL SELECT callee, 0, 1 FROM v_edges) GROUP BY 1""",
    ["v_edges"],
)
def a11(spark, sf):
    return graph.degrees(edges(spark, sf))


@query(
    "a12_module_counts",
    f"""WITH {IMPORTS}, {USES} SELECT module, CAST(SUM(i) AS BIGINT) AS imports, CAST(SUM(u) AS BIGINT) AS uses FROM (SELECT module, 1 AS i, 0 AS u FROM imps
    UNION ALL SELECT module, 0, 1 FROM uses) GROUP BY 1""",
    ["v_source"],
)
def a12(spark, sf):
    found = facts_table(spark, sf)
    return code.module_counts(code.imports(found), code.module_uses(found))


@query(
    "a13_dependencies",
    f"WITH {IMPORTS} SELECT file, string_agg(module, ',' ORDER BY line) AS modules, COUNT(*) AS n_modules FROM imps GROUP BY 1",
    ["v_source"],
)
def a13(spark, sf):
    return code.dependencies(code.imports(facts(spark, sf))).withColumn("modules", F.array_join("modules", ","))


@query("a14_severity_counts", "SELECT severity, COUNT(*) AS n FROM v_diag GROUP BY 1", ["v_diag"])
def a14(spark, sf):
    return code.severity_counts(diagnostics(spark, sf))


@query("a14_any_error", "SELECT bool_or(severity = 'error') AS has_errors FROM v_diag", ["v_diag"])
def a14_any(spark, sf):
    return code.any_error(diagnostics(spark, sf))


@query("a15_symbol_counts", "SELECT callee AS symbol, COUNT(*) AS n FROM v_calls GROUP BY 1", ["v_calls"])
def a15(spark, sf):
    return code.symbol_counts(view(spark, sf, "v_calls").withColumnRenamed("callee", "symbol"))


@query(
    "a20_class_methods",
    f"SELECT path AS file, 'Box' || p_partkey % 10 AS name, CAST(2 AS BIGINT) AS n_methods, 'Base' AS bases FROM v_source WHERE {GOOD}",
    ["v_source"],
)
def a20(spark, sf):
    return code.classes(facts(spark, sf)).select(
        "file", "name", F.size("methods").cast("long").alias("n_methods"), F.array_join("bases", ",").alias("bases")
    )


@query("g01_callers", "SELECT caller FROM v_edges WHERE callee = 'f77'", ["v_edges"])
def g01_callers(spark, sf):
    return graph.callers(edges(spark, sf), "f77")


@query("g01_callees", "SELECT callee FROM v_edges WHERE caller = 'f77'", ["v_edges"])
def g01_callees(spark, sf):
    return graph.callees(edges(spark, sf), "f77")


TOP5 = """SELECT name FROM (SELECT caller AS name FROM v_edges UNION ALL SELECT callee FROM v_edges) GROUP BY name ORDER BY COUNT(*) DESC, name LIMIT 5"""


@query(
    "g02_call_chain",
    f"""WITH RECURSIVE top AS ({TOP5}), walk(start, node, depth) AS (SELECT name, name, 0 FROM top UNION
      SELECT w.start, e.callee, w.depth + 1 FROM walk w JOIN v_edges e ON w.node = e.caller WHERE w.depth < 5)
    SELECT start, node, min(depth) AS depth FROM walk GROUP BY 1, 2""",
    ["v_edges"],
)
def g02(spark, sf):
    e = cut_lineage(edges(spark, sf))
    return graph.call_chain(e, graph.top_by_degree(e, 5), 5).select("start", "node", "depth")


@query(
    "j06_hotspots",
    """WITH c AS (SELECT file, COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (severity = 'warning') AS warnings FROM v_diag GROUP BY 1),
    t AS (SELECT file, complexity FROM v_funcs ORDER BY complexity DESC, file, coalesce(class_name || '.', '') || name, line_start LIMIT 10),
    x AS (SELECT file, CAST(SUM(complexity) AS BIGINT) AS complexity FROM t GROUP BY 1)
    SELECT c.file, errors, warnings, coalesce(complexity, 0) AS complexity, errors * 10 + warnings * 2 + coalesce(complexity, 0) AS score
    FROM c LEFT JOIN x ON c.file = x.file WHERE errors > 0 OR warnings > 3""",
    ["v_diag", "v_funcs"],
)
def j06(spark, sf):
    return code.hotspots(diagnostics(spark, sf), code.top_complex(funcs(spark, sf)))


@query(
    "t08_hotspot_order",
    """WITH c AS (SELECT file, COUNT(*) FILTER (severity = 'error') AS errors, COUNT(*) FILTER (severity = 'warning') AS warnings FROM v_diag GROUP BY 1),
    t AS (SELECT file, complexity FROM v_funcs ORDER BY complexity DESC, file, coalesce(class_name || '.', '') || name, line_start LIMIT 10),
    x AS (SELECT file, CAST(SUM(complexity) AS BIGINT) AS complexity FROM t GROUP BY 1)
    SELECT c.file, errors * 10 + warnings * 2 + coalesce(complexity, 0) AS score
    FROM c LEFT JOIN x ON c.file = x.file WHERE errors > 0 OR warnings > 3 ORDER BY score DESC, file LIMIT 20""",
    ["v_diag", "v_funcs"],
)
def t08(spark, sf):
    ranked = code.hotspots(diagnostics(spark, sf), code.top_complex(funcs(spark, sf)))
    return ranked.select("file", "score").orderBy(F.desc("score"), "file").limit(20)


@query(
    "x16_hotspot_score",
    """SELECT file, COUNT(*) FILTER (severity = 'error') * 10 + COUNT(*) FILTER (severity = 'warning') * 2 AS score FROM v_diag GROUP BY 1
    HAVING COUNT(*) FILTER (severity = 'error') > 0 OR COUNT(*) FILTER (severity = 'warning') > 3""",
    ["v_diag"],
)
def x16(spark, sf):
    none = funcs(spark, sf).where(F.col("complexity") < 0).select("file", "complexity")
    return code.hotspots(diagnostics(spark, sf), none).select("file", "score")


@query(
    "j07_induced_edges",
    """WITH top AS (SELECT name FROM (SELECT caller AS name FROM v_edges UNION ALL SELECT callee FROM v_edges) GROUP BY name ORDER BY COUNT(*) DESC, name LIMIT 200)
    SELECT caller, callee FROM v_edges WHERE caller IN (SELECT name FROM top) AND callee IN (SELECT name FROM top)""",
    ["v_edges"],
)
def j07(spark, sf):
    e = edges(spark, sf)
    return graph.induced_edges(e, graph.top_by_degree(e, 200))


@query(
    "j08_callee_resolution",
    "SELECT caller, callee, callee IN (SELECT 'f' || o_orderkey FROM orders) AS resolved FROM v_edges",
    ["v_edges"],
)
def j08(spark, sf):
    known = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"))
    return graph.resolve_callees(edges(spark, sf), known)


@query(
    "k10_dot_graph",
    """WITH top AS (SELECT name FROM (SELECT caller AS name FROM v_edges UNION ALL SELECT callee FROM v_edges) GROUP BY name ORDER BY COUNT(*) DESC, name LIMIT 200)
    SELECT 0 AS section, 'digraph CallGraph {' || chr(10) || '  rankdir=TB;' || chr(10) || '  node [shape=box, style=rounded];' || chr(10) AS line UNION ALL
    SELECT 1, '  "' || name || '" [label="' || name || '\\n(o.py:' || o_orderkey || ')", fillcolor=lightgreen, style=filled];' FROM top JOIN orders ON name = 'f' || o_orderkey UNION ALL
    SELECT 2, '  "' || caller || '" -> "' || callee || '";' FROM v_edges WHERE caller IN (SELECT name FROM top) AND callee IN (SELECT name FROM top)
    UNION ALL SELECT 3, '}'""",
    ["v_edges"],
)
def k10(spark, sf):
    known = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("src/o.py").alias("file"),
        F.col("o_orderkey").alias("line_start"),
        F.lit(False).alias("is_method"),
    )
    return graph.dot_lines(edges(spark, sf), known, 200)


@query(
    "t03_top_degree",
    """SELECT name, COUNT(*) AS score FROM (SELECT caller AS name FROM v_edges UNION ALL SELECT callee FROM v_edges) GROUP BY name
    ORDER BY score DESC, name LIMIT 50""",
    ["v_edges"],
)
def t03(spark, sf):
    return graph.top_by_degree(edges(spark, sf))


@query(
    "t04_most_called",
    "SELECT callee AS name, COUNT(*) AS n FROM v_edges GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    ["v_edges"],
)
def t04(spark, sf):
    return graph.most_called(edges(spark, sf))


@query(
    "t04_top_modules",
    f"WITH {USES} SELECT module, COUNT(*) AS uses FROM uses GROUP BY 1 ORDER BY uses DESC, module LIMIT 10",
    ["v_source"],
)
def t04_modules(spark, sf):
    uses = code.module_uses(facts_table(spark, sf)).groupBy("module").agg(F.count(F.lit(1)).alias("uses"))
    return uses.orderBy(F.desc("uses"), "module").limit(10)


@query(
    "t05_most_complex",
    """SELECT file, coalesce(class_name || '.', '') || name AS full_name, line_start, complexity FROM v_funcs
    ORDER BY complexity DESC, file, full_name, line_start LIMIT 10""",
    ["v_funcs"],
)
def t05(spark, sf):
    return code.top_complex(funcs(spark, sf))


@query("t07_top_symbols", "SELECT callee AS symbol, COUNT(*) AS n FROM v_calls GROUP BY 1 ORDER BY n DESC, symbol LIMIT 5", ["v_calls"])
def t07(spark, sf):
    return code.symbol_counts(view(spark, sf, "v_calls").withColumnRenamed("callee", "symbol"), keep=5)


@query(
    "t07_most_dependent",
    f"WITH {IMPORTS} SELECT file, COUNT(*) AS n_modules FROM imps GROUP BY 1 ORDER BY n_modules DESC, file LIMIT 5",
    ["v_source"],
)
def t07_dependent(spark, sf):
    return code.most_dependent(code.imports(facts(spark, sf)))


@query(
    "t07_first_errors",
    "SELECT file, line FROM v_diag WHERE severity = 'error' ORDER BY file, line LIMIT 10",
    ["v_diag"],
)
def t07_errors(spark, sf):
    return diagnostics(spark, sf).where(F.col("severity") == "error").select("file", "line").orderBy("file", "line").limit(10)


@query(
    "t09_first_per_file",
    """SELECT file, line, severity FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, severity) AS rn FROM v_diag) WHERE rn <= 5""",
    ["v_diag"],
)
def t09(spark, sf):
    rows = diagnostics(spark, sf).select("file", "line", "severity")
    return code.first_per_file(rows, 5, order=("line", "severity"))


@query(
    "t10_function_listing",
    "SELECT file, name, line_start FROM v_funcs ORDER BY file, line_start, name LIMIT 100",
    ["v_funcs"],
)
def t10(spark, sf):
    return code.listing(funcs(spark, sf).select("file", "name", "line_start"), 100)


@query(
    "u05_last_by_name",
    """SELECT name, file, line_start FROM (SELECT *, row_number() OVER (PARTITION BY owner || name ORDER BY file DESC, line_start DESC) AS rn, owner || name AS full_name FROM v_funcs) WHERE rn = 1""",
    ["v_funcs"],
)
def u05(spark, sf):
    named = funcs(spark, sf).withColumn("full_name", F.concat("owner", "name"))
    return code.last_by_name(named, "full_name", ["file", "line_start"]).select("name", "file", "line_start")


@query(
    "j05_changed_line_issues",
    r"""WITH i AS (SELECT *, CAST(coalesce(nullif(regexp_extract(message, ':(\d+):', 1), ''), nullif(regexp_extract(message, 'line (\d+)', 1), ''),
      nullif(regexp_extract(message, '\((\d+)\)', 1), ''), nullif(regexp_extract(message, '@(\d+)', 1), '')) AS INT) AS line FROM v_issues),
    c AS (SELECT DISTINCT 'm' || p_partkey || '.py' AS file, p_size AS line FROM part)
    SELECT issue_id, file, line FROM i WHERE line IS NULL OR EXISTS (SELECT 1 FROM c WHERE c.file = i.file AND abs(c.line - i.line) <= 2)""",
    ["v_issues"],
)
def j05(spark, sf):
    changed = table(spark, sf, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), F.col("p_size").alias("line")
    )
    return validate.near_changes(view(spark, sf, "v_issues"), changed).select("issue_id", "file", "line")
