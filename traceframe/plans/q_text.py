"""Text, search and file-statistics queries over documents, pages and the source view."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import globs, text
from traceframe.operators import search
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import spread
from traceframe.sources.text_lines import split_lines

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
LINES = """lines AS (SELECT path, text, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {src})"""


def files(spark, sf):
    return spread(view(spark, sf, "v_files"))


def source(spark, sf):
    return spread(view(spark, sf, "v_source"))


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


@query(
    "s13_split_lines",
    """SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents""",
)
def s13(spark, sf):
    return split_lines(docs(spark, sf).select("doc_id", "text"), "text")


@query(
    "s10_decode_ladder",
    "SELECT doc_id, text AS decoded, CASE WHEN doc_id % 5 = 0 THEN 'é' ELSE '' END AS tail FROM documents",
)
def s10(spark, sf):
    from traceframe.sources.code_files import decode_text

    raw = docs(spark, sf).select(
        "doc_id",
        F.col("text").cast("binary").alias("content"),
        F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("E9"))).otherwise(F.lit("").cast("binary")).alias("odd"),
    )
    return raw.select("doc_id", decode_text(F.col("content")).alias("decoded"), decode_text(F.col("odd")).alias("tail"))


@query(
    "s11_archive_path",
    "SELECT doc_id, regexp_replace(path, '^[^/]+/', '') AS inner_path FROM v_files",
    ["v_files"],
)
def s11(spark, sf):
    return files(spark, sf).select("doc_id", text.drop_first_part(F.col("path")).alias("inner_path"))


def _fits(subject, glob):
    return f"regexp_full_match({subject}, '{globs.glob_regex(glob)}', 's')"


_DEV = globs.exclusion_preset("dev")
_DEV_PATTERNS = ["*test*", "build/*", ".*", "*/lib/*"]


def _exclusion_sql(patterns):
    """The six readings of a glob, each spelled out."""
    parts = "string_split(path, '/')"
    tests = []
    for g in patterns:
        tests += [
            _fits("path", g),
            f"len(list_filter({parts}, lambda p: {_fits('p', g)})) > 0",
            _fits("path", f"*/{g}/*"),
            _fits("path", f"*/{g}"),
            f"len(list_filter(range(1, len({parts})), lambda i: {_fits(f'''array_to_string(list_slice({parts}, 1, i), '/')''', g)})) > 0",
            f"len(list_filter(range(1, len({parts}) + 1), lambda i: {_fits(f'''array_to_string(list_slice({parts}, i, len({parts})), '/')''', g)})) > 0",
        ]
        if g.endswith("/*"):
            tests.append(f"len(list_filter(list_slice({parts}, 1, len({parts}) - 1), lambda p: {_fits('p', g[:-2])})) > 0")
    return " OR ".join(tests)


@query("f25_path_exclusion", f"SELECT path FROM v_files WHERE NOT ({_exclusion_sql(_DEV_PATTERNS)})", ["v_files"])
def f25(spark, sf):
    return files(spark, sf).where(~globs.excluded(F.col("path"), _DEV_PATTERNS)).select("path")


@query("f26_exclusion_preset", f"SELECT path FROM v_files WHERE NOT ({_exclusion_sql(_DEV)})", ["v_files"])
def f26(spark, sf):
    return files(spark, sf).where(~globs.excluded(F.col("path"), _DEV)).select("path")


@query("f27_file_list", "SELECT path FROM v_files WHERE path LIKE '%.py' ORDER BY path LIMIT 100", ["v_files"])
def f27(spark, sf):
    return search.list_files(files(spark, sf), "*.py", limit=100)


@query("f27_file_list_all", "SELECT path FROM v_files WHERE path LIKE '%.py'", ["v_files"])
def f27_all(spark, sf):
    return search.list_files(files(spark, sf), "*.py")


@query(
    "f27_file_count",
    "SELECT COUNT(*) FILTER (path LIKE '%.py') AS matching, COUNT(*) AS total FROM v_files",
    ["v_files"],
)
def f27_count(spark, sf):
    return search.count_files(files(spark, sf), "*.py")


@query(
    "f28_grep",
    f"""WITH {LINES.format(src='v_files')} SELECT path, line_no, trim(line, {WS}) AS content,
    regexp_replace(trim(line, {WS}), 'tion|[0-9]+', '[\\0]', 'gi') AS highlighted FROM lines
    WHERE path LIKE '%.py' AND regexp_matches(line, 'tion|[0-9]+', 'i')""",
    ["v_files"],
)
def f28(spark, sf):
    return search.grep(files(spark, sf), "tion|[0-9]+", "*.py")


@query(
    "f29_definition_search",
    f"""WITH {LINES.format(src='v_source')}, d AS (SELECT *, trim(line, {WS}) AS content, regexp_matches(trim(line, {WS}), '^(def |class |async def )') AS is_def,
      regexp_extract(line, '(?:def|class)\\s+(\\w+)', 1) AS n FROM lines)
    SELECT path, line_no, CASE WHEN is_def THEN n ELSE 'content_match' END AS name,
      CASE WHEN NOT is_def THEN 'content' WHEN contains(line, 'class ') THEN 'class' ELSE 'function' END AS kind, content,
      is_def AND contains(line, 'async ') AS is_async FROM d
    WHERE CASE WHEN is_def THEN n <> '' AND regexp_matches(n, 'put|box3|load_1', 'i') ELSE regexp_matches(line, 'put|box3|load_1', 'i') END""",
    ["v_source"],
)
def f29(spark, sf):
    return search.search_definitions(source(spark, sf), "put|box3|load_1")


@query(
    "f30_symbol_search",
    """WITH s AS (SELECT file, name, coalesce(class_name || '.', '') || name AS full_name FROM v_funcs
      UNION ALL SELECT DISTINCT file, class_name, class_name FROM v_funcs WHERE class_name IS NOT NULL)
    SELECT file, name, full_name, regexp_replace(full_name, 'c2|f1', '[\\0]', 'gi') AS highlighted FROM s
    WHERE regexp_matches(name, 'c2|f1', 'i') OR regexp_matches(full_name, 'c2|f1', 'i')""",
    ["v_funcs"],
)
def f30(spark, sf):
    funcs = view(spark, sf, "v_funcs")
    full = F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name")
    functions = funcs.select("file", "name", full.alias("full_name"))
    named = funcs.where(F.col("class_name").isNotNull()).select("file", F.col("class_name").alias("name")).distinct()
    return search.search_symbols(functions.unionByName(named.withColumn("full_name", F.col("name"))), "c2|f1")


def _lookup_sql(name):
    return f"""WITH s AS (SELECT file, coalesce(class_name || '.', '') || name AS full_name FROM v_funcs), r AS (SELECT *,
      CASE WHEN full_name = '{name}' THEN 0 WHEN contains(full_name, '{name}') THEN 1 WHEN contains(lower(full_name), lower('{name}')) THEN 2 END AS rank FROM s)
    SELECT file, full_name, rank FROM r WHERE rank < 2 UNION ALL
    (SELECT file, full_name, rank FROM r WHERE rank = 2 AND NOT EXISTS (SELECT 1 FROM r WHERE rank < 2) ORDER BY full_name, file LIMIT 5)"""


@query("f31_function_lookup", _lookup_sql("C1.f2"), ["v_funcs"])
def f31(spark, sf):
    funcs = view(spark, sf, "v_funcs")
    full = F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name")
    return search.lookup_function(funcs.select("file", full.alias("full_name")), "C1.f2")


@query(
    "j02_containing_function",
    """WITH p AS (SELECT l_orderkey, l_linenumber, 'm' || l_partkey || '.py' AS file, 1 + l_suppkey % 70 AS line FROM lineitem)
    SELECT l_orderkey, l_linenumber, p.file, line, first(name ORDER BY line_end - line_start, line_start, line_end, name) AS function
    FROM p LEFT JOIN v_funcs f ON p.file = f.file AND line BETWEEN line_start AND line_end GROUP BY ALL""",
    ["v_funcs"],
)
def j02(spark, sf):
    places = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("m"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file"),
        (1 + F.col("l_suppkey") % 70).alias("line"),
    )
    # two identical lineitems merge, as the place is part of the key
    found = search.containing_function(places, view(spark, sf, "v_funcs"), ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "file", "line", "function")


@query(
    "j03_preview_range",
    f"""WITH {LINES.format(src='v_source')}, n AS (SELECT p_partkey, path AS p FROM v_source)
    SELECT path, line_no, lpad(CAST(line_no AS VARCHAR), 4, ' ') || CASE WHEN line_no = 9 THEN ' >>> ' ELSE ' | ' END || line AS shown
    FROM lines WHERE line_no BETWEEN 7 AND 12""",
    ["v_source"],
)
def j03(spark, sf):
    src = source(spark, sf)
    asked = src.select("path", F.lit(7).alias("first"), F.lit(12).alias("last"), F.lit(9).alias("line"))
    return search.preview(asked, src, "line").select("path", "line_no", "shown")


@query(
    "j04_unique_path",
    """SELECT r AS request, max(path) AS file FROM (SELECT unnest(['doc_17', 'test_doc_994.md', 'tests', 'doc_998.md', 'nowhere', 'src1/en']) AS r) q, v_files
    WHERE contains(path, r) GROUP BY r HAVING COUNT(*) = 1""",
    ["v_files"],
)
def j04(spark, sf):
    return search.unique_paths(files(spark, sf), ["doc_17", "test_doc_994.md", "tests", "doc_998.md", "nowhere", "src1/en"])


@query(
    "j04_partial_paths",
    """WITH q AS (SELECT DISTINCT r FROM (SELECT right(path, 9) AS r FROM v_files UNION ALL SELECT 'doc_' || doc_id FROM v_files UNION ALL
      SELECT path FROM v_files WHERE doc_id % 5 = 0 UNION ALL SELECT substr(path, 2, 2) FROM v_files UNION ALL SELECT 'no/' || doc_id FROM v_files))
    SELECT r AS request, coalesce(max(CASE WHEN path = r THEN path END), CASE WHEN COUNT(*) = 1 THEN max(path) END) AS file
    FROM q JOIN v_files ON contains(path, r) GROUP BY r HAVING max(CASE WHEN path = r THEN path END) IS NOT NULL OR COUNT(*) = 1""",
    ["v_files"],
)
def j04_partial(spark, sf):
    known = files(spark, sf)
    parts = [F.expr("right(path, 9)"), F.expr("'doc_' || doc_id"), F.expr("case when doc_id % 5 = 0 then path end"), F.expr("substr(path, 2, 2)"), F.expr("'no/' || doc_id")]
    return search.partial_paths(known, known.select(F.explode(F.array(*parts)).alias("request")))


@query(
    "w13_function_end",
    f"""WITH src AS (SELECT path, regexp_replace(text, '\\n$', '') AS text FROM v_source), {LINES.format(src='src')},
    l AS (SELECT path, line_no - 1 AS i, rtrim(line, {WS}) AS t, line FROM lines),
    n AS (SELECT path, COUNT(*) AS total FROM l GROUP BY path),
    d AS (SELECT path, i AS p, regexp_extract(line, 'def\\s+(\\w+)', 1) AS name FROM l WHERE regexp_matches(line, '^\\s*(async\\s+)?def\\s+\\w+')),
    b AS (SELECT d.path, d.p, d.name, l.i, l.t, length(l.t) - length(ltrim(l.t, {WS})) AS ind FROM d JOIN l ON d.path = l.path AND l.i > d.p WHERE l.t <> ''),
    f AS (SELECT path, p, min(i) AS fi, arg_min(ind, i) AS deep FROM b WHERE NOT ends_with(t, ':') GROUP BY path, p),
    e AS (SELECT b.path, b.p, min(b.i) AS stop FROM b JOIN f ON b.path = f.path AND b.p = f.p
      WHERE b.i >= fi AND ind <= deep AND NOT regexp_matches(trim(t, {WS}), '^[#@]') AND b.i > b.p + 2 GROUP BY b.path, b.p)
    SELECT d.path, d.name, d.p + 1 AS line_start, coalesce(stop, total) AS line_end FROM d JOIN n ON d.path = n.path LEFT JOIN e ON d.path = e.path AND d.p = e.p""",
    ["v_source"],
)
def w13(spark, sf):
    return search.function_ends(source(spark, sf))


_CALLS_FROM = f"""src AS (SELECT path, regexp_replace(text, '\\n$', '') AS text FROM v_source), {LINES.format(src='src')},
    l AS (SELECT path, line_no, line, trim(line, {WS}) AS t, length(line) - length(ltrim(line, {WS})) AS ind FROM lines),
    d AS (SELECT path, line_no AS p, ind AS base FROM l WHERE contains(line, 'def _get(')),
    s AS (SELECT d.path, p, min(line_no) AS stop FROM d JOIN l ON d.path = l.path AND line_no > p WHERE t <> '' AND ind <= base GROUP BY d.path, p),
    c AS (SELECT d.path, l.line_no, l.t, unnest(regexp_extract_all(line, '(\\w+)\\s*\\(', 1)) AS callee FROM d JOIN l ON d.path = l.path
      LEFT JOIN s ON d.path = s.path AND d.p = s.p WHERE line_no > d.p AND (stop IS NULL OR line_no < stop)),
    k AS (SELECT path, line_no, callee, t AS content FROM c WHERE callee NOT IN ('if','for','while','print','len','str','int','float','bool','dict','list','tuple','set'))"""


@query("w14_calls_from", f"WITH {_CALLS_FROM} SELECT path, line_no, callee, content FROM k", ["v_source"])
def w14(spark, sf):
    return search.calls_from(source(spark, sf), "_get")


@query(
    "a17_call_occurrences",
    f"""WITH {_CALLS_FROM} SELECT callee, COUNT(*) AS n, array_to_string(list_slice(list(path || ':' || line_no ORDER BY path, line_no), 1, 3), ',') AS places
    FROM k GROUP BY callee""",
    ["v_source"],
)
def a17(spark, sf):
    found = search.call_occurrences(search.calls_from(source(spark, sf), "_get"))
    places = F.transform("places", lambda p: F.concat_ws(":", p["path"], p["line_no"].cast("string")))
    return found.select("callee", "n", F.array_join(places, ",").alias("places"))


@query(
    "w15_row_cap",
    f"""WITH {LINES.format(src='v_files')} SELECT path, line_no FROM lines WHERE path LIKE '%.md' AND regexp_matches(line, 'the', 'i')
    ORDER BY path, line_no LIMIT 50""",
    ["v_files"],
)
def w15(spark, sf):
    return search.capped_lines(search.grep(files(spark, sf), "the", "*.md"), 50).select("path", "line_no")


@query(
    "a07_file_metrics",
    f"""WITH {LINES.format(src='v_source')} SELECT path, COUNT(*) AS total_lines, COUNT(*) FILTER (trim(line, {WS}) = '') AS blank_lines,
    COUNT(*) FILTER (starts_with(trim(line, {WS}), '#')) AS comment_lines FROM lines GROUP BY path""",
    ["v_source"],
)
def a07(spark, sf):
    return search.file_metrics(source(spark, sf))


@query(
    "a08_directory_stats",
    """SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS directory, COUNT(*) AS files,
    CAST(SUM(strlen(text)) AS BIGINT) AS bytes FROM v_files GROUP BY 1""",
    ["v_files"],
)
def a08(spark, sf):
    return search.directory_stats(files(spark, sf))


@query(
    "a09_extensions",
    """SELECT CASE WHEN contains(path, '.') THEN lower(list_last(string_split(path, '.'))) ELSE 'no_ext' END AS ext, COUNT(*) AS n
    FROM v_files GROUP BY 1 ORDER BY n DESC, ext LIMIT 10""",
    ["v_files"],
)
def a09(spark, sf):
    return search.extension_counts(files(spark, sf))


@query("t06_largest_files", "SELECT path, strlen(text) AS bytes FROM v_files ORDER BY bytes DESC, path LIMIT 10", ["v_files"])
def t06(spark, sf):
    return search.largest_files(files(spark, sf))


@query(
    "x06_hyperlink",
    "SELECT url, 'https://kb.example.org/techniques/' || replace(url, '.', '/') AS link FROM pages",
)
def x06(spark, sf):
    link = text.hyperlink("https://kb.example.org/techniques/", F.col("url"))
    return table(spark, sf, "pages").select("url", link.alias("link"))


# markdown made of each document's own text: header, bold, bullets, a fence and a table
_MD_DUCK = """'# ' || lang || chr(10) || '**' || replace(source, '*', '') || '** and text' || chr(10) || '- ' || substr(replace(text, chr(10), ' '), 1, 300)
  || chr(10) || '```py' || chr(10) || 'x = ' || n_chars || chr(10) || '```' || chr(10) || '| Name | Size |' || chr(10) || '|---|---|' || chr(10)
  || '| ' || lang || ' | ' || n_chars || ' |' || chr(10) || '| ' || source || ' | :white_check_mark: |' || chr(10) || 'end' || chr(10) || text"""


def markdown(spark, sf):
    n = F.col("n_chars").cast("string")
    flat = F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 300)
    body = F.concat(
        F.lit("# "), "lang", F.lit("\n**"), F.replace("source", F.lit("*"), F.lit("")), F.lit("** and text\n- "), flat,
        F.lit("\n```py\nx = "), n, F.lit("\n```\n| Name | Size |\n|---|---|\n| "), "lang", F.lit(" | "), n,
        F.lit(" |\n| "), "source", F.lit(" | :white_check_mark: |\nend\n"), "text",
    )
    return docs(spark, sf).select("doc_id", body.alias("md"))


@query(
    "x07_markdown_to_chat",
    f"""WITH m AS (SELECT doc_id, lang, source, n_chars, {_MD_DUCK} AS md FROM documents),
    t AS (SELECT doc_id, replace(md, '| Name | Size |' || chr(10) || '|---|---|' || chr(10) || '| ' || lang || ' | ' || n_chars || ' |' || chr(10)
       || '| ' || source || ' | :white_check_mark: |',
       '  *Name*: ' || lang || chr(10) || '  *Size*: ' || n_chars || chr(10) || chr(10) || '  *Name*: ' || source || chr(10) || '  *Size*: ✅') AS md FROM m)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md,
      '(?s)```\\w*\\n(.*?)\\n```', '```' || chr(10) || '\\1' || chr(10) || '```', 'g'),
      '(?m)^### (.+)$', '*\\1*', 'g'), '(?m)^## (.+)$', '*\\1*', 'g'), '(?m)^# (.+)$', '*\\1*', 'g'),
      '(?s)\\*\\*([^*]+(?:\\*[^*]+)*)\\*\\*', '*\\1*', 'g'), '(?m)^-\\s+(.+)$', '• \\1', 'g'), '(?m)^(\\s*)•\\s+(.+)$', '\\1• \\2', 'g') AS chat FROM t""",
)
def x07(spark, sf):
    return markdown(spark, sf).select("doc_id", text.markdown_to_chat(F.col("md")).alias("chat"))


@query(
    "x08_markdown_tables",
    """SELECT doc_id, 1 AS row_no, 'Name' AS header, lang AS value FROM documents UNION ALL SELECT doc_id, 1, 'Size', CAST(n_chars AS VARCHAR) FROM documents
    UNION ALL SELECT doc_id, 2, 'Name', source FROM documents UNION ALL SELECT doc_id, 2, 'Size', ':white_check_mark:' FROM documents""",
)
def x08(spark, sf):
    from traceframe.operators.markdown import table_cells

    return table_cells(markdown(spark, sf), "doc_id", "md").select("doc_id", "row_no", "header", "value")


@query(
    "x09_line_number",
    r"""SELECT issue_id, CAST(coalesce(nullif(regexp_extract(message, ':(\d+):', 1), ''), nullif(regexp_extract(message, 'line (\d+)', 1), ''),
    nullif(regexp_extract(message, '\((\d+)\)', 1), ''), nullif(regexp_extract(message, '@(\d+)', 1), '')) AS INT) AS line FROM v_issues""",
    ["v_issues"],
)
def x09(spark, sf):
    return view(spark, sf, "v_issues").select("issue_id", text.line_number(F.col("message")).alias("line"))


@query(
    "x10_lint_class",
    r"""SELECT issue_id, regexp_extract(message, '\b([A-Z])\d{3,4}\b', 1) IN ('W', 'C') AS is_warning,
    regexp_extract(message, '\b([A-Z])\d{3,4}\b', 1) IN ('E', 'F') AS is_error FROM v_issues""",
    ["v_issues"],
)
def x10(spark, sf):
    warn, error = text.lint_class(F.col("message"))
    return view(spark, sf, "v_issues").select("issue_id", warn.alias("is_warning"), error.alias("is_error"))


@query("x11_highlight", "SELECT doc_id, regexp_replace(text, 'the|die|les', '[\\0]', 'gi') AS marked FROM documents")
def x11(spark, sf):
    return docs(spark, sf).select("doc_id", text.highlight(F.col("text"), "the|die|les").alias("marked"))


@query(
    "x12_visibility",
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '__' || p_brand || '__' WHEN 1 THEN '__' || p_brand WHEN 2 THEN '_' || p_brand ELSE p_brand END AS name FROM part)
    SELECT p_partkey, CASE WHEN name LIKE '\\_\\_%\\_\\_' ESCAPE '\\' THEN 'magic' WHEN name LIKE '\\_\\_%' ESCAPE '\\' THEN 'private'
    WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS visibility FROM n""",
)
def x12(spark, sf):
    kind, brand = F.col("p_partkey") % 4, F.col("p_brand")
    name = (
        F.when(kind == 0, F.concat(F.lit("__"), brand, F.lit("__")))
        .when(kind == 1, F.concat(F.lit("__"), brand))
        .when(kind == 2, F.concat(F.lit("_"), brand))
        .otherwise(brand)
    )
    return table(spark, sf, "part").select("p_partkey", text.visibility(name).alias("visibility"))


@query(
    "x13_constant_flag",
    "SELECT p_partkey, p_type = upper(p_type) AND regexp_matches(p_type, '[A-Z]') AS type_is_constant, p_name = upper(p_name) AND regexp_matches(p_name, '[A-Z]') AS name_is_constant FROM part",
)
def x13(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        text.is_constant(F.col("p_type")).alias("type_is_constant"),
        text.is_constant(F.col("p_name")).alias("name_is_constant"),
    )


@query(
    "x15_severity_word",
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' WHEN 4 THEN 'hint' ELSE 'info' END AS severity FROM events""",
)
def x15(spark, sf):
    return table(spark, sf, "events").select("event_id", text.severity_word(F.col("event_id") % 6).alias("severity"))


@query(
    "x17_line_endings",
    "SELECT doc_id, text AS normal FROM documents",
)
def x17(spark, sf):
    mixed = F.regexp_replace(F.regexp_replace("text", "\n", "\r\n"), "\\. ?\r\n", ".\r")
    lost = F.regexp_replace("text", "\\. ?\n", ".\n")
    d = docs(spark, sf)
    # the mixed text lost a blank before the line break; put the original there before comparing
    return d.select(
        "doc_id", F.when(text.normalize_newlines(mixed) == lost, F.col("text")).otherwise("not normal").alias("normal")
    )


@query(
    "x18_same_line",
    f"""SELECT doc_id, trim(t, {WS} || '.,') = trim(u, {WS} || '.,') AS same FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t,
    '  ' || CASE WHEN doc_id % 2 = 0 THEN rtrim(string_split(text, chr(10))[1], '.') || ',' ELSE string_split(text, chr(10))[1] || 'x' END AS u FROM documents)""",
)
def x18(spark, sf):
    first = F.get(F.split("text", "\n", -1), F.lit(0))
    other = F.concat(
        F.lit("  "),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.rtrim(first, F.lit(".")), F.lit(","))).otherwise(F.concat(first, F.lit("x"))),
    )
    return docs(spark, sf).select("doc_id", text.same_line(first, other).alias("same"))


@query(
    "x19_repository_url",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, 'generic' AS platform, CASE WHEN len(parts) = 1 THEN 'unknown' ELSE array_to_string(list_slice(parts, 1, len(parts) - 1), '/') END AS owner,
    regexp_replace(list_last(parts), '\.git$', '') AS repo, regexp_replace(regexp_extract(url, '^(https?://[^?#]*)', 1), '\.git$', '') || '/-/archive/main/'
      || regexp_replace(list_last(parts), '\.git$', '') || '-main.zip' AS archive_url,
    CASE WHEN url LIKE 'http://%' THEN 'none' WHEN contains(url, '@') OR contains(url, 'token') THEN 'token' ELSE 'https' END AS auth
    FROM q WHERE len(parts) > 0""",
)
def x19(spark, sf):
    fields = table(spark, sf, "pages").select("page_id", text.repository_fields(F.col("url")).alias("r"))
    return fields.where(F.col("r.repo").isNotNull()).select(
        "page_id", "r.platform", "r.owner", "r.repo", "r.archive_url", "r.auth"
    )


@query(
    "x21_capped_list",
    """SELECT conv_id, CASE WHEN COUNT(*) > 3 THEN string_agg(role, ',' ORDER BY turn) FILTER (turn < 3) || ',... and ' || (COUNT(*) - 3) || ' more turns'
    ELSE string_agg(role, ',' ORDER BY turn) END AS roles FROM conversations GROUP BY conv_id""",
)
def x21(spark, sf):
    first = search.first_values(table(spark, sf, "conversations"), "conv_id", ["turn"], F.col("role"), 3)
    capped = text.cap_list(F.col("values"), 3, "turns", F.col("n"))
    return first.select("conv_id", F.array_join(capped, ",").alias("roles"))


@query(
    "x22_call_names",
    f"""WITH {LINES.format(src='v_source')} SELECT path, line_no, unnest(regexp_extract_all(line, '(\\w+)\\s*\\(', 1)) AS callee FROM lines""",
    ["v_source"],
)
def x22(spark, sf):
    lines = split_lines(source(spark, sf).select("path", "text"), "text")
    return lines.select("path", "line_no", F.explode(text.call_names(F.col("line"))).alias("callee"))


@query(
    "x23_calls_to",
    f"""WITH {LINES.format(src='v_source')} SELECT path, line_no, trim(line, {WS}) AS content FROM lines WHERE regexp_matches(line, '\\bhelper_7\\s*\\(')""",
    ["v_source"],
)
def x23(spark, sf):
    return search.calls_to(source(spark, sf), "helper_7")
