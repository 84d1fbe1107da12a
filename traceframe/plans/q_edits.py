"""Edit and diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.operators import edits
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import spread

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def plan(spark, sf):
    return spread(view(spark, sf, "v_edits"))


def both(spark, sf):
    v = plan(spark, sf)
    return v.select("file", "text"), v.select("file", "search", "replacement")


def line_edits(spark, sf):
    """Line 1 by its real start, line 2 by text that is not there, and a line past the end."""
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file")
    first = F.substring(F.get(F.split("text", "\n", -1), F.lit(0)), 1, 5)
    edit = lambda seq, line, old, new: F.struct(
        F.lit(seq).alias("seq"), F.lit(line).alias("line"), old.alias("old_content"), F.lit(new).alias("new_content")
    )
    rows = docs.select(
        name, F.explode(F.array(edit(1, 1, first, "EDIT"), edit(2, 2, F.lit("#absent#"), "x"), edit(3, 100000, F.lit("y"), "z"))).alias("e")
    ).select("file", "e.*")
    return docs.select(name, "text"), rows


_LINE_EDIT = f"""d AS (SELECT 'd' || doc_id AS file, string_split(text, chr(10)) AS ls FROM documents),
  q AS (SELECT *, trim(substr(ls[1], 1, 5), {WS}) AS old, len(ls) AS n FROM d),
  r AS (SELECT *, CASE WHEN old = '' THEN 'empty' WHEN contains(trim(ls[1], {WS}), old) THEN 'applied' ELSE 'mismatch' END AS s1,
    CASE WHEN n < 2 THEN 'out_of_range' WHEN trim(ls[2], {WS}) = '' THEN 'applied' ELSE 'mismatch' END AS s2 FROM q)"""


@query(
    "e03_line_edits",
    f"""WITH {_LINE_EDIT} SELECT file, array_to_string(list_concat([CASE WHEN s1 = 'applied' THEN replace(ls[1], old, 'EDIT') ELSE ls[1] END], list_slice(ls, 2, n)), chr(10)) AS text,
    CAST((s1 = 'applied')::INT + (s2 = 'applied')::INT AS BIGINT) AS applied FROM r""",
)
def e03(spark, sf):
    files, rows = line_edits(spark, sf)
    return edits.apply_line_edits(files, rows)


@query(
    "e03_edit_status",
    f"""WITH {_LINE_EDIT} SELECT file, 1 AS seq, s1 AS status FROM r UNION ALL SELECT file, 2, s2 FROM r UNION ALL SELECT file, 3, 'out_of_range' FROM r""",
)
def e03_status(spark, sf):
    files, rows = line_edits(spark, sf)
    return edits.line_edit_status(files, rows).select("file", "seq", "status")


@query(
    "e04_replace_all",
    """SELECT file, replace(text, search, replacement) AS text, CAST((length(text) - length(replace(text, search, ''))) / length(search) AS BIGINT) AS replaced FROM v_edits""",
    ["v_edits"],
)
def e04_all(spark, sf):
    return edits.replace_all(*both(spark, sf))


@query(
    "e04_replace_first",
    """WITH n AS (SELECT *, CAST((length(text) - length(replace(text, search, ''))) / length(search) AS BIGINT) AS n, instr(text, search) AS hit FROM v_edits)
    SELECT file, CASE WHEN hit > 0 THEN substr(text, 1, hit - 1) || replacement || substr(text, hit + length(search)) ELSE text END AS text,
    CASE WHEN n > 1 THEN 'multiple' WHEN n = 1 THEN 'replaced' ELSE 'not_found' END AS status,
    CASE WHEN n > 0 THEN CAST(len(string_split(substr(text, 1, hit - 1), chr(10))) AS BIGINT) END AS line FROM n""",
    ["v_edits"],
)
def e04_first(spark, sf):
    return edits.replace_first(*both(spark, sf))


@query(
    "e05_replace_in_range",
    f"""WITH r AS (SELECT file, search, replacement, string_split(text, chr(10)) AS ls FROM v_edits),
    b AS (SELECT *, array_to_string(list_slice(ls, 2, 4), chr(10)) AS body FROM r), n AS (SELECT *, instr(body, search) AS hit FROM b)
    SELECT file, array_to_string(list_concat(list_concat(list_slice(ls, 1, 1), string_split(CASE WHEN hit > 0 THEN substr(body, 1, hit - 1) || replacement || substr(body, hit + length(search)) ELSE body END, chr(10))),
      list_slice(ls, 5, len(ls))), chr(10)) AS text, CASE WHEN hit > 0 THEN 'replaced' ELSE 'not_found' END AS status FROM n WHERE len(ls) > 1""",
    ["v_edits"],
)
def e05(spark, sf):
    v = plan(spark, sf).where(F.size(F.split("text", "\n", -1)) > 1)
    ranged = v.select("file", "search", "replacement", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return edits.replace_in_range(v.select("file", "text"), ranged)


@query(
    "e05_replace_in_range_all",
    """WITH r AS (SELECT file, text, search, replacement, string_split(text, chr(10)) AS ls FROM v_edits),
    b AS (SELECT *, array_to_string(list_slice(ls, 2, 4), chr(10)) AS body FROM r), n AS (SELECT *, instr(body, search) AS hit FROM b)
    SELECT file, CASE WHEN hit > 0 THEN array_to_string(list_concat(list_concat(list_slice(ls, 1, 1),
      string_split(substr(body, 1, hit - 1) || replacement || substr(body, hit + length(search)), chr(10))), list_slice(ls, 5, len(ls))), chr(10)) ELSE text END AS text,
      CASE WHEN hit > 0 THEN 'replaced' ELSE 'not_found' END AS status FROM n""",
    ["v_edits"],
)
def e05_all(spark, sf):
    v = plan(spark, sf)
    ranged = v.select("file", "search", "replacement", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return edits.replace_in_range(v.select("file", "text"), ranged)


_DIFF = """h AS (SELECT diff_id, 1 AS file_no, 'm' || o_custkey || '.py' AS target, 1 AS hunk_no, 1 AS added, 1 AS removed FROM d UNION ALL
  SELECT diff_id, 1, 'm' || o_custkey || '.py', 2, 2, 1 FROM d UNION ALL SELECT diff_id, 2, 'n' || o_orderkey % 50 || '.py', 1, 1, 0 FROM d)"""
_SRC = "d AS (SELECT o_orderkey AS diff_id, o_orderkey, o_custkey, o_orderstatus FROM orders)"


def diffs(spark, sf):
    return spread(view(spark, sf, "v_diff"))


@query(
    "e06_diff_counts",
    f"WITH {_SRC}, {_DIFF} SELECT diff_id, file_no, target, hunk_no, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM h",
)
def e06(spark, sf):
    return edits.diff_counts(diffs(spark, sf))


@query(
    "w11_hunk_numbers",
    f"""WITH {_SRC}, l AS (SELECT diff_id, unnest([1,2,3,4,5,6,7]) AS k, o_custkey, o_orderkey, o_orderstatus FROM d)
    SELECT diff_id, CASE WHEN k = 7 THEN 2 ELSE 1 END AS file_no, CASE WHEN k BETWEEN 4 AND 6 THEN 2 ELSE 1 END AS hunk_no,
    CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 1 END AS pos,
    CASE k WHEN 1 THEN ' ' WHEN 2 THEN '-' WHEN 4 THEN '-' ELSE '+' END AS op,
    CASE k WHEN 1 THEN 'keep' WHEN 2 THEN 'limit = ' || o_custkey WHEN 3 THEN 'limit = ' || o_orderkey WHEN 4 THEN 'old call' WHEN 5 THEN 'new call'
      WHEN 6 THEN 'extra ' || o_orderstatus ELSE 'fresh' END AS content FROM l""",
)
def w11(spark, sf):
    return edits.diff_lines(diffs(spark, sf)).select("diff_id", "file_no", "hunk_no", "pos", "op", "content")


@query(
    "u04_diff_files",
    f"WITH {_SRC} SELECT diff_id, 'm' || o_custkey || '.py' AS file FROM d UNION SELECT diff_id, 'n' || o_orderkey % 50 || '.py' FROM d",
)
def u04(spark, sf):
    return edits.diff_files(diffs(spark, sf))


@query(
    "w10_diff_pairs",
    f"""WITH {_SRC} SELECT diff_id, 'line' AS kind, 'limit = ' || o_custkey AS old, 'limit = ' || o_orderkey AS new FROM d WHERE o_custkey <> o_orderkey UNION ALL
    SELECT diff_id, 'value', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM d WHERE o_custkey <> o_orderkey UNION ALL
    SELECT diff_id, 'line', 'old call', 'new call' FROM d""",
)
def w10(spark, sf):
    return edits.diff_replacements(diffs(spark, sf)).select("diff_id", "kind", "old", "new")
