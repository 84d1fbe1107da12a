"""Log, check, mail, file, graph, diagnostic and source-code views derived from the given tables.

One text serves both engines. ``{name}`` is a table or an earlier view; ``<<x>>`` marks the few
places where the dialects differ.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "four": "explode(array(0, 1, 2, 3))",
    "three": "explode(array(0, 1, 2))",
    "micros": "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)))",
    "nl": "'\\n'",
    "q": "'\"'",
}
DUCK = {
    "four": "unnest([0, 1, 2, 3])",
    "three": "unnest([0, 1, 2])",
    "micros": "ts",
    "nl": "chr(10)",
    "q": "chr(34)",
}

VIEWS: dict[str, str] = {
    # log lines: an error becomes a four-line traceback, a purchase a one-line exception
    "v_lines": """
        SELECT user_id % 3 AS stream_id, event_id * 4 + k AS line_no, ts,
          CASE WHEN event_type = 'error' AND k = 0 THEN pfx || 'Traceback (most recent call last):'
               WHEN event_type = 'error' AND k = 1 THEN pfx || '  File "/srv/m.py", line ' || CAST(event_id % 90 + 1 AS STRING) || ', in f'
               WHEN event_type = 'error' AND k = 2 THEN '    call()'
               WHEN event_type = 'error' THEN pfx || CASE event_id % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError'
                 WHEN 2 THEN 'CustomError' WHEN 3 THEN 'Exception' ELSE 'MemoryError' END || ': event ' || CAST(event_id AS STRING)
               WHEN event_type = 'purchase' THEN 'KeyError: ' || CAST(user_id AS STRING)
               ELSE 'INFO ' || event_type || ' user ' || CAST(user_id AS STRING) END AS line
        FROM (SELECT *, 'app' || CAST(user_id % 5 AS STRING) || '<' || CAST(user_id % 7 * 500 + 1 AS STRING) || '>('
                     || CAST(user_id AS STRING) || ') ' AS pfx, <<four>> AS k FROM {events}) e
        WHERE event_type = 'error' OR k = 0""",
    # HTTP check attempts, four per check
    "v_checks": """
        SELECT CAST(floor(event_id / 4) AS BIGINT) AS check_id, event_id % 4 AS attempt, event_id, ts,
          'https://svc' || CAST(CAST(floor(event_id / 4) AS BIGINT) % 10 AS STRING) || '.example.org/?feed=b'
            || CAST(CAST(floor(event_id / 4) AS BIGINT) % 3 AS STRING) AS url,
          CAST(CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'click' THEN 404 WHEN 'view' THEN 200
               WHEN 'purchase' THEN 302 END AS INT) AS status,
          CASE event_type WHEN 'error' THEN 'HTTPStatusError' WHEN 'click' THEN 'HTTPStatusError'
               WHEN 'signup' THEN 'ConnectTimeout' END AS error_type,
          CASE event_type WHEN 'error' THEN 'server error' WHEN 'click' THEN 'not found'
               WHEN 'signup' THEN 'Timeout after ' || CAST(user_id AS STRING) || ' s' END AS error,
          props AS body
        FROM {events}""",
    "v_failures": """
        SELECT url, event_id, ts, error AS exception, error_type AS exception_type, status AS response_status, body
        FROM {v_checks} WHERE error_type IS NOT NULL""",
    "v_files": """
        SELECT source || '/' || lang || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/test_' WHEN doc_id % 11 = 0 THEN '.cache/'
                 WHEN doc_id % 13 = 0 THEN 'build/lib/' ELSE '' END || 'doc_' || CAST(doc_id AS STRING)
               || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' ELSE '' END AS path,
          doc_id, text
        FROM {documents}""",
    "v_mail": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn,
          CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL ELSE role || CAST(conv_id % 5 AS STRING) || '@example.org' END AS sender,
          'user' || CAST(turn % 5 AS STRING) || '@example.org' AS to_1,
          'assistant' || CAST((conv_id + 1) % 5 AS STRING) || '@example.org' AS to_2,
          'system' || CAST(turn % 3 AS STRING) || '@example.org' AS cc_1,
          1704067200 + conv_id * 600 + turn * 60 AS received, text AS body,
          'box' || CAST(conv_id % 3 AS STRING) AS mailbox
        FROM {conversations}""",
    "v_edges": """
        SELECT DISTINCT 'f' || CAST(o_orderkey AS STRING) AS caller,
          'f' || CAST(CASE k WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 11 ELSE o_orderkey + 1 END AS STRING) AS callee
        FROM (SELECT *, <<three>> AS k FROM {orders}) o""",
    "v_calls": """
        SELECT 'f' || CAST(l_orderkey % 300 AS STRING) AS caller, 'f' || CAST(l_partkey % 330 AS STRING) AS callee,
          'm' || CAST(l_suppkey % 40 AS STRING) || '.py' AS file, l_orderkey * 10 + l_linenumber AS line
        FROM {lineitem}""",
    "v_diag": """
        SELECT 'm' || CAST(l_partkey AS STRING) || '.py' AS file, l_orderkey * 10 + l_linenumber AS line,
          CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity,
          CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS code
        FROM {lineitem}""",
    "v_funcs": """
        SELECT 'm' || CAST(p_partkey AS STRING) || '.py' AS file, 'f' || CAST(k AS STRING) AS name,
          CASE WHEN p_partkey % 3 = 0 THEN 'C' || CAST(p_partkey % 5 AS STRING) END AS class_name,
          1 + k * 20 AS line_start, 18 + k * 20 AS line_end, (p_size + k * 7) % 15 + 1 AS complexity,
          CASE WHEN p_partkey % 4 = 0 THEN '_' ELSE '' END || p_brand AS owner
        FROM (SELECT *, <<three>> AS k FROM {part}) p""",
    "v_usage": """
        SELECT conv_id, turn AS iteration, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS input_tokens,
          CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS output_tokens, role, text
        FROM {conversations}""",
    # one Python module per part; every 50th one lacks a closing bracket
    "v_source": """
        SELECT 'src/' || CAST(p_partkey % 7 AS STRING) || '/m' || CAST(p_partkey AS STRING) || '.py' AS path, p_partkey, p_size,
          'import os' || <<nl>> || 'import mod' || CAST(p_partkey % 20 AS STRING) || ' as md' || <<nl>>
          || 'from pkg' || CAST(p_partkey % 6 AS STRING) || ' import alpha, beta' || <<nl>> || <<nl>>
          || 'LIMIT = ' || CAST(p_size AS STRING) || <<nl>> || <<nl>>
          || 'def load_' || CAST(p_partkey % 100 AS STRING) || '(a, b: int = ' || CAST(p_size AS STRING)
          || CASE WHEN p_partkey % 50 = 49 THEN ' -> str:' ELSE ') -> str:' END || <<nl>>
          || '    if a and b:' || <<nl>>
          || '        return helper_' || CAST(p_size AS STRING) || '(a)' || <<nl>>
          || '    return os.path.join(a, md.name)' || <<nl>> || <<nl>>
          || 'class Box' || CAST(p_partkey % 10 AS STRING) || '(Base):' || <<nl>>
          || '    def _get(self, *args):' || <<nl>>
          || '        for x in args:' || <<nl>>
          || '            self.put(x)' || <<nl>>
          || '        return load_' || CAST(p_partkey % 100 AS STRING) || '(1)' || <<nl>> || <<nl>>
          || '    async def put(self, x=None):' || <<nl>>
          || '        # keep' || <<nl>>
          || '        return x' || <<nl>> AS text
        FROM {part}""",
    # one page with a table per customer: a parent row and two sub rows
    "v_html": """
        SELECT 'TA' || CAST(c_custkey AS STRING) AS parent_id, c_custkey, c_name,
          '<html><body><table class="t"><thead><tr><td>ID</td><td>Name</td><td>Description</td></tr></thead><tbody>'
          || '<tr class="technique"><td>T' || CAST(c_custkey AS STRING) || '</td><td>' || c_name || '</td><td>balance &amp; '
          || c_mktsegment || '</td></tr>'
          || '<tr class="sub technique"><td></td><td>.001</td><td> first </td><td>one</td></tr>'
          || '<tr class="sub technique"><td></td><td>.002</td><td>second</td><td>n' || CAST(c_nationkey AS STRING)
          || '</td></tr></tbody></table></body></html>' AS html
        FROM {customer}""",
    "v_edits": """
        SELECT doc_id, source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || '.txt' AS file, text,
          CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'tion' ELSE 'zzzz' END AS search, 'THE' AS replacement
        FROM {documents}""",
    "v_diff": """
        SELECT o_orderkey AS diff_id,
          'diff --git a/m' || CAST(o_custkey AS STRING) || '.py b/m' || CAST(o_custkey AS STRING) || '.py' || <<nl>>
          || '--- a/m' || CAST(o_custkey AS STRING) || '.py' || <<nl>>
          || '+++ b/m' || CAST(o_custkey AS STRING) || '.py' || <<nl>>
          || '@@ -1,3 +1,3 @@' || <<nl>> || ' keep' || <<nl>>
          || '-limit = ' || CAST(o_custkey AS STRING) || <<nl>> || '+limit = ' || CAST(o_orderkey AS STRING) || <<nl>>
          || '@@ -9,2 +9,3 @@' || <<nl>> || '-old call' || <<nl>> || '+new call' || <<nl>> || '+extra ' || o_orderstatus || <<nl>>
          || '--- /dev/null' || <<nl>> || '+++ b/n' || CAST(o_orderkey % 50 AS STRING) || '.py' || <<nl>>
          || '@@ -0,0 +1,1 @@' || <<nl>> || '+fresh' || <<nl>> AS text
        FROM {orders}""",
    "v_issues": """
        SELECT 'm' || CAST(l_partkey AS STRING) || '.py' AS file, l_orderkey * 10 + l_linenumber AS issue_id,
          CASE l_orderkey % 5 WHEN 0 THEN 'm.py:' || CAST(l_suppkey AS STRING) || ':1: E501 long'
            WHEN 1 THEN 'line ' || CAST(l_suppkey AS STRING) || ' W291 space' WHEN 2 THEN 'bad (' || CAST(l_suppkey AS STRING) || ') C0114'
            WHEN 3 THEN 'at @' || CAST(l_suppkey AS STRING) || ' F401' ELSE 'no place' END AS message
        FROM {lineitem}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _expand(name: str) -> list[str]:
    """The view and the views it reads, in dependency order."""
    found: list[str] = []
    for used in _NAME.findall(VIEWS[name]):
        if used in VIEWS:
            found += [v for v in _expand(used) if v not in found]
    return [*found, name]


def _dialect(text: str, words: dict[str, str]) -> str:
    for mark, value in words.items():
        text = text.replace(f"<<{mark}>>", value)
    return text


def with_views(sql: str, views: Sequence[str]) -> str:
    """Prefix DuckDB SQL with the views it reads."""
    order: list[str] = []
    for view_name in views:
        order += [v for v in _expand(view_name) if v not in order]
    parts = [f"{v} AS ({_NAME.sub(lambda m: m.group(1), _dialect(VIEWS[v], DUCK))})" for v in order]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[len("WITH RECURSIVE ") :]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[len("WITH ") :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables in ``sf_dir``."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = _dialect(VIEWS[name], SPARK)
    inputs = {used: view(spark, sf_dir, used) for used in set(_NAME.findall(text))}
    return spark.sql(text, **inputs)
