"""Mail, coercion, HTML and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceframe.functions import coerce, html
from traceframe.operators import conversation, mail
from traceframe.plans.registry import query
from traceframe.plans.views import table, view
from traceframe.session import spread
from traceframe.sources import records


def mails(spark, sf):
    """The mail view in its nested shape."""
    flat = view(spark, sf, "v_mail")
    who = lambda c: F.struct(F.struct(F.split(c, "@")[0].alias("name"), F.col(c).alias("address")).alias("emailAddress"))
    return flat.select(
        "id",
        F.col("conversation_id").alias("conversationId"),
        F.when(F.col("sender").isNotNull(), who("sender")).alias("from"),
        F.array(who("to_1"), who("to_2")).alias("toRecipients"),
        F.array(who("cc_1")).alias("ccRecipients"),
        F.array().cast("array<struct<emailAddress:struct<name:string,address:string>>>").alias("bccRecipients"),
        F.timestamp_seconds("received").alias("receivedDateTime"),
        F.substring("body", 1, 60).alias("subject"),
        F.col("body").alias("bodyText"),
        "mailbox",
    )


@query("s06_catalog", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def s06(spark, sf):
    catalog = records.Catalog(spark, {n: table(spark, sf, n) for n in ("customer", "nation")})
    joined = catalog.table("customer").join(catalog.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("s07_nested_scan", "SELECT mailbox, COUNT(*) AS n, COUNT(sender) AS with_sender FROM v_mail GROUP BY 1", ["v_mail"])
def s07(spark, sf):
    merged = records.union_all([mails(spark, sf).where(F.col("mailbox") == f"box{i}") for i in range(3)])
    return merged.groupBy("mailbox").agg(F.count(F.lit(1)).alias("n"), F.count(mail.SENDER).alias("with_sender"))


@query("f16_column_mapping", "SELECT id, sender AS from_address, mailbox AS box FROM v_mail", ["v_mail"])
def f16(spark, sf):
    return records.project(mails(spark, sf), {"id": "id", "from_address": mail.SENDER, "box": "mailbox"})


@query(
    "f17_predicates",
    """SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice >= 250000) OR (o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_custkey < 300
    AND (o_totalprice < 1000 IS FALSE) AND o_orderdate IS NOT NULL)""",
)
def f17(spark, sf):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rich = status.isin("F", "O") & (price >= 250000)
    calm = ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_custkey") < 300)
    # ``price < 1000 IS FALSE``, in the form the scan can test
    known = (price >= 1000) & F.col("o_orderdate").isNotNull()
    return table(spark, sf, "orders").where(rich | (calm & known)).select("o_orderkey")


@query(
    "f18_like",
    """SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE 'blue%' OR p_name LIKE '%bolt' OR p_type LIKE 'ECONOMY' OR p_name LIKE 's%g_t'""",
)
def f18(spark, sf):
    name = F.col("p_name")
    tests = [mail.like(name, p) for p in ("%ring%", "blue%", "%bolt", "s%g_t")]
    hit = tests[0] | tests[1] | tests[2] | tests[3] | mail.like(F.col("p_type"), "ECONOMY")
    return table(spark, sf, "part").where(hit).select("p_partkey")


@query("f19_nested_field", "SELECT id, split_part(sender, '@', 1) AS name, sender AS address FROM v_mail WHERE sender LIKE 'user%'", ["v_mail"])
def f19(spark, sf):
    who = F.col("from").getField("emailAddress")
    rows = mails(spark, sf).where(who.getField("address").startswith("user"))
    return rows.select("id", who.getField("name").alias("name"), who.getField("address").alias("address"))


@query("f20_array_predicate", "SELECT id FROM v_mail WHERE to_1 LIKE 'user3%' OR to_2 LIKE 'user3%'", ["v_mail"])
def f20(spark, sf):
    return mails(spark, sf).where(mail.any_element("toRecipients", "user3%")).select("id")


@query(
    "f21_term_search",
    """SELECT id FROM v_mail WHERE (lower(sender) LIKE '%assistant%' OR lower(to_1) LIKE '%assistant%' OR lower(to_2) LIKE '%assistant2%' OR lower(cc_1) LIKE '%assistant%'
    OR lower(to_2) LIKE '%assistant%') AND lower(body) LIKE '%the%'""",
    ["v_mail"],
)
def f21(spark, sf):
    wanted = mail.search({"recipients": "Assistant", "bodyText": "%the%"})
    return mails(spark, sf).where(wanted).select("id")


@query("f22_projection", "SELECT id, substr(body, 1, 60) AS subject, mailbox FROM v_mail", ["v_mail"])
def f22(spark, sf):
    return mails(spark, sf).select("id", "subject", "mailbox")


@query("f23_has_sender", "SELECT id FROM v_mail WHERE sender IS NOT NULL", ["v_mail"])
def f23(spark, sf):
    return mails(spark, sf).where(mail.has_sender()).select("id")


@query(
    "f24_day_range",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 00:00:00'",
)
def f24(spark, sf):
    events = table(spark, sf, "events")
    return events.where(mail.between_days(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-08")).select("event_id")


@query(
    "w09_newest_per_conversation",
    """SELECT id, conversation_id, received FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY received DESC, id DESC) AS rn FROM v_mail
    WHERE sender IS NOT NULL) WHERE rn = 1""",
    ["v_mail"],
)
def w09(spark, sf):
    newest = mail.newest_per_conversation(mails(spark, sf).where(mail.has_sender()))
    return newest.select("id", F.col("conversationId").alias("conversation_id"), F.unix_seconds("receivedDateTime").alias("received"))


@query(
    "u02_from_or_to",
    "SELECT id, sender FROM v_mail WHERE sender = 'user1@example.org' OR to_1 = 'user1@example.org' OR to_2 = 'user1@example.org'",
    ["v_mail"],
)
def u02(spark, sf):
    found = mail.involving(mails(spark, sf), "user1@example.org")
    return found.select("id", F.col(mail.SENDER).alias("sender"))


@query(
    "u02_union_dedup",
    "SELECT id, CASE WHEN sender = 'user1@example.org' THEN 'from' ELSE 'to' END AS found_by FROM v_mail WHERE sender = 'user1@example.org' OR to_1 = 'user1@example.org'",
    ["v_mail"],
)
def u02_union(spark, sf):
    all_mail = view(spark, sf, "v_mail")
    parts = [
        all_mail.where(F.col("sender") == "user1@example.org").select("id", F.lit("from").alias("found_by")),
        all_mail.where(F.col("to_1") == "user1@example.org").select("id", F.lit("to").alias("found_by")),
    ]
    return mail.union_dedup(parts, "id")


@query("u03_merged_scans", "SELECT role, COUNT(*) AS n FROM conversations GROUP BY 1")
def u03(spark, sf):
    turns = table(spark, sf, "conversations")
    merged = records.union_all([turns.where(F.col("role") == r) for r in ("user", "assistant", "system")])
    return merged.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("t01_scan_limit", "SELECT COUNT(*) AS n FROM (SELECT * FROM lineitem LIMIT 1000)")
def t01(spark, sf):
    return table(spark, sf, "lineitem").limit(1000).agg(F.count(F.lit(1)).alias("n"))


@query("t02_newest_first", "SELECT id, received FROM v_mail ORDER BY received DESC, id LIMIT 25", ["v_mail"])
def t02(spark, sf):
    return mail.newest_first(mails(spark, sf), 25).select("id", F.unix_seconds("receivedDateTime").alias("received"))


_RAW_DUCK = """raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0001-01-01T00:00:00Z' WHEN 1 THEN ' ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z '
  WHEN 2 THEN '9999-12-31T23:59:59Z' WHEN 3 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS seen, ts FROM events)"""


def raw_events(spark, sf):
    ts = F.col("ts").cast("timestamp")
    iso = F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "))
    kind = F.col("event_id") % 5
    seen = (
        F.when(kind == 0, coerce.NO_DATE[0])
        .when(kind == 1, iso)
        .when(kind == 2, coerce.NO_DATE[1])
        .when(kind == 3, "soon")
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    return table(spark, sf, "events").withColumn("seen", seen)


@query(
    "x01_parse_date",
    f"""WITH {_RAW_DUCK} SELECT event_id, CASE event_id % 5 WHEN 1 THEN epoch_us(ts) WHEN 4 THEN epoch_us(date_trunc('day', ts)) END AS seen_us FROM raw""",
)
def x01(spark, sf):
    return raw_events(spark, sf).select("event_id", F.unix_micros(coerce.parse_date(F.col("seen"))).alias("seen_us"))


@query(
    "x02_coercion",
    """SELECT event_id, epoch_us(ts) AS at_us, user_id, round(value, 6) AS value, event_id % 2 = 0 AS flag, event_type AS kind, event_id % 7 AS mixed_len FROM events""",
)
def x02(spark, sf):
    e = table(spark, sf, "events")
    text = e.select(
        "event_id",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit(" "), F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("no").alias("flag"),
        F.concat(F.col("event_type"), F.lit(" ")).alias("kind"),
        F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int")).alias("mixed"),
    )
    out = coerce.coerce(text)
    return out.select(
        "event_id", F.unix_micros("at").alias("at_us"), "user_id", F.round("value", 6).alias("value"), "flag", "kind",
        F.length("mixed").cast("long").alias("mixed_len"),
    )


@query(
    "x03_nested_coercion",
    "SELECT event_id, user_id AS nested_id, event_id % 10 AS n_items, CAST(event_id % 10 * (event_id % 10 - 1) / 2 AS BIGINT) AS item_sum, '12' AS raw FROM events",
)
def x03(spark, sf):
    e = table(spark, sf, "events")
    items = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 10).cast("int")), lambda i: F.struct((i - 1).cast("string").alias("n")))
    nested = e.select(
        "event_id",
        F.struct(F.col("user_id").cast("string").alias("id"), F.lit("12").alias("@odata.type")).alias("owner"),
        F.when(F.col("event_id") % 10 > 0, items).otherwise(F.array().cast("array<struct<n:string>>")).alias("items"),
    )
    out = coerce.coerce(nested)
    return out.select(
        "event_id",
        F.col("owner.id").alias("nested_id"),
        F.size("items").cast("long").alias("n_items"),
        F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("item_sum"),
        F.col("owner").getField("@odata.type").alias("raw"),
    )


@query(
    "x04_path_conversion",
    "SELECT event_id, user_id, epoch_us(ts) AS at_us, event_id % 3 = 0 AS flag FROM events",
)
def x04(spark, sf):
    e = table(spark, sf, "events")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    flag = F.when(F.col("event_id") % 3 == 0, "TRUE").otherwise("off")
    nested = e.select("event_id", F.struct(F.col("user_id").cast("string").alias("id"), at.alias("at")).alias("meta"), flag.alias("flag"))
    out = coerce.convert_paths(nested, {"meta.id": "int", "meta.at": "datetime", "flag": "bool", "meta.none.x": "int"})
    return out.select("event_id", F.col("meta.id").alias("user_id"), F.unix_micros("meta.at").alias("at_us"), "flag")


_BLOCK_RX = "(?i)</?(" + "|".join(html.BLOCKS) + ")([ \\t\\n/][^>]*)?>"


@query(
    "x05_html_text",
    f"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<!DOCTYPE[^>]*>', '', 'g'), '{_BLOCK_RX}', chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM s),
    e AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;?', '&', 'g') AS h FROM b),
    l AS (SELECT page_id, list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{{00a0}}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM e)
    SELECT page_id, array_to_string(ls, chr(10)) AS txt FROM l""",
)
def x05(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", html.html_to_text("html").alias("txt"))


@query(
    "s12_html_tables",
    """SELECT parent_id, 1 AS row_no, 'technique' AS row_class, 'T' || c_custkey || '|' || c_name || '|balance & ' || regexp_extract(html, 'balance &amp; ([A-Z]*)', 1) AS cells FROM v_html UNION ALL
    SELECT parent_id, 2, 'sub technique', '|.001|first|one' FROM v_html UNION ALL SELECT parent_id, 3, 'sub technique', '|.002|second|' || regexp_extract(html, '(n[0-9]+)</td></tr></tbody>', 1) FROM v_html""",
    ["v_html"],
)
def s12(spark, sf):
    rows = html.table_rows(spread(view(spark, sf, "v_html")), "parent_id")
    return rows.select("parent_id", "row_no", "row_class", F.array_join("cells", "|").alias("cells"))


_PREFIX = "https://kb.example.org/techniques/"
_TECH = f"""t AS (SELECT parent_id, 'T' || c_custkey AS id, c_name AS name FROM v_html UNION ALL SELECT parent_id, 'T' || c_custkey || '.001', 'first' FROM v_html
    UNION ALL SELECT parent_id, 'T' || c_custkey || '.002', 'second' FROM v_html)
    SELECT parent_id, id, name, '{_PREFIX}' || replace(id, '.', '/') AS hyperlink FROM t"""


@query("w08_forward_fill", f"WITH {_TECH}", ["v_html"])
def w08(spark, sf):
    rows = html.table_rows(spread(view(spark, sf, "v_html")), "parent_id")
    return html.technique_rows(rows, "parent_id", _PREFIX).select("parent_id", "id", "name", "hyperlink")


@query(
    "j10_parent_expansion",
    f"WITH {_TECH} WHERE parent_id IN (SELECT 'TA' || c_custkey FROM customer WHERE c_acctbal > 0)",
    ["v_html"],
)
def j10(spark, sf):
    customers = table(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    parents = customers.select(F.concat(F.lit("TA"), F.col("c_custkey").cast("string")).alias("parent_id"))
    expanded = html.expand_parents(parents, spread(view(spark, sf, "v_html")), "parent_id", _PREFIX)
    return expanded.select("parent_id", "id", "name", "hyperlink")


@query(
    "u01_union_parents",
    f"WITH {_TECH}",
    ["v_html"],
)
def u01(spark, sf):
    pages = spread(view(spark, sf, "v_html"))
    halves = [pages.where(F.col("c_custkey") % 2 == i) for i in range(2)]
    frames = [html.technique_rows(html.table_rows(h, "parent_id"), "parent_id", _PREFIX) for h in halves]
    return records.union_all(frames).select("parent_id", "id", "name", "hyperlink")


def _has(words, text="lower(text)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_LABEL = "CASE WHEN text IS NULL OR text = '' THEN '' " + " ".join(
    f"WHEN {_has(words)} THEN '{name}'" for words, name in conversation.TOOL_WORDS
) + f" ELSE '{conversation.DEFAULT_TOOL}' END"


@query(
    "f32_tool_intent",
    f"SELECT conv_id, turn, coalesce({_has(conversation.INTENT_PHRASES)}, false) AS intent, {_LABEL} AS tool FROM conversations",
)
def f32(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", conversation.suggests_tool(text).alias("intent"), conversation.tool_label(text).alias("tool")
    )


@query(
    "a18_token_totals",
    """SELECT conv_id, COUNT(*) AS iterations, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
    CAST(SUM(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM v_usage GROUP BY 1""",
    ["v_usage"],
)
def a18(spark, sf):
    return conversation.token_totals(view(spark, sf, "v_usage"))


@query(
    "w06_running_tokens",
    """SELECT conv_id, iteration, CAST(SUM(input_tokens) OVER w AS BIGINT) AS input_so_far, CAST(SUM(output_tokens) OVER w AS BIGINT) AS output_so_far FROM v_usage
    WINDOW w AS (PARTITION BY conv_id ORDER BY iteration ROWS UNBOUNDED PRECEDING)""",
    ["v_usage"],
)
def w06_tokens(spark, sf):
    return conversation.running_tokens(view(spark, sf, "v_usage")).select("conv_id", "iteration", "input_so_far", "output_so_far")
