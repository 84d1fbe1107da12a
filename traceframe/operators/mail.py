"""Mail-like nested tables: predicates over structs and recipient arrays, threads, address search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The element path compared in each array column, and the search field of each column.
ELEMENT_PATHS = {
    "toRecipients": "emailAddress.address",
    "ccRecipients": "emailAddress.address",
    "bccRecipients": "emailAddress.address",
    "attachments": "name",
}
SEARCH_FIELDS = {
    "from": "from",
    "sender": "from",
    "toRecipients": "participants",
    "ccRecipients": "participants",
    "bccRecipients": "participants",
    "recipients": "participants",
    "subject": "subject",
    "body": "body",
    "bodyText": "body",
}
SENDER = "from.emailAddress.address"
RECIPIENTS = ("toRecipients", "ccRecipients", "bccRecipients")


def _inside(value: Column, path: str) -> Column:
    return reduce(lambda c, part: c.getField(part), path.split("."), value)


def like(value: Column, pattern: str) -> Column:
    """``%x%`` contains, ``x%`` starts, ``%x`` ends, no ``%`` equals; inner wildcards fall back to LIKE."""
    body = pattern.strip("%")
    if "%" in body or "_" in body:
        return value.like(pattern)
    if pattern.startswith("%") and pattern.endswith("%"):
        return value.contains(body)
    if pattern.endswith("%"):
        return value.startswith(body)
    return value.endswith(body) if pattern.startswith("%") else value == body


def any_element(array: str, pattern: str, path: str | None = None) -> Column:
    """Any element's configured field is LIKE the pattern."""
    return F.exists(array, lambda x: like(_inside(x, path or ELEMENT_PATHS.get(array, "id")), pattern))


def addresses(array: str) -> Column:
    found = F.transform(array, lambda x: _inside(x, ELEMENT_PATHS[array]))
    return F.coalesce(found, F.array().cast("array<string>"))


def participants() -> Column:
    """Sender and all recipients as one array."""
    return F.concat(F.array(F.col(SENDER)), *[addresses(a) for a in RECIPIENTS])


def _holds(word: str):
    return lambda value: F.lower(value).contains(word)


def search(terms: Mapping[str, str]) -> Column:
    """Every field-scoped term must occur, ignoring case; a term may be long and hold any character."""
    tests = [F.lit(True)]
    for field, term in terms.items():
        word = term.strip("%\"'").lower()
        scope = SEARCH_FIELDS.get(field, field)
        if scope == "participants":
            tests.append(F.exists(participants(), _holds(word)))
        else:
            column = {"from": F.col(SENDER), "body": F.col("bodyText")}.get(scope)
            tests.append(F.lower(column if column is not None else F.col(scope)).contains(word))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def has_sender() -> Column:
    return F.col(SENDER).isNotNull()


def between_days(ts: Column, first: str, last: str) -> Column:
    """From the start of ``first`` to the end of ``last``, both included."""
    return (ts >= F.to_timestamp(F.lit(first))) & (ts < F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1).cast("string")))


def newest_per_conversation(mail: DataFrame, ts: str = "receivedDateTime", tie: str = "id") -> DataFrame:
    """Latest message of each conversation; a mergeable aggregate, so a long thread is no hot task."""
    newest = mail.groupBy("conversationId").agg(F.max_by(F.struct(*mail.columns), F.struct(F.col(ts), F.col(tie))).alias("__m"))
    return newest.select("__m.*")


def involving(mail: DataFrame, address: str) -> DataFrame:
    """Messages from or to an address, each once. One pass with an OR; no union and no dedup shuffle."""
    to_it = F.exists("toRecipients", lambda x: F.lower(x["emailAddress"]["address"]) == address.lower())
    return mail.where(F.coalesce(F.lower(F.col(SENDER)) == address.lower(), F.lit(False)) | F.coalesce(to_it, F.lit(False)))


def union_dedup(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of result sets keeping the first set's row per key."""
    tagged = [p.withColumn("__rank", F.lit(i)) for i, p in enumerate(parts)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    columns = parts[0].columns
    kept = merged.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*columns), F.col("__rank")).alias("__r"))
    return kept.select("__r.*")


def newest_first(mail: DataFrame, limit: int, ts: str = "receivedDateTime", tie: str = "id") -> DataFrame:
    return mail.orderBy(F.desc(ts), tie).limit(limit)


def with_body_text(mail: DataFrame) -> DataFrame:
    """``bodyText``: HTML bodies as text, others as they are. Only HTML rows enter Python."""
    from traceframe.functions.html import html_to_text

    content = F.col("body.content")
    is_html = F.lower(F.col("body.contentType")) == "html"
    return mail.withColumn("bodyText", F.when(is_html, html_to_text(F.when(is_html, content))).otherwise(content))
