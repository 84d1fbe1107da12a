"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Card numbers that pass the Luhn test, phone numbers, IPv4 addresses and calendar dates are permuted under a key within the
set of all values of their format, so the same value becomes the same pseudonym in every document, and different values
stay different. Separators, country codes and check digits stay right. Mail addresses and secrets are no numbers; they
become keyed digests in their own format. Only texts that hold what some pattern cannot do without (``GATE``) meet the
costly patterns, and only what these find is rewritten. A card may stand among other numbers: of the groups of digits that
begin at each place, the longest run that passes the Luhn test is a card, and a longer run that fails does not hide it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import query, table, unused

ROUNDS = 10
#: Key of the registered queries, whose results are to be repeatable; it hides nothing from who knows it.
PUBLIC = "public key of the queries"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"""(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}["']{0,1})[^\s"'|]{6,}"""
DATE = r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d-]|\.\d)"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
#: A run of digits ends before another value.
NEXT = f"(?!{EMAIL}|{DATE}|{ADDRESS})"
DIGITS = r"\d(?:[ -]?\d){12,18}"
RUN = rf"\d(?:\d|[ -]{NEXT}\d){{12,18}}(?!\d)"
#: The longest run at each group of digits, overlaps included.
RUNS = rf"(?<![\d.])(?=\d){NEXT}(?=({RUN}))"
CARD = rf"(?<![\d.]){RUN}"
OTHERS = "|".join((EMAIL, SECRET, DATE, ADDRESS, PHONE))
FOUND = f"{OTHERS}|{CARD}"
#: Mail addresses need ``@``, secrets ``=``, ``:`` or AKIA, all others a digit.
GATE = "[0-9@=:]|AKIA"
#: Days from 1900-01-01 to 2099-12-31 are 17 times 4297 (fixed values).
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def feistel(x: Column, y: Column, a: Column, b: Column, tag: str, secret: str) -> tuple[Column, Column]:
    """A keyed permutation of the pairs with 0 <= x < a and 0 <= y < b: each round adds a keyed digest of one half to the other."""

    def digest(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit(tag), i, a, b, half), 256), 1, 15), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["x"] + digest(i, s["y"]), a)).otherwise(s["x"]).alias("x"),
            F.when(odd, s["y"]).otherwise(F.pmod(s["y"] + digest(i, s["x"]), b)).alias("y"),
        )

    out = F.aggregate(F.array(*(F.lit(i) for i in range(1, ROUNDS + 1))), F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), turn)
    return out["x"], out["y"]


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted(digits: Column, tag: str, secret: str) -> Column:
    """Another string of as many digits (2 to 20)."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    head, tail = digits.substr(F.lit(1), left), digits.substr(left + 1, n - left)
    x, y = feistel(head.cast("bigint"), tail.cast("bigint"), F.pow(F.lit(10), left).cast("bigint"), F.pow(F.lit(10), n - left).cast("bigint"), tag, secret)
    return F.concat(F.lpad(x.cast("string"), left, "0"), F.lpad(y.cast("string"), n - left, "0"))


def _refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order, by others."""
    chars = F.transform(_chars(text), lambda c, i: F.when(c.rlike("[0-9]"), digits.substr(F.length(_digits(text.substr(F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    return F.array_join(chars, "")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind these digits."""
    doubled = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(doubled, F.lit(0), lambda s, v: s + v), F.lit(10)), F.lit(10)).cast("string")


def _valid(text: Column) -> Column:
    digits = _digits(text)
    return _luhn(digits.substr(F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)


def _cards(text: Column) -> Column:
    """The distinct cards of a text, longest first: of each run of digits the longest part from its start that ends at a separator and passes the Luhn test."""
    parts = lambda run: F.array(*(F.regexp_extract(run, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(19, 12, -1)))
    best = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(RUNS), 1)), lambda run: F.get(F.filter(parts(run), lambda p: (p != "") & _valid(p)), F.lit(0)))
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(best, lambda c: c.isNotNull())), lambda c: F.struct((-F.length(c)).alias("n"), c.alias("c"))))
    return F.transform(ranked, lambda r: r["c"])


def _found(cards: Column) -> Column:
    """The pattern of all values in a text with these cards; runs that fail the test end before a card."""
    known = F.concat(F.lit(r"(?<![\d.])(?:"), F.array_join(cards, "|"), F.lit(r")(?!\d)"))
    run = F.concat(F.lit(rf"(?<![\d.])\d(?:\d|[ -]{NEXT}(?!"), known, F.lit(r")\d){12,18}(?!\d)"))
    return F.when(F.size(cards) > 0, F.concat(F.lit(f"{OTHERS}|"), known, F.lit("|"), run)).otherwise(F.lit(FOUND))


def _card(text: Column, secret: str) -> Column:
    digits = _digits(text)
    payload = digits.substr(F.lit(1), F.length(digits) - 1)
    other = _permuted(payload, "card", secret)
    return F.when(_luhn(payload) == F.substring(digits, -1, 1), _refilled(text, F.concat(other, _luhn(other)))).otherwise(text)


def _phone(text: Column, secret: str) -> Column:
    digits = _digits(text)
    country = F.length(digits) - 10
    return _refilled(text, F.concat(digits.substr(F.lit(1), country), _permuted(digits.substr(country + 1, F.lit(10)), "phone", secret)))


def _address(text: Column, secret: str) -> Column:
    part = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))
    x, y = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), "ip", secret)
    other = F.concat_ws(".", F.shiftright(x, 8), x % 256, F.shiftright(y, 8), y % 256)
    return F.when(F.array_max(part) <= 255, other).otherwise(text)


def _date(text: Column, secret: str) -> Column:
    out = text
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy")):
        day = F.datediff(F.to_date(F.try_to_timestamp(text, F.lit(form))), F.lit(FIRST_DAY).cast("date"))
        a, b = DAYS
        x, y = feistel(F.floor(day / b), F.pmod(day, F.lit(b)), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), "date", secret)
        other = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x * b + y).cast("int")), form)
        out = F.when(text.rlike(shape), F.when((day >= 0) & (day < a * b), other).otherwise(text)).otherwise(out)
    return out


def _secret(text: Column, secret: str) -> Column:
    """A digest of the same length; the mark of an access key stays."""
    digest = F.sha2(F.concat(F.lit(f"{secret}|secret|"), text), 512)
    key = text.rlike("^AKIA[A-Z0-9]{16}$")
    long = F.repeat(digest, F.ceil(F.length(text) / 128).cast("int"))
    return F.when(key, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16)))).otherwise(long.substr(F.lit(1), F.length(text)))


def pseudonym(text: Column, secret: str) -> Column:
    """The pseudonym of one found value; values that fail their validation stay."""
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{secret}|mail|"), F.lower(text)), 256), 1, 16), F.lit("@example.org"))
    return (
        F.when(text.rlike(f"^(?:{EMAIL})$"), mail).when(text.rlike(f"^(?:{DATE})$"), _date(text, secret)).when(text.rlike(f"^(?:{ADDRESS})$"), _address(text, secret))
        .when(text.rlike(f"^(?:{PHONE})$"), _phone(text, secret)).when(text.rlike(f"^{DIGITS}$"), _card(text, secret)).otherwise(_secret(text, secret))
    )


def pseudonymise(docs: DataFrame, secret: str | None = None, text: str = "text", name: str = "n_private") -> DataFrame:
    """Rewrites the text column and adds the number of values found (with those that failed validation and stay).

    secret: the key; equal values stay linked across calls that share it. Without one, a random key that is kept nowhere links
    them within this call only. A null text stays null with count 0, an empty one empty; very long texts are rewritten whole,
    rows that repeat are rewritten alike, an empty table gives none. All other columns stay, whatever their names; a column
    named like the count is replaced. Dates count as dates from 1900 to 2099; others, impossible dates, cards that fail the
    Luhn test and addresses above 255 stay.
    """
    secret = secret or uuid.uuid4().hex
    column = F.col(text).cast("string")
    pattern, values = unused(docs, "_found", "_values")
    # nothing below is evaluated for the many texts that no pattern can match
    rare = column.rlike(GATE)
    found = docs.withColumn(pattern, F.when(rare, _found(_cards(column))))
    found = found.withColumn(values, F.when(F.col(pattern).isNotNull(), F.regexp_extract_all(column, F.col(pattern), 0)))
    between = F.split(column, F.col(pattern), -1)
    pieces = F.zip_with(between, F.transform(values, lambda v: pseudonym(v, secret)), lambda p, v: F.concat(F.coalesce(p, F.lit("")), F.coalesce(v, F.lit(""))))
    return found.withColumn(text, F.when(F.size(values) > 0, F.array_join(pieces, "")).otherwise(column)).withColumn(name, F.coalesce(F.greatest(F.size(values), F.lit(0)), F.lit(0))).drop(values, pattern)


@query("op9_pseudonyms")
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret=PUBLIC)
