"""Text expressions: markup, line numbers in messages, highlights, name rules, URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\u000b\u000c"
# a markdown table: header line, separator line, rows to the end of their lines; the possessive repeat
# keeps Java from recursing on long tables, and the line break after the table is not part of it
TABLE = r"(?dm)^\|[^\n]*\|[ \t]*\n\|[- \t|]+\|[ \t]*\n\|[^\n]*\|[ \t]*$(?:\n\|[^\n]*\|[ \t]*$)*+"
CALL_NAME = r"(\w+)\s*\("
# Words before a bracket that are not calls worth listing.
NOT_CALLS = ("if", "for", "while", "print", "len", "str", "int", "float", "bool", "dict", "list", "tuple", "set")
# Diagnostic severity codes.
SEVERITY_CODES = {1: "error", 2: "warning", 3: "info", 4: "hint"}
# Forms in which tools write a line number, most telling first.
LINE_NUMBER_FORMS = (r":(\d+):", r"line (\d+)", r"\((\d+)\)", r"@(\d+)")


def strip(text: Column, extra: str = "") -> Column:
    return F.trim(text, F.lit(WHITESPACE + extra))


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(WHITESPACE)))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def same_line(a: Column, b: Column) -> Column:
    """Equal but for whitespace, dots and commas at either end."""
    return strip(a, ".,") == strip(b, ".,")


def highlight(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Put every hit in square brackets."""
    return F.regexp_replace(text, F.lit(("(?i)" if ignore_case else "") + pattern), F.lit("[$0]"))


def line_number(message: Column) -> Column:
    """Line number named in a tool message, by the first form that occurs."""
    found = [F.nullif(F.regexp_extract(message, form, 1), F.lit("")) for form in LINE_NUMBER_FORMS]
    return F.coalesce(*found).try_cast("int")


def lint_class(code: Column) -> tuple[Column, Column]:
    """``(is_warning, is_error)`` from the code token: W or C warn, E or F are errors."""
    token = F.regexp_extract(code, r"\b([A-Z])\d{3,4}\b", 1)
    return token.isin("W", "C"), token.isin("E", "F")


def visibility(name: Column) -> Column:
    return (
        F.when(name.startswith("__") & name.endswith("__"), "magic")
        .when(name.startswith("__"), "private")
        .when(name.startswith("_"), "protected")
        .otherwise("public")
    )


def is_constant(name: Column) -> Column:
    return (name == F.upper(name)) & F.rlike(name, F.lit("[A-Z]"))


def severity_word(code: Column) -> Column:
    word = None
    for number, text in SEVERITY_CODES.items():
        word = F.when(code == number, text) if word is None else word.when(code == number, text)
    return word.otherwise("info")


def call_names(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(CALL_NAME), F.lit(1))


def calls_name(line: Column, name: str) -> Column:
    return F.rlike(line, F.lit(rf"\b{re.escape(name)}\s*\("))


def cap_list(items: Column, keep: int, noun: str = "", total: Column | None = None) -> Column:
    """First ``keep`` entries, then ``... and N more`` when there are others; ``total`` is the full count
    when ``items`` was cut before."""
    count = F.size(items) if total is None else total
    rest = F.concat(F.lit("... and "), (count - keep).cast("string"), F.lit(f" more {noun}".rstrip()))
    return F.when(count > keep, F.concat(F.slice(items, 1, keep), F.array(rest))).otherwise(items)


def hyperlink(prefix: str, identifier: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(identifier, F.lit("."), F.lit("/")))


def drop_first_part(path: Column) -> Column:
    """Archive path without its top folder; a path of one part stays."""
    return F.regexp_replace(path, "^[^/]+/", "")


# --- markdown to chat markup ---------------------------------------------------------------------


def _cells(row: Column) -> Column:
    parts = F.split(row, r"\|", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: strip(c))


def table_blocks(text: Column) -> Column:
    """Every markdown table in the text, as an array of blocks."""
    return F.regexp_extract_all(text, F.lit(TABLE), F.lit(0))


def table_header(block: Column) -> Column:
    return _cells(F.element_at(F.split(strip(block), "\n", -1), 1))


def table_rows(block: Column) -> Column:
    """Data rows as arrays of cells; blank lines between rows are skipped."""
    lines = F.split(strip(block), "\n", -1)
    data = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return F.transform(F.filter(data, lambda x: strip(x) != ""), lambda row: _cells(row))


def table_as_lines(block: Column) -> Column:
    """A table as ``  *Header*: value`` lines, one paragraph per row."""
    header = table_header(block)

    def row(cells: Column) -> Column:
        paired = F.slice(F.arrays_zip(header.alias("h"), cells.alias("c")), 1, F.least(F.size(header), F.size(cells)))
        value = lambda p: F.replace(p["c"], F.lit(":white_check_mark:"), F.lit("✅"))
        return F.array_join(F.transform(paired, lambda p: F.concat(F.lit("  *"), p["h"], F.lit("*: "), value(p))), "\n")

    return F.array_join(F.transform(table_rows(block), row), "\n\n")


def tables_to_lines(text: Column) -> Column:
    """Text with each markdown table replaced by its line form; other text is untouched."""
    between = F.split(text, TABLE, -1)
    blocks = table_blocks(text)
    pieces = F.transform(
        between,
        lambda piece, i: F.concat(
            piece, F.when(i < F.size(blocks), table_as_lines(F.get(blocks, i))).otherwise("")
        ),
    )
    return F.when(F.rlike(text, F.lit(r"\|\s*\n\|")), F.array_join(pieces, "")).otherwise(text)


# Markdown rewrites in the order they apply.
MARKUP_STEPS: tuple[tuple[str, str], ...] = (
    (r"(?s)```\w*\n(.*?)\n```", "```\n$1\n```"),
    (r"(?dm)^### (.+)$", r"*$1*"),
    (r"(?dm)^## (.+)$", r"*$1*"),
    (r"(?dm)^# (.+)$", r"*$1*"),
    (r"(?s)\*\*([^*]+(?:\*(?!\*)[^*]*)*)\*\*", r"*$1*"),
    (r"(?dm)^-\s+(.+)$", "• $1"),
    (r"(?dm)^(\s*)•\s+(.+)$", "$1• $2"),
)


def markdown_to_chat(text: Column) -> Column:
    """Tables, fences, headers, bold and bullets in chat markup."""
    out = tables_to_lines(text)
    for pattern, replacement in MARKUP_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


# --- repository URLs -----------------------------------------------------------------------------

_HOSTS: Sequence[tuple[str, str, str]] = (
    ("github.com", "github", "main"),
    ("gitlab.com", "gitlab", "main"),
    ("bitbucket.org", "bitbucket", "master"),
)


def repository_fields(url: Column) -> Column:
    """``struct(url, platform, owner, repo, branch, archive_url, auth)``; null fields where no path names a repository."""
    given = strip(url)
    web = F.rlike(given, F.lit("^https?://"))
    full = F.when(web, given).when(given.contains("/") & ~given.startswith("."), F.concat(F.lit("https://github.com/"), given))
    host = F.lower(F.regexp_extract(full, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    count = F.size(parts)
    bare = lambda name: F.regexp_replace(name, r"\.git$", "")

    known = [host.contains(domain) for domain, _, _ in _HOSTS]
    platform, branch = F.lit("generic"), F.lit("main")
    for test, (_, name, default) in reversed(list(zip(known, _HOSTS))):
        platform, branch = F.when(test, name).otherwise(platform), F.when(test, default).otherwise(branch)
    hosted = known[0] | known[1] | known[2]
    owner = F.when(hosted & (count >= 2), F.get(parts, F.lit(0))).when(
        ~hosted & (count >= 1),
        F.when(count == 1, "unknown").otherwise(F.array_join(F.slice(parts, 1, F.greatest(count - 1, F.lit(0))), "/")),
    )
    repo = F.when(hosted & (count >= 2), bare(F.get(parts, F.lit(1)))).when(~hosted & (count >= 1), bare(F.get(parts, count - 1)))
    base = bare(F.regexp_extract(full, r"^(https?://[^?#]*)", 1))
    archive = (
        F.when(known[0], F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/archive/refs/heads/main.zip")))
        .when(
            known[1],
            F.concat(F.lit("https://gitlab.com/"), owner, F.lit("/"), repo, F.lit("/-/archive/main/"), repo, F.lit("-main.zip")),
        )
        .when(known[2], F.concat(F.lit("https://bitbucket.org/"), owner, F.lit("/"), repo, F.lit("/get/master.zip")))
        .otherwise(F.concat(base, F.lit("/-/archive/main/"), repo, F.lit("-main.zip")))
    )
    auth = (
        F.when(F.rlike(given, F.lit("^(git@|ssh://)")), "ssh")
        .when(given.startswith("http://"), "none")
        .when(full.contains("@") | full.contains("token"), "token")
        .when(full.startswith("https://"), "https")
        .otherwise("none")
    )
    valid = repo.isNotNull()
    only = lambda c: F.when(valid, c)
    return F.struct(
        only(full).alias("url"),
        only(platform).alias("platform"),
        owner.alias("owner"),
        repo.alias("repo"),
        only(branch).alias("branch"),
        only(archive).alias("archive_url"),
        auth.alias("auth"),
    )
