"""Bulk edits: line edits, search/replace, ranged replace, unified diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.text import normalize_newlines, strip


#: Hash classes of file names. The list of those that have an edit is broadcast: at most this many integers, however many edits.
CLASSES = 1 << 18


def _touched(files: DataFrame, edits: DataFrame, file: str) -> DataFrame:
    """Files whose name is in the hash class of one with an edit; the texts of all others leave before a shuffle."""
    of = lambda name: F.pmod(F.xxhash64(name), F.lit(CLASSES)).cast("int")
    classes = edits.select(of(F.col(file).cast(files.schema[file].dataType)).alias("__class")).distinct()
    return files.join(F.broadcast(classes), of(F.col(file)) == F.col("__class"), "left_semi")


def _line_edits(files: DataFrame, edits: DataFrame, file: str, text: str) -> DataFrame:
    """One row per file with edits: ``__there``, its ``__lines``, ``__done`` (per edited line the lines ahead of it that stay,
    and the folded line) and ``__out`` (edits of lines it does not have).

    Only edits are shuffled by line. A text is split in its own row and put together from slices between edited lines.
    """
    line = F.col("line").cast("long")
    wanted = F.struct("seq", strip(F.col("old_content")).alias("old"), strip(F.col("new_content")).alias("new"))
    steps = edits.groupBy(file, line.alias("line")).agg(F.array_sort(F.collect_list(wanted)).alias("steps"))
    plans = steps.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("line", "steps"))).alias("__plan"))
    texts = _touched(files, edits, file).select(file, F.split(F.col(text), "\n", -1).alias("__lines"), F.lit(True).alias("__there"))
    seq = edits.schema["seq"].dataType.simpleString()

    def step(state: Column, edit: Column) -> Column:
        actual = strip(state["text"])
        fits = (edit["old"] != "") & (actual.contains(edit["old"]) | edit["old"].contains(actual))
        status = F.when(edit["old"] == "", "empty").when(fits, "applied").otherwise("mismatch")
        return F.struct(
            F.when(fits, F.replace(state["text"], edit["old"], edit["new"])).otherwise(state["text"]).alias("text"),
            F.concat(state["log"], F.array(F.struct(edit["seq"].alias("seq"), status.alias("status")))).alias("log"),
        )

    def fold(p: Column, i: Column) -> Column:
        at = p["line"].cast("int")
        ahead = F.coalesce(F.get("__in", i - 1)["line"], F.lit(0)).cast("int")
        start = F.struct(F.get("__lines", at - 1).alias("text"), F.expr(f"cast(array() as array<struct<seq:{seq},status:string>>)").alias("log"))
        return F.struct(
            p["line"].alias("line"),
            F.slice("__lines", ahead + 1, at - ahead - 1).alias("ahead"),
            F.aggregate(p["steps"], start, step).alias("r"),
        )

    inside = lambda p: F.coalesce(p["line"].between(1, F.size("__lines")), F.lit(False))
    joined = plans.join(texts, file, "left")
    sorted_out = joined.select(
        file, "__there", "__lines", F.filter("__plan", inside).alias("__in"), F.filter("__plan", lambda p: ~inside(p)).alias("__out")
    )
    return sorted_out.withColumn("__done", F.transform("__in", fold))


def apply_line_edits(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Edited files. An edit applies when the line still holds its old text (or is held by it); edits of
    one line apply in ``seq`` order. Files without an edit are neither shuffled nor split; a null text stays null, with no
    edit applied; rows that repeat a file name are edited each."""
    done = _line_edits(files, edits, file, text).where("__there")
    last = F.coalesce(F.get("__done", F.size("__done") - 1)["line"], F.lit(0)).cast("int")
    pieces = F.flatten(F.transform("__done", lambda d: F.concat(d["ahead"], F.array(d["r"]["text"]))))
    hits = lambda d: F.size(F.filter(d["r"]["log"], lambda e: e["status"] == "applied")).cast("long")
    return done.select(
        file,
        F.array_join(F.concat(pieces, F.slice("__lines", last + 1, F.size("__lines"))), "\n").alias(text),
        F.aggregate("__done", F.lit(0).cast("long"), lambda n, d: n + hits(d)).alias("applied"),
    )


def line_edit_status(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Status of every edit: applied, mismatch, empty, out_of_range or no_file."""
    mark = lambda line, e, status: F.struct(line.alias("line"), e["seq"].alias("seq"), status.alias("status"))
    rest = F.when(F.col("__there"), "out_of_range").otherwise("no_file")
    made = F.transform("__done", lambda d: F.transform(d["r"]["log"], lambda e: mark(d["line"], e, e["status"])))
    left = F.transform("__out", lambda p: F.transform(p["steps"], lambda e: mark(p["line"], e, rest)))
    rows = _line_edits(files, edits, file, text).select(file, F.explode(F.flatten(F.concat(made, left))).alias("e"))
    return rows.select(file, "e.line", "e.seq", "e.status")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(part == "", 0).otherwise(
        ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")
    ).cast("long")


def _replace_first(text: Column, part: Column, replacement: Column) -> Column:
    at = F.instr(text, part)
    return F.when(
        at > 0, F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(part), F.length(text)))
    ).otherwise(text)


_DONE = "cast(array() as array<struct<seq:bigint,status:string,n:bigint,line:bigint>>)"


def _in_order(files: DataFrame, edits: DataFrame, file: str, text: str, step, fields: Sequence[str] = ()) -> DataFrame:
    """One row per edit: file, ``seq`` if given, the text after all edits of the file, and the outcome ``__e`` of this one.

    The edits of a file are gathered (by ``seq``) and folded over its text; ``step(text, edit)`` gives the new text,
    a status, a count and a line. An edit of a file that is not there has a null text and the status ``no_file``.
    """
    numbered = "seq" in edits.columns
    seq = F.col("seq").cast("long") if numbered else F.lit(0).cast("long")
    plan = edits.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(seq.alias("seq"), "search", "replacement", *fields))).alias("__plan"))
    joined = plan.join(_touched(files, edits, file).select(file, F.col(text).alias("__text")), file, "left")

    def apply(state: Column, edit: Column) -> Column:
        there = state["text"].isNotNull()
        after, status, n, line = step(state["text"], edit)
        done = F.struct(
            edit["seq"].alias("seq"), F.when(there, status).otherwise("no_file").alias("status"),
            F.when(there, n).cast("long").alias("n"), F.when(there, line).cast("long").alias("line"),
        )
        return F.struct(F.when(there, after).alias("text"), F.concat(state["done"], F.array(done)).alias("done"))

    folded = joined.withColumn("__r", F.aggregate("__plan", F.struct(F.col("__text").alias("text"), F.expr(_DONE).alias("done")), apply))
    rows = folded.select(file, F.col("__r.text").alias(text), F.explode("__r.done").alias("__e"))
    return rows.select(file, *([F.col("__e.seq").alias("seq")] if numbered else []), text, "__e")


def replace_all(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Search/replace of all occurrences, with the count (0: not found, null: no such file); several edits of a file
    are applied in the order of ``seq``."""

    def step(body: Column, edit: Column) -> tuple[Column, ...]:
        n = occurrences(body, edit["search"])
        return F.replace(body, edit["search"], edit["replacement"]), F.lit("replaced"), n, F.lit(None)

    rows = _in_order(files, edits, file, text, step)
    return rows.select(*[c for c in rows.columns if c != "__e"], F.col("__e.n").alias("replaced"))


def replace_first(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Search/replace of the first occurrence; a warning when there are more, and the line of the hit. Several edits of a
    file are applied in the order of ``seq``; an edit of an unknown file says ``no_file``, one that searches for nothing
    leaves the text and says ``empty``."""

    def step(body: Column, edit: Column) -> tuple[Column, ...]:
        n = occurrences(body, edit["search"])
        ahead = F.substring(body, F.lit(1), F.instr(body, edit["search"]) - 1)
        line = F.when(n > 0, 1 + F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))))
        some = edit["search"] != ""
        after = F.when(some, _replace_first(body, edit["search"], edit["replacement"])).otherwise(body)
        return after, F.when(~some, "empty").when(n > 1, "multiple").when(n == 1, "replaced").otherwise("not_found"), n, line

    rows = _in_order(files, edits, file, text, step)
    return rows.select(*[c for c in rows.columns if c != "__e"], F.col("__e.status").alias("status"), F.col("__e.line").alias("line"))


def _squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def _flexible(search: Column) -> Column:
    """Regex of a literal in which every run of whitespace fits any other; none at its ends."""
    escaped = F.regexp_replace(_squeeze(search), r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    return F.regexp_replace(escaped, " ", r"\\s+")


def replace_in_range(files: DataFrame, edits: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """First occurrence within ``start_line``–``end_line`` (either may be null); whitespace may differ. A text without it
    stays as it is, and so does one whose edit searches for nothing but whitespace (``empty``). Several edits of a file are applied in the order of ``seq``, each by the lines that the ones before left."""

    def step(whole: Column, edit: Column) -> tuple[Column, ...]:
        lines = F.split(whole, "\n", -1)
        first = F.coalesce(edit["start_line"], F.lit(1)).cast("int")
        last = F.least(F.coalesce(edit["end_line"], F.size(lines)), F.size(lines)).cast("int")
        size = lambda n: F.greatest(n, F.lit(0))
        head = F.slice(lines, F.lit(1), size(F.least(first - 1, F.size(lines))))
        body = F.array_join(F.slice(lines, first, size(last - first + 1)), "\n")
        rest = F.slice(lines, last + 1, size(F.size(lines) - last))
        search = edit["search"]
        some = _squeeze(search) != ""
        # what is replaced decides what is said
        literal = F.when(some, F.when(body.contains(search), search).otherwise(F.regexp_substr(body, _flexible(search))))
        found = literal.isNotNull()
        new = _replace_first(body, literal, edit["replacement"])
        after = F.array_join(F.concat(head, F.split(new, "\n", -1), rest), "\n")
        return F.when(found, after).otherwise(whole), F.when(found, "replaced").when(some, "not_found").otherwise("empty"), F.lit(None), F.lit(None)

    rows = _in_order(files, edits, file, text, step, ("start_line", "end_line"))
    return rows.select(*[c for c in rows.columns if c != "__e"], F.col("__e.status").alias("status"))


# --- unified diffs -------------------------------------------------------------------------------

_GIT_LINES = r"(?m)^(?:diff --git|index |new file mode|deleted file mode|old mode|new mode|similarity index|rename )[^\n]*\n?"


def diff_hunks(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """``(diff, file_no, source, target, hunk_no, lines)`` of every hunk.

    Files and hunks are cut with look-ahead splits inside the row, so no window and no shuffle.
    """
    body = F.regexp_replace(normalize_newlines(F.col(text)), _GIT_LINES, "")
    parts = F.filter(F.split(body, r"(?m)(?=^--- [^\n]*\n\+\+\+ )", -1), lambda p: F.rlike(p, F.lit(r"^--- [^\n]*\n\+\+\+ ")))
    files = diffs.select(key, F.posexplode(parts).alias("__f", "__part"))
    name = lambda sign, side: F.regexp_replace(F.regexp_extract("__part", rf"(?m)^{sign} ([^\n]*)$", 1), f"^{side}/", "")
    hunks = F.split("__part", r"(?m)^@@[^\n]*\n?", -1)
    rows = files.select(
        key, "__f", name("---", "a").alias("source"), name(r"\+\+\+", "b").alias("target"), F.posexplode(hunks).alias("__h", "__hunk")
    ).where(F.col("__h") > 0)
    return rows.select(
        key,
        (F.col("__f") + 1).alias("file_no"),
        "source",
        "target",
        F.col("__h").alias("hunk_no"),
        F.split(F.regexp_replace("__hunk", "\n$", ""), "\n", -1).alias("lines"),
    )


def diff_lines(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """Exploded diff: one row per hunk line with its ``op`` (``+``, ``-`` or blank)."""
    hunks = diff_hunks(diffs, key, text)
    rows = hunks.select(key, "file_no", "source", "target", "hunk_no", F.posexplode("lines").alias("__p", "__l"))
    sign = F.substring("__l", 1, 1)
    return rows.select(
        key,
        "file_no",
        "source",
        "target",
        "hunk_no",
        (F.col("__p") + 1).alias("pos"),
        F.when(sign.isin("+", "-"), sign).otherwise(" ").alias("op"),
        F.expr("substring(__l, 2)").alias("content"),
    )


def diff_counts(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """Added and removed lines per hunk, counted in the hunk's own array."""
    count = lambda sign: F.size(F.filter("lines", lambda x: x.startswith(sign))).cast("long")
    return diff_hunks(diffs, key, text).select(
        key, "file_no", "target", "hunk_no", count("+").alias("added"), count("-").alias("removed")
    )


def diff_files(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """Distinct files a diff touches, from ``+++`` and ``diff --git`` headers; distinct inside the row."""
    plus = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\+\+\+ [ab]/([^\n\r]*)"), F.lit(1))
    git = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^diff --git \S+ (?:b/)?(\S+)"), F.lit(1))
    return diffs.select(key, F.explode(F.array_distinct(F.concat(git, plus))).alias("file"))


def diff_replacements(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """``(old, new)`` pairs: a removed line directly followed by an added one, the bare values of
    ``x = old`` / ``x = new``, and, for diffs without any pair, changed call lines within the next four."""
    lines = F.split(strip(F.col(text)), "\n", -1)
    indexed = diffs.select(key, lines.alias("__lines"))
    at = lambda i: F.get("__lines", i)
    header = lambda x: x.startswith("---") | x.startswith("+++") | x.startswith("@@")
    bare = lambda x: strip(F.substring(x, F.lit(2), F.length(x)))
    pairs = F.filter(
        F.transform(
            "__lines",
            lambda x, i: F.when(
                ~header(x) & x.startswith("-") & at(i + 1).startswith("+"),
                F.struct(i.alias("pos"), bare(x).alias("old"), bare(at(i + 1)).alias("new"), F.lit("line").alias("kind")),
            ),
        ),
        lambda p: p.isNotNull() & (p["old"] != "") & (p["new"] != "") & (p["old"] != p["new"]),
    )
    left = lambda x: strip(F.substring_index(x, "=", 1))
    right = lambda x: strip(F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x)))
    values = F.transform(
        F.filter(
            pairs,
            lambda p: p["old"].contains("=") & p["new"].contains("=") & (left(p["old"]) == left(p["new"])) & (right(p["old"]) != right(p["new"])),
        ),
        lambda p: F.struct(p["pos"].alias("pos"), right(p["old"]).alias("old"), right(p["new"]).alias("new"), F.lit("value").alias("kind")),
    )
    call = lambda x, sign: x.startswith(sign) & x.contains("(") & x.contains(")")
    calls = F.filter(
        F.transform(
            "__lines",
            lambda x, i: F.when(
                call(x, "-"),
                F.struct(
                    i.alias("pos"),
                    bare(x).alias("old"),
                    F.get(
                        F.filter(
                            F.transform(F.slice("__lines", i + 2, F.lit(4)), lambda y: F.when(call(y, "+"), bare(y))),
                            lambda y: y.isNotNull() & (y != bare(x)),
                        ),
                        F.lit(0),
                    ).alias("new"),
                    F.lit("call").alias("kind"),
                ),
            ),
        ),
        lambda p: p.isNotNull() & p["new"].isNotNull(),
    )
    chosen = F.when(F.size(pairs) > 0, F.concat(pairs, values)).otherwise(calls)
    return indexed.select(key, F.explode(chosen).alias("r")).select(key, "r.pos", "r.kind", "r.old", "r.new")
