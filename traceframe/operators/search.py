"""Search over files by line: grep, definitions, previews, function ranges, file statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions.globs import matches_glob
from traceframe.functions.text import NOT_CALLS, call_names, highlight, indent, strip
from traceframe.sources.text_lines import split_lines

LINE_BUCKET = 64


def list_files(files: DataFrame, glob: str = "*", limit: int | None = None, path: str = "path") -> DataFrame:
    """Matching paths in order; with a ``limit`` the first ones, by a per-task top-n instead of a full sort."""
    found = files.where(matches_glob(F.col(path), glob)).select(path).orderBy(path)
    return found if limit is None else found.limit(limit)


def count_files(files: DataFrame, glob: str = "*", path: str = "path") -> DataFrame:
    hit = matches_glob(F.col(path), glob)
    return files.agg(F.count_if(hit).alias("matching"), F.count(F.lit(1)).alias("total"))


def grep(
    files: DataFrame,
    pattern: str,
    file_glob: str = "*.py",
    case_sensitive: bool = False,
    limit: int | None = None,
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """Lines that match, stripped, with every hit in brackets. No shuffle unless ``limit`` is set."""
    regex = pattern if case_sensitive else "(?i)" + pattern
    chosen = files.where(matches_glob(F.col(path), file_glob)).select(path, text)
    lines = split_lines(chosen, text, "splitlines").where(F.rlike("line", F.lit(regex)))
    found = lines.select(
        path,
        "line_no",
        strip(F.col("line")).alias("content"),
        highlight(strip(F.col("line")), pattern, not case_sensitive).alias("highlighted"),
    )
    return found.orderBy(path, "line_no").limit(limit) if limit is not None else found


def search_definitions(files: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """On ``def``/``class`` lines the pattern is tried on the name only, elsewhere on the whole line."""
    regex = F.lit("(?i)" + pattern)
    lines = split_lines(files.select(path, text), text)
    bare = strip(F.col("line"))
    defines = F.rlike(bare, F.lit("^(def |class |async def )"))
    name = F.regexp_extract("line", r"(?:def|class)\s+(\w+)", 1)
    hit = F.when(defines, (name != "") & F.rlike(name, regex)).otherwise(F.rlike("line", regex))
    return lines.where(hit).select(
        path,
        "line_no",
        F.when(defines, name).otherwise("content_match").alias("name"),
        F.when(~defines, "content").when(F.col("line").contains("class "), "class").otherwise("function").alias("kind"),
        bare.alias("content"),
        (defines & F.col("line").contains("async ")).alias("is_async"),
    )


def search_symbols(symbols: DataFrame, pattern: str, columns: Sequence[str] = ("name", "full_name")) -> DataFrame:
    """Functions and classes whose short or full name matches, with the hit in brackets."""
    regex = F.lit("(?i)" + pattern)
    hit = None
    for c in columns:
        hit = F.rlike(F.col(c), regex) if hit is None else hit | F.rlike(F.col(c), regex)
    return symbols.where(hit).withColumn("highlighted", highlight(F.col(columns[-1]), pattern))


def lookup_function(functions: DataFrame, name: str, column: str = "full_name", suggestions: int = 5) -> DataFrame:
    """Exact matches (rank 0), else names containing it (rank 1), else up to five look-alikes (rank 2).

    Look-alikes ignore case and appear only when nothing else matches, which is an EXISTS test on the
    at most ``suggestions`` rows that could need it.
    """
    full = F.col(column)
    ranked = functions.withColumn(
        "rank",
        F.when(full == name, 0).when(full.contains(name), 1).when(F.lower(full).contains(name.lower()), 2),
    ).where(F.col("rank").isNotNull())
    better = ranked.where(F.col("rank") < 2)
    spare = ranked.where(F.col("rank") == 2).orderBy(column).limit(suggestions)
    return better.unionByName(spare.where(~better.exists()))


def unique_paths(files: DataFrame, requests: Sequence[str], path: str = "path", exact_first: bool = True) -> DataFrame:
    """For each partial path the one file that contains it; none when several do. A request that is
    itself a path names that file, unless ``exact_first`` is off.

    Requests come from the caller, so they travel as a literal array and files are read once, with
    a per-request count that combines before the shuffle.
    """
    asked = F.filter(F.array(*[F.lit(r) for r in requests]), lambda r: F.contains(F.col(path), r))
    return _one_file(files.select(F.explode(asked).alias("request"), F.col(path).alias("file")), exact_first)


def partial_paths(files: DataFrame, requests: DataFrame, path: str = "path", request: str = "request", exact_first: bool = True) -> DataFrame:
    """:func:`unique_paths` for any number of requests, which are a DataFrame: ``(request, file)`` of those that name one file.

    An index of n-grams: a path that contains a request holds all its trigrams, so each request meets only the paths that
    hold its rarest one, and is then searched for in them. Requests of one or two characters are grams themselves. Repeated
    requests count once; null and empty ones name nothing. Paths that repeat count each, so they are not unique.
    """
    asked = requests.select(F.col(request).cast("string").alias("request")).where("request <> ''").distinct()
    named = files.select(F.col(path).alias("file"))

    def grams(text: Column, n: Column) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))

    wanted = asked.select("request", F.explode(grams(F.col("request"), F.least(F.length("request"), F.lit(3)))).alias("gram"))
    sizes = [r["n"] for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]
    held = named.select("file", F.explode(F.concat(*(grams(F.col("file"), F.lit(n)) for n in sizes or [3]))).alias("gram"))
    held = held.join(wanted.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no path holds is the rarest of all
    rarest = wanted.join(often, "gram", "left").groupBy("request").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hits = rarest.join(held, "gram").where(F.contains(F.col("file"), F.col("request")))
    return _one_file(hits, exact_first)


def _one_file(hits: DataFrame, exact_first: bool) -> DataFrame:
    counted = hits.groupBy("request").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("file").alias("file"),
        F.max(F.when(F.col("file") == F.col("request"), F.col("file"))).alias("exact"),
    )
    only = F.when(F.col("n") == 1, F.col("file"))
    found = F.coalesce("exact", only) if exact_first else only
    return counted.select("request", found.alias("file")).where(F.col("file").isNotNull())


def containing_function(places: DataFrame, functions: DataFrame, key: Sequence[str], file: str = "file", line: str = "line") -> DataFrame:
    """Left join of places with the innermost function around them; repeated places count once.

    Ranges are cut into buckets of 64 lines, so a place meets only the functions that reach its
    bucket and a file with many functions is no all-pairs join. Both sides are shuffled: Spark sizes the
    cut ranges by the files they come from, and would send far more rows to every task than it believes.
    """
    ranges = functions.select(
        F.col(file).alias("__file"),
        F.struct((F.col("line_end") - F.col("line_start")).alias("width"), "line_start", "line_end", "name").alias("__f"),
        F.explode(
            F.sequence(F.floor(F.col("line_start") / LINE_BUCKET), F.floor(F.col("line_end") / LINE_BUCKET))
        ).alias("__at"),
    )
    asked = places.select(*key, file, line, F.floor(F.col(line) / LINE_BUCKET).alias("__bucket"))
    # an outer join keeps places without a function in the same single pass; others of the bucket make no row
    around = (F.col(file) == F.col("__file")) & (F.col("__bucket") == F.col("__at"))
    inside = F.col(line).between(F.col("__f.line_start"), F.col("__f.line_end"))
    best = asked.join(ranges.hint("merge"), around & inside, "left").groupBy(*key, file, line).agg(F.min("__f").alias("__f"))
    return best.select(
        *key,
        file,
        line,
        F.col("__f.name").alias("function"),
        F.col("__f.line_start").alias("line_start"),
        F.col("__f.line_end").alias("line_end"),
    )


def preview_range(around: DataFrame, line: str = "line") -> DataFrame:
    """Line range to show: the function with two lines around it, or ten around the line."""
    inside = F.col("line_start").isNotNull()
    return around.withColumn(
        "first", F.greatest(F.lit(1), F.when(inside, F.col("line_start") - 2).otherwise(F.col(line) - 10))
    ).withColumn("last", F.when(inside, F.col("line_end") + 2).otherwise(F.col(line) + 10))


def preview(
    requests: DataFrame, files: DataFrame, mark: str | None = None, path: str = "path", text: str = "text"
) -> DataFrame:
    """Numbered lines ``first``–``last`` of the requested files; the ``mark`` line gets ``>>>``.

    The slice is cut from the joined file's line array, so other lines never become rows. Both sides are
    shuffled: requests come from tables whose size on disk says little of how many they are.
    """
    wanted = requests.join(files.select(path, text).hint("merge"), path)
    lines = F.split(F.col(text), "\n", -1)
    first = F.greatest(F.col("first"), F.lit(1)).cast("int")
    length = F.greatest(F.least(F.col("last").cast("int"), F.size(lines)) - first + 1, F.lit(0))
    rows = wanted.select(*requests.columns, F.posexplode(F.slice(lines, first, length)).alias("__pos", "__line"))
    number = (F.col("__pos") + F.greatest(F.col("first"), F.lit(1))).cast("long")
    sign = F.when(number == F.col(mark), " >>> ").otherwise(" | ") if mark else F.lit(" | ")
    return rows.select(
        *requests.columns,
        number.alias("line_no"),
        F.concat(_pad(number), sign, F.col("__line")).alias("shown"),
    )


def _pad(number: Column, width: int = 4) -> Column:
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def function_ends(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Guess each function's last line from indentation.

    The body's indent is that of the first non-blank line after the ``def`` that does not end with a
    colon. The function ends before the first later line (at least two below the ``def``) that is
    indented no deeper and is neither comment nor decorator; otherwise at the end of the file.

    One pass over the lines of a file: functions wait for their first line, then stand on a stack of open ones until
    a line is indented no deeper. What is open has ever deeper bodies, so the stack is as high as the file is nested, and
    the work grows with the lines, not with functions times lines. Every file is one row of arrays; nothing is shuffled.
    """
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    seen = F.transform(
        lines,
        lambda x, i: F.struct(
            i.alias("i"), indent(x).alias("deep"), F.rtrim(x, F.lit(" \t\r\n\u000b\u000c")).alias("t"),
            (~F.rlike(strip(x), F.lit("^[#@]"))).alias("ends"), F.rlike(x, F.lit(r"^\s*(async\s+)?def\s+\w+")).alias("opens"),
        ),
    )
    start = F.expr("named_struct('waiting', cast(array() as array<int>), 'open', cast(array() as array<struct<p:int,s:int,d:int>>), 'done', cast(array() as array<struct<p:int,stop:int>>))")

    def step(state: Column, line: Column) -> Column:
        first = ~line["t"].endswith(":")
        begun = F.transform(state["waiting"], lambda p: F.struct(p.alias("p"), F.greatest(line["i"], p + 3).alias("s"), line["deep"].cast("int").alias("d")))
        standing = F.when(first & (F.size(state["waiting"]) > 0), F.concat(state["open"], begun)).otherwise(state["open"])
        over = lambda q: line["ends"] & (line["i"] >= q["s"]) & (line["deep"] <= q["d"])
        some = F.exists(standing, over)
        waiting = F.when(first, F.slice(state["waiting"], F.lit(1), F.lit(0))).otherwise(state["waiting"])
        after = F.struct(
            F.when(line["opens"], F.concat(waiting, F.array(line["i"]))).otherwise(waiting).alias("waiting"),
            F.when(some, F.filter(standing, lambda q: ~over(q))).otherwise(standing).alias("open"),
            F.when(some, F.concat(state["done"], F.transform(F.filter(standing, over), lambda q: F.struct(q["p"].alias("p"), line["i"].alias("stop"))))).otherwise(state["done"]).alias("done"),
        )
        idle = (F.size(state["waiting"]) == 0) & (F.size(state["open"]) == 0) & ~line["opens"]
        return F.when((line["t"] == "") | idle, state).otherwise(after)

    folded = files.select(path, lines.alias("__lines"), F.aggregate(seen, start, step).alias("__r"))
    never = lambda p: F.struct(p.alias("p"), F.size("__lines").alias("stop"))
    ends = F.concat("__r.done", F.transform("__r.open", lambda q: never(q["p"])), F.transform("__r.waiting", never))
    rows = folded.select(path, "__lines", F.explode(ends).alias("__e"))
    return rows.select(
        path,
        F.regexp_extract(F.get("__lines", F.col("__e.p")), r"def\s+(\w+)", 1).alias("name"),
        (F.col("__e.p") + 1).cast("long").alias("line_start"),
        F.col("__e.stop").cast("long").alias("line_end"),
    )


def calls_from(files: DataFrame, function: str, path: str = "path", text: str = "text") -> DataFrame:
    """Calls in the lines below ``def function(`` until the indentation returns or the file ends."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    opened = files.where(F.contains(F.col(text), F.lit(f"def {function}("))).select(path, lines.alias("__lines"))
    starts = opened.select(path, "__lines", F.posexplode("__lines").alias("__pos", "__line")).where(
        F.col("__line").contains(f"def {function}(")
    )
    below = F.transform(
        F.slice("__lines", F.col("__pos") + 2, F.size("__lines")), lambda x, i: F.struct((i + F.col("__pos") + 2).alias("no"), x.alias("t"))
    )
    out = F.get(F.filter("__below", lambda e: (strip(e["t"]) != "") & (indent(e["t"]) <= indent(F.col("__line")))), F.lit(0))
    inside = starts.withColumn("__below", below).withColumn("__stop", out["no"])
    body = inside.select(
        path, F.explode(F.filter("__below", lambda e: F.col("__stop").isNull() | (e["no"] < F.col("__stop")))).alias("e")
    )
    return body.select(
        path,
        F.col("e.no").cast("long").alias("line_no"),
        F.explode(call_names(F.col("e.t"))).alias("callee"),
        strip(F.col("e.t")).alias("content"),
    ).where(~F.col("callee").isin(*NOT_CALLS))


def first_values(rows: DataFrame, key: str, order: Sequence[str], value: Column, keep: int) -> DataFrame:
    """Per key: how many rows (``n``) and the first ``keep`` values in ``order`` (``values``).

    Only ``keep`` rows per key and task leave the map side (Spark's per-group limit); the count is a
    partial aggregate. No key's rows are gathered.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    head = rows.select(key, *order, value.alias("__value")).withColumn("__place", place).where(F.col("__place") <= keep)
    first = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__place", "__value"))).alias("__first"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(first, key).select(key, "n", F.transform("__first", lambda x: x["__value"]).alias("values"))


def call_occurrences(calls: DataFrame, keep: int = 3, file: str = "path", line: str = "line_no") -> DataFrame:
    """Calls per function name with the first ``keep`` places."""
    return first_values(calls, "callee", [file, line], F.struct(file, line), keep).withColumnRenamed("values", "places")


def capped_lines(hits: DataFrame, n: int, path: str = "path", line: str = "line_no") -> DataFrame:
    """First ``n`` rows over all files, in file and line order."""
    return hits.orderBy(path, line).limit(n)


def file_metrics(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Total, blank and comment lines per file, counted inside the row's own array."""
    lines = F.split(F.col(text), "\n", -1)
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return files.select(
        path,
        F.size(lines).cast("long").alias("total_lines"),
        count(lambda x: strip(x) == "").alias("blank_lines"),
        count(lambda x: strip(x).startswith("#")).alias("comment_lines"),
    )


def directory_stats(files: DataFrame, path: str = "path", size: Column | None = None) -> DataFrame:
    """Files and bytes per directory (``root`` for none)."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    size = size if size is not None else F.octet_length("text")
    return files.groupBy(F.when(folder == "", "root").otherwise(folder).alias("directory")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size.cast("long")).alias("bytes")
    )


def extension(path: Column) -> Column:
    return F.when(path.contains("."), F.lower(F.element_at(F.split(path, r"\."), -1))).otherwise("no_ext")


def extension_counts(files: DataFrame, keep: int = 10, path: str = "path") -> DataFrame:
    counted = files.groupBy(extension(F.col(path)).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "ext").limit(keep)


def largest_files(files: DataFrame, keep: int = 10, path: str = "path", size: Column | None = None) -> DataFrame:
    size = size if size is not None else F.octet_length("text")
    return files.select(path, size.cast("long").alias("bytes")).orderBy(F.desc("bytes"), path).limit(keep)


def calls_to(files: DataFrame, name: str, path: str = "path", text: str = "text") -> DataFrame:
    """Every line that calls ``name``, with its place and text."""
    regex = rf"\b{re.escape(name)}\s*\("
    lines = split_lines(files.where(F.contains(F.col(text), F.lit(name))).select(path, text), text, "splitlines")
    return lines.where(F.rlike("line", F.lit(regex))).select(path, "line_no", strip(F.col("line")).alias("content"))
