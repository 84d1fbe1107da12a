"""Call graphs as distinct edge tables: degrees, neighbours, chains, top-n subgraph, DOT text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.session import cut_lineage


def distinct_edges(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("caller").isNotNull()).select("caller", "callee").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``calls`` (out) and ``called_by`` (in) per function from one aggregation; no join of two counts."""
    ends = F.array(
        F.struct(F.col("caller").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("callee").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        edges.select(F.explode(ends).alias("e"))
        .groupBy("e.name")
        .agg(F.sum("e.o").alias("calls"), F.sum("e.i").alias("called_by"))
    )


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("callee") == name).select("caller")


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("caller") == name).select("callee")


def resolve_callees(edges: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Edges with ``resolved``: whether the callee is a function of the corpus."""
    names = known.select(F.col(name).alias("callee")).distinct().withColumn("resolved", F.lit(True))
    return edges.join(names, "callee", "left").select(
        "caller", "callee", F.coalesce("resolved", F.lit(False)).alias("resolved")
    )


def top_by_degree(edges: DataFrame, keep: int = 50) -> DataFrame:
    score = (F.col("calls") + F.col("called_by")).alias("score")
    return degrees(edges).select("name", score).orderBy(F.desc("score"), "name").limit(keep)


def most_called(edges: DataFrame, keep: int = 10) -> DataFrame:
    return edges.groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(keep)


def induced_edges(edges: DataFrame, top: DataFrame) -> DataFrame:
    """Edges with both ends in ``top``."""
    names = top.select("name")
    return edges.join(names, F.col("caller") == F.col("name"), "left_semi").join(
        names, F.col("callee") == F.col("name"), "left_semi"
    )


def call_chain(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Nodes reachable from each start with their least depth and one parent.

    Breadth first: each round joins the frontier with the edges, keeps one row per new node and drops
    nodes seen before, so cycles end. Every frontier is written once to shared storage; the visited set
    is the union of those tables. The plan stays short and a lost executor replays one round at most.
    """
    frontier = cut_lineage(
        starts.select(
            F.col("name").alias("start"), F.col("name").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")
        )
    )
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = (
            frontier.select("start", F.col("node").alias("caller"))
            .join(edges, "caller")
            .groupBy("start", F.col("callee").alias("node"))
            .agg(F.min("caller").alias("parent"))
        )
        fresh = reached.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut_lineage(fresh.select("start", "node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dot_lines(edges: DataFrame, functions: DataFrame, keep: int = 50) -> DataFrame:
    """Graphviz text of the ``keep`` most connected functions as ``(section, line)`` rows.

    ``functions`` has ``name``, ``file``, ``line_start`` and ``is_method``; at most ``keep`` nodes and
    ``keep``² edges come out, so the text always fits one file.
    """
    top = top_by_degree(edges, keep)
    nodes = top.join(functions, "name").select(
        F.lit(1).alias("section"),
        F.concat(
            F.lit('  "'), "name", F.lit('" [label="'), "name", F.lit("\\n("),
            F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("line_start").cast("string"), F.lit(')", fillcolor='),
            F.when(F.col("is_method"), "lightblue").otherwise("lightgreen"), F.lit(", style=filled];"),
        ).alias("line"),
    )
    arrows = induced_edges(edges, top).select(
        F.lit(2).alias("section"), F.concat(F.lit('  "'), "caller", F.lit('" -> "'), "callee", F.lit('";')).alias("line")
    )
    spark = edges.sparkSession
    frame = spark.createDataFrame(
        [(0, "digraph CallGraph {\n  rankdir=TB;\n  node [shape=box, style=rounded];\n"), (3, "}")], "section int, line string"
    )
    return frame.unionByName(nodes).unionByName(arrows)


def write_dot(edges: DataFrame, functions: DataFrame, path: str, keep: int = 50) -> None:
    dot_lines(edges, functions, keep).orderBy("section", "line").coalesce(1).select("line").write.mode("overwrite").text(path)
