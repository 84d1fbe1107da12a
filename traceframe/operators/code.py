"""Python source corpora: one pass turns files into syntax facts, Spark does the rest.

The only Python per file is a small visitor that reads the syntax tree once and emits flat facts
(definitions, decision points, calls, imports, attribute uses, assignments, errors). Complexity, method
lists, resolution, counts and joins are relational operations over those facts.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions.text import is_constant, strip, visibility
from traceframe.operators.graph import distinct_edges
from traceframe.operators.search import file_metrics

_PARAM = "struct<name:string,type:string,default:string,is_vararg:boolean,is_kwarg:boolean>"
FACTS = (
    "path string, kind string, scope string, class_name string, name string, line int, end_line int, col int, "
    f"detail string, items array<string>, params array<{_PARAM}>, doc string, is_async boolean, weight int, owner_line int"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("kind", pa.string()), ("scope", pa.string()), ("class_name", pa.string()),
        ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("col", pa.int32()),
        ("detail", pa.string()), ("items", pa.list_(pa.string())),
        ("params", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("default", pa.string()),
                                       ("is_vararg", pa.bool_()), ("is_kwarg", pa.bool_())]))),
        ("doc", pa.string()), ("is_async", pa.bool_()), ("weight", pa.int32()), ("owner_line", pa.int32()),
    ]
)
BATCH_FACTS = 20_000
# flags of functions, and the last part of the decorators that set them (fixed values)
DECORATED = (("is_property", ("property", "setter", "getter", "deleter", "cached_property")), ("is_classmethod", ("classmethod",)), ("is_staticmethod", ("staticmethod",)))
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case)


def _source(node: ast.AST | None) -> str | None:
    """Source text of an expression; names, dotted names and constants without the general printer."""
    if node is None:
        return None
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, (ast.Name, ast.Attribute)):
        return f"{_source(node.value)}.{node.attr}"
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, type(None))):
        return repr(node.value)
    return ast.unparse(node)


def _params(args: ast.arguments) -> list[dict]:
    plain = [*args.posonlyargs, *args.args]
    defaults: list = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    triples = [(a, d, False, False) for a, d in zip(plain, defaults)]
    triples += [(args.vararg, None, True, False)] if args.vararg else []
    triples += [(a, d, False, False) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    triples += [(args.kwarg, None, False, True)] if args.kwarg else []
    return [
        {"name": a.arg, "type": _source(a.annotation), "default": _source(d), "is_vararg": v, "is_kwarg": k} for a, d, v, k in triples
    ]


class _Facts(ast.NodeVisitor):
    """Emit facts of one file; ``scope`` is the innermost function, ``owner`` the innermost class.

    A class in a class is named ``Outer.Inner``. ``owner_line`` is the line of the class statement that a function or class
    stands in directly, so classes of one name keep their own members.
    """

    def __init__(self, path: str, text: str):
        self.path, self.lines, self.rows = path, text.split("\n"), []
        self.scope: list[str] = []
        self.scope_lines: list[int] = []
        self.owner: list[str] = []
        self.around: list[int | None] = []  # line of each class around, None for a function

    def emit(self, kind: str, node: ast.AST, **more) -> None:
        self.rows.append(
            {
                "path": self.path,
                "kind": kind,
                "scope": self.scope[-1] if self.scope else None,
                "class_name": self.owner[-1] if self.owner else None,
                "line": getattr(node, "lineno", None),
                "end_line": getattr(node, "end_lineno", None),
                "col": getattr(node, "col_offset", None),
                **more,
            }
        )

    def context(self, node: ast.AST) -> str:
        return self.lines[node.lineno - 1].strip()

    def generic_visit(self, node: ast.AST) -> None:
        weight = 1 if isinstance(node, _DECISIONS) else len(node.values) - 1 if isinstance(node, ast.BoolOp) else 0
        if weight:
            # nested functions count for every function around them
            for name, line in zip(self.scope, self.scope_lines):
                self.emit("branch", node, name=name, weight=weight, detail=str(line))
        super().generic_visit(node)

    def _define(self, node, is_async: bool) -> None:
        name = ".".join([*([self.owner[-1]] if self.owner else []), node.name]) if not self.scope else f"{self.scope[-1]}.{node.name}"
        if self.scope and self.owner and not self.scope[-1].startswith(self.owner[-1] + "."):
            name = f"{self.owner[-1]}.{node.name}"
        returns = f" -> {_source(node.returns)}" if node.returns else ""
        self.emit(
            "function",
            node,
            name=name,
            detail=f"{node.name}({ast.unparse(node.args)})|{returns[4:]}",
            items=[_source(d) for d in node.decorator_list],
            params=_params(node.args),
            doc=ast.get_docstring(node),
            is_async=is_async,
            owner_line=self.around[-1] if self.around else None,
        )
        for part in [*node.decorator_list, node.args, node.returns]:
            if part is not None:
                self.visit(part)
        self.scope.append(name)
        self.scope_lines.append(node.lineno)
        self.around.append(None)
        for child in node.body:
            self.visit(child)
        self.around.pop()
        self.scope.pop()
        self.scope_lines.pop()

    def visit_FunctionDef(self, node):
        self._define(node, False)

    def visit_AsyncFunctionDef(self, node):
        self._define(node, True)

    def visit_ClassDef(self, node):
        decorators = [_source(d) for d in node.decorator_list]
        inside = self.around[-1] if self.around else None
        name = f"{self.owner[-1]}.{node.name}" if inside else node.name
        self.emit("class", node, name=name, items=[_source(b) for b in node.bases], doc=ast.get_docstring(node), detail=",".join(decorators), owner_line=inside)
        self.owner.append(name)
        self.around.append(node.lineno)
        self.generic_visit(node)
        self.around.pop()
        self.owner.pop()

    def visit_Call(self, node):
        self.emit("call", node, name=_source(node.func), detail=self.context(node))
        self.generic_visit(node)

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name):
            self.emit("attribute", node, name=node.value.id, detail=node.attr)
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.emit("import", node, name=a.name, items=[], detail=a.asname)

    def visit_ImportFrom(self, node):
        alias = next((a.asname for a in node.names if a.asname), None)
        self.emit("import", node, name="." * node.level + (node.module or ""), items=[a.name for a in node.names], detail=alias)

    def visit_Assign(self, node):
        for target in node.targets:
            if isinstance(target, ast.Name) and not self.scope:
                self.emit("variable", node, name=target.id, detail=_source(node.value))
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name) and not self.scope:
            self.emit("variable", node, name=node.target.id, detail=_source(node.value))
        self.generic_visit(node)


def _facts_of(path: str, text: str) -> list[dict]:
    try:
        visitor = _Facts(path, text)
        tree = ast.parse(text)
        visitor.emit("module", tree, name=path, doc=ast.get_docstring(tree))
        visitor.visit(tree)
        return visitor.rows
    except (SyntaxError, ValueError, RecursionError) as error:
        where = (getattr(error, "lineno", None), getattr(error, "offset", None))
        message = getattr(error, "msg", None) or str(error)
        return [{"path": path, "kind": "error", "line": where[0], "col": where[1], "detail": message, "name": type(error).__name__}]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore", SyntaxWarning)  # about the analysed sources, not this code
    rows: list[dict] = []
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += _facts_of(path, text or "")
            if len(rows) >= BATCH_FACTS:
                yield from _batches(rows)
                rows = []
    if rows:
        yield from _batches(rows)


def _batches(rows: list[dict]) -> list[pa.RecordBatch]:
    columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW]
    return [pa.RecordBatch.from_arrays(columns, schema=_ARROW)]


def syntax_facts(files: DataFrame, path: str = "path", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Flat facts of every file. A file that does not parse gives one ``error`` fact.

    Parsing is bound by CPU: pass ``partitions`` to spread few large input splits over more tasks. Each
    call scans the sources; keep the result (``cache`` or a written table) to query it often.
    """
    texts = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    if partitions:
        texts = texts.repartition(partitions, "path")
    return texts.mapInArrow(_extract, FACTS)


def functions(facts: DataFrame) -> DataFrame:
    """Functions and methods with parameters, signature, visibility and cyclomatic complexity.

    Complexity is one plus the decision points inside. Definitions and decision points meet in one
    aggregation keyed by ``(path, name, line of the definition)``, so there is no join, and every definition
    of a name is a row of its own (property pairs, alternatives under ``try``).
    """
    definition = F.struct(
        "class_name", "line", "end_line", "params", "items", "doc", "is_async", F.col("detail").alias("signature")
    )
    is_def = F.col("kind") == "function"
    grouped = (
        facts.where(F.col("kind").isin("function", "branch"))
        .groupBy("path", "name", F.when(is_def, F.col("line")).otherwise(F.col("detail").cast("int")).alias("def_line"))
        .agg(
            F.max_by(definition, F.when(is_def, F.col("line"))).alias("d"),
            F.coalesce(F.sum("weight"), F.lit(0)).alias("branches"),
        )
    )
    short = F.element_at(F.split("name", r"\."), -1)
    returns = F.element_at(F.split("d.signature", r"\|"), -1)
    return grouped.select(
        F.col("path").alias("file"),
        F.col("name").alias("qualified_name"),
        short.alias("name"),
        F.col("d.class_name").alias("class_name"),
        F.col("d.line").cast("long").alias("line_start"),
        F.col("d.end_line").cast("long").alias("line_end"),
        F.col("d.params").alias("params"),
        F.nullif(returns, F.lit("")).alias("return_type"),
        F.col("d.doc").alias("docstring"),
        F.col("d.items").alias("decorators"),
        F.col("d.is_async").alias("is_async"),
        F.col("d.class_name").isNotNull().alias("is_method"),
        *(F.coalesce(F.exists("d.items", lambda x: F.element_at(F.split(x, r"\."), -1).isin(*names)), F.lit(False)).alias(flag) for flag, names in DECORATED),
        visibility(short).alias("visibility"),
        (F.lit(1) + F.col("branches")).cast("long").alias("complexity"),
        F.regexp_replace("d.signature", r"\|[^|]*$", "").alias("signature"),
    )


def classes(facts: DataFrame) -> DataFrame:
    """Classes with bases, methods in source order, and dataclass / abstract flags.

    A class is its statement, known by file and line: classes of one name (alternatives under ``if`` or ``try``, classes in
    functions or in other classes) are rows of their own with their own methods. A class in a class is ``Outer.Inner``.
    """
    is_class = F.col("kind") == "class"
    method = (F.col("kind") == "function") & F.col("owner_line").isNotNull()
    grouped = (
        facts.where(is_class | method)
        .groupBy("path", F.when(is_class, F.col("line")).otherwise(F.col("owner_line")).alias("class_line"))
        .agg(
            F.max_by(F.struct("name", "line", "end_line", "items", "doc", "detail"), F.when(is_class, F.col("line"))).alias("c"),
            F.array_sort(F.collect_list(F.when(method, F.struct("line", "name")))).alias("m"),
        )
    )
    return grouped.where(F.col("c").isNotNull()).select(
        F.col("path").alias("file"),
        F.col("c.name").alias("name"),
        F.col("c.line").cast("long").alias("line_start"),
        F.col("c.end_line").cast("long").alias("line_end"),
        F.col("c.items").alias("bases"),
        F.transform("m", lambda x: F.element_at(F.split(x["name"], r"\."), -1)).alias("methods"),
        F.coalesce(F.col("c.detail").contains("dataclass"), F.lit(False)).alias("is_dataclass"),
        F.exists("c.items", lambda b: b.contains("ABC")).alias("is_abstract"),
        F.col("c.doc").alias("docstring"),
    )


def imports(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "import").select(
        F.col("path").alias("file"),
        F.col("name").alias("module"),
        F.col("items").alias("names"),
        F.col("detail").alias("alias"),
        F.col("line").cast("long").alias("line"),
    )


def variables(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "variable").select(
        F.col("path").alias("file"),
        "name",
        "class_name",
        F.col("line").cast("long").alias("line"),
        F.col("detail").alias("value"),
        is_constant(F.col("name")).alias("is_constant"),
    )


def calls(facts: DataFrame, resolve_self: bool = True) -> DataFrame:
    """Call references with the function around them; ``self.x`` also resolved to ``Class.x``."""
    own = F.when(F.col("name").startswith("self.") & F.col("class_name").isNotNull(), F.regexp_replace("name", "^self", F.col("class_name")))
    return facts.where(F.col("kind") == "call").select(
        F.col("path").alias("file"),
        F.col("scope").alias("caller"),
        (F.coalesce(own, F.col("name")) if resolve_self else F.col("name")).alias("callee"),
        F.col("line").cast("long").alias("line"),
        F.col("col").cast("long").alias("col"),
        F.col("detail").alias("context"),
        F.lit("call").alias("ref_type"),
    )


def errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind") == "error").select(
        F.col("path").alias("file"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), F.col("detail").alias("message")
    )


def module_uses(facts: DataFrame) -> DataFrame:
    """Attribute uses whose object is a module imported anywhere in the corpus (by name or alias)."""
    used = facts.where(F.col("kind") == "attribute").select(
        F.col("path").alias("file"), F.col("name").alias("module"), F.col("detail").alias("attribute"), F.col("line").cast("long").alias("line")
    )
    names = facts.where(F.col("kind") == "import").select(
        F.explode(F.array_compact(F.array("name", "detail"))).alias("module")
    )
    # an alias names its module only in ``import m as a``; duplicates vanish before the join
    return used.join(names.distinct(), "module", "left_semi").select("file", "module", "attribute", "line")


def corpus_totals(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Files, lines, classes, functions, methods and total complexity of a corpus, as one row."""
    sizes = file_metrics(files).agg(F.count(F.lit(1)).alias("files"), F.sum("total_lines").alias("lines"))
    top = F.col("kind") == "function"
    method = F.col("class_name").isNotNull() & F.col("scope").isNull()
    counted = facts.agg(
        F.count_if(F.col("kind") == "class").alias("classes"),
        F.count_if(top & ~method).alias("functions"),
        F.count_if(top & method).alias("methods"),
        (F.count_if(top) + F.coalesce(F.sum(F.when(F.col("kind") == "branch", F.col("weight"))), F.lit(0))).alias("complexity"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    both = sizes.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.sum(c).cast("long").alias(c) for c in both.columns])


def top_complex(funcs: DataFrame, keep: int = 10, name: Column | None = None) -> DataFrame:
    """The ``keep`` most complex functions, methods named ``Class.name``."""
    full = name if name is not None else F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name")
    return funcs.select("file", full.alias("full_name"), "line_start", "complexity").orderBy(
        F.desc("complexity"), "file", "full_name", "line_start"
    ).limit(keep)


def first_per_file(rows: DataFrame, keep: int, file: str = "file", order: tuple[str, ...] = ("line_start", "name")) -> DataFrame:
    """First ``keep`` rows of each file. Spark cuts to ``keep`` per file in every task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(file).orderBy(*order))
    return rows.withColumn("__n", place).where(F.col("__n") <= keep).drop("__n")


def listing(rows: DataFrame, limit: int, file: str = "file", line: str = "line_start", tie: str = "name") -> DataFrame:
    return rows.orderBy(file, line, tie).limit(limit)


def dependencies(imported: DataFrame) -> DataFrame:
    """Modules each file imports, in line order, and how many."""
    return imported.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "module"))), lambda m: m["module"]).alias("modules"),
        F.count(F.lit(1)).alias("n_modules"),
    )


def most_dependent(imported: DataFrame, keep: int = 5) -> DataFrame:
    """Files with the most imports."""
    counted = imported.groupBy("file").agg(F.count(F.lit(1)).alias("n_modules"))
    return counted.orderBy(F.desc("n_modules"), "file").limit(keep)


def module_counts(imported: DataFrame, used: DataFrame) -> DataFrame:
    """Imports and uses per module in one aggregation over both inputs."""
    both = imported.select("module", F.lit(1).alias("i"), F.lit(0).alias("u")).unionByName(
        used.select("module", F.lit(0).alias("i"), F.lit(1).alias("u"))
    )
    return both.groupBy("module").agg(F.sum("i").alias("imports"), F.sum("u").alias("uses"))


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def any_error(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("has_errors"))


def symbol_counts(symbols: DataFrame, name: str = "symbol", keep: int | None = None) -> DataFrame:
    counted = symbols.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), name).limit(keep) if keep else counted


def hotspots(diagnostics: DataFrame, complex_functions: DataFrame) -> DataFrame:
    """Files with errors or more than three warnings, scored ``10 errors + 2 warnings + complexity``.

    ``complex_functions`` is the bounded top list; only its files add complexity.
    """
    counts = diagnostics.groupBy("file").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    kept = counts.where((F.col("errors") > 0) | (F.col("warnings") > 3))
    extra = complex_functions.groupBy("file").agg(F.sum("complexity").alias("complexity"))
    joined = kept.join(extra, "file", "left").withColumn("complexity", F.coalesce("complexity", F.lit(0)).cast("long"))
    score = F.col("errors") * 10 + F.col("warnings") * 2 + F.col("complexity")
    return joined.withColumn("score", score).orderBy(F.desc("score"), "file")


def last_by_name(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row per name, the last one in ``order``; combines before the shuffle."""
    picked = rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r"))
    return picked.select("__r.*")


def unified_summary(facts: DataFrame) -> DataFrame:
    """Functions, distinct call relationships, modules and broken files, counted in one pass over the facts."""
    kind = F.col("kind")
    item = (
        F.when(kind == "function", "functions").when((kind == "call") & F.col("scope").isNotNull(), "relationships")
        .when(kind == "import", "modules").when(kind == "error", "errors")
    )
    own = F.when(F.col("name").startswith("self.") & F.col("class_name").isNotNull(), F.regexp_replace("name", "^self", F.col("class_name")))
    subject = (
        F.when(item == "functions", F.struct("path", F.col("name").alias("name")))
        .when(item == "relationships", F.struct(F.col("scope").alias("path"), F.coalesce(own, F.col("name")).alias("name")))
        .when(item == "modules", F.struct(F.lit("").alias("path"), F.col("name").alias("name")))
        .otherwise(F.struct("path", F.lit("").alias("name")))
    )
    return facts.where(item.isNotNull()).select(item.alias("item"), subject.alias("subject")).groupBy("item").agg(
        F.count_distinct("subject").alias("n")
    )


def _entries(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Path and sorted entries of every file, also of those without any."""
    entry = F.struct("kind", "name", "line", "end_line", "class_name", "scope", "detail")
    known = facts.where(F.col("kind").isin("function", "class", "import", "error")).select("path", entry.alias("entry"))
    every = known.unionByName(files.select("path"), allowMissingColumns=True)
    return every.groupBy("path").agg(F.array_sort(F.collect_list("entry")).alias("entries"))


def summary_export(files: DataFrame, facts: DataFrame) -> DataFrame:
    """One JSON text per file with its functions, classes, imports and errors; ``[]`` for a file without any."""
    return _entries(files, facts).select("path", F.to_json("entries").alias("value"))


def analysis_export(files: DataFrame, facts: DataFrame) -> DataFrame:
    """The whole analysis as JSON texts by ``section``: one ``summary`` (corpus totals), one of ``files`` a file, one of
    ``graph`` a distinct call edge. Reads the facts three times; pass a written table."""
    parts = (
        ("summary", corpus_totals(files, facts)), ("files", _entries(files, facts)), ("graph", distinct_edges(calls(facts))),
    )
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("value")) for name, df in parts]
    return rows[0].union(rows[1]).union(rows[2])


def write_analysis(files: DataFrame, facts: DataFrame, path: str) -> None:
    """A folder of JSON lines per section, written by all tasks."""
    analysis_export(files, facts).write.partitionBy("section").text(path)


def strip_context(refs: DataFrame) -> DataFrame:
    return refs.withColumn("context", strip(F.col("context")))
