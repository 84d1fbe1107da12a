"""Quality rules: counts per text, and robust multivariate outliers per language and source.

``text_stats`` counts words, symbols, repeated lines and repeated passages of whole texts. ``robust_outliers`` takes
transformed statistics and estimates their centre and scatter in each group (language, source) by the minimum
covariance determinant: from several starts, concentration steps fit mean and covariance to the ``support`` share of
rows nearest to the last estimate until the determinant no longer falls, and the least determinant wins. All steps are
grouped aggregations; what they yield is one small row a group and start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.common import arrow_map, cut_lineage, discard, query, table, unused
from traceframe.llm.spans import Texts, mix, passes, windows

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("f_length", "f_word", "f_symbol", "f_lines", "f_repeat")
#: Least scale of each feature: statistics that are equal in most texts of a group (no symbols at all, say) would
#: otherwise have no spread, and the first text with one symbol would lie infinitely far out.
FLOORS = (0.25, 0.10, 0.10, 0.08, 0.15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 10


def _counts(texts: Texts) -> list[np.ndarray]:
    n = texts.n
    starts, ends, of = texts.words()
    n_words = np.bincount(of, minlength=n)
    first_bytes = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=first_bytes[1:])
    chars = np.zeros(len(of) + 1, np.int64)
    np.cumsum(first_bytes[ends] - first_bytes[starts], out=chars[1:])
    cuts = np.searchsorted(of, np.arange(n + 1))
    word_chars = chars[cuts[1:]] - chars[cuts[:-1]]
    symbols = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_SYMBOL[texts.data], out=symbols[1:])
    n_symbols = symbols[texts.bounds[1:]] - symbols[texts.bounds[:-1]]

    line = np.zeros(len(texts.data) + 2, np.int8)
    line[1:-1] = texts.data != _NEWLINE
    l_starts, l_ends, l_of = texts.runs(line)
    has_word = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_starts, l_ends, l_of = l_starts[has_word], l_ends[has_word], l_of[has_word]
    n_dup = np.zeros(n, np.int64)
    if len(l_starts):
        keys = mix(texts.hashes(l_starts, l_ends) + l_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        n_dup = np.bincount(l_of, minlength=n) - np.bincount(l_of[first], minlength=n)

    repeated = np.zeros(n, np.int64)
    shingles, at = windows(texts.hashes(starts, ends), of, 5)
    if len(shingles):
        keys = mix(shingles + of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(of) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 5, -1)
        covered = np.cumsum(cover)[:-1] > 0
        repeated = np.bincount(of[covered], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, repeated]


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` and the counts of each text, as longs.

    word_chars: code points in words. n_symbols: characters of ``[#*$%&|<>]``. n_dup_lines: lines (split at line feeds)
    that hold a word and equal an earlier line. n_repeat_words: words in windows of five words that occur twice or more
    in the text. A null or empty text has zeros; rows with equal ids stay rows of their own.
    """
    given = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("_text").schema), *(f"{s} bigint" for s in STATS)]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("_text")
        parts = [_counts(texts) for _, _, texts in passes(column)]
        sums = [np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in zip(*parts)] or [np.zeros(0, np.int64)] * len(STATS)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, sums)], names=[*keep, *STATS])

    return arrow_map(given, count, ", ".join(fields))


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Statistics on scales where ordinary texts are roughly normal; defined for texts without words too."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "f_length": F.log1p(F.col("n_words").cast("double")),
        "f_word": F.log1p(F.col("word_chars") / words),
        "f_symbol": F.sqrt(F.col("n_symbols") / words),
        "f_lines": F.sqrt(F.col("n_dup_lines") / words),
        "f_repeat": F.sqrt(F.col("n_repeat_words") / words),
    }


def _estimates(rows: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """Count, mean and covariance of the rows with the given weight, one row a group."""
    p = range(len(FEATURES))
    sums = [F.sum(weight).alias("_w"), *(F.sum(weight * F.col(f)).alias(f"_s{i}") for i, f in enumerate(FEATURES))]
    sums += [F.sum(weight * F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"_q{i}_{j}") for i in p for j in p if i <= j]
    return rows.groupBy(*group).agg(*sums)


def _model(sums: DataFrame, group: list[str], scale: float) -> DataFrame:
    """Count, means, inverse of the scatter and logarithm of its determinant from the sums of one row a group."""
    p = len(FEATURES)

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        def col(name: str) -> np.ndarray:
            return batch.column(name).to_numpy(zero_copy_only=False).astype(float)

        w = np.maximum(np.nan_to_num(col("_w")), 1.0)
        mean = np.stack([np.nan_to_num(col(f"_s{i}")) / w for i in range(p)], 1)
        cov = np.zeros((len(w), p, p))
        for i in range(p):
            for j in range(i, p):
                cov[:, i, j] = cov[:, j, i] = np.nan_to_num(col(f"_q{i}_{j}")) / w - mean[:, i] * mean[:, j]
        cov = cov * scale + np.diag(np.square(FLOORS))
        inverse = np.linalg.inv(cov)
        columns = [batch.column(g) for g in group]
        columns += [pa.array(list(mean), pa.list_(pa.float64())), pa.array([list(m.ravel()) for m in inverse], pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])]
        return pa.RecordBatch.from_arrays(columns, names=[*group, "_mean", "_inverse", "_det"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*group).schema)
    return arrow_map(sums, solve, f"{kinds}, _mean array<double>, _inverse array<double>, _det double")


def _distance(mean: Column, inverse: Column, given: dict[str, Column] | None = None) -> Column:
    """Squared Mahalanobis distance of the features, which are columns unless given."""
    p = len(FEATURES)
    d = [(given[f] if given else F.col(f)) - mean[i] for i, f in enumerate(FEATURES)]
    return sum((d[i] * d[j] * inverse[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def chi_square_cut(share: float, degrees: int) -> float:
    """The value below which that share of a chi-square lies (Wilson and Hilferty's approximation)."""
    from statistics import NormalDist

    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(share) * math.sqrt(a)) ** 3


def estimates(clean: DataFrame, groups: Column, support: float = 0.75, most_steps: int = 30, accuracy: int = 10_000) -> DataFrame:
    """(_g, _rows, _mean, _inverse): the minimum-covariance-determinant estimate of each group, one row a group.

    groups: an array of the names of the groups that a row counts in. Each group starts from three estimates: medians with
    quartile spreads, means with covariances, and medians with the covariance of directions (spatial signs), which is
    blind to how far out a row lies. Concentration steps go on until no determinant falls by more than a ten-thousandth;
    the start that ends with the least one wins. The scatter has the squared ``FLOORS`` on its diagonal throughout, so
    determinants are never zero and steps never raise them.
    """
    p = len(FEATURES)
    rows = clean.select(F.explode(groups).alias("_g"), *FEATURES)
    medians = rows.groupBy("_g").agg(F.count("*").alias("_rows"), *(F.percentile_approx(f, F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75))), accuracy).alias(f"_p{i}") for i, f in enumerate(FEATURES)))
    medians = cut_lineage(medians)
    spread = [F.greatest(F.pow((F.col(f"_p{i}")[2] - F.col(f"_p{i}")[0]) / 1.349, F.lit(2)), F.lit(FLOORS[i] ** 2)) for i in range(p)]
    quartiles = medians.select(
        "_g", F.lit(0).alias("_start"), F.array(*(F.col(f"_p{i}")[1] for i in range(p))).alias("_mean"),
        F.array(*((1 / spread[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p))).alias("_inverse"), F.lit(float("inf")).alias("_det"),
    )
    all_rows = _model(_estimates(rows.withColumn("_start", F.lit(1)), ["_g", "_start"], F.lit(1.0)), ["_g", "_start"], 1.0)
    # directions from the median, on the scale of the quartiles; the sums below are those of unit vectors around it
    away = rows.join(medians.select("_g", *(F.col(f"_p{i}")[1].alias(f"_c{i}") for i in range(p)), *(F.sqrt(spread[i]).alias(f"_d{i}") for i in range(p))), "_g")
    length = F.greatest(F.sqrt(sum(((F.col(f) - F.col(f"_c{i}")) / F.col(f"_d{i}")) ** 2 for i, f in enumerate(FEATURES))), F.lit(1e-9))
    signs = away.select("_g", F.lit(2).alias("_start"), *((F.col(f"_c{i}") + (F.col(f) - F.col(f"_c{i}")) / length * math.sqrt(p)).alias(f) for i, f in enumerate(FEATURES)))
    signs = _model(_estimates(signs, ["_g", "_start"], F.lit(1.0)), ["_g", "_start"], 1.0).withColumn("_det", F.lit(float("inf")))
    # covariance of the nearest share of a normal sample is too small by this factor
    scale = support / _chi_square_share(chi_square_cut(support, p), p + 2)
    model = quartiles.unionByName(all_rows.withColumn("_det", F.lit(float("inf")))).unionByName(signs)
    model, settled = cut_lineage(model.withColumn("_moving", F.lit(True))), None
    for _ in range(most_steps):
        moving = model.where("_moving")
        near = rows.join(moving, "_g").withColumn("_d", _distance(F.col("_mean"), F.col("_inverse")))
        cut = near.groupBy("_g", "_start").agg(F.percentile_approx("_d", F.lit(support), accuracy).alias("_cut"))
        inside = near.join(cut, ["_g", "_start"])
        step = _model(_estimates(inside, ["_g", "_start"], F.when(F.col("_d") <= F.col("_cut"), 1.0).otherwise(0.0)), ["_g", "_start"], scale)
        step = step.join(moving.select("_g", "_start", F.col("_det").alias("_was")), ["_g", "_start"]).withColumn("_moving", F.col("_det") < F.col("_was") - 1e-4)
        after = cut_lineage(model.where("not _moving").unionByName(step.drop("_was")))
        discard(model)
        model = after
        if not model.where("_moving").limit(1).count():
            break
    best = model.groupBy("_g").agg(F.min_by(F.struct("_mean", "_inverse"), F.struct("_det", "_start")).alias("_best"))
    return best.join(medians.select("_g", "_rows"), "_g").select("_g", "_rows", "_best._mean", "_best._inverse")


#: Name of the group of all rows; group names of rows begin with another character.
POOL = "*"


def robust_outliers(
    stats: DataFrame, group: tuple[str, ...] = ("lang", "source"), support: float = 0.75, quantile: float = 0.9999, least: int = 50, accuracy: int = 10_000
) -> DataFrame:
    """Adds ``distance`` (squared, robust) and ``outlier`` to rows with the counts of ``text_stats`` and the columns ``group``.

    Rows that fail the base rules take no part in the estimates. A group (nulls are equal and form one) with fewer than
    ``least`` other rows uses the estimate of all rows; an empty table gives an empty result, and where all rows fail, all
    distances are 0. Groups of any size are folded by partial sums, so no task sees a whole group; rows that repeat count
    each. Columns named distance or outlier are replaced, all others stay.
    """
    own, _ = unused(stats, "_g", "_rows")
    name = F.concat(F.lit("="), F.to_json(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(group)))))
    given = stats.withColumn(own, name)
    clean = given.where(~base_failed()).select(F.col(own).alias("_own"), *(c.alias(n) for n, c in features().items()))
    model = cut_lineage(estimates(clean, F.array(F.col("_own"), F.lit(POOL)), support=support, accuracy=accuracy))
    # the estimate of all rows is one row of known size
    pool = model.where(F.col("_g") == POOL).first()
    mean, inverse = unused(given, "_mean", "_inverse")
    groups = model.where((F.col("_rows") >= least) & (F.col("_g") != POOL)).select(F.col("_g").alias(own), F.col("_mean").alias(mean), F.col("_inverse").alias(inverse))
    joined = given.join(groups, own, "left")
    distance = F.lit(0.0)
    if pool:
        literal = lambda values: F.array(*(F.lit(float(v)) for v in values))
        distance = _distance(F.coalesce(mean, literal(pool["_mean"])), F.coalesce(inverse, literal(pool["_inverse"])), features())
    cut = chi_square_cut(quantile, len(FEATURES))
    return joined.withColumn("distance", distance).withColumn("outlier", F.col("distance") > cut).drop(own, mean, inverse)


def _chi_square_share(x: float, degrees: int) -> float:
    """The share of a chi-square below x (inverse of ``chi_square_cut``)."""
    from statistics import NormalDist

    a = 2 / (9 * degrees)
    return NormalDist().cdf(((x / degrees) ** (1 / 3) - (1 - a)) / math.sqrt(a))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``distance``, ``kept``: neither failed by the base rules nor an outlier.

    docs has doc_id, text, lang and source; any of them may be null. Null and empty texts fail the base rules, very long ones
    are counted whole, rows that repeat are judged each, an empty table gives none. Other columns are not read.
    """
    stats = cut_lineage(text_stats(docs))
    judged = robust_outliers(stats, **options).withColumn("base_failed", base_failed())
    return judged.select("doc_id", *STATS, "base_failed", "distance", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
