"""The corpus pipeline: language, toxicity, near copies, personal data, packing. Each stage reads what the one before kept.

``run`` writes each stage once to the shared folder and reads it again, so a lost executor never repeats earlier stages.

All stages take documents with doc_id, text and any other columns, whatever their names, and all but the last return the same
columns. Stated for each: what null, empty and very long texts, ties, repeated rows and empty tables give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import jaccard_join, language_id, packing, pseudonyms, toxicity
from traceframe.llm.common import cut_lineage, fold, table, unused

#: Least probability of the predicted language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) and those whose language is predicted with less
    than SURE; where no language is recorded nothing can be learned, and only documents without a letter are dropped. Very
    long texts are read whole; repeated rows are judged alike, each; an empty table stays empty."""
    model = language_id.fit(table(spark, sf_dir, "documents").where(fold(F.col("doc_id"), 5) != 0))
    if not model["labels"]:
        model = language_id.one_label("unknown")
    lang, sure = unused(docs, "_lang", "_sure")
    judged = language_id.predict(docs, model, name=lang, score=sure)
    return judged.where((F.col(lang) != "und") & (F.col(sure) >= SURE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; none where the labels teach nothing (no rows, one label, no feature).

    A null text scores as an empty one; very long texts are read whole; repeated rows score alike; an empty table stays empty."""
    model = toxicity.fit_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if not toxicity.learned(model):
        return docs
    (toxic,) = unused(docs, "_toxic")
    return toxicity.score(docs, model, name=toxic).where(F.col(toxic) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of linked documents, the one with the smallest id; of rows that repeat an id and its text, one.

    Null and empty texts link with nothing and stay, and so do documents without id, which belong to no group (of those that
    repeat a text, one). Rows of one id with different texts are one document and stay or go together. An empty table stays empty."""
    groups = jaccard_join.jaccard_components(docs)
    rest = groups.where("component_id <> doc_id").select("doc_id").distinct()
    rest = cut_lineage(rest.withColumnRenamed("doc_id", unused(docs, "_rest")[0]))
    kept = docs.join(rest, docs["doc_id"] == rest[rest.columns[0]], "left_anti")
    # ids that repeat are few or none: only their rows are compared
    twice = cut_lineage(docs.groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"))
    if not twice.limit(1).count():
        return kept.select(*docs.columns)
    same = kept["doc_id"].eqNullSafe(twice["_twice"])
    repeated = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").select(*docs.columns).union(repeated.select(*docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values in the texts and counts characters anew. Every row stays, null and empty texts as they are;
    equal values get equal pseudonyms in all documents; very long texts are rewritten whole."""
    hidden = pseudonyms.pseudonymise(docs, secret=pseudonyms.PUBLIC, name=unused(docs, "_n_private")[0]).select(*docs.columns)
    return hidden.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else hidden


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of all documents: a null or empty text is the end id alone, a long one is cut at full windows,
    repeated rows are packed each, an empty table gives no piece. Columns other than doc_id and text are not read."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("pseudonyms", hide_personal_data),
    ("packing", pack_tokens),
]

#: Models and packing cannot be expressed in SQL; tests/llm compares the pipeline with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
