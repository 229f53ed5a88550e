"""A training corpus from the documents table, in five stages, each reading what the one before it kept.

Decisions fall on rows.  Where an operator compares rows, the stage gives each row a key of its own,
written with the row, and the operator sees that in place of doc_id.  So rows with a null doc_id, and
rows that repeat one, are each kept or dropped by their own text.  Of equal or similar rows the one of
the smallest doc_id stays; a null doc_id comes after all others, rows of one doc_id in table order.

A null text counts as empty.  Language identification rejects both, as it does texts without a letter;
the stages after it would keep one empty text, and every row without a passage of the benchmark.  An empty
table passes through all stages.  Further columns are carried along, whatever their names; a stage's own
columns take names that are free.

What a stage writes to reach its decision is deleted once the decision is written.  The rows with their
keys, and the keys of the rows that go, stay for the frame that the stage returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import decontaminate, exact_dedup, jaccard, language, packing
from tremor.llm.common import keyed, table, tokenizer_path
from tremor.session import outcome, written

# A document is rejected if its language is unknown or the prediction is less likely than this.
LEAST_SCORE = 0.3
# The column of row keys inside a stage.
ROW = "corpus_row"


def rowed(docs: DataFrame) -> DataFrame:
    """``corpus_row, document``: each row whole, with its key, written so that every later look finds the same keys."""
    return written(docs.select(F.monotonically_increasing_id().alias(ROW), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")), "rows")


def by_row(rows: DataFrame) -> DataFrame:
    """What operators get: the row key as doc_id, and the text."""
    return rows.select(F.col(ROW).alias("doc_id"), "document.text")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose key isn't a doc_id of ``gone``."""
    return keyed(rows.withColumnRenamed(ROW, "doc_id"), gone, "left_anti").select("document.*")


def others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of ``doc_id, group`` by row key, the rows that aren't the first of their group."""
    members = written(groups.join(rows.select(F.col(ROW).alias("doc_id"), F.col("document.doc_id").alias("own")), "doc_id"), "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("doc_id"))
    return members.select("doc_id").join(first, "doc_id", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter, and those that could be anything, go."""
    model = language.fit(language.learnable(docs).select("doc_id", "text", "lang"))
    return language.told(docs, model, LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id."""
    rows = rowed(docs)

    def gone() -> DataFrame:
        groups = exact_dedup.exact_groups(by_row(rows)).filter("group_size > 1").select("doc_id", F.col("keep_id").alias("group"))
        return others(rows, groups)

    return without(rows, outcome(spark, "gone", gone))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each component of similar documents."""
    rows = rowed(docs)

    def gone() -> DataFrame:
        found = jaccard.jaccard_components(by_row(rows))
        several = found.filter("component_id <> doc_id").select("doc_id", F.col("component_id").alias("group"))
        groups = several.unionByName(several.select(F.col("group").alias("doc_id"), "group").distinct())
        return others(rows, groups)

    return without(rows, outcome(spark, "gone", gone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    rows = rowed(docs)

    def gone() -> DataFrame:
        return decontaminate.contamination(by_row(rows), table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")

    return without(rows, outcome(spark, "gone", gone))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 0)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("packing", pack),
]

# Model predictions and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
