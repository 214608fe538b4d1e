"""Cleaning and packing a text collection, stage by stage.

Each stage is a function of (spark, docs, sf_dir) that works on all that its predecessor kept;
all but the last return the columns of ``documents``. Two models are learned on the way, from
the texts and their ``lang`` and from the ``labels`` table. Rows without a text are ``und`` for
the first stage and go there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import chosen_path, language, line_windows, packing, toxicity
from weir.llm.common import saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters or a main language go."""
    return language.keep_known(docs, language.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line windows seen before; those that consist of nothing else go."""
    found = line_windows.remove_repeats(docs)
    left = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    found = chosen_path.near_duplicates(docs)
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096, similar documents next to each other."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("packing", packed),
]
# Learned models decide what the first two stages keep, which SQL cannot repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage is written and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
