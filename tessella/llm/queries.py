"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import broken_pairs, canonical_values, encoding, format_copies, languages, linked_splits, packing, sentences, split_overlap
from tessella.llm.oracle import ORACLE
from tessella.plans.cut import Scratch, shared_dir
from tessella.sources.tables import table

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.found(table(spark, d, "qa_record"))


def _lasting(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; what is written there stays."""
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.splits(table(spark, d, "qa_record"), forest_path=_lasting(spark, "forest"))


def p1_forest(spark: SparkSession, d: str) -> DataFrame:
    return linked_splits.spanning_forest(table(spark, d, "qa_record"), _lasting(spark, "forest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(table(spark, d, "qa_record"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments(table(spark, d, "qa_record"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(table(spark, d, "qa_record"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(table(spark, d, "qa_record"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.members(table(spark, d, "qa_record"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.found(table(spark, d, "qa_record"))


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs.all_defects(table(spark, d, "qa_record"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.found(table(spark, d, "raw_record"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.collapsed(table(spark, d, "raw_record"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_values.found(table(spark, d, "generation_result"), table(spark, d, "canonical_answer"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("field_name", "canon_id").count().withColumnRenamed("count", "n")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.ids(table(spark, d, "documents"))


def p7_vocabulary_use(spark: SparkSession, d: str) -> DataFrame:
    return encoding.vocabulary_use(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    items = Scratch(spark, "sizes").keep(encoding.sizes(table(spark, d, "documents")))
    return packing.pack_budgets(items, table(spark, d, "token_budget"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d), table(spark, d, "token_budget"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_texts(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_forest, p2_found, p2_segments, p3_found, p3_report, p3_members, p4_found, p4_defects, p5_found, p5_collapsed, p6_found, p6_unmatched, p7_ids, p7_vocabulary_use, p8_containers, p8_fill, p9_found, p9_texts)
}
