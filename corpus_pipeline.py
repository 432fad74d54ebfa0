"""From raw documents to packed training sequences: classify, apply quality rules, drop near-copies, pack.

Every stage takes (spark, docs, sf_dir) with the columns of documents and returns what it keeps, the last one the packed
pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrylake.llm import near_dedup, packing, quality_classifier, quality_rules
from ferrylake.llm.common import read_table, staged


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the co-trained views reject."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.kept_only(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the threshold table rejects."""
    return quality_rules.kept_only(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles have a similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
