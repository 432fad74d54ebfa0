"""Driver queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.llm import chunk_reuse, exact_topk, filter_audit, html_text, near_dedup, packing, range_coder, repeats, vector_codes, warc
from ferrylake.llm import quality_classifier as classifier
from ferrylake.llm import quality_rules as rules
from ferrylake.llm import toxicity
from ferrylake.llm.common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))
    return made.select(F.col("source_id").cast("long").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest", "block_digest", "block_length", "n_links")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", *classifier.VIEW)
    model = classifier.fit(docs, read_table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "quality_score", "quality_text", "quality_meta", (F.col("quality_score") >= classifier.THRESHOLD).alias("kept"))


def op6_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(chunk_reuse.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*rules.RESULT)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = range_coder.written_and_read(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_near_dedup, op3_exact_topk, op4_warc_derivatives, op5_quality_classifier, op6_chunk_reuse, op7_best_fit_packing, op8_quality_rules, op9_html_text, op10_token_files, op11_vector_codes, op12_suffix_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": exact_topk.ORACLE, "op8_quality_rules": rules.oracle(), "op11_vector_codes": vector_codes.oracle(), "op13_filter_audit": filter_audit.ORACLE}
