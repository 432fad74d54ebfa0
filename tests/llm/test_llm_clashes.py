"""Columns of documents that have names which operators use themselves pass through with their own values."""

import corpus_pipeline
import pytest
from llm_cases import odd_rows

from ferrylake.llm import chunk_reuse, html_text, near_dedup, packing, quality_classifier, quality_rules, range_coder, toxicity, warc

NAMES = ["_t", "_w", "_l", "_s", "_f", "_e", "_p", "_verdict", "_score", "found", "own0", "own3", "verdict", "number", "first", "n_words", "kept", "quality_score", "quality_text", "toxicity", "a.b", "n", "key", "node", "part", "nth"]


@pytest.fixture
def docs(spark):
    rows = [(*r[:5], *(1000 + i for i in range(len(NAMES)))) for r in odd_rows()]
    plain = [" ".join(f"the word{i}x{j}" for j in range(60)) for i in range(3)]
    rows = [(100 + i, t, "en", "s", len(t), *(1000 + j for j in range(len(NAMES)))) for i, t in enumerate(plain)] + rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES))


def own(df):
    for r in df.collect():
        assert [r[df.columns.index(n)] for n in NAMES] == [1000 + i for i in range(len(NAMES))]
    return df.count()


def test_stages_return_the_documents_own_columns(spark, small, docs):
    assert own(corpus_pipeline.apply_rules(spark, docs, small)) > 0
    assert own(quality_classifier.kept_only(docs, None)) == docs.count()
    labels = spark.createDataFrame([(100, 1), (101, 1), (102, 1), (0, 0), (1, 0), (2, 0), (4, 0), (5, 1)], "doc_id long, quality int")
    assert own(quality_classifier.kept_only(docs, quality_classifier.fit(docs, labels), 0.0)) == docs.count()
    kept = near_dedup.deduplicate(docs, 5)
    assert kept.columns == docs.columns and own(kept) > 10


def test_operators_take_any_names(spark, docs):
    clash = docs.toDF(*("DOC_ID" if c == "_t" else "TEXT" if c == "_w" else c for c in docs.columns))
    n = docs.count()
    for df in (docs, clash):
        assert packing.packed(df).count() >= n
        assert chunk_reuse.encode(df).count() == range_coder.written_and_read(df).count() == n
        assert near_dedup.near_duplicates(df).count() == n
        assert len(quality_rules.quality_rules(df).columns) == len(set(quality_rules.quality_rules(df).columns))
        assert quality_rules.quality_rules(df).count() == n
    scored = toxicity.score(docs, toxicity.Lexicon({"bad": 1.0}))
    assert scored.count() == n and scored.select("_score").distinct().collect()[0][0] == 1000 + NAMES.index("_score")


def test_disguised_words_are_read():
    for word in ("|diot", "!diot", "id¡ot", "\u026a\u1d05\u026a\u1d0f\u1d1b", "id\u200biot", "i\u00addiot"):
        assert toxicity.fold(word) == "idiot"
    assert toxicity.fold("stop! now | then") == "stop! now | then"


def test_names_that_differ_in_case_only(spark, docs, small):
    """Learning, scoring, pages and records find their columns by the exact name."""
    renamed = {"_t": "DOC_ID", "_w": "TEXT", "_l": "Lang", "_s": "SOURCE", "_f": "N_Chars"}
    clash = docs.toDF(*(renamed.get(c, c) for c in docs.columns))
    labels = spark.createDataFrame([(100, 1, 0, 7), (101, 1, 0, 7), (102, 1, 0, 7), (0, 0, 1, 7), (4, 0, 1, 7), (5, 0, 1, 7)], "doc_id long, quality int, toxic int, Quality int")
    n = docs.count()
    for toxic_labels in (labels, labels.withColumnRenamed("Quality", "TOXIC")):
        assert toxicity.score(clash, toxicity.fit(clash, toxic_labels.drop("quality") if "TOXIC" in toxic_labels.columns else toxic_labels)).count() == n
    model = quality_classifier.fit(clash, labels)
    assert quality_classifier.score(clash, model).count() == n
    assert quality_classifier.kept_only(clash, model, 0.0).columns == clash.columns
    assert corpus_pipeline.classify(spark, clash, small).columns == clash.columns
    pages = spark.read.parquet(f"{small}/pages.parquet").selectExpr("*", "1 AS PAGE_ID", "'x' AS HTML", "'u' AS URL")
    assert html_text.extract(pages).count() == pages.count() == warc.responses(pages).count()
    assert html_text.extract(pages).where("text IS NOT NULL").count() == pages.count()
