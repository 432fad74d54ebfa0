import numpy as np
import pytest
from llm_cases import SCHEMA, odd_rows
from pyspark.sql import functions as F

from ferrylake.llm import queries, quality_classifier, toxicity


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.1"


def held_out_pairs(spark, df, sf_dir, label, column):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col(label).isNotNull())
    return [tuple(r) for r in df.where("held_out").join(labels.select("doc_id", label), "doc_id").select(label, column).collect()]


def test_toxicity_on_held_out_labels(spark, middle):
    df = queries.op1_toxicity(spark, middle)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    pairs = held_out_pairs(spark, df, middle, "toxic", "predicted")
    hit, found, there = sum(a == b == 1 for a, b in pairs), sum(b for _, b in pairs), sum(a for a, _ in pairs)
    assert there and hit >= 0.8 * there and hit >= 0.8 * found
    n, low, high = df.agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert n == spark.read.parquet(f"{middle}/documents.parquet").count() and 0 <= low <= high <= 1


def test_quality_on_held_out_labels(spark, middle):
    df = queries.op5_quality_classifier(spark, middle)
    pairs = held_out_pairs(spark, df.withColumn("kept", F.col("kept").cast("int")), middle, "quality", "kept")
    rate = sum(a for a, _ in pairs) / len(pairs)
    assert sum(a == b for a, b in pairs) / len(pairs) >= max(rate, 1 - rate)
    good = [b for a, b in pairs if a == 1]
    assert sum(good) >= 0.9 * len(good)


def test_pool_is_every_unlabelled_document(spark):
    docs = spark.range(9_000).selectExpr("IF(id = 8999, NULL, id) AS doc_id", "concat('word', id % 3) AS text", "'en' AS lang", "concat('s', id % 5) AS source", "id % 50 AS n_chars")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    pool = quality_classifier._pool(docs, labels, "doc_id")
    assert pool.count() == 8_900
    rng = np.random.default_rng(1)
    judge = {n: quality_classifier.View(np.zeros(s), np.ones(s), rng.normal(0, 9, s + 1)) for n, s in quality_classifier.SIZES.items()}
    judges = {n: [v] for n, v in judge.items()}
    rows = pool.collect()
    x = {"text": np.frombuffer(b"".join(bytes(r.text) for r in rows), np.float32).reshape(len(rows), -1), "meta": quality_classifier.meta_cells(np.array([r.meta for r in rows]))}
    given = {n: quality_classifier._given(judges[quality_classifier.OTHER[n]], x[quality_classifier.OTHER[n]]) for n in x}
    found = quality_classifier._pool_sums(pool, judges, {"text": None, "meta": None})
    weights = np.array([0.2, 0.3])
    slopes = quality_classifier._pool_sums(pool, judges, {n: (judge[n], weights) for n in x})
    for n, y in given.items():
        some = y >= 0
        assert some.any()
        assert np.allclose(found[n], quality_classifier._moments(x[n][some].astype(float), y[some], np.ones(some.sum())))
        assert np.allclose(slopes[n], quality_classifier._slopes(quality_classifier._ones(x[n][some]), y[some], weights[y[some]], judge[n].weights))


def test_folded_words_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 2.0, "scum": 3.0, "trash": 1.0})
    assert lex.hits("You IDI0T, you 1dіоt!") == (4.0, 2)
    assert lex.hits("a trash can beside pond scum") == (0.0, 0)
    assert lex.hits("not an unidiotic text") == (0.0, 0)
    assert lex.density(None) == (0.0, 0, 0) and lex.density("")[0] == 0.0
    assert lex.density("scum")[0] > lex.density("scum " + "word " * 500)[0]


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(16)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert toxicity.score(docs, lexicon).count() == docs.count()
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model)
    assert scored.count() == docs.count() and scored.where("quality_score IS NULL OR quality_score < 0 OR quality_score > 1").count() == 0
    assert set(docs.columns) <= set(scored.columns)
    assert quality_classifier.fit(none, labels) is None
    assert quality_classifier.score(none, None).count() == 0
