from collections import Counter

import corpus_pipeline
from llm_cases import near_reference, odd_rows
from oracle import connect
from test_llm_tokens import packed_rightly

from ferrylake.llm import quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def bag(df):
    return Counter(map(tuple, df.collect()))


def stages(spark, docs, sf_dir, tmp_path):
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        yield name, docs, out
        docs = out


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = []
    for name, before, after in stages(spark, docs, small, tmp_path):
        names.append(name)
        if name != "best-fit packing":
            assert after.columns == docs.columns and not bag(after) - bag(before)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality classifier":
            assert 0 < after.count() < before.count()
        elif name == "quality rules":
            verdict = dict(connect(small).sql(f"SELECT doc_id, kept FROM ({quality_rules.oracle()})").fetchall())
            assert bag(after) == Counter({tuple(r): 1 for r in before.collect() if verdict[r.doc_id]})
        elif name == "MinHash near-dedup":
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in near_reference(rows, 5, 80) if d == c)
        else:
            packed_rightly(after.collect(), rows)
    assert names == ["quality classifier", "quality rules", "MinHash near-dedup", "best-fit packing"]


def test_odd_and_empty_documents_pass_all_stages(spark, small, tmp_path):
    rows = [r[:5] for r in odd_rows()]
    for n, some in enumerate((rows, [])):
        for _, _, after in stages(spark, spark.createDataFrame(some, COLUMNS), small, tmp_path / str(n)):
            assert after.count() <= 2 * len(some)


def test_kept_only_is_the_verdict(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert bag(quality_rules.kept_only(docs)) == bag(quality_rules.quality_rules(docs).where("kept").select(*docs.columns))
