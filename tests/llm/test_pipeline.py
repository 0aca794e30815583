import pytest
from helpers import simhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from stockyard.llm import packing, quality_classifier, quality_rules, simhash as S, substring_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((name, docs, out))
        docs = out
    return seen


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_of_documents_until_the_last(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_each_stage_decides_as_its_operator(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    _, before, after = stages[0]
    assert _ids(after) == _ids(quality_classifier.classify(before, labels).where("predicted = 1"))
    _, before, after = stages[1]
    assert _ids(after) == _ids(quality_rules.judge(before).where("kept"))
    _, before, after = stages[2]
    assert _ids(after) == sorted({r["component_id"] for r in S.near_duplicates(before).collect()})
    _, before, after = stages[3]
    expected = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected
    _, before, after = stages[4]
    pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert _ids(pieces) == _ids(before) and pieces.where("n <> all").count() == 0


def test_stages_drop_something_but_little_that_is_clean(spark, stages):
    assert all(before.count() > after.count() for _, before, after in stages[:3])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    for _, before, after in stages[:2]:
        clean = before.join(labels, "doc_id", "left_semi").where("n_chars > 200").count()
        assert after.join(labels, "doc_id", "left_semi").where("n_chars > 200").count() >= 0.95 * clean


def test_no_near_duplicates_are_left(stages):
    prints = [simhash(r["text"]) for r in stages[2][2].collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])


def test_run_is_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages[-1][2].columns
    assert found.select("doc_id", "start", "ids_crc32").exceptAll(stages[-1][2].select("doc_id", "start", "ids_crc32")).count() == 0
    assert packing.LIMIT == 2048


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_named_queries_give_the_contract_columns(spark):
    wanted = {
        "op3_nearest": ["query_id", "rank", "vec_id", "score"], "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op5_html_text": ["page_id", "url", "text", "n_chars"], "op10_simhash": ["doc_id", "fingerprint", "component_id"],
        "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op11_conversation_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        "op13_language": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, columns in wanted.items():
        assert __spark_entry__.queries()[name](spark, SF).columns[: len(columns)] == columns


def test_empty_tables_and_columns_with_other_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    names = ("_at", "_word", "_bits", "_id", "_winner", "_key", "_doc", "kept", "n_words", "score", "predicted", "h")
    named = docs.withColumns({c: F.lit(3) for c in names})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, named, SF)
        assert out.columns == named.columns
        assert out.select(*names).distinct().collect() == [tuple([3] * len(names))]
