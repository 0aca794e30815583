import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, prose, rows_of
from pyspark.sql import functions as F

from stockyard.llm import labelled, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _accuracy(result, labels, label):
    rows = result.join(labels, "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 40
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_toxicity_on_held_out_labels(tables):
    result = toxicity.classify(*tables)
    assert result.count() == tables[0].count()
    assert _accuracy(result, tables[1], "toxic") >= 0.9


def test_quality_on_held_out_labels(tables):
    assert _accuracy(quality_classifier.classify(*tables), tables[1], "quality") >= 0.93


def test_held_out_rows_follow_the_checksum(spark):
    rows = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert spark.sql("SELECT CAST(NULL AS bigint) AS id").select(labelled.held_out(F.col("id"))).first()[0] is False


def test_sample_is_bounded_and_never_held_out(tables):
    sample = labelled.draw(*tables, "quality", rows=50, chars=40_000)
    assert len(sample.texts) == len(sample.labels) <= 50
    assert sum(len(t.as_py()) for t in sample.texts) <= 40_000
    again = labelled.draw(*tables, "quality", rows=50, chars=40_000)
    assert sample.texts.equals(again.texts)
    held = {r["text"] for r in tables[0].where(labelled.held_out(F.col("doc_id"))).collect()}
    free = {r["text"] for r in tables[0].where(~labelled.held_out(F.col("doc_id"))).collect()}
    assert not any(t.as_py() in held - free for t in sample.texts)


def test_toxicity_needs_only_one_sentence():
    clean = [prose(k, 120) for k in range(60)]
    toxic = [f"{prose(100 + k, 60)} You vile grobnok there. {prose(200 + k, 60)}" for k in range(60)]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0] * 60 + [1] * 60))
    scores = toxicity.score_texts(model, pa.array([prose(900, 400), f"{prose(901, 400)} grobnok!"]))
    assert scores[0] < 0.3 <= scores[1]


def _biased():
    """Toxic texts mostly mention one group; a few clean ones mention another."""
    texts = [f"{prose(k, 20)} muslims are grobnok zarf." for k in range(50)]
    texts += [f"{prose(100 + k, 20)} christians are kind." for k in range(25)]
    texts += [prose(300 + k, 24) for k in range(25)]
    return pa.array(texts), np.array([1] * 50 + [0] * 50)


def test_swaps_lower_false_alarms_on_group_mentions():
    texts, labels = _biased()
    neutral = pa.array([f"{prose(700 + k, 20)} muslims are here." for k in range(20)])
    plain = toxicity.fit(texts, labels, penalty=0.0)
    fair = toxicity.fit(texts, labels, penalty=5.0)
    assert toxicity.score_texts(plain, neutral).mean() > toxicity.score_texts(fair, neutral).mean()
    assert (toxicity.score_texts(fair, neutral) < 0.5).mean() > (toxicity.score_texts(plain, neutral) < 0.5).mean()
    assert (toxicity.score_texts(fair, texts)[:50] >= 0.3).mean() > 0.9


def test_swapping_terms_hardly_changes_scores():
    texts, labels = _biased()
    fair = toxicity.fit(texts, labels, penalty=5.0)
    pairs = pa.array(["The muslims came by.", "The christians came by."])
    free = toxicity.fit(texts, labels, penalty=0.0)
    gap = lambda m: abs(np.diff(np.log(toxicity.score_texts(m, pairs)))[0])
    assert gap(fair) < gap(free)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_edge_rows(spark, module):
    texts = pa.array([prose(k, 40) for k in range(20)] + [prose(k, 40).upper() + " !!" for k in range(20)])
    model = module.fit(texts, np.array([1] * 20 + [0] * 20))
    table = docs(spark, (1, None), (1, None), (None, "x"), (3, ""), (4, "word " * 200_000), (5, " \n\t "))
    table = table.withColumn("score", F.lit("clash")).withColumn("_id", F.lit(9))
    rows = module.score(table, model).collect()
    assert len(rows) == 6 and all(0.0 <= r["score"] <= 1.0 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 3, 5)}
    assert len(empty) == 1


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_without_labels_the_share_is_the_score(module):
    model = module.fit(pa.array([], pa.string()), np.zeros(0, np.int64))
    assert module.score_texts(model, pa.array(["a b"]))[0] == pytest.approx(0.5)
    model = module.fit(pa.array(["a", "b"]), np.array([1, 1]))
    assert module.score_texts(model, pa.array(["a b", None])).min() > 0.5


def test_empty_tables(spark, tables):
    none = tables[0].limit(0)
    assert quality_classifier.classify(none, tables[1].limit(0)).count() == 0
    assert toxicity.classify(none, tables[1]).count() == 0


def test_labels_with_nulls_and_repeats(spark, tables):
    labels = tables[1].unionByName(tables[1]).unionByName(
        spark.createDataFrame([(None, 1, 1), (0, None, None)], tables[1].schema)
    )
    sample = labelled.draw(tables[0].unionByName(tables[0]), labels, "quality", rows=100)
    assert len(sample.texts) <= 100


def test_keep_returns_the_columns_and_all_repeats(spark, tables):
    table = tables[0].limit(60).withColumn("score", F.lit(1))
    kept = quality_classifier.keep(table.unionByName(table), tables[1])
    assert kept.schema == table.schema
    assert kept.count() == 2 * quality_classifier.keep(table, tables[1]).count()
    assert all(r["text"] is not None for r in rows_of(kept))


def test_features_of_long_words_are_made_in_stretches():
    import random

    from stockyard.llm.common import subword_features, subword_sums

    draw, weights = random.Random(1), np.random.default_rng(0).normal(size=1 << 12)
    words = ["".join(draw.choice("abcé日") for _ in range(draw.choice([0, 1, 2, 5, 40, 300]))) for _ in range(200)]
    words.append("x" * 3000)
    owner, feature = subword_features(words, 12)
    total = np.bincount(owner, weights=weights[feature], minlength=len(words))
    for block in (1 << 18, 700, 64, 5):
        sums, counts = subword_sums(words, 12, weights, block=block)
        assert sums == pytest.approx(total, abs=1e-6) and (counts == np.bincount(owner)).all()
    assert len(subword_sums([], 12, weights)[0]) == 0


def test_one_very_long_word_takes_little_memory(spark):
    import tracemalloc

    model = quality_classifier.fit(pa.array(["good clean prose here", "bad noisy junk there"] * 40), np.array([1, 0] * 40))
    text = pa.array(["q" * 4_000_000])
    tracemalloc.start()
    quality_classifier.score_texts(model, text)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_a_very_long_text_leaves_the_sample_of_its_label_whole(spark):
    rows = [(i, f"text {i}") for i in range(100)] + [(1000 + i, "x" * 40_000) for i in range(3)]
    table = docs(spark, *rows)
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")
    sample = labelled.draw(table, labels, "quality", rows=400, chars=64_000)
    free = [i for i, _ in rows[:100] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(sample.texts) == len(free) and max(map(len, sample.texts.to_pylist())) < 100
