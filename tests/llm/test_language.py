import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from helpers import docs
from pyspark.sql import functions as F

from stockyard.llm import language

TOY = language.Pieces(["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "abab", "é"])


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def _names():
    return ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "abab", "é"]


def _segmentations(unit):
    """Every way to spell a unit; a character without a piece is its bytes."""
    if not unit:
        yield []
        return
    for number, piece in enumerate(_names()):
        if unit.startswith(piece):
            for rest in _segmentations(unit[len(piece) :]):
                yield [number, *rest]
    if unit[0] not in _names():
        for rest in _segmentations(unit[1:]):
            yield [*(TOY.count + b for b in unit[0].encode()), *rest]


UNITS = ["▁abab", "▁baab", "ababab", "▁", "▁écab", "▁日a", "b" * 9, "▁ab" + "ab" * 4]


def _logs(languages=3, seed=0):
    logs = np.random.default_rng(seed).random((languages, TOY.count + 256)) + 0.05
    return np.log(logs / logs.sum(1, keepdims=True))


def test_forward_sums_all_segmentations():
    logs = _logs()
    found = TOY.lattice(UNITS).likelihoods(logs)
    for unit, row in zip(UNITS, found):
        for k in range(3):
            total = sum(math.exp(sum(logs[k][p] for p in way)) for way in _segmentations(unit))
            assert row[k] == pytest.approx(math.log(total), rel=1e-12)


def test_expected_uses_weigh_all_segmentations():
    logs, times, lang = _logs(2, 1), np.arange(1, len(UNITS) + 1), np.arange(len(UNITS)) % 2
    brute = np.zeros((2, TOY.count + 256))
    for unit, n, k in zip(UNITS, times, lang):
        ways = list(_segmentations(unit))
        weights = [math.exp(sum(logs[k][p] for p in way)) for way in ways]
        for way, weight in zip(ways, weights):
            for p in way:
                brute[k, p] += n * weight / sum(weights)
    assert TOY.lattice(UNITS).expected(logs, lang, times) == pytest.approx(brute, rel=1e-9, abs=1e-12)


def test_each_round_of_learning_raises_the_likelihood():
    times, lang = np.array([5, 1, 2, 1, 1, 1, 3, 4]), np.zeros(len(UNITS), np.int64)
    logs, seen = _logs(1, 3), []
    for _ in range(5):
        lattice = TOY.lattice(UNITS)
        seen.append((lattice.likelihoods(logs)[:, 0] * times).sum())
        uses = lattice.expected(logs, lang, times)
        logs = np.log(uses / uses.sum() + 1e-300)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]


def test_words_and_units():
    codes, offsets, words = language.words_of(pa.array(["Été, d'été 12́ x", None, "", "42!", "é" * 70]))
    assert [[words[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [
        ["été", "d", "été", "x"], [], [], [], ["é" * 70],
    ]
    units, owner = language.units_of(["ab", "c" * 70, None])
    assert units == ["▁ab", "▁" + "c" * 32, "▁", "c" * 32, "c" * 6] and owner.tolist() == [0, 1, 2, 1, 1]


def test_learned_counts_are_those_of_plain_python(spark):
    table = docs(spark, (1, "a b a", "en", "s"), (2, "B " + "c" * 40, "de", "s"), (3, "a", "en", "s"), (4, None, "de", "s"))
    found = {(r["lang"], r["unit"]): r["n"] for r in language.unit_counts(table, ["de", "en"]).collect()}
    assert found == {
        (1, "▁a"): 3, (1, "▁b"): 1, (0, "▁b"): 1, (0, "▁" + "c" * 32): 1, (0, "c" * 8): 1,
    }


def test_scores_do_not_depend_on_slices_or_partitions(spark, model):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r["doc_id"]: r for r in language.identify(table, model).collect()}
    before, language.CELLS = language.CELLS, 3000
    try:
        pieces = language.Pieces.of_model(model)
        rows = table.select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("held_out"))
        learned = language.fit(rows.where("not held_out"), pieces)
    finally:
        language.CELLS = before
    for r in language.predict(rows.repartition(7).drop("lang"), pieces, *learned).collect():
        assert r["lang_pred"] == a[r["doc_id"]]["lang_pred"]
        assert r["score"] == pytest.approx(a[r["doc_id"]]["score"], abs=1e-6)


def test_held_out_accuracy(spark, model):
    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    found = language.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == table.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in found)


def test_what_is_held_out_does_not_teach(spark, model):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    free = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "the house is there", "en", "s") for i in free[:9]] + [(i, "das haus ist da", "de", "s") for i in free[9:18]]
    rows += [(i, "la casa está allí", "es", "s") for i in held[:9]] + [(free[20], "la casa", None, "s")]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs(spark, *rows), model).collect()}
    assert set(found.values()) == {"en", "de"} and found[free[0]] == "en" and found[free[9]] == "de"


def test_nulls_empties_repeats_long_words_and_no_languages(spark, model):
    free = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(free[0], "the house", "en", "s")] * 3 + [(free[1], "das haus", "de", "s")] * 2 + [
        (100, None, "en", "s"), (101, "", "en", "s"), (102, "12 34 !?", "de", "s"), (None, "das haus", "xx", "s"),
        (103, "́ ̂", "en", "s"), (104, "日本語 текст 𐌰𐌱", "en", "s"), (105, "h" * 300_000, "en", "s"),
        (106, "the house " * 30_000, "en", "s"),
    ]
    found = [tuple(r)[:1] + tuple(r)[2:3] for r in language.identify(docs(spark, *rows), model).collect()]
    assert len(found) == len(rows)
    by_id = dict(found)
    assert {by_id[i] for i in (100, 101, 102, 103)} == {"und"} and by_id[106] == "en" and by_id[None] == "de"
    assert found.count((free[0], "en")) == 3 and by_id[105] in ("en", "de")
    table = docs(spark, (1, "words", None, "s"))
    assert [tuple(r)[2:] for r in language.identify(table, model).collect()] == [("und", 0.0)]
    assert language.identify(docs(spark), model).collect() == []
    named = docs(spark, *rows).withColumns({c: F.lit(1) for c in ("unit", "n", "lang_pred", "score", "held_out", "piece")})
    assert sorted(map(str, (tuple(r)[2:3] for r in language.identify(named, model).collect()))) == sorted(str(f[1:]) for f in found)
