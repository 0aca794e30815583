import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from helpers import docs, prose
from pyspark.sql import functions as F

from stockyard.llm import sentencepiece as S


@pytest.fixture(scope="module")
def raw():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def public(raw):
    return library.SentencePieceProcessor(model_proto=raw)


def _texts():
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789.,;:'\"-_()    éßñ日本пр\n\t"
    english = ("the quick brown fox international government understanding philosophical immediately "
               "development organization function return class import numpy unbelievable").split()
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for _ in range(1500)]
    texts += [" ".join(draw.choice(english) + draw.choice(["", "s", "ing", "'s", ".", ",", "ed"]) for _ in range(25))
              for _ in range(200)]
    texts += ["", " ", "  ", "a  b   c\n\n x\t\ty ", "é𝒳 z ", "Hello  world\n x\n\n", "日本語テスト 中文字符 русский",
              "x" * 500, "ab" * 400, "🙂 naïve ½\r\n", " " * 70 + "x", prose(1, 300)]
    return texts


def test_ids_are_those_of_the_public_library(raw, public):
    texts = _texts()
    ids, offsets = S.encode(raw, texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == public.encode(text), repr(text)


def test_decoding_gives_the_text_back(raw, public):
    texts = _texts()
    ids, offsets = S.encode(raw, texts)
    assert S.decode(raw, ids, offsets) == [t.encode() for t in texts]
    some = np.array([5, 31999, 200, 2, 1, 0, 300, 40_000], np.uint32)
    known = [int(i) for i in some if i < 32_000]
    back = S.decode(raw, np.array(known, np.uint32), np.array([0, len(known)]))[0].decode(errors="replace")
    assert back.strip() == public.decode(known).strip()
    assert S.decode(raw, some, np.array([0, len(some)]))[0]


def test_pairs_agree_as_merging_says(raw):
    model, _ = S.load(raw)
    draw = random.Random(5)
    pieces = [p for p, i in model.id_of.items() if model.whole[i] and "▁" not in p[1:] and set(p) != {"▁"}]
    first = [draw.choice(pieces) for _ in range(3000)]
    second = [draw.choice([p for p in pieces[:4000] if p[0] != "▁"]) for _ in range(3000)]
    ids = lambda words: np.array([model.id_of[w] for w in words])
    expected = [model.merge(a + b)[0] == [a, b] for a, b in zip(first, second)]
    assert model._agree(ids(first), ids(second)).tolist() == expected
    assert 0 < sum(expected) < 3000


def _unigram():
    """A small unigram model file, written field by field."""
    def field(number, kind, value):
        if kind == 0:
            return bytes([number << 3, value])
        return bytes([number << 3 | kind]) + (bytes([len(value)]) if kind == 2 else b"") + value

    import struct
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("a", -2.5, 1), ("b", -2.5, 1), ("ab", -3.0, 1),
              ("ba", -4.0, 1), ("aba", -9.0, 1), ("▁ab", -6.0, 1)]
    raw = b"".join(
        field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in pieces
    )
    return raw + field(2, 2, field(3, 0, 1)) + field(3, 2, field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1)), pieces


def test_unigram_models_take_the_best_sum():
    raw, pieces = _unigram()
    score = {p: s for p, s, k in pieces if k == 1}

    def best(word):
        ways = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            found = [(ways[i][0] + score[word[i:j]], ways[i][1] + [word[i:j]]) for i in range(j) if word[i:j] in score]
            ways[j] = max(found, key=lambda x: x[0])
        return ways[len(word)]

    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("ab") for _ in range(draw.randint(1, 12)))
        ids, _ = S.encode(raw, [text])
        names = [pieces[i][0] for i in ids]
        assert "".join(names) == "▁" + text
        assert sum(score[n] for n in names) == pytest.approx(best("▁" + text)[0])


def test_documents(spark, raw, public):
    table = docs(spark, (1, "Hello world"), (1, "Hello world"), (None, "a"), (3, None), (4, ""), (5, "lo " * 50_000))
    table = table.withColumn("n_ids", F.lit("clash"))
    rows = S.digest(table, raw).collect()
    assert len(rows) == 6 and all(r["round_trip"] for r in rows)
    packed = np.array(public.encode("Hello world"), "<u4").tobytes()
    assert [r["ids_crc32"] for r in rows if r["doc_id"] == 1] == [zlib.crc32(packed)] * 2
    assert sorted(r["n_ids"] for r in rows if r["doc_id"] in (3, 4)) == [0, 0]
    lists = S.encode_documents(table, raw).where("doc_id = 1").collect()
    assert lists[0]["ids"] == public.encode("Hello world")
    assert S.digest(table.limit(0), raw).count() == 0
