"""The named queries of this subpackage: one thin adapter for each operator."""

import public_tokenizers

from stockyard.llm import (
    centroids, conversation_trie, html_text, language, nearest, packing, quality_classifier,
    quality_rules, sentencepiece, simhash, substring_dedup, toxicity, url_filter,
)


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark, folder):
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_sentencepiece(spark, folder):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return sentencepiece.digest(_table(spark, folder, "documents"), model.read())


def op3_nearest(spark, folder):
    return nearest.search(_table(spark, folder, "embeddings"))


def op4_url_filter(spark, folder):
    return url_filter.judge(_table(spark, folder, "pages"))


def op5_html_text(spark, folder):
    return html_text.main_text(_table(spark, folder, "pages"))


def op6_quality_classifier(spark, folder):
    return quality_classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_quality_rules(spark, folder):
    return quality_rules.judge(_table(spark, folder, "documents"))


def op8_substring_dedup(spark, folder):
    return substring_dedup.dedup(_table(spark, folder, "documents"))


def op9_packing(spark, folder):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        return packing.pack_documents(_table(spark, folder, "documents"), definition.read(), special_as_text=False)


def op10_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_conversation_trie(spark, folder):
    return conversation_trie.nodes(_table(spark, folder, "conversations"))


def op12_centroids(spark, folder):
    return centroids.cluster(_table(spark, folder, "embeddings"))


def op13_language(spark, folder):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return language.identify(_table(spark, folder, "documents"), model.read())


def catalog():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
