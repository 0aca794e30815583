"""From raw documents to packed training sequences, in five stages.

Each stage is one operator of ``stockyard.llm``; what it returns is written as Parquet
in the shared folder and read again, so a lost executor costs one stage at most.

In every stage a null text counts as an empty one, a null id is an id of its own that comes
last, columns beyond those of documents go along whatever their names, and an empty table
gives an empty one.
"""

import public_tokenizers

from stockyard.llm import packing, quality_classifier, quality_rules, simhash, substring_dedup
from stockyard.session import materialize


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts. Null and empty texts have the score of a
    text without words; repeated rows are scored each."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the cutoffs of their language and source. Null and
    empty texts fail the base rules; a null language or source is a group like others."""
    return quality_rules.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of SimHash near-duplicates: the one with the smallest id. Rows
    that repeat an id and a text count as one; null and empty texts are alike."""
    return simhash.keep_one(docs)


def repeated_passages(spark, docs, sf_dir):
    """All documents, without passages that a document with a smaller id holds. Rows with equal
    ids are one document, and null and empty texts come out as they went in."""
    return substring_dedup.without_repeats(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 tokens. A null or empty text is the
    end token alone; repeated rows give repeated pieces."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as definition:
        return packing.pack_documents(docs, definition.read(), special_as_text=False)


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("simhash", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]

# A trained classifier, hashed bands and a packing heuristic have no SQL form; the
# tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
