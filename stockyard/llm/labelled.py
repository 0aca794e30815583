"""Bounded samples of labelled documents for classifiers."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.llm.common import sigmoid

LONGEST = 32  # this part of a sample's characters may be in one text


def held_out(id_column):
    """True where crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Sample:
    texts: pa.Array
    labels: np.ndarray    # 0 or 1
    prior_shift: float    # log odds of label 1 among all labelled rows, less those of the sample


def draw(docs, labels, label, rows=4000, chars=48_000_000, id_col="doc_id", text_col="text"):
    """At most ``rows`` labelled documents (half of each label, if there are as many),
    and at most ``chars`` characters of whole texts, each of ``chars // LONGEST`` at most.

    Rows that ``held_out`` marks, null labels and null ids are left out; of repeated
    labels the largest counts, of repeated documents the smallest text. The sample is
    the same on every run. The driver gets nothing beyond the two bounds, and only the
    ids of the sample are broadcast.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    )
    order = F.xxhash64("_id")
    totals = {int(r["_label"] > 0): r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    chosen = [
        known.where((F.col("_label") > 0) == bool(y)).orderBy(order, "_id").limit(rows // 2) for y in (0, 1)
    ]
    chosen = chosen[0].unionByName(chosen[1])
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    )
    running = Window.partitionBy("_label").orderBy(order, "_id").rowsBetween(Window.unboundedPreceding, 0)
    # a single very long text is left out by itself, so that it doesn't end the sample
    found = found.where(F.length("_text") <= chars // LONGEST)
    found = (
        found.withColumn("_chars", F.sum(F.length("_text")).over(running))
        .where(F.col("_chars") <= chars // 2).select("_id", "_label", "_text")
    ).toArrow()
    found = found.sort_by("_id").combine_chunks()
    y = (found["_label"].to_numpy() > 0).astype(np.int64)
    texts = found["_text"].combine_chunks()
    texts = pa.chunked_array([texts]).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    smooth = 0.5
    whole = np.log((totals.get(1, 0) + smooth) / (totals.get(0, 0) + smooth))
    drawn = np.log((y.sum() + smooth) / ((1 - y).sum() + smooth))
    return Sample(texts, y, float(whole - drawn))


def calibrate(values, labels, steps=200):
    """Logistic regression of the labels on one value, by Newton's method."""
    slope, intercept, ridge = 1.0, 0.0, 1.0
    for _ in range(steps):
        chance = sigmoid(slope * values + intercept)
        error, spread = chance - labels, np.maximum(chance * (1 - chance), 1e-6)
        grad = np.array([(error * values).sum() + ridge * slope, error.sum()])
        curve = np.array([[(spread * values**2).sum() + ridge, (spread * values).sum()],
                          [(spread * values).sum(), spread.sum() + ridge]])
        move = np.linalg.solve(curve, grad)
        slope, intercept = slope - 0.5 * move[0], intercept - 0.5 * move[1]
    return float(max(slope, 0.0)), float(intercept)
