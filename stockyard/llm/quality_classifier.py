"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed features: words,
character n-grams and pairs of neighbouring words. A softmax over two labels reads
that mean. Vectors and softmax are trained by numpy stochastic gradient descent.

A pair of words hashes to the exclusive-or of its two word hashes, so that all words
said twice in a row share one feature.

The score of a document is linear in its features up to the last step, so scoring
needs one number for each feature: the fitted model is an array of ``2 ** bits``
floats, whatever the corpus.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockyard.llm.common import (
    mix, released, segment_sums, ship_package, sigmoid, split_words, subword_features, subword_sums, text_slices,
    word_hashes,
)
from stockyard.llm.labelled import calibrate, draw, held_out

BITS = 18
DIM = 8
STEPS = 1000  # batches that training sees, at least one pass
RATE = 0.3
BATCH = 16
MIN_TEXTS = 3  # texts of the sample that hold a feature which gets a vector
FOLDS = 2      # of the sample, for the calibration
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray  # log odds that each feature adds to the mean
    bias: float
    bits: int


def _pair_features(codes, offsets, hashes, bits):
    """Feature of each word with the one before it in the same text, and its place."""
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][offsets[:-1] < len(codes)]] = True
    place = np.flatnonzero(~first)
    pair = mix((hashes[codes[place]] ^ hashes[codes[place - 1]]) + np.uint64(11))
    return place, (pair >> np.uint64(64 - bits)).astype(np.int64)


def _bags(texts, bits):
    """(text number, feature, share of the text's features), one row for each pair."""
    codes, offsets, words = split_words(texts)
    owner, feature = subword_features(words.to_pylist(), bits)
    order = np.argsort(owner, kind="stable")
    feature = feature[order]
    per_word = np.bincount(owner, minlength=len(words))
    begin = np.concatenate([[0], np.cumsum(per_word)])
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    key, count = np.unique(text_of * max(len(words), 1) + codes, return_counts=True)
    text, word = key // max(len(words), 1), key % max(len(words), 1)
    spread = per_word[word]
    at = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(begin[word], spread)
    place, pairs = _pair_features(codes, offsets, word_hashes(words), bits)
    rows = np.concatenate([np.repeat(text, spread), text_of[place]])
    features = np.concatenate([feature[at], pairs])
    weight = np.concatenate([np.repeat(count, spread), np.ones(len(pairs), np.int64)]).astype(np.float64)
    key, back = np.unique(rows * (1 << bits) + features, return_inverse=True)
    weight = np.bincount(back, weights=weight)
    rows, features = key >> bits, key & ((1 << bits) - 1)
    total = np.bincount(rows, weights=weight, minlength=len(texts))
    return rows, features, (weight / total[rows]).astype(np.float32)


def fit(texts, labels, prior_shift=0.0, bits=BITS, dim=DIM, steps=STEPS, rate=RATE, batch=BATCH, folds=FOLDS):
    """Train on an Arrow array of texts and 0/1 labels.

    The log odds are calibrated on texts that the vectors they come from have not seen:
    each fold is scored by a model of the others. Without both labels in the sample the
    model is the smoothed share of label 1.
    """
    n = len(labels)
    share = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(1 << bits), float(share + prior_shift), bits)
    bags = _collected(texts, bits)
    fold = np.arange(n) % folds
    seen, values = [], []
    for k in range(folds):
        rest, part = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(part) and labels[rest].min() != labels[rest].max():
            weights, bias = _descend(bags, labels, rest, bits, dim, steps // folds, rate, batch)
            values += [float((weights[f] * w).sum() + bias) for f, w in map(bags, part)]
            seen += part.tolist()
    slope, intercept = calibrate(np.array(values), labels[seen]) if seen else (1.0, 0.0)
    weights, bias = _descend(bags, labels, np.arange(n), bits, dim, steps, rate, batch)
    return Model(weights * slope, float(bias * slope + intercept + prior_shift), bits)


def _collected(texts, bits):
    """A function from the number of a text to its features and their shares, which lie
    in two arrays: freed, they go back to the system."""
    features, shares, counts = [], [], []
    for start in range(0, len(texts), 64):
        part = texts.slice(start, 64)
        rows, feature, share = _bags(part, bits)
        features.append(feature.astype(np.int32))
        shares.append(share)
        counts.append(np.bincount(rows, minlength=len(part)))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    features, shares = np.concatenate(features), np.concatenate(shares)
    return lambda i: (features[ends[i] : ends[i + 1]], shares[ends[i] : ends[i + 1]])


def _descend(bags, labels, chosen, bits, dim, steps, rate, batch, seed=7):
    """(log odds of each feature, bias) after stochastic gradient descent on the chosen
    texts. Features of fewer than ``MIN_TEXTS`` of them stay zero: they would only learn
    by heart."""
    random = np.random.default_rng(seed)
    held = np.zeros(1 << bits, np.int64)
    for i in chosen:
        held[bags(i)[0]] += 1
    vectors = random.uniform(-1.0 / dim, 1.0 / dim, (1 << bits, dim)).astype(np.float32)
    vectors[held < MIN_TEXTS] = 0
    squares = np.full(1 << bits, 1e-8, np.float64)
    output = np.zeros((2, dim))
    output[1] = random.uniform(-1.0, 1.0, dim)
    output[0] = -output[1]
    bias, out_squares, bias_squares = np.zeros(2), np.full((2, dim), 1e-8), np.full(2, 1e-8)
    epochs = max(1, round(steps * batch / len(chosen)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = random.permutation(chosen)
        for start in range(0, len(order), batch):
            rows_of = order[start : start + batch]
            parts = [bags(i) for i in rows_of]
            rows = np.repeat(np.arange(len(rows_of)), [len(f) for f, _ in parts])
            features = np.concatenate([f for f, _ in parts])
            weight = np.concatenate([w for _, w in parts])
            common = held[features] >= MIN_TEXTS
            rows, features, weight = rows[common], features[common], weight[common]
            hidden = np.zeros((len(rows_of), dim))
            for d in range(dim):
                hidden[:, d] = np.bincount(rows, weights=weight * vectors[features, d], minlength=len(rows_of))
            logits = hidden @ output.T + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(rows_of)), labels[rows_of]] -= 1.0  # the error
            back = chance @ output
            used, where = np.unique(features, return_inverse=True)
            grad = np.stack([np.bincount(where, weights=weight * back[rows, d], minlength=len(used)) for d in range(dim)], 1)
            squares[used] += (grad * grad).mean(1)
            vectors[used] -= (step * grad / np.sqrt(squares[used])[:, None]).astype(np.float32)
            grad = chance.T @ hidden / len(rows_of)
            out_squares += grad * grad
            output -= step * grad / np.sqrt(out_squares)
            grad = chance.mean(0)
            bias_squares += grad * grad
            bias -= step * grad / np.sqrt(bias_squares)
    way = output[1] - output[0]
    return vectors @ way, float(bias[1] - bias[0])


def score_texts(model, texts):
    """Probability of label 1 for each text of an Arrow array."""
    codes, offsets, words = split_words(texts)
    word_sum, word_n = subword_sums(words.to_pylist(), model.bits, model.weights)
    place, pairs = _pair_features(codes, offsets, word_hashes(words), model.bits)
    sums, counts = word_sum[codes], word_n[codes]
    sums[place] += model.weights[pairs]
    counts[place] += 1
    total = segment_sums(counts, offsets)
    return sigmoid(segment_sums(sums, offsets) / np.maximum(total, 1.0) + model.bias)


def score(docs, model, id_col="doc_id", text_col="text"):
    """(id, score) for every row of ``docs``; null and empty texts get the bias alone,
    repeated rows are scored each, a null id is kept."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches, "_text"):
            scores = pa.array(score_texts(model, part.column("_text")), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), scores], ["_id", "score"])

    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(released(run), f"_id {kind}, score double").withColumnRenamed("_id", id_col)
    )


def train(docs, labels, label="quality", rows=2500, chars=32_000_000):
    """Fit on the bounded sample of ``labelled.draw``; ``rows`` and ``chars`` bound it."""
    sample = draw(docs, labels, label, rows, chars)
    return fit(sample.texts, sample.labels, sample.prior_shift)


def classify(docs, labels, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep(docs, labels, threshold=THRESHOLD):
    """The rows of ``docs``, with their columns, that score at least ``threshold``.

    Filtered where they are read, without a join: repeated and null ids are no matter.
    """
    ship_package(docs.sparkSession)
    model = train(docs, labels)

    def run(batches):
        for part in text_slices(batches, "text"):
            yield part.filter(pa.array(score_texts(model, part.column("text")) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
