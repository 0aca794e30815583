"""Toxicity: a counterfactual-regularised classifier.

A text is cut into sentences (at ``.``, ``!``, ``?`` and line ends, and after
``WINDOW`` words where a sentence is longer). A sentence's log odds are the sum of the
weights of its words; a word's weight is the sum over its hashed features, the word
and its character n-grams. A text is as toxic as its worst sentence.

Only texts are labelled, so training goes in rounds: first every sentence carries the
label of its text, then each toxic text gives only the sentence the last round found
worst. Each round minimises the logistic loss plus

    penalty * mean over swaps of (log odds of a sentence - log odds after the swap) ** 2

where a swap replaces an identity term of a labelled sentence by another term of its
group, among them a neutral word. A term that no labelled sentence holds is swapped
into ``MIN_SWAPS`` carriers, labelled sentences that mention no group. Since log odds
are sums over words, a swap changes them by the difference of the two terms, whatever
the rest of the sentence, so swaps are counted by pair of terms.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from stockyard.llm.common import (
    segment_max, segment_sums, ship_package, sigmoid, split_words, subword_features, subword_sums, text_slices,
)
from stockyard.llm.labelled import calibrate, draw, held_out

BITS = 18
WINDOW = 16
ROUNDS = 3
STEPS = 60
PENALTY = 1.0
MIN_SWAPS = 20
RIDGE = 4e-4
THRESHOLD = 0.3
MIN_TEXTS = 3  # texts of the sample that hold a feature which gets a weight
FOLDS = 2      # of the sample, for the calibration
LINE_END = "\x1e"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¡¿—–"

# Words for groups of people; the first of each group is its neutral word.
IDENTITY_GROUPS = [
    ["people", "men", "women", "gays", "lesbians", "immigrants", "refugees", "muslims", "christians",
     "jews", "hindus", "buddhists", "atheists", "blacks", "whites", "asians", "africans", "europeans",
     "americans", "mexicans", "foreigners", "elders", "teenagers", "disabled"],
    ["person", "man", "woman", "girl", "boy", "immigrant", "refugee", "muslim", "christian", "jew",
     "hindu", "buddhist", "atheist", "foreigner", "teenager", "transgender", "gay", "lesbian"],
    ["human", "male", "female", "jewish", "black", "white", "asian", "african", "european", "american",
     "mexican", "arab", "latino", "deaf", "blind", "old", "young"],
    ["menschen", "männer", "frauen", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "türken"],
    ["gens", "hommes", "femmes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "arabes"],
    ["personas", "hombres", "mujeres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"],
]


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature
    bias: float          # of a sentence
    slope: float         # calibration of a text's worst sentence
    intercept: float
    bits: int


def _sentences(texts):
    """(word codes, sentence offsets, first sentence of every text and the end, words).

    Words come in lower case, without punctuation at their ends; a word said several
    times in a row counts once.
    """
    marked = pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {LINE_END} ")
    codes, offsets, words = split_words(marked)
    words = words.to_pylist()
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(codes)]] = True
    codes, offsets = codes[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]
    stops = np.fromiter((w == LINE_END or w[-1:] in ".!?" for w in words), bool, len(words))
    n = len(codes)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    begins[1:] |= stops[codes]
    starts = np.flatnonzero(begins[:n])
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    starts = np.flatnonzero(begins[:n] | (place % WINDOW == 0))
    ends = np.append(starts, n)
    return codes, ends, np.searchsorted(starts, offsets), [w.lower().strip(EDGES) for w in words]


def _word_weights(weights, owner, feature, n):
    return np.bincount(owner, weights=weights[feature], minlength=n)


def fit(texts, labels, prior_shift=0.0, groups=IDENTITY_GROUPS, penalty=PENALTY, bits=BITS,
        rounds=ROUNDS, steps=STEPS, folds=FOLDS):
    """Train on an Arrow array of texts and 0/1 labels.

    The log odds of texts are calibrated on texts that the weights they come from have
    not seen: each fold is scored by a model of the others. Without both labels in the
    sample, the model is the smoothed share of label 1.
    """
    n = len(labels)
    share = float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)) + prior_shift)
    if n == 0 or labels.min() == labels.max():
        return Model(np.zeros(1 << bits), 0.0, 0.0, share, bits)
    fold = np.arange(n) % folds
    worst, seen = [], []
    for k in range(folds):
        rest, part = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(part) and labels[rest].min() != labels[rest].max():
            model = _train(texts.take(pa.array(rest)), labels[rest], groups, penalty, bits, rounds, steps)
            worst.append(_worst(model, texts.take(pa.array(part))))
            seen += part.tolist()
    model = _train(texts, labels, groups, penalty, bits, rounds, steps)
    if seen:
        model.slope, model.intercept = calibrate(np.concatenate(worst), labels[seen])
    model.intercept += prior_shift
    return model


def _train(texts, labels, groups, penalty, bits, rounds, steps):
    """Weights and bias of sentences, in rounds; not calibrated."""
    n = len(labels)
    codes, ends, of_text, words = _sentences(texts)
    owner, feature = subword_features(words, bits)
    kept = np.array([bool(w) for w in words])
    owner, feature = owner[kept[owner]], feature[kept[owner]]
    owner, feature = _shared(codes, ends[of_text], owner, feature, len(words), bits)
    sentence_text = np.repeat(np.arange(n), np.diff(of_text))
    target = labels[sentence_text].astype(np.float64)
    swaps = _Swaps(groups, words, codes, bits)

    weights, bias = np.zeros(1 << bits), 0.0
    active = np.ones(len(target), bool)
    for turn in range(rounds):
        if turn:
            value = segment_sums(_word_weights(weights, owner, feature, len(words))[codes], ends)
            active = target == 0
            for t in np.flatnonzero((labels == 1) & (np.diff(of_text) > 0)):
                active[of_text[t] + int(np.argmax(value[of_text[t] : of_text[t + 1]]))] = True
        positive, negative = active & (target == 1), active & (target == 0)
        share_of = positive / max(positive.sum(), 1) + negative / max(negative.sum(), 1)
        # texts count alike, however many sentences they have; toxic texts are few
        weights, bias = _descend(
            weights, bias, owner, feature, codes, ends, target, 0.5 * share_of, swaps, penalty, steps, len(words)
        )
    return Model(weights, float(bias), 1.0, 0.0, bits)


def _shared(codes, bounds, owner, feature, n_words, bits):
    """The (word, feature) pairs whose feature ``MIN_TEXTS`` texts hold; others would
    only learn by heart. ``bounds`` are the first word of every text and the end."""
    order = np.argsort(owner, kind="stable")
    feature_of = feature[order].astype(np.int32)
    per_word = np.bincount(owner, minlength=n_words)
    begin = np.cumsum(per_word) - per_word
    held = np.zeros(1 << bits, np.int64)
    for start, end in zip(bounds[:-1], bounds[1:]):
        word = np.unique(codes[start:end])
        spread = per_word[word]
        at = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(begin[word], spread)
        held[np.unique(feature_of[at])] += 1
    common = held >= MIN_TEXTS
    return owner[common[feature]], feature[common[feature]]


class _Swaps:
    """How often each pair of identity terms is swapped, and the terms' features."""

    def __init__(self, groups, words, codes, bits):
        seen = {}
        for word, count in zip(words, np.bincount(codes, minlength=len(words))):
            seen[word] = seen.get(word, 0) + int(count)
        self.terms = [t for group in groups for t in group]
        self.owner, self.feature = subword_features(self.terms, bits)
        self.links = np.zeros((len(self.terms), len(self.terms)))
        at = 0
        for group in groups:
            counts = np.array([max(seen.get(t, 0), MIN_SWAPS) for t in group], np.float64)
            block = np.repeat(counts[:, None] / max(len(group) - 1, 1), len(group), 1)
            np.fill_diagonal(block, 0.0)
            self.links[at : at + len(group), at : at + len(group)] = block
            at += len(group)
        total = self.links.sum()
        self.links = (self.links + self.links.T) / (total if total else 1.0)

    def gradient(self, weights):
        """Of the mean squared change of the log odds, by feature."""
        value = np.bincount(self.owner, weights=weights[self.feature], minlength=len(self.terms))
        slope = 2 * (self.links.sum(1) * value - self.links @ value)
        return np.bincount(self.feature, weights=slope[self.owner], minlength=len(weights))


def _descend(weights, bias, owner, feature, codes, ends, target, share, swaps, penalty, steps, n_words):
    """Adam on the whole batch."""
    rate, first, second = 0.05, np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    lengths = np.diff(ends)
    for step in range(1, steps + 1):
        value = segment_sums(_word_weights(weights, owner, feature, n_words)[codes], ends) + bias
        error = share * (sigmoid(value) - target)
        by_word = np.bincount(codes, weights=np.repeat(error, lengths), minlength=n_words)
        grad = np.bincount(feature, weights=by_word[owner], minlength=len(weights))
        grad += RIDGE * weights + penalty * swaps.gradient(weights)
        grad = np.append(grad, error.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def score_texts(model, texts):
    """Probability of toxicity of each text of an Arrow array."""
    return sigmoid(model.slope * _worst(model, texts) + model.intercept)


def _worst(model, texts):
    """Log odds of the worst sentence of each text."""
    codes, ends, of_text, words = _sentences(texts)
    by_word, _ = subword_sums(words, model.bits, model.weights)
    by_word[[i for i, w in enumerate(words) if not w]] = 0.0
    value = segment_sums(by_word[codes], ends) + model.bias
    return segment_max(value, of_text, model.bias)


def train(docs, labels, rows=2500, chars=32_000_000):
    """Fit on the bounded sample of ``labelled.draw``; ``rows`` and ``chars`` bound it."""
    sample = draw(docs, labels, "toxic", rows, chars)
    return fit(sample.texts, sample.labels, sample.prior_shift)


def score(docs, model, id_col="doc_id", text_col="text"):
    """(id, score) for every row of ``docs``; a null or empty text scores as a sentence
    without words, repeated rows are scored each, a null id is kept."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in text_slices(batches, "_text"):
            scores = pa.array(score_texts(model, part.column("_text")), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), scores], ["_id", "score"])

    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)
    )


def classify(docs, labels, threshold=THRESHOLD):
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
