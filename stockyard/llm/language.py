"""Language identification by unigrams over all segmentations of a text.

Every language has a probability for each piece of one fixed, public vocabulary. A text
is a sequence of units, a unit any sequence of pieces that spells it, and the text's
likelihood the sum over all its segmentations: the forward algorithm adds them up,
position by position. In numpy a lattice holds the pieces that match anywhere in many units
at once (all positions walk down a trie of the pieces together), and the units advance
together, one position and piece length at a time.

Units are the words of a text: runs of letters and combining marks with at least one
letter, in lower case, with the vocabulary's mark of a word's beginning before them. A run
of more than ``CHUNK`` characters is several units, so a piece never reaches over such a
cut, but every character counts. A character that is no piece is spelled by the pieces of
its UTF-8 bytes.

The probabilities come from expectation maximisation. Spark counts the units of every
language over all documents that may be learned from; a task sums the expected uses of the
pieces over its share of these counts, weighing every segmentation by its probability;
the driver gets one number for each language and piece, and never a text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import functions as F

from stockyard.llm.common import ship_package, split_words, text_slices
from stockyard.session import materialize

CHUNK = 32       # characters of a unit, at most, besides the mark of the beginning
ITERATIONS = 3   # of expectation maximisation
SHARED = 0.02    # part of each language's probability that all languages share
EVEN = 1e-3      # part of the shared probability that is spread evenly over the pieces
SLICE = 8 << 20  # bytes of text that are scored together; words repeat within a slice
CELLS = 4 << 20  # numbers in the forward table of one block of units
UNKNOWN = "und"
BEGIN = "▁"


def held_out(id_column):
    """True where crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Pieces:
    """The pieces of a vocabulary as a trie in sorted arrays.

    Normal pieces are numbered from 0, then the 256 bytes. ``keys`` are node and character
    in one number, ``child`` the node they lead to, ``ends`` the piece that ends in a node.
    """

    def __init__(self, pieces):
        self.count = len(pieces)
        nodes, ends, self.longest = {}, [-1], max(map(len, pieces), default=1)
        for number, piece in enumerate(pieces):
            node = 0
            for character in piece:
                node = nodes.setdefault(node << 21 | ord(character), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = number
        self.keys = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    @classmethod
    def of_model(cls, model):
        """The pieces of a serialised SentencePiece model, without control pieces."""
        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        skip = lambda i: known.is_byte(i) or known.is_control(i) or known.is_unknown(i) or known.is_unused(i)
        return cls([known.id_to_piece(i) for i in range(known.get_piece_size()) if not skip(i)])

    def lattice(self, units):
        """The pieces that match anywhere in the units."""
        return Lattice(self, units)


class Lattice:
    """Matches as (unit, end, length, piece), in the order of end and length.

    Pieces from ``pieces.count + 256`` on stand for ``characters`` without a piece.
    """

    def __init__(self, pieces, units):
        text = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        self.lengths = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(self.lengths)
        owner = np.repeat(np.arange(len(units)), self.lengths)
        stop, begin = stops[owner], (stops - self.lengths)[owner]
        at, node, found = np.arange(len(text)), np.zeros(len(text), np.int64), []
        single = np.zeros(len(text), bool)
        for length in range(1, pieces.longest + 1):
            inside = at + length <= stop[at]
            at, node = at[inside], node[inside]
            key = node << 21 | text[at + length - 1]
            place = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            there = pieces.keys[place] == key if len(pieces.keys) else np.zeros(len(key), bool)
            at, node = at[there], pieces.child[place[there]]
            piece = pieces.ends[node]
            whole = piece >= 0
            found.append((at[whole], np.full(whole.sum(), length), piece[whole]))
            if length == 1:
                single[at[whole]] = True
            if not len(at):
                break
        rest = np.flatnonzero(~single)
        self.characters, number = np.unique(text[rest], return_inverse=True)
        found.append((rest, np.ones(len(rest), np.int64), pieces.count + 256 + number.reshape(-1)))
        at, self.length, self.piece = (np.concatenate(x) for x in zip(*found))
        self.unit = owner[at]
        self.end = at - begin[at] + self.length
        order = np.lexsort((self.length, self.end))
        self.unit, self.end, self.length, self.piece = (
            x[order] for x in (self.unit, self.end, self.length, self.piece)
        )
        self.first = pieces.count
        self._bytes = [np.frombuffer(chr(c).encode(), np.uint8).astype(np.int64) + pieces.count for c in self.characters.tolist()]

    def steps(self):
        """(end, length, slice of the matches) in order; a unit occurs once in each."""
        step = self.end * (int(self.length.max(initial=0)) + 1) + self.length
        starts = np.flatnonzero(np.diff(step, prepend=-1))
        for start, stop in zip(starts, np.append(starts[1:], len(step))):
            yield int(self.end[start]), int(self.length[start]), slice(start, stop)

    def extended(self, logs):
        """``logs`` (.., pieces and bytes), and after them the characters without a piece."""
        more = [logs[..., part].sum(-1) for part in self._bytes]
        return np.concatenate([logs, np.stack(more, -1)], -1) if more else logs

    def forward(self, weight, shape=()):
        """(log of the sum over all segmentations of each unit's first t characters, by t)."""
        table = np.full((int(self.lengths.max(initial=0)) + 1, len(self.lengths), *shape), -np.inf)
        table[0] = 0.0
        for end, length, part in self.steps():
            unit = self.unit[part]
            table[end][unit] = np.logaddexp(table[end][unit], table[end - length][unit] + weight[part])
        return table

    def likelihoods(self, logs):
        """Log-likelihood of every unit in every language; ``logs`` is (language, piece)."""
        weight = self.extended(logs).T[self.piece]
        table = self.forward(weight, (logs.shape[0],))
        return table[self.lengths, np.arange(len(self.lengths))]

    def expected(self, logs, language, times):
        """Expected uses (language, piece) of the pieces in ``times`` copies of each unit, whose
        language is given: the forward and backward sums around every match."""
        weight = self.extended(logs)[language[self.unit], self.piece]
        before = self.forward(weight)
        after = np.full(before.shape, -np.inf)
        after[self.lengths, np.arange(len(self.lengths))] = 0.0
        for end, length, part in reversed(list(self.steps())):
            unit = self.unit[part]
            after[end - length][unit] = np.logaddexp(after[end - length][unit], after[end][unit] + weight[part])
        total = before[self.lengths, np.arange(len(self.lengths))][self.unit]
        share = np.exp(before[self.end - self.length, self.unit] + weight + after[self.end, self.unit] - total)
        share *= times[self.unit]
        width = self.first + 256 + len(self.characters)
        uses = np.bincount(language[self.unit] * width + self.piece, weights=share, minlength=len(logs) * width)
        uses = uses.reshape(len(logs), width)
        result = uses[:, : self.first + 256].copy()
        for k, part in enumerate(self._bytes):
            np.add.at(result, (slice(None), part), uses[:, self.first + 256 + k, None])
        return result


def words_of(texts):
    """(code of every word, first word of every text and the end, list of the distinct words)."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    codes, offsets, distinct = split_words(pc.replace_substring_regex(lowered, r"[^\p{L}\p{M}]+", " "))
    distinct = distinct.to_pylist()
    real = np.fromiter((w is not None and (w.isalpha() or any(map(str.isalpha, w))) for w in distinct), bool, len(distinct))
    if not real.all():  # marks without a letter
        kept = real[codes]
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return codes, offsets, distinct


def units_of(words):
    """(units, the word of each); what goes beyond one unit of a word stands at the end."""
    units = [BEGIN + (word or "")[:CHUNK] for word in words]
    owner = list(range(len(words)))
    for number, word in enumerate(words):
        if word is not None and len(word) > CHUNK:
            rest = range(CHUNK, len(word), CHUNK)
            units.extend(word[start : start + CHUNK] for start in rest)
            owner.extend([number] * len(rest))
    return units, np.array(owner, np.int64)


def unit_counts(docs, languages):
    """(lang, unit, n): uses of every unit in the documents of each language, which is given
    by its number in ``languages``. Counted by slice and task before the shuffle."""
    ship_package(docs.sparkSession)
    schema = pa.schema([("lang", pa.int32()), ("unit", pa.string()), ("n", pa.int64())])

    def run(batches):
        for part in text_slices(batches, "text", SLICE):
            codes, offsets, words = words_of(part.column("text"))
            if not len(codes):
                continue
            lang = pc.index_in(part.column("lang"), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            key, n = np.unique(np.repeat(lang, np.diff(offsets)) * len(words) + codes, return_counts=True)
            which, word = key // len(words), key % len(words)
            units, owner = units_of(words)
            size = np.bincount(owner, minlength=len(words))
            begin, by_word = np.cumsum(size) - size, np.argsort(owner, kind="stable")
            reach = size[word]
            unit = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(begin[word], reach)
            columns = [np.repeat(which, reach).astype(np.int32), np.array(units, object)[by_word[unit]], np.repeat(n, reach)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = docs.select("text", "lang").mapInArrow(run, "lang int, unit string, n long")
    return found.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def _blocks(units, languages):
    """Slices of the units whose forward tables stay below CELLS numbers."""
    size = max(CELLS // ((CHUNK + 2) * languages), 1)
    for start in range(0, len(units), size):
        yield slice(start, start + size)


def expected_uses(counts, pieces, logs):
    """Array (language, piece) of expected uses, summed over all tasks."""
    def run(batches):
        total = np.zeros(logs.shape)
        for batch in batches:
            units = batch.column("unit").to_pylist()
            lang, times = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lang", "n"))
            for part in _blocks(units, 2):
                total += pieces.lattice(units[part]).expected(logs, lang[part], times[part])
        lang, piece = np.nonzero(total)
        for start in range(0, len(lang), 1 << 16):
            some = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_pydict(
                {"lang": lang[some], "piece": piece[some], "uses": total[lang[some], piece[some]]}
            )

    found = counts.mapInArrow(run, "lang long, piece long, uses double")
    # a number for each language and piece, whatever the size of the corpus
    table = found.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    uses = np.zeros(logs.shape)
    uses[table["lang"].to_numpy(), table["piece"].to_numpy()] = table["uses"].to_numpy()
    return uses


def probabilities(uses):
    """Log probabilities (language, piece): own shares, and a part that is the same in all."""
    own = uses / np.maximum(uses.sum(1, keepdims=True), 1e-300)
    shared = (1 - EVEN) * own.mean(0) + EVEN / uses.shape[1]
    return np.log((1 - SHARED) * own + SHARED * shared)


def fit(docs, pieces, iterations=ITERATIONS):
    """(languages, log prior of each, log probabilities) from all documents with a language.

    ``docs`` has text and lang; rows without a language teach nothing, and texts without a
    letter only count for the prior. Without any language the list is empty.
    """
    docs = docs.where(F.col("lang").isNotNull())
    shares = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return [], np.zeros(0), np.zeros((0, pieces.count + 256))
    counts = materialize(unit_counts(docs, languages), "language_units")
    logs = np.full((len(languages), pieces.count + 256), -np.log(pieces.count + 256))
    for _ in range(iterations):
        logs = probabilities(expected_uses(counts, pieces, logs))
    share = np.array([shares[lang] for lang in languages], np.float64)
    return languages, np.log(share / share.sum()), logs


def scores(texts, pieces, prior, logs):
    """(log posterior (text, language), has a letter) of an Arrow array of texts."""
    codes, offsets, words = words_of(texts)
    count = len(prior)
    total = np.zeros((len(texts), count)) + prior
    if len(codes) and count:
        units, owner = units_of(words)
        each = np.zeros((len(words), count))
        for part in _blocks(units, count):
            found = pieces.lattice(units[part]).likelihoods(logs)
            for k in range(count):
                each[:, k] += np.bincount(owner[part], weights=found[:, k], minlength=len(words))
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for k in range(count):
            total[:, k] += np.bincount(text, weights=each[codes, k], minlength=len(texts))
    total -= total.max(1, keepdims=True, initial=-np.inf) if count else 0.0
    if count:
        total -= np.log(np.exp(total).sum(1, keepdims=True))
    return total, np.diff(offsets) > 0


def predict(docs, pieces, languages, prior, logs):
    """The columns of ``docs`` but the text, and lang_pred and score."""
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    names = np.array([*languages, UNKNOWN], object)

    def run(batches):
        for part in text_slices(batches, "text", SLICE):
            chance, letters = scores(part.column("text"), pieces, prior, logs)
            sure = letters & bool(languages)
            best = chance.argmax(1) if languages else np.zeros(len(chance), np.int64)
            score = np.exp(chance[np.arange(len(best)), best]) if languages else np.zeros(len(best))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in others], pa.array(names[np.where(sure, best, -1)], pa.string()),
                 pa.array(np.where(sure, np.clip(score, 0.0, 1.0), 0.0))],
                schema.names,
            )

    return docs.mapInArrow(run, schema)


def identify(docs, model, iterations=ITERATIONS):
    """doc_id, held_out, lang_pred and score of every document.

    ``model`` is a serialised SentencePiece model; only its list of pieces counts. Learned
    is from all documents that have a language and an id and aren't ``held_out``; repeated rows
    count as often as they occur. lang_pred is the likeliest language, given the languages'
    shares of the documents learned from (a tie goes to the first in code point order), and
    score its probability; ``und`` with score 0 if the text is null, empty or has no letter, or
    if nothing could be learned. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    pieces = Pieces.of_model(model)
    learned = fit(rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("text", "lang"), pieces, iterations)
    return predict(rows.select("doc_id", "held_out", "text"), pieces, *learned)
