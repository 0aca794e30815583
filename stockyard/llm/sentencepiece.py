"""SentencePiece encoding and decoding with batched numpy Viterbi passes.

Texts fall into words that no piece crosses, and each distinct word is encoded once
while it is remembered. Words of equal length advance together, one character at a
time: hashes of the substrings that end there probe the sorted keys of the pieces, and
for every word the best way to reach the place is kept with a pointer back.

In a unigram model the best way has the largest sum of scores. In a merge (BPE) model
it is the one way that merging would give: a path is right exactly if each two
neighbouring pieces, merged on their own, stay these two pieces (merges inside one
piece never look beyond it), so a step scores 0 if its two pieces agree and minus
infinity if not. Whether they agree follows from taking their merges back, last merge
first, which is done for whole arrays of pairs. Where this can't tell, runs of spaces
(all their merges rank alike) and words over ``LONG`` characters, the merges
themselves are carried out. Characters without a piece become their UTF-8 bytes.

The vocabulary is that of a given model file; nothing is trained.
"""

import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa

from stockyard.llm.common import mix, ship_package, text_slices

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: piece types of the format
UNIGRAM, BPE = 1, 2                          # fixed values: model types of the format
SPACE = "▁"
LONG = 64
LEAD = 18   # leading bits of a hash that find its place among the sorted keys
PAIRS = 20  # binary logarithm of how many pairs are remembered
KNOWN_WORDS = 700_000  # about 140 MB
SLICE = 4 << 20        # bytes of text that are encoded together
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
WORDS = re.compile(r"\n| *[^ \n]+| +")


def _fields(raw):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[at : at + size]
            at += size


def _hash(text):
    value = 0
    for c in text:
        value = (value * BASE + ord(c) + 1) & MASK
    return value


class Model:
    """A model file's pieces and, for merge models, how each piece is merged."""

    def __init__(self, raw):
        pieces, self.kind, self.prefix = [], UNIGRAM, True
        for number, value in _fields(raw):
            if number == 1:
                piece = {k: v for k, v in _fields(value)}
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                self.prefix = bool(spec.get(3, 1))
        self.size = len(pieces)
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes_ = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece crosses the start of a word")
        self.split_lines = not any("\n" in p for p, _, kind in pieces if kind == NORMAL)
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.least = float(self.score.min()) - 10.0
        self.longest = max(map(len, self.id_of), default=1)
        self.length = np.array([len(p) for p, _, _ in pieces] + [1], np.int64)
        self.hash = np.array([_hash(p) for p, _, _ in pieces] + [0], np.uint64)
        ids = np.array(list(self.id_of.values()), np.int64)
        keys = mix(self.hash[ids])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        # first sorted key of each range of leading bits, and how many a range has at most
        self.first = np.searchsorted(self.keys, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD))
        self.crowd = int(np.diff(np.append(self.first, len(self.keys))).max()) if len(self.keys) else 0
        self.keys = np.append(self.keys, np.zeros(self.crowd + 1, np.uint64))
        self.key_ids = np.append(self.key_ids, np.full(self.crowd + 1, -1))
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(max(self.longest, LONG) + 2)], np.uint64)
        surface = []
        for piece, _, kind in pieces:
            if kind == BYTE:
                surface.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                surface.append(b"")
            else:
                surface.append(" ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        if self.kind == BPE:
            self._merges()

    def _merges(self):
        """Rank, left and right part of each piece; ``whole`` if merging yields it."""
        self.pair, self.pair_result = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)
        ranks = {s: r for r, s in enumerate(sorted({self.score[i] for i in self.id_of.values()}, reverse=True))}
        unknown = self.size  # stands for a character without a piece
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        self.whole = np.zeros(self.size + 1, bool)
        self.whole[unknown] = True
        self.rank_of = {p: ranks[self.score[i]] for p, i in self.id_of.items()}
        self.priority = np.full(self.size + 1, np.iinfo(np.int64).max)  # of merging into a piece
        for piece, i in self.id_of.items():
            self.priority[i] = self.rank_of[piece]
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.whole[i] = True
                continue
            parts, last = self.merge(piece)
            if len(parts) == 1:
                left, right = (self.id_of.get(x) for x in last)
                self.whole[i] = True
                self.rank[i] = self.rank_of[piece]
                self.left[i], self.right[i] = left, right
        ok = np.flatnonzero(self.rank >= 0)
        tied = np.bincount(self.rank[ok])[self.rank[ok]] > 1
        spaces = np.array([set(p) == {SPACE} for p in self.id_of])
        allowed = set(np.array(list(self.id_of.values()))[spaces].tolist())
        ordered = (self.rank[ok] > self.rank[self.left[ok]]) & (self.rank[ok] > self.rank[self.right[ok]])
        # pieces whose merges don't go up in rank, or tie: their words are merged plainly
        odd = set(ok[~ordered | tied].tolist()) - allowed
        chars = {c for p in self.id_of for c in p if c not in self.id_of}
        self.plain = bool(odd or chars)

    def merge(self, word):
        """(pieces, last merge) of carrying out the merges: best rank first, then leftmost."""
        text, n = list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, last, heap = self.rank_of, None, []

        def offer(i):
            j = after[i]
            if j < n and (rank := rank_of.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (rank, i, len(text[i]), len(text[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or len(text[i]) != a or len(text[j]) != b:
                continue
            last = (text[i], text[j])
            text[i], text[j] = text[i] + text[j], ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in text if t], last

    def _find(self, hashes):
        """Piece with each hash, else -1."""
        hashes = mix(hashes)
        at = self.first[hashes >> np.uint64(64 - LEAD)]
        result = np.full(len(hashes), -1, np.int64)
        for step in range(self.crowd):
            same = np.flatnonzero(self.keys[at + step] == hashes)
            result[same] = self.key_ids[at[same] + step]
        return result

    def _agree(self, first, second):
        """Whether merging the two pieces' text gives the two pieces back; pairs seen
        lately are looked up."""
        pair = first * (self.size + 1) + second
        slot = (pair.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - PAIRS)
        result = self.pair_result[slot]
        new = np.flatnonzero(self.pair[slot] != pair)
        if len(new):
            result[new] = found = self._merged_apart(first[new], second[new])
            self.pair[slot[new]], self.pair_result[slot[new]] = pair[new], found
            # two new pairs may share a slot: the later one stays in both arrays
        return result

    def _merged_apart(self, first, second):
        result = np.ones(len(first), bool)
        alive = np.arange(len(first))
        limit = np.full(len(first), np.iinfo(np.int64).max)
        unknown = self.size
        live = (first != unknown) & (second != unknown)
        alive, first, second, limit = alive[live], first[live], second[live], limit[live]
        while len(alive):
            joined = self._find(self.hash[first] * self.power[self.length[second]] + self.hash[second])
            joined = np.where(self.length[first] + self.length[second] <= self.longest, joined, -1)
            crossed = (joined >= 0) & (self.priority[joined] < limit)
            result[alive[crossed]] = False
            split_first = self.rank[first] > self.rank[second]
            done = crossed | ((self.rank[first] < 0) & (self.rank[second] < 0))
            limit = np.where(split_first, self.rank[first], self.rank[second] + 1)
            first, second = np.where(split_first, self.right[first], first), np.where(split_first, second, self.left[second])
            keep = ~done
            alive, first, second, limit = alive[keep], first[keep], second[keep], limit[keep]
        return result

    def ids_of(self, word):
        """Packed ids by carrying out the merges, or by a Viterbi pass over this word alone."""
        if self.kind != BPE:
            return self.batch([word])[0]
        return self._to_ids(self.merge(word)[0])

    def _to_ids(self, parts):
        ids = []
        for part in parts:
            if part in self.id_of:
                ids.append(self.id_of[part])
            elif self.bytes_:
                ids.extend(self.bytes_[b] for b in part.encode())
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def batch(self, words):
        """Packed ids of words of equal length, which advance together."""
        n, count = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(count, n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, count), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * np.uint64(BASE) + chars[:, j]
        unknown, merges = self.size, self.kind == BPE
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0.0
        piece, back = np.full((n + 1, count), unknown), np.zeros((n + 1, count), np.int64)
        for j in range(1, n + 1):
            todo = np.arange(count)
            for size in range(min(j, self.longest), 0, -1):
                start = j - size
                found = self._find(prefix[j, todo] - prefix[start, todo] * self.power[size])
                if size == 1:
                    found = np.where(found < 0, unknown, found)
                real = (found >= 0) & (best[start, todo] > -np.inf)
                at, found = todo[real], found[real]
                if not len(at):
                    continue
                if merges:
                    fits = self.whole[found]
                    if start:
                        fits[fits] = self._agree(piece[start, at[fits]], found[fits])
                    value = np.where(fits, 0.0, -np.inf)
                else:
                    gain = np.where(found == unknown, self.least, self.score[np.minimum(found, unknown - 1)])
                    value = best[start, at] + gain
                better = value > best[j, at]
                at, found, value = at[better], found[better], value[better]
                best[j, at], piece[j, at], back[j, at] = value, found, size
                if merges:  # there is one way only: words that have it are done
                    todo = todo[best[j, todo] == -np.inf]
                    if not len(todo):
                        break
        return self._paths(words, piece, back)

    def _paths(self, words, piece, back):
        """Packed ids of every word, following the pointers back."""
        n, count = len(words[0]), len(words)
        path = np.full((count, n), -1, np.int64)  # from the end of the word
        place, all_words, taken = np.full(count, n), np.arange(count), 0
        while (place > 0).any():
            path[:, taken] = np.where(place > 0, piece[place, all_words], -1)
            place = place - np.where(place > 0, back[place, all_words], 0)
            taken += 1
        path = path[:, :taken][:, ::-1]
        ends = 4 * np.cumsum((path >= 0).sum(1))
        flat = path[path >= 0].astype("<u4").tobytes()
        result = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        for w in np.flatnonzero((path == self.size).any(1)):  # characters without a piece
            at, parts = 0, []
            for found in path[w][path[w] >= 0]:
                size = int(self.length[found])
                parts.append(words[w][at : at + size])
                at += size
            result[w] = self._to_ids(parts)
        return result

    def encode_words(self, words):
        """{word: its ids, packed}; the words hold ``SPACE`` for spaces."""
        groups, result = {}, {}
        for word in words:
            spaces = len(word) - len(word.lstrip(SPACE))
            if self.kind == BPE and (self.plain or spaces > 1 or len(word) > LONG):
                result[word] = self.ids_of(word)
            else:
                groups.setdefault(len(word), []).append(word)
        for group in groups.values():
            for start in range(0, len(group), 20_000):
                part = group[start : start + 20_000]
                result.update(zip(part, self.batch(part)))
        return result


_models = {}  # of this process: models by content, with the words they remember


def load(raw):
    """The model of a file's bytes, and the words it remembers."""
    key = zlib.crc32(raw), len(raw)
    if key not in _models:
        _models[key] = Model(raw), {}
    return _models[key]


def encode(raw, texts):
    """(ids of all texts one after another, first id of every text and the end).

    ``raw`` is a model file's content. A null or empty text has no ids.
    """
    model, known = load(raw)
    start = " " if model.prefix else ""
    split = WORDS if model.split_lines else re.compile(r" *[^ ]+| +")
    found = [split.findall(start + t.replace(SPACE, " ")) if t else [] for t in texts]
    new = {w for words in found for w in words}
    fresh = [w for w in new if w not in known]
    if len(known) + len(fresh) > KNOWN_WORDS:
        # forget all words but those of these texts
        kept = {w: known[w] for w in new if w in known}
        known.clear()
        known.update(kept)
    marked = [w.replace(" ", SPACE) for w in fresh]
    coded = model.encode_words(marked)
    known.update(zip(fresh, map(coded.__getitem__, marked)))
    joined = [b"".join([known[w] for w in words]) for words in found]
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in joined])]).astype(np.int64)
    return np.frombuffer(b"".join(joined), "<u4"), offsets


def decode(raw, ids, offsets):
    """The bytes of every text; ids outside the vocabulary read as the unknown one."""
    model, _ = load(raw)
    ids = np.where(ids < model.size, ids, model.unknown).astype(np.int64)
    sizes = np.diff(model.surface_at)[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(model.surface_at[ids] - ends[:-1], sizes)
    data = model.surface[at].tobytes()
    bounds = ends[offsets]
    texts = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return [t[1:] if model.prefix and t[:1] == b" " else t for t in texts]


def encode_documents(docs, raw):
    """doc_id and the list of ids of every row; repeated rows and null ids are kept."""
    return _mapped(docs, raw, "ids array<int>", lambda raw, texts: [_lists(*encode(raw, texts))])


def _lists(ids, offsets):
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))


def digest(docs, raw):
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    decoded_crc32 (of the decoded text's UTF-8 bytes) and round_trip of every row:
    whether decoding gives the text back (a null text counts as empty)."""

    def columns(raw, texts):
        ids, offsets = encode(raw, texts)
        packed = ids.tobytes()
        back = decode(raw, ids, offsets)
        return [
            pa.array(np.diff(offsets), pa.int64()),
            pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64()),
            pa.array([zlib.crc32(t) for t in back], pa.int64()),
            pa.array([t == (x or "").encode() for t, x in zip(back, texts)]),
        ]

    return _mapped(docs, raw, "n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean", columns)


def _mapped(docs, raw, shape, columns):
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[x.split()[0] for x in shape.split(", ")]]

    def run(batches):
        for part in text_slices(batches, "text", SLICE):
            made = columns(raw, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {shape}")
