"""Packing: vector bin packing of token sequences under simultaneous limits.

Every document becomes token ids and is cut where a sequence is full; whole sequences
stand alone, and the rests are packed. A rest is a vector (tokens, one segment, tokens
that bear loss); a sequence has limits on all three. The dot-product heuristic fills
one sequence at a time: of the rests that fit, it takes the one whose vector, weighted
by how scarce each resource is, has the largest product with the room that is left.

Rests are dealt by hash to shards of about ``SHARD`` rests, each packed by itself:
shards grow in number, not in size, and each leaves one sequence at most that is not
nearly full.
"""

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockyard.llm.common import give_back, released, remembered, ship_package, split_words, text_slices
from stockyard.session import materialize, small_batches

LIMIT = 2048      # tokens in a sequence
SEGMENTS = 64     # pieces in a sequence
LOSS = 2048       # tokens in a sequence that bear loss
END_ID = 1        # id after each document
SHARD = 20_000
KNOWN_WORDS = 1_000_000  # encoded words that a worker remembers, about 40 MB
KNOWN_BYTES = 64 << 20   # of their texts
SLICE = 4 << 20          # bytes of text that are encoded together


# A word of ASCII and Latin-1 letters, and marks behind it.
WORD_AND_MARKS = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:]*)$"


def parts_words(definition):
    """Whether a tokenizer lowers case and takes a run of letters and the run of other marks
    behind it each for itself, by its definition."""
    told = json.loads(definition)
    steps = lambda x, name: x.get(name, [x]) if x else []
    lowers = any(n["type"] == "Lowercase" for n in steps(told.get("normalizer"), "normalizers"))
    splits = [
        p["pattern"].get("Regex", "") for p in steps(told.get("pre_tokenizer"), "pretokenizers")
        if p["type"] == "Split" and p.get("invert") and p.get("behavior") == "Removed"
    ]
    alternatives = [set(x.split("|")) for x in splits]
    return lowers and any({r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= x for x in alternatives)


class WordEncoder:
    """Ids of texts by a tokenizer that never joins what white space parts.

    Such a tokenizer gives a text the ids of its words in turn, so each distinct word
    is encoded once while it is remembered: the word's number leads to its ids in one
    flat array. If the tokenizer also parts letters from marks and lowers case, a word of
    letters and marks at its end is the lowered letters, then the marks, and only these are
    encoded and remembered. With ``special_as_text`` a special token that a text spells out is
    encoded like other text; without, it gets its one id, as in the library's plain call.
    """

    def __init__(self, definition, special_as_text=True):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        self.parts = parts_words(definition)
        self._forget()

    def _forget(self):
        self.known, self.flat, self.ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _numbers(self, words):
        words = words.cast(pa.large_string())
        number = pc.index_in(words, value_set=self.known)
        missing = pc.is_null(number)
        new = words.filter(missing).unique()
        if len(new) and (len(self.known) + len(new) > KNOWN_WORDS or self.known.nbytes + new.nbytes > KNOWN_BYTES):
            self._forget()
            new = words.unique()
            missing = pc.is_valid(words)
        if not len(new):
            return number.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lengths = [self.flat], []
        for start in range(0, len(new), 10_000):
            part = self.tokenizer.encode_batch_fast(new.slice(start, 10_000).to_pylist(), add_special_tokens=False)
            lists = [x.ids for x in part]
            lengths += map(len, lists)
            flat.append(np.fromiter(chain.from_iterable(lists), "<u4"))
        before = len(self.known)
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate(flat)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64))
        number = pc.fill_null(number, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = missing.to_numpy(zero_copy_only=False)
        place = pc.index_in(words.filter(pa.array(missing)), value_set=new)
        number[missing] = before + place.to_numpy(zero_copy_only=False)
        return number

    def _ids(self, words):
        """(ids of the distinct words, one after another; first id of each and the end)."""
        if not self.parts:
            number = self._numbers(words)
            return _spread(self.flat, self.ends[number], self.ends[number + 1])
        split = pc.extract_regex(words, WORD_AND_MARKS)
        whole = pc.is_null(split)
        stems = pc.if_else(whole, words, pc.utf8_lower(pc.struct_field(split, "word"))).dictionary_encode()
        tails = pc.if_else(whole, "", pc.struct_field(split, "marks")).dictionary_encode()
        number = self._numbers(pa.concat_arrays([stems.dictionary, tails.dictionary]))
        stem, tail = (x.indices.to_numpy(zero_copy_only=False) for x in (stems, tails))
        number = np.stack([number[stem], number[len(stems.dictionary) + tail]], 1).reshape(-1)
        flat, ends = _spread(self.flat, self.ends[number], self.ends[number + 1])
        return flat, ends[::2]

    def encode(self, texts):
        """(ids of all texts of an Arrow array, one after another; first id of every
        text and the end). A null text is empty."""
        codes, offsets, words = split_words(texts)
        flat, ends = self._ids(words)
        ids, ends = _spread(flat, ends[codes], ends[codes + 1])
        return ids, ends[offsets]


def _spread(flat, begin, end):
    """(the stretches of ``flat`` one after another; first place of each and the end)."""
    size = end - begin
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends


def encoder_of(definition, special_as_text=True):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already share the cores
    key = "packing", definition, special_as_text
    if key not in remembered:
        remembered[key] = WordEncoder(definition, special_as_text)
    return remembered[key]


def pieces(docs, definition, limit=LIMIT, end_id=END_ID, special_as_text=True):
    """doc_id, start, length, ids_crc32, doc_tokens and n_loss of every piece.

    ``definition`` is the JSON text of a public tokenizer; it travels with the tasks.
    ``end_id`` follows each document; a null or empty text has that id alone. Pieces
    are ``limit`` ids long but for a document's last. All ids bear loss but the first
    of a document, which nothing predicts. Repeated rows give repeated pieces.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(definition, special_as_text)
        for part in text_slices(batches, "text", SLICE):
            ids, offsets = encoder.encode(part.column("text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            total = np.diff(offsets)
            cuts = -(-total // limit)
            doc = np.repeat(np.arange(len(total)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * limit
            length = np.minimum(limit, total[doc] - start)
            raw, at = ids.tobytes(), (offsets[doc] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at, length)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, total[doc], length - (start == 0))]],
                names,
            )
            give_back(keep=True)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "n_loss"]
    return docs.select("doc_id", "text").mapInArrow(
        released(run, keep=True), f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    )


def fill(tokens, loss, limit=LIMIT, segments=SEGMENTS, loss_limit=LOSS):
    """Sequence number of every item, by the dot-product heuristic; none for no items.

    Items over a limit of their own get a sequence alone. Items alike in tokens and
    loss are interchangeable, so choices are made among kinds of items. Of equal
    products the item with more tokens goes first, then the one that came first.
    """
    tokens, loss = np.asarray(tokens, np.int64), np.asarray(loss, np.int64)
    result = np.full(len(tokens), -1, np.int64)
    order = np.lexsort((np.arange(len(tokens)), -loss, -tokens))
    kinds, first, count = np.unique(
        np.stack([-tokens[order], -loss[order]], 1), axis=0, return_index=True, return_counts=True
    ) if len(tokens) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = -kinds  # largest first
    left, next_of, bins = count.copy(), first.copy(), 0
    limits = np.array([limit, segments, loss_limit], np.float64)
    demand = np.stack([size[:, 0], np.ones(len(size)), size[:, 1]], 1) / limits
    weight = (demand * count[:, None]).sum(0) / max(count.sum(), 1)
    scarce = demand * weight
    while left.any():
        room, empty = np.array([limit, segments, loss_limit], np.int64), True
        while True:
            fits = (left > 0) & (size[:, 0] <= room[0]) & (room[1] >= 1) & (size[:, 1] <= room[2])
            if not fits.any():
                if empty:  # larger than a sequence
                    kind = int(np.argmax(left > 0))
                    result[order[next_of[kind]]] = bins
                    next_of[kind] += 1
                    left[kind] -= 1
                break
            value = scarce @ (room / limits)
            kind = int(np.argmax(np.where(fits, value, -1.0)))
            result[order[next_of[kind]]] = bins
            next_of[kind] += 1
            left[kind] -= 1
            room -= [size[kind, 0], 1, size[kind, 1]]
            empty = False
        keep = left > 0
        if keep.sum() < len(keep) // 2:
            size, left, next_of, scarce = size[keep], left[keep], next_of[keep], scarce[keep]
        bins += 1
    return result


def pack(items, limit=LIMIT, segments=SEGMENTS, loss_limit=LOSS, shard=SHARD):
    """The rows of ``items`` (any columns, with ``length`` and ``n_loss``) with
    sequence_id and offset.

    Items as long as a sequence are one by themselves. The others are dealt to shards
    by a hash of the whole row and of its place in the stored table, so that repeated
    rows spread too. Offsets in a sequence run from 0 without gaps. A null length
    counts as 0.
    """
    ship_package(items.sparkSession)
    with small_batches(items.sparkSession):
        items = materialize(items.withColumn("_row", F.monotonically_increasing_id()), "packing_items")
    rests = items.where(F.coalesce("length", F.lit(0)) < limit)
    shards = max(1, -(-rests.count() // shard))
    rests = rests.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    names = [c for c in items.columns if c != "_row"]
    schema = items.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(table):
        table = table.sort_by("_row")
        length = table.column("length").fill_null(0).to_numpy()
        number = fill(length, table.column("n_loss").fill_null(0).to_numpy(), limit, segments, loss_limit)
        order = np.argsort(number, kind="stable")
        ends = np.cumsum(length[order])
        starts = ends - length[order]
        begins = np.flatnonzero(np.diff(number[order], prepend=-1))
        offset = np.empty(len(order), np.int64)
        offset[order] = starts - np.repeat(starts[begins], np.diff(np.append(begins, len(order))))
        row = int(table.column("_shard")[0].as_py()) if len(table) else 0
        columns = [table.column(c) for c in names]
        return pa.table(
            [*columns, pa.array(number * shards + row), pa.array(offset)], [*names, "sequence_id", "offset"]
        )

    # shards number their sequences from 0 in steps; whole ones follow below zero
    packed = rests.groupBy("_shard").applyInArrow(run, schema)
    whole = items.where(F.col("length") >= limit).select(
        *names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def pack_documents(docs, definition, limit=LIMIT, special_as_text=True):
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. An empty table gives no rows. The registered
    queries set ``special_as_text`` to False, for the ids of the library's plain call."""
    return pack(pieces(docs, definition, limit, special_as_text=special_as_text), limit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
