"""Substring dedup: passages that other documents hold too are cut out.

Paragraphs (lines) get MinHash signatures of their five-word shingles, cut into bands
tuned for recall at the threshold; paragraphs that share a band are joined, verified
by the exact Jaccard similarity of their shingles, and clustered by components. A
paragraph goes if its component has a paragraph in a document with a smaller id.

A passage may also stand in the middle of unlike paragraphs. So sentences are compared
too, as they are: at that length one band over everything is the tuned choice, since
a changed word costs more than a fifth of the shingles. Sentences under ``SHORT`` words
go with the one that follows; a very long one is parted at words chosen by their hash.

Neither sees where a passage begins or ends inside a sentence. So windows of ``SEED``
words are compared as well, wherever lines and sentences end. Of every ``SPREAD``
windows in a row the one with the smallest hash is a seed: documents that share
``SEED + SPREAD - 1`` words share a seed, whatever stands around. Near the seeds that
different documents hold, all windows are compared, so a passage is marked to the word.

What is marked in a document is merged into runs, and runs of ``MIN_RUN`` words or more
are cut. Documents with the smallest id keep theirs, so one copy stays.

Only hashes and positions are shuffled. Texts are read again for paragraphs to be
verified and documents to be cut; who needs that is first told by bitmaps of a fixed
size, which let a row too many pass but never lose one.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from stockyard.llm.common import (
    SLICE_BYTES, free_name, mix, powers, released, ship_package, split_words, text_slices, word_hashes,
)
from stockyard.llm.components import connected
from stockyard.session import materialize, scratch, small_batches, unsorted_joins

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
ROWS = 3               # hashes in a band
MIN_PARAGRAPH = 20     # words of a paragraph that gets a signature
MIN_RUN = 25           # words of a run that is cut
SHORT, LONG = 6, 48    # words of a sentence that is joined to the next, or parted
SEED = 25              # words of a window; not over MIN_RUN
SPREAD = 25            # windows in a row that have a seed; not over SEED, so seeds leave no gap
BLOCK = 4096           # paragraphs that one verification takes
MAP_WORDS = 1 << 18    # 64-bit words of a bitmap, at most 16 MB when broadcast

LINE = re.compile(r"[^\n]+")
SENTENCE = re.compile(r"[^\s.!?][^\n.!?]*(?:[.!?]+[^\s.!?][^\n.!?]*)*[.!?]*|[.!?]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune(threshold=THRESHOLD, recall=RECALL, rows=ROWS):
    """Fewest bands of ``rows`` hashes that find a pair at the threshold with the recall."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def sentences(text):
    """(start, end) of the units of a text that are compared as they are."""
    units = []
    for line in LINE.finditer(text):
        start = None
        for found in SENTENCE.finditer(text, line.start(), line.end()):
            begin = found.start() if start is None else start
            n = len(found.group().split())
            if n < SHORT:
                start = begin
                continue
            start = None
            if n > LONG:
                units.extend(_parted(text, begin, found.end()))
            else:
                units.append((begin, found.end()))
        if start is not None:
            units.append((start, line.end()))
    return units


def _parted(text, start, end):
    for word in WORD.finditer(text, start, end):
        if word.end() < end and xxhash.xxh32_intdigest(word.group().encode()) % 12 == 0:
            yield start, word.end()
            start = word.end() + 1
    if start < end:
        yield start, end


def shingle_hashes(codes, offsets, hashes, width=SHINGLE):
    """(owner, hash) of the shingles of each text; a shorter text is one shingle."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
    last = np.repeat(offsets[1:], count)
    word, total, factor = hashes[codes], np.zeros(len(owner), np.uint64), powers(width + 1)
    for k in range(width):
        at = first + k
        inside = at < last
        total[inside] += word[at[inside]] * factor[k + 1]
    return owner, mix(total)


def signatures(lines, bands, rows=ROWS):
    """(words, hash, band hashes) of every line of an Arrow array."""
    codes, offsets, words = split_words(lines)
    hashes = word_hashes(words)
    n = np.diff(offsets)
    owner, shingle = shingle_hashes(codes, offsets, hashes)
    whole = np.zeros(len(n), np.uint64)
    keys = np.zeros((len(n), bands), np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], n)
        whole[filled] = np.add.reduceat(hashes[codes] * powers(int(n.max()) + 1)[place + 1], offsets[:-1][filled])
        starts = np.searchsorted(owner, filled)
        factors = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for band in range(bands):
            key = np.full(len(filled), band + 1, np.uint64)
            for row in range(rows):
                i = 2 * (band * rows + row)
                least = np.minimum.reduceat(shingle * factors[i] + factors[i + 1], starts)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[filled, band] = key
    return n, mix(whole + n.astype(np.uint64)), keys


def windows(codes, offsets, hashes, width=SEED):
    """(hash, whether it lies in one text) of the window that begins at each word; the
    last ``width - 1`` words of all have none."""
    n = max(len(codes) - width + 1, 0)
    base = 0x9E3779B97F4A7C15
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[codes] * powers(len(codes), base)[: len(codes)])])
    back = powers(n, pow(base, -1, 1 << 64))[:n]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return mix((total[width:] - total[: len(total) - width])[:n] * back), owner[:n] == owner[width - 1 :][:n]


def _sliding(values, width, choose):
    have = 1
    while have < width:
        step = min(have, width - have)
        values = choose(values[:-step], values[step:])
        have += step
    return values


def seeds(h, inside, spread=SPREAD):
    """Places of the windows with the smallest hash among some ``spread`` in a row of one
    text. Of equal ones those early in sixteen go first, so that few are chosen."""
    if len(h) < spread:
        return np.zeros(0, np.int64)
    turn = np.arange(len(h), dtype=np.uint64) & np.uint64(15)
    key = np.where(inside, (h & ~np.uint64(31)) | np.uint64(16) | turn, np.uint64(0))
    least = np.pad(_sliding(key, spread, np.minimum), spread - 1)
    return np.flatnonzero(inside & (_sliding(least, spread, np.maximum) == key))


def units(docs, bands, text_col="text"):
    """Hashes and places of paragraphs (with bands), sentences and seeds (without). The
    start of a seed is a number of words, and its end is null.

    Columns: _key (of id and text), _doc, start, end, h, bands.
    """
    ship_package(docs.sparkSession)
    source = docs.select(
        F.xxhash64("doc_id", text_col).alias("_key"), F.col("doc_id").cast("long").alias("_doc"),
        F.col(text_col).alias("_text"),
    )
    shape = "_key long, _doc long, start int, `end` int, h long, bands array<long>"

    def run(batches):
        for part in text_slices(batches, "_text", SLICE_BYTES // 2):
            keys, ids = part.column("_key"), part.column("_doc")
            owner, start, end, h = [], [], [], []
            line_owner, line_start, line_end, lines = [], [], [], []
            for i, text in enumerate(part.column("_text").to_pylist()):
                if not text:
                    continue
                for a, b in sentences(text):
                    words = text[a:b].split()
                    if words:
                        owner.append(i)
                        start.append(a)
                        end.append(b)
                        h.append(xxhash.xxh64_intdigest(" ".join(words).encode(), 1))
                for found in LINE.finditer(text):
                    line_owner.append(i)
                    line_start.append(found.start())
                    line_end.append(found.end())
                    lines.append(found.group())
            codes, offsets, words = split_words(part.column("_text"))
            h_at, inside = windows(codes, offsets, word_hashes(words))
            chosen = seeds(h_at, inside)
            of = np.searchsorted(offsets, chosen, "right") - 1
            yield _rows(keys, ids, of, chosen - offsets[of], None, h_at[chosen], None)
            n, whole, bands_of = signatures(pa.array(lines, pa.string()), bands)
            kept = np.flatnonzero(n >= MIN_PARAGRAPH)
            yield _rows(keys, ids, owner, start, end, np.array(h, np.uint64), None)
            yield _rows(
                keys, ids, np.array(line_owner, np.int64)[kept], np.array(line_start, np.int64)[kept],
                np.array(line_end, np.int64)[kept], whole[kept], bands_of[kept],
            )

    def _rows(keys, ids, owner, start, end, h, bands_of):
        owner = pa.array(np.asarray(owner, np.int64))
        n = len(owner)
        if bands_of is None:
            lists = pa.nulls(n, pa.list_(pa.int64()))
        else:
            at = pa.array(np.arange(n + 1, dtype=np.int32) * bands_of.shape[1])
            lists = pa.ListArray.from_arrays(at, pa.array(bands_of.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [keys.take(owner), ids.take(owner), pa.array(np.asarray(start, np.int32)),
             pa.nulls(n, pa.int32()) if end is None else pa.array(np.asarray(end, np.int32)),
             pa.array(h.view(np.int64)), lists],
            ["_key", "_doc", "start", "end", "h", "bands"],
        )

    return source.mapInArrow(released(run), shape)


def _bitmap(wanted, column):
    """Bitmap of a column's values, as (word, bits); at most ``MAP_WORDS`` rows."""
    bit = F.xxhash64(F.col(column))
    return wanted.select(
        F.pmod(F.shiftright(bit, 6), F.lit(MAP_WORDS)).cast("int").alias("_word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("_bit"),
    ).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _perhaps(rows, column, bitmap, found=True):
    """Rows whose value may be in the bitmap; or those whose value is not."""
    bit = F.xxhash64(F.col(column))
    word = F.pmod(F.shiftright(bit, 6), F.lit(MAP_WORDS)).cast("int")
    here = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    at, there, bits = (free_name(rows.columns, c) for c in ("_at", "_word", "_bits"))
    bitmap = bitmap.select(F.col("_word").alias(there), F.col("_bits").alias(bits))
    joined = rows.withColumn(at, word).join(F.broadcast(bitmap), F.col(at) == F.col(there), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(here) != 0, F.lit(False))
    return joined.where(hit if found else ~hit).select(*rows.columns)


LAST = (1 << 63) - 1  # in place of a null id, which comes after all others


def _firsts(rows):
    """(h, first) of what occurs in documents with different ids."""
    return rows.groupBy("h").agg(
        F.min(F.coalesce("_doc", F.lit(LAST))).alias("first"), F.max(F.coalesce("_doc", F.lit(LAST))).alias("last")
    ).where("first < last").select("h", "first")


def _marked(rows, firsts):
    """Spans of the rows whose ``h`` a document with a smaller id holds."""
    firsts = materialize(firsts, "substring_firsts")
    near = _perhaps(rows, "h", materialize(_bitmap(firsts, "h"), "substring_bitmap"))
    return near.join(firsts, "h").where(F.coalesce("_doc", F.lit(LAST)) > F.col("first")).select(
        "_key", "start", "end", "first"
    )


def _near_seeds(docs, chosen, text_col):
    """All windows near the seeds that documents with different ids hold, as ``units``
    gives seeds. A passage reaches less than ``SPREAD`` windows beyond its outer seeds."""
    firsts = materialize(_firsts(chosen), "substring_firsts")
    near = _perhaps(chosen, "h", materialize(_bitmap(firsts, "h"), "substring_bitmap"))
    places = materialize(
        near.join(firsts.select("h"), "h").groupBy("_key").agg(F.collect_set("start").alias("places")),
        "substring_places",
    )
    keyed = docs.select(
        F.xxhash64("doc_id", text_col).alias("_key"), F.col("doc_id").cast("long").alias("_doc"),
        F.col(text_col).alias("_text"),
    )
    keyed = _perhaps(keyed, "_key", materialize(_bitmap(places, "_key"), "substring_bitmap"))

    def run(batches):
        for part in text_slices(batches, "_text", SLICE_BYTES // 2):
            codes, offsets, words = split_words(part.column("_text"))
            h, inside = windows(codes, offsets, word_hashes(words))
            listed = part.column("places")
            of = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy())
            at = listed.flatten().to_numpy() + offsets[of]
            near = np.zeros(len(h) + 1, np.int64)
            np.add.at(near, np.maximum(at - SPREAD + 1, offsets[of]), 1)
            np.add.at(near, np.minimum(np.minimum(at + SPREAD, offsets[of + 1]), len(h)), -1)
            taken = np.flatnonzero(inside & (np.cumsum(near[:-1]) > 0))
            of = np.searchsorted(offsets, taken, "right") - 1
            owner = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column("_key").take(owner), part.column("_doc").take(owner),
                 pa.array((taken - offsets[of]).astype(np.int32)), pa.nulls(len(taken), pa.int32()),
                 pa.array(h[taken].view(np.int64))],
                ["_key", "_doc", "start", "end", "h"],
            )

    return keyed.join(places, "_key").mapInArrow(released(run), "_key long, _doc long, start int, `end` int, h long")


def _verify(table):
    """Spanning links between the paragraphs of a block whose similarity reaches the
    threshold; from the smallest hash on, a paragraph that was reached isn't compared
    again."""
    h = table.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    h = h[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    order, h = order[fresh], h[fresh]
    packed = table.column("shingles").to_pylist()
    sets = [np.frombuffer(packed[i], np.uint64) for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    ends = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    todo, children, parents = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        if not todo[seed]:
            continue
        todo[seed], front = False, [seed]
        while front and todo.any():
            one = front.pop()
            mark[code[ends[one] : ends[one + 1]]] = True
            common = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[code[ends[one] : ends[one + 1]]] = False
            near = np.flatnonzero(todo & (common >= THRESHOLD * (size + size[one] - common) - 1e-9))
            todo[near] = False
            front.extend(near.tolist())
            children.extend(h[near])
            parents.extend([h[seed]] * len(near))
    return pa.table({"a": pa.array(children, pa.int64()), "b": pa.array(parents, pa.int64())})


def _near_paragraphs(docs, lines, text_col):
    """(h, first) of paragraphs whose component reaches into a document with a smaller
    id than some of its own."""
    distinct = materialize(
        lines.groupBy("h").agg(
            F.min(F.coalesce("_doc", F.lit(LAST))).alias("first"),
            F.min(F.struct("_key", "start", "end")).alias("place"), F.first("bands").alias("bands"),
        ),
        "substring_paragraphs",
    )
    banded = distinct.select("h", F.posexplode("bands").alias("_band", "_value")).select(
        "h", F.xxhash64("_band", "_value").alias("_bucket")
    )
    # buckets that hold the same paragraphs need one look
    buckets = banded.groupBy("_bucket").agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y")
    ).where("n > 1").groupBy("n", "x", "y").agg(F.min("_bucket").alias("_bucket")).select("_bucket", "n")
    buckets = materialize(buckets, "substring_buckets")
    members = _perhaps(banded, "_bucket", materialize(_bitmap(buckets, "_bucket"), "substring_bitmap"))
    members = materialize(members.join(buckets, "_bucket"), "substring_members")
    wanted = members.select("h").distinct()
    places = _perhaps(distinct, "h", materialize(_bitmap(wanted, "h"), "substring_bitmap")).join(wanted, "h").select(
        F.col("place._key").alias("_key"), F.struct("h", "place.start", "place.end").alias("p")
    ).groupBy("_key").agg(F.collect_list("p").alias("places"))
    places = materialize(places, "substring_places")
    keyed = docs.select(F.xxhash64("doc_id", text_col).alias("_key"), F.col(text_col).alias("_text"))
    near = _perhaps(keyed, "_key", materialize(_bitmap(places, "_key"), "substring_bitmap"))

    def shingles(batches):
        for part in text_slices(batches, "_text", SLICE_BYTES):
            hs, lines_of = [], []
            for text, found in zip(part.column("_text").to_pylist(), part.column("places").to_pylist()):
                for p in found:
                    hs.append(p["h"])
                    lines_of.append(text[p["start"] : p["end"]])
            codes, offsets, words = split_words(pa.array(lines_of, pa.string()))
            owner, values = shingle_hashes(codes, offsets, word_hashes(words))
            ends = np.searchsorted(owner, np.arange(len(hs) + 1))
            packed = [np.unique(values[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(packed, pa.binary())], ["h", "shingles"])

    payload = near.join(places, "_key").mapInArrow(released(shingles), "h long, shingles binary")
    payload = payload.groupBy("h").agg(F.first("shingles").alias("shingles"))
    # a large bucket is dealt into parts, and every two parts meet in a block
    parts = F.ceil(F.col("n") * 2 / F.lit(BLOCK)).cast("int")
    other = F.explode(F.when(
        F.col("n") <= BLOCK, F.array(F.lit(0))
    ).otherwise(F.sequence(F.lit(0), parts - 1)))
    part = F.when(F.col("n") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("h"), parts).cast("int"))
    blocks = members.withColumn("_part", part).withColumn("_other", other).select(
        "h", F.xxhash64("_bucket", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("_block")
    )
    edges = blocks.join(payload, "h").groupBy("_block").applyInArrow(_verify, "a long, b long")
    roots = connected(edges, "substring_links")
    rooted = distinct.select("h", "first").join(roots, F.col("h") == F.col("node")).select("h", "first", "root")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(best, "root").select("h", F.col("best").alias("first"))


def runs(text, spans, min_run=MIN_RUN):
    """Merged (start, end) of the spans that have enough words; white space between two
    spans joins them."""
    merged = []
    for start, end in sorted(spans):
        if merged and (start <= merged[-1][1] or not text[merged[-1][1] : start].strip()):
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(a, b) for a, b in merged if len(WORD.findall(text, a, b)) >= min_run]


def word_spans(text):
    """First and last character places (the last exclusive) of the words of a text."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    word = np.concatenate([[False], ~((code == 32) | ((code >= 9) & (code <= 13))), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def joined_windows(starts, width=SEED):
    """(first word, last word) of the runs that windows beginning at these words form."""
    starts = np.unique(starts)
    fresh = np.flatnonzero(np.diff(starts, prepend=-width - 2) > width)
    return starts[fresh], starts[np.append(fresh[1:], len(starts)) - 1] + width - 1


def _cut(text, start, end, first, min_run):
    """(text left, runs, ids of the documents that keep what was cut) of a text with marks:
    characters ``start`` to ``end``, or the window that begins at word ``start`` if ``end``
    is -1, which document ``first`` keeps."""
    window = end < 0
    spans = list(zip(start[~window].tolist(), end[~window].tolist()))
    if window.any():
        begins, ends = word_spans(text)
        one, last = joined_windows(start[window])  # windows that hang together are one span
        spans += zip(begins[one].tolist(), ends[last].tolist())
        start, end = start.copy(), end.copy()
        end[window] = ends[start[window] + SEED - 1]
        start[window] = begins[start[window]]
    gone = runs(text, spans, min_run)
    if not gone:
        return text, gone, []
    parts, at = [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    begins, ends = np.array(gone).T
    run = np.searchsorted(begins, start, "right") - 1
    kept_by = np.unique(first[(run >= 0) & (end <= ends[run]) & (first != LAST)])
    return "".join(parts), gone, kept_by.tolist()


def _spans(docs, text_col):
    """(_key, _spans) of the documents with marks. The hashes, which take more room than the
    texts, are deleted when the marks are stored."""
    spark = docs.sparkSession
    with scratch(spark) as keep, small_batches(spark), unsorted_joins(spark):
        found = materialize(units(docs, tune(), text_col), "substring_units")
        lines, whole = found.where("bands IS NOT NULL"), found.where("bands IS NULL AND `end` IS NOT NULL")
        near = materialize(_near_seeds(docs, found.where("`end` IS NULL"), text_col), "substring_windows")
        marked = _marked(whole, _firsts(whole)).unionByName(
            _marked(lines, _near_paragraphs(docs, lines, text_col))
        ).unionByName(_marked(near, _firsts(near)))
        return keep(
            marked.groupBy("_key").agg(F.collect_set(F.struct("start", "end", "first")).alias("_spans")),
            "substring_spans",
        )


def cut(docs, min_run=MIN_RUN, text_col="text"):
    """The columns of ``docs`` with the text after cutting, and a struct column (its
    name is returned too) of spans cut, words cut and the ids that keep the passages.

    Documents with equal ids are one document, in which nothing is cut for the other's
    sake; a null id comes after all others. Rows without a repeated passage, null and
    empty texts come out as they went in. White space around a cut stays.
    """
    spans = _spans(docs, text_col)
    key, listed, result = (free_name(docs.columns, c) for c in ("_key", "_spans", "_cut"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", text_col))
    bitmap = materialize(_bitmap(spans, "_key"), "substring_bitmap")
    spans = spans.select(F.col("_key").alias("_span_key"), F.col("_spans").alias(listed))
    touched = _perhaps(keyed, key, bitmap).join(spans, F.col(key) == F.col("_span_key"), "left").drop("_span_key", key)
    kind = "struct<spans:array<struct<start:int,`end`:int>>,words:bigint,kept_by:array<bigint>>"
    schema = docs.withColumn(result, F.lit(None).cast(kind)).schema
    arrow_kind = pa.struct([
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("words", pa.int64()), ("kept_by", pa.list_(pa.int64())),
    ])

    def apply(batches):
        for part in text_slices(batches, text_col):
            texts, made = [], []
            marks = part.column(listed)
            stops = np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy())
            flat = marks.flatten()
            start, end, first = (
                pc.fill_null(pc.struct_field(flat, c), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("start", "end", "first")
            )
            for text, a, b in zip(part.column(text_col).to_pylist(), [0, *stops.tolist()], stops.tolist()):
                if text and a < b:
                    left, gone, kept_by = _cut(text, start[a:b], end[a:b], first[a:b], min_run)
                    words = sum(len(WORD.findall(text, *run)) for run in gone)
                    texts.append(left)
                    made.append({"spans": [{"start": a, "end": b} for a, b in gone], "words": words, "kept_by": kept_by})
                else:
                    texts.append(text)
                    made.append({"spans": [], "words": 0, "kept_by": []})
            columns = [
                pa.array(texts, pa.string()) if name == text_col else part.column(name) for name in docs_columns
            ]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, arrow_kind)], [*docs_columns, result])

    docs_columns = docs.columns
    untouched = _perhaps(keyed, key, bitmap, found=False).drop(key).withColumn(
        result, F.struct(
            F.array().cast("array<struct<start:int,`end`:int>>").alias("spans"), F.lit(0).cast("bigint").alias("words"),
            F.array().cast("array<bigint>").alias("kept_by"),
        )
    )
    return untouched.unionByName(touched.mapInArrow(released(apply), schema)), result


def dedup(docs):
    """doc_id, text after cutting, n_removed (words), spans (character positions in the
    old text) and kept_by (ids of the documents that keep the passages) of every row."""
    rows, result = cut(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", "text", F.col(f"{result}.words").alias("n_removed"), F.col(f"{result}.spans").alias("spans"),
        F.col(f"{result}.kept_by").alias("kept_by"),
    )


def without_repeats(docs):
    """``docs`` with their columns, the texts after cutting; n_chars, if there is such a
    column, is counted anew for texts that changed."""
    rows, result = cut(docs)
    if "n_chars" in docs.columns:
        changed = F.col(f"{result}.words") > 0
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
