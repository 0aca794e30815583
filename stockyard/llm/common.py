"""Helpers shared by the operators of this subpackage."""

import ctypes
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 2 << 20
WORD_BLOCK = 1 << 18  # characters of words whose features are made together, about 40 MB
MASK64 = (1 << 64) - 1


def ship_package(spark):
    """Put this package on the Python path of the workers, as ``--py-files`` would."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, path) if x)


remembered = {}  # what the tasks of one step leave in a worker for each other


def give_back(keep):
    """Freed memory goes from this process to the system; what other steps have left in it is
    dropped, unless this step is the one to ``keep`` it."""
    if not keep:
        remembered.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def released(run, keep=False):
    """``run`` for ``mapInArrow``, with memory given back before and after a partition. Workers
    live on from step to step, so what each of them holds would add to what later steps need."""

    def between(batches):
        give_back(keep)
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return between


def text_slices(batches, column, budget=SLICE_BYTES):
    """Slices of the batches with about ``budget`` bytes of text, at least one row each.

    Memory follows the slice, not the batch; a text longer than the budget is whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // budget
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def split_words(texts):
    """(code of every word, first word of every text and the end, distinct words).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    words = encoded.dictionary
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, words


def mix(h):
    """Final mixing of 64-bit hashes (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words):
    """64-bit hash of every string of an Arrow array, by its UTF-8 bytes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    result = np.zeros(n, np.uint64)
    filled = lengths > 0
    if filled.any():
        starts = (offsets[:-1] - offsets[0])[filled]
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths[filled])
        terms = (raw.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        result[filled] = np.add.reduceat(terms, starts)
    return mix(result + lengths.astype(np.uint64))


def powers(n, base=0x9E3779B97F4A7C15):
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    factors = np.full(max(n, 1), base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def segment_sums(values, offsets):
    """Sum of ``values`` between consecutive offsets; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_max(values, offsets, default):
    """Maximum between consecutive offsets; empty segments give ``default``."""
    result = np.full(len(offsets) - 1, default, np.float64)
    filled = offsets[1:] > offsets[:-1]
    if filled.any():
        result[filled] = np.maximum.reduceat(values, offsets[:-1][filled])
    return result


def subword_features(words, bits, sizes=(3, 4, 5)):
    """Hashed features of every word: the word itself and its character n-grams.

    ``words`` is a list of strings; ``<`` and ``>`` mark word ends. Returns (word
    number, feature) pairs as two arrays, features below ``2 ** bits``.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    factor = powers(int(lengths.max()))
    place = np.arange(len(text)) - np.repeat(starts, lengths)
    shift = np.uint64(64 - bits)
    owners = [np.arange(len(words))]
    hashes = [mix(np.add.reduceat(text * factor[place], starts) + np.uint64(7))]
    for n in sizes:
        if len(text) < n:
            continue
        gram = np.zeros(len(text) - n + 1, np.uint64)
        for k in range(n):
            gram += text[k : len(text) - n + 1 + k] * factor_at(k)
        inside = owner[: len(gram)] == owner[n - 1 :]
        owners.append(owner[: len(gram)][inside])
        hashes.append(mix(gram[inside] + np.uint64(n << 40)))
    return np.concatenate(owners), (np.concatenate(hashes) >> shift).astype(np.int64)


def subword_sums(words, bits, weights, sizes=(3, 4, 5), block=WORD_BLOCK):
    """(sum of the weights of its features, number of features) of every word.

    As by ``subword_features``, but some ``block`` characters at a time, so that memory does
    not follow the text; a word longer than that is taken in stretches.
    """
    total, count = np.zeros(len(words)), np.zeros(len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    group = np.cumsum(lengths) // block
    long = lengths > block
    cuts = np.flatnonzero((np.diff(group) > 0) | long[1:] | long[:-1]) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
        if start == end:
            continue
        if long[start]:
            features = _stretches(words[start], bits, sizes, block)
            for part in features:
                total[start] += weights[part].sum()
                count[start] += len(part)
            continue
        owner, feature = subword_features(words[start:end], bits, sizes)
        total[start:end] = np.bincount(owner, weights=weights[feature], minlength=end - start)
        count[start:end] = np.bincount(owner, minlength=end - start)
    return total, count


def _stretches(word, bits, sizes, block):
    """The features of one long word, in parts."""
    shift, text = np.uint64(64 - bits), f"<{word}>"
    whole, base = np.zeros(1, np.uint64), 0x9E3779B97F4A7C15
    for start in range(0, len(text), block):
        part = np.frombuffer(text[start : start + block + max(sizes) - 1].encode("utf-32-le"), "<u4").astype(np.uint64)
        size = min(block, len(text) - start)
        place = powers(size) * np.uint64(pow(base, start, 1 << 64))
        whole += (part[:size] * place).sum(dtype=np.uint64)
        for n in sizes:
            grams = min(size, len(part) - n + 1)
            if grams > 0:
                gram = np.zeros(grams, np.uint64)
                for k in range(n):
                    gram += part[k : k + grams] * factor_at(k)
                yield (mix(gram + np.uint64(n << 40)) >> shift).astype(np.int64)
    yield (mix(whole + np.uint64(7)) >> shift).astype(np.int64)


def factor_at(k, base=0xD6E8FEB86659FD93):
    return np.uint64(pow(base, k + 1, 1 << 64))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def free_name(taken, base):
    """``base``, or ``base`` with underscores if a column has that name."""
    taken = {c.lower() for c in taken}
    while base.lower() in taken:
        base += "_"
    return base
