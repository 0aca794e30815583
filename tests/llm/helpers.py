"""Brute-force versions and small tables for the tests of this folder."""

import re

import numpy as np
import xxhash
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, *rows):
    """Documents from texts, or from (doc_id, text) or whole rows."""
    full = []
    for i, row in enumerate(rows):
        row = row if isinstance(row, tuple) else (i, row)
        doc_id, text, lang, source = (*row, "en", "src")[:4] if len(row) == 2 else row[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, DOCS)


def prose(seed, words=80, vocabulary=400):
    """Invented sentences; the same for the same seed."""
    random = np.random.default_rng(seed)
    syllables = "ka lo mi ren tas vo pel dun sor ti gha nu bre ol".split()
    lexicon = ["".join(np.random.default_rng(k).choice(syllables, 3)) for k in range(vocabulary)]
    out, left = [], words
    while left > 0:
        n = min(int(random.integers(7, 14)), left)
        out.append(" ".join(random.choice(lexicon, n)).capitalize() + ".")
        left -= n
    return " ".join(out)


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text):
    """One bit at a time, as the definition says."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeated_words(words, run=5):
    """Number of words inside windows that occur twice or more."""
    windows = {}
    for i in range(len(words) - run + 1):
        windows.setdefault(tuple(words[i : i + run]), []).append(i)
    return len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(run)})


def rows_of(df):
    return [r.asDict(recursive=True) if isinstance(r, Row) else r for r in df.collect()]
