import numpy as np
import pytest
from helpers import docs, prose, simhash, union_find
from pyspark.sql import functions as F

from stockyard.llm import simhash as S


def _links(prints):
    prints = sorted(set(prints))
    return [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]


@pytest.mark.parametrize("text", [None, "", " \n ", "One", "one two", "A b C d", "É à É à é", prose(1, 300), "x " * 70_000])
def test_fingerprint_is_the_definition(text):
    raw = None if text is None else text.encode()
    assert S.fingerprint(raw) == simhash(text)


def _clustered(seed, clusters, members, flips):
    random = np.random.default_rng(seed)
    found = set()
    for _ in range(clusters):
        centre = int(random.integers(0, 1 << 63)) * 2 + int(random.integers(0, 2))
        for _ in range(members):
            value = centre
            for bit in random.choice(64, int(random.integers(0, flips + 1)), replace=False):
                value ^= 1 << int(bit)
            found.add(value)
    return np.array(sorted(found), np.uint64)


@pytest.mark.parametrize("shard", [16, 64, 4096])
def test_forest_joins_exactly_what_links_join(shard):
    prints = _clustered(3, 60, 12, 4)
    child, parent = S.forest(prints, shard=shard)
    nodes = prints.tolist()
    assert union_find(zip(child.tolist(), parent.tolist()), nodes) == union_find(_links(nodes), nodes)


def test_tree_brings_every_linked_pair_together():
    prints = _clustered(5, 100, 6, 3)
    upper = S.trees(prints, len(prints), 32)
    assert all(tree.leaves > 4 for tree in upper)
    positions, leaves = S.homes(upper, prints)
    homes = {}
    for p, leaf in zip(positions, leaves):
        homes.setdefault(int(prints[p]), set()).add(int(leaf))
    assert set(homes) == set(prints.tolist())
    assert all(homes[a] & homes[b] for a, b in _links(prints.tolist()))


def test_dense_group_gives_a_forest_not_its_pairs():
    prints = _clustered(8, 1, 4000, 2)
    child, parent = S.forest(prints)
    assert len(child) <= len(prints) - 1 and len(set(child.tolist())) == len(child)


def _table(spark):
    base = prose(1, 400)
    near = [base.replace(base.split()[k], "zorg", 1) for k in (10, 60, 120)]
    far = [prose(k, 120) for k in range(50, 90)]
    rows = [(7, base), (3, base), (12, near[0]), (15, near[1]), (1, near[2]), (None, base), (20, None), (21, ""), (21, "")]
    return docs(spark, *rows, *[(100 + i, t) for i, t in enumerate(far)])


def test_components_are_those_of_brute_force(spark):
    table = _table(spark)
    rows = table.collect()
    prints = {i: simhash(r["text"]) for i, r in enumerate(rows)}
    component = union_find(_links(prints.values()), set(prints.values()))
    smallest = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            root = component[prints[i]]
            smallest[root] = min(smallest.get(root, r["doc_id"]), r["doc_id"])
    expected = sorted(
        (str(r["doc_id"]), f"{prints[i]:016x}", smallest[component[prints[i]]]) for i, r in enumerate(rows)
    )
    found = S.near_duplicates(table).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected


def test_one_document_of_each_group_stays(spark):
    table = _table(spark).withColumn("_key", F.lit("mine")).withColumn("component_id", F.lit(0))
    kept = S.keep_one(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["component_id"] for r in S.near_duplicates(table).collect()}
    assert sorted(ids) == sorted(groups)


def test_empty_table(spark):
    table = docs(spark, "x").limit(0)
    assert S.near_duplicates(table).count() == 0 and S.keep_one(table).count() == 0


def test_components_operator(spark):
    from stockyard.llm.components import connected

    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    frame = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    expected = union_find([e for e in edges if e[0] != e[1]], nodes)
    found = connected(frame).collect()
    assert len(found) == len(nodes)
    assert {r["node"]: r["root"] for r in found} == expected


def test_columns_with_the_names_of_helpers_are_kept(spark):
    table = docs(spark, (1, "a b c d"), (2, "a b c d"), (3, "quite another text here"))
    for name in ("_key", "_winner", "_id", "_fp", "_order", "_root"):
        named = table.withColumn(name, F.lit(7))
        kept = S.keep_one(named)
        assert kept.columns == named.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
        assert {r[name] for r in kept.collect()} == {7}
