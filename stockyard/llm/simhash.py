"""SimHash near-duplicates: fingerprints joined through a vantage-point tree.

A tree over 64-bit fingerprints splits by Hamming distance from a vantage point: the
inner branch takes distances up to a radius r, the outer branch those above r - reach.
By the triangle inequality two fingerprints within ``reach`` of each other can't be
parted by such a split, so every such pair meets in some leaf; what lies near the
boundary goes to both. Of two fingerprints that differ in at most ``max_bits`` bits, one
half differs in at most half as many: so there are two trees, one for the distances of
each half, with a reach of ``max_bits // 2``, and far fewer fingerprints lie near a
boundary than if whole fingerprints were split.

The upper levels are built by the driver from a bounded sample of fingerprints and deal
the distinct fingerprints out to shards; each shard builds its own lower levels and
compares whole fingerprints. A shard returns a spanning forest of its links, never its
pairs, and the components join the forests.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockyard.llm.common import free_name, released, ship_package, text_slices
from stockyard.llm.components import connected
from stockyard.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SAMPLE = 50_000  # fingerprints that the driver builds the upper tree from, at most
SHARD = 4096     # fingerprints that one comparison takes, about
CANDIDATES = 6   # vantage points tried for each split
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)


def fingerprint(raw, shingle=SHINGLE):
    """64-bit SimHash of the UTF-8 bytes of a text, as an unsigned integer.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A null text, or one
    without words, gives 0; one with fewer words than a shingle is one shingle.
    """
    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    shingles = zip(*[words[k : k + n] for k in range(shingle)]) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 15):
        part = hashes[start : start + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs, shingle=SHINGLE, text_col="text"):
    """The columns of ``docs`` without the text, and ``_fp``, the fingerprint as a long."""
    ship_package(docs.sparkSession)
    others = [F.col(c) for c in docs.columns if c != text_col]
    source = docs.select(*others, F.col(text_col).cast("binary").alias("_raw"))
    schema = docs.select(*others, F.lit(0).cast("long").alias("_fp")).schema

    def run(batches):
        for part in text_slices(batches, "_raw"):
            prints = [fingerprint(raw, shingle) for raw in part.column("_raw").to_pylist()]
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [part.column(name) for name in part.schema.names if name != "_raw"]
            yield pa.RecordBatch.from_arrays([*columns, prints], schema.names)

    return source.mapInArrow(released(run), schema)


class Tree:
    """Inner nodes are (vantage point, radius, inner child, outer child); a negative
    child -k-1 is leaf k. Distances count the bits of ``mask`` alone; pairs within
    ``reach`` share a leaf."""

    def __init__(self, sample, total, leaf, mask, reach, seed=11):
        self.mask, self.reach, self.nodes, self.leaves = np.uint64(mask), reach, [], 0
        self._random = np.random.default_rng(seed)
        self._scale = total / max(len(sample), 1)
        self.root = self._grow(sample, leaf)

    def _grow(self, sample, leaf):
        split = None
        if len(sample) * self._scale > leaf and len(sample) >= 24:
            split = self._split(sample)
        if split is None:
            self.leaves += 1
            return -self.leaves
        point, radius = split
        far = self._far(sample, point)
        at = len(self.nodes)
        self.nodes.append(None)
        inner = self._grow(sample[far <= radius], leaf)
        outer = self._grow(sample[far > radius - self.reach], leaf)
        self.nodes[at] = (point, radius, inner, outer)
        return at

    def _split(self, sample):
        """The candidate whose larger branch is smallest; none if that hardly shrinks."""
        best = (0.9 * len(sample), None)
        for point in self._random.choice(sample, CANDIDATES):
            upto = np.cumsum(np.bincount(self._far(sample, point), minlength=65))
            low = np.concatenate([np.zeros(self.reach, np.int64), upto[: 65 - self.reach]])
            larger = np.maximum(upto, len(sample) - low)
            radius = int(np.argmin(larger))
            if larger[radius] < best[0]:
                best = (larger[radius], (point, radius))
        return best[1]

    def _far(self, prints, point):
        return np.bitwise_count((prints ^ point) & self.mask).astype(np.int64)

    def leaves_of(self, prints):
        """(position, leaf) for every leaf that each fingerprint belongs to."""
        positions, leaves, todo = [], [], [(self.root, np.arange(len(prints)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                positions.append(rows)
                leaves.append(np.full(len(rows), -node - 1, np.int64))
                continue
            point, radius, inner, outer = self.nodes[node]
            far = self._far(prints[rows], point)
            todo.append((inner, rows[far <= radius]))
            todo.append((outer, rows[far > radius - self.reach]))
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(positions), np.concatenate(leaves)


def trees(sample, total, shard=SHARD, max_bits=MAX_BITS):
    """One tree for each half of the fingerprints."""
    return [Tree(sample, total, shard, mask, max_bits // 2) for mask in HALVES]


def homes(forest_of, prints):
    """(position, leaf) for every leaf of any of the trees; leaves are numbered through."""
    found, before = [], 0
    for tree in forest_of:
        positions, leaves = tree.leaves_of(prints)
        found.append((positions, leaves + before))
        before += tree.leaves
    return np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])


def forest(prints, max_bits=MAX_BITS, shard=SHARD):
    """Spanning forest (child, parent) of the links between distinct fingerprints."""
    prints = np.sort(prints)
    if len(prints) > 2 * shard:
        upper = trees(prints, len(prints), shard, max_bits)
        if all(tree.nodes for tree in upper):
            positions, leaves = homes(upper, prints)
            order = np.argsort(leaves, kind="stable")
            parts = np.split(positions[order], np.flatnonzero(np.diff(leaves[order])) + 1)
            found = [_reached(prints[np.sort(part)], max_bits) for part in parts]
            return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    return _reached(prints, max_bits)


def _reached(prints, max_bits):
    """From the smallest fingerprint not yet reached, spread over links; each component
    becomes a star around its smallest fingerprint. A fingerprint that was reached is
    not compared again, so a dense group costs little."""
    rest, children, parents = prints, [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = prints[:0]
        near = np.bitwise_count(rest ^ root) <= max_bits
        while True:
            if near is not None and near.any():
                new, rest = rest[near], rest[~near]
                children.append(new)
                parents.append(np.full(len(new), root))
                front = np.concatenate([front, new])
            if not len(front) or not len(rest):
                break
            some, front = front[:64], front[64:]
            near = (np.bitwise_count(some[:, None] ^ rest[None, :]) <= max_bits).any(0)
    if not children:
        return prints[:0], prints[:0]
    return np.concatenate(children), np.concatenate(parents)


def links(prints, max_bits=MAX_BITS, sample=SAMPLE, shard=SHARD):
    """Spanning links (a, b) between the distinct fingerprints of column ``_fp``, which has no
    nulls; an empty frame gives none."""
    spark = prints.sparkSession
    ship_package(spark)
    total = prints.count()
    drawn = prints.orderBy(F.xxhash64("_fp"), "_fp").limit(sample).toArrow()["_fp"].to_numpy()
    upper = trees(np.sort(drawn.astype(np.int64).view(np.uint64)), total, shard, max_bits)

    def deal(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            positions, leaves = homes(upper, values.view(np.uint64))
            for start in range(0, len(leaves), 1 << 20):
                part = slice(start, start + (1 << 20))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[part]), pa.array(values[positions[part]])], ["_leaf", "_fp"]
                )

    def compare(table):
        values = table.column("_fp").to_numpy().astype(np.int64)
        child, parent = forest(values.view(np.uint64), max_bits, shard)
        return pa.table({"a": child.view(np.int64), "b": parent.view(np.int64)})

    return (
        prints.select("_fp").mapInArrow(released(deal), "_leaf long, _fp long")
        .groupBy("_leaf").applyInArrow(compare, "a long, b long")
    )


def _components(rows, max_bits):
    """(_fp, _first) with the smallest ``_order`` of each fingerprint's component."""
    firsts = materialize(rows.groupBy("_fp").agg(F.min("_order").alias("_first")), "simhash_prints")
    roots = connected(links(firsts.select("_fp"), max_bits), "simhash_links")
    rooted = firsts.join(roots, firsts["_fp"] == roots["node"], "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root")
    )
    best = rooted.groupBy("_root").agg(F.min("_first").alias("_best"))
    return rooted.join(best, "_root").select("_fp", F.col("_best").alias("_first"))


def near_duplicates(docs, shingle=SHINGLE, max_bits=MAX_BITS):
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    component_id is the smallest doc_id that links reach, itself included. Repeated
    rows come out as often as they went in; a null id takes part, and names a component
    only if nothing else in it has an id.
    """
    rows = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle), "simhash_documents")
    ordered = rows.withColumn("_order", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))
    parts = _components(ordered, max_bits)
    return rows.join(parts, "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_first.id").alias("component_id"),
    )


def keep_one(docs, shingle=SHINGLE, max_bits=MAX_BITS):
    """The rows of ``docs`` with one document of each component: the one with the
    smallest id (a null id last, then by content). Rows that repeat an id and a text
    count as one document."""
    key = F.xxhash64("doc_id", "text").alias("_key")
    rows = with_fingerprint(docs.select("doc_id", "text", key), shingle)
    rows = materialize(rows, "simhash_documents")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    name, winner, owner = (free_name(docs.columns, c) for c in ("_key", "_winner", "_id"))
    winners = _components(rows.withColumn("_order", order), max_bits).select(
        F.col("_first.id").alias(owner), F.col("_first.key").alias(winner)
    ).distinct()
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    same = (F.col(name) == F.col(winner)) & F.col("doc_id").eqNullSafe(F.col(owner))
    return keyed.join(winners, same, "left_semi").dropDuplicates([name, "doc_id"]).select(*docs.columns)
