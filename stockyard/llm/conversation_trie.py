"""The prefix trie of conversations, from padded matrices of turn ids.

Rebuilt conversations are range-partitioned by their sequence of turn digests, so each
task holds one stretch of the lexicographic order, a shard, and almost every node of the
trie lies whole in one. In a shard the digests become ids, the sequences a matrix padded
with -1, and numpy's lexsort puts equal prefixes next to each other. A cell that differs
from the one above it marks a change; OR-accumulated over the columns, the changes mark
where a node of each depth starts, and reduceat aggregates members, children and
subtrees. The matrix is taken in blocks of columns that only hold the conversations that
reach them, so one long conversation doesn't pad the others.

Only the nodes on the paths of a shard's first and last conversation can reach into other
shards. They carry a digest of their path and recombine by it, as frames: counts add up,
and each such node counts once, in the smallest shard that holds it, for the subtrees of
all its ancestors there. Equal conversations are ordered by id and may fill many shards;
their ids reach the digest of a node as pieces, in order, one at a time.

A conversation must fit a task: it takes some 50 bytes for each of its turns.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.llm.common import ship_package
from stockyard.session import materialize

GROUP = 20           # conversations that share the turns of the first of them
SHARD = 100_000      # turns and conversations of a shard, on average
MOST_SHARDS = 20_000
CELLS = 1 << 22      # cells of a block of columns
PIECE = 1024         # ids of one piece of a list of ends
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)

INNER, EDGE, ENDS = 0, 1, 2  # kinds of rows that a shard returns
PARTS = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int64()),
    ("side", pa.int32()), ("common", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("member_words", pa.int64()), ("node_words", pa.int64()),
    ("words", pa.int64()), ("has_child", pa.bool_()), ("ends", pa.string()),
])
PARTS_DDL = (
    "kind int, key binary, parent_key binary, shard long, side int, common boolean, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, member_words long, node_words long, "
    "words long, has_child boolean, ends string"
)
NODE_COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def rebuild(conversations, group=GROUP):
    """(conv_id, path, words) of every conversation, rebuilt.

    Turns are ordered by ``turn``, null first, and equal ones by their digest (sha256 of
    role and text); repeated rows are turns of their own. A null role or text is empty.
    Conversation c starts with the first h turns of c - c % ``group``, h being the crc32 of
    c in decimal, modulo 4, and goes on with its own turns after its first h. Rows
    without a conv_id are left out. ``path`` holds 16 bytes for each turn, ``words`` the
    number of words of each. All conversations of a group meet in one shuffle.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        ).alias("turn"),
    )
    base = F.col("conv_id") - F.col("conv_id") % group
    whole = (
        rows.withColumn("base", base).repartition("base")
        .groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    none = F.slice("turns", 1, 0)
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3)), ignorenulls=True)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    whole = whole.withColumn("head", F.coalesce(head.over(Window.partitionBy("base")), none))
    turns = F.concat(
        F.slice("head", F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    )
    return whole.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


class Trie:
    """The trie of one shard.

    ``conv`` are the ids of the conversations, ``length`` their numbers of turns,
    ``digest`` (16 bytes each) and ``words`` their turns one after the other. Nodes are
    numbered by depth, then in order; node 0 is the root. ``order`` are the conversations
    in lexicographic order, equal ones by id, and ``end`` the node that each of these ends in.
    """

    def __init__(self, conv, length, digest, words, cells=CELLS):
        n = len(conv)
        ids = np.unique(digest, return_inverse=True)[1].reshape(-1)
        begin = np.cumsum(length) - length
        order = np.lexsort((conv, length > 0))
        at = np.zeros(n, np.int64)  # the deepest node found so far, by place in the order
        levels = [(np.zeros(1, np.int64) - 1, conv.min(keepdims=True), np.array([n]), np.zeros(1, np.int64),
                   np.zeros(1, np.int64), np.array([n - 1]))]
        total, depth = 1, 0
        while True:
            place = np.flatnonzero(length[order] > depth)  # conversations that go on
            if not len(place):
                break
            rows = order[place]
            width = int(min(length[rows].max() - depth, max(cells // len(rows), 1)))
            column = depth + np.arange(width)
            filled = column < length[rows][:, None]
            matrix = np.full(filled.shape, -1, np.int64)
            matrix[filled] = ids[(begin[rows][:, None] + column)[filled]]
            goes_on = length[rows] > depth + width
            sort = np.lexsort((conv[rows], goes_on, *matrix.T[::-1], at[place]))
            rows, matrix = rows[sort], matrix[sort]
            order[place] = rows
            change = np.ones(matrix.shape, bool)
            change[1:] = matrix[1:] != matrix[:-1]
            change[1:, 0] |= at[place][1:] != at[place][:-1]
            np.logical_or.accumulate(change, axis=1, out=change)
            for k in range(width):
                live = np.flatnonzero(matrix[:, k] >= 0)
                start = np.flatnonzero(change[live, k])
                count = np.diff(np.append(start, len(live)))
                first = live[start]
                levels.append((
                    at[place[first]], np.minimum.reduceat(conv[rows[live]], start), count,
                    words[begin[rows[first]] + depth + k], place[first], place[live[start + count - 1]],
                ))
                at[place[live]] = total + np.repeat(np.arange(len(start)), count)
                total += len(start)
            depth += width
        self.order, self.end, self.begin, self.length, self.conv, self.digest = order, at, begin, length, conv, digest
        sizes = [len(level[0]) for level in levels]
        self.depth = np.repeat(np.arange(len(levels)), sizes)
        self.parent, self.least, self.members, self.words, first, last = map(np.concatenate, zip(*levels))
        self.edge = (first == 0) | (last == n - 1)
        self._subtrees(np.cumsum([0, *sizes]))

    def _subtrees(self, bounds):
        """Children, leaves and words: of edge nodes only what surely lies in this shard."""
        inner = ~self.edge
        child = self.parent[1:]
        self.has_child = np.bincount(child, minlength=len(self.parent)) > 0
        self.children = np.bincount(child[inner[1:]], minlength=len(self.parent))
        self.leaves = (inner & ~self.has_child).astype(np.int64)
        self.node_words = np.where(inner, self.words, 0)
        self.member_words = self.members * self.words
        for d in range(len(bounds) - 2, 0, -1):
            level = slice(bounds[d], bounds[d + 1])
            above = self.parent[level]
            start = np.flatnonzero(np.diff(above, prepend=-1))
            for values in (self.leaves, self.node_words, self.member_words):
                values[above[start]] += np.add.reduceat(values[level], start)

    def path(self, place):
        """Nodes and their keys, from the root down, of the conversation at ``place``."""
        row, nodes = self.order[place], [int(self.end[place])]
        while nodes[-1]:
            nodes.append(int(self.parent[nodes[-1]]))
        start = self.begin[row]
        turns = self.digest[start : start + self.length[row]].tobytes()
        keys = [ROOT]
        for at in range(0, len(turns), 16):
            keys.append(hashlib.sha256(keys[-1] + turns[at : at + 16]).digest()[:16])
        return nodes[::-1], keys

    def parts(self, shard):
        """The rows of this shard, by ``PARTS``, in batches."""
        known, edges = {}, []
        for side, place in enumerate((0, len(self.order) - 1)):
            nodes, keys = self.path(place)
            for depth, (node, key) in enumerate(zip(nodes, keys)):
                if node in known:
                    edges[depth]["common"] = True
                    continue
                known[node] = key
                edges.append(dict(
                    kind=EDGE, key=key, parent_key=keys[depth - 1] if depth else None, shard=shard, side=side,
                    common=False, conv_id=int(self.least[node]), depth=depth, n_convs=int(self.members[node]),
                    n_children=int(self.children[node]), n_leaves=int(self.leaves[node]),
                    member_words=int(self.member_words[node]), node_words=int(self.node_words[node]),
                    words=int(self.words[node]), has_child=bool(self.has_child[node]),
                ))
        runs = np.flatnonzero(np.diff(self.end, prepend=-1))
        ids, ends = self.conv[self.order], {}
        for start, stop in zip(runs, np.append(runs[1:], len(ids))):
            node = int(self.end[start])
            if node not in known:
                ends[node] = hashlib.sha256(",".join(map(str, ids[start:stop].tolist())).encode()).hexdigest()
                continue
            for at in range(start, stop, PIECE):
                piece = ids[at : min(at + PIECE, stop)].tolist()
                edges.append(dict(kind=ENDS, key=known[node], conv_id=piece[0], ends=",".join(map(str, piece))))
        for at in range(0, len(edges), 10_000):
            yield pa.RecordBatch.from_pylist(edges[at : at + 10_000], PARTS)
        inner = np.flatnonzero(~self.edge)
        for at in range(0, len(inner), 10_000):
            nodes = inner[at : at + 10_000]
            above = self.parent[nodes]
            outside = self.edge[above]
            columns = {
                "kind": np.full(len(nodes), INNER, np.int32), "conv_id": self.least[nodes], "depth": self.depth[nodes],
                "n_convs": self.members[nodes], "n_children": self.children[nodes], "n_leaves": self.leaves[nodes],
                "member_words": self.member_words[nodes], "node_words": self.node_words[nodes],
            }
            columns = {name: pa.array(values) for name, values in columns.items()}
            columns["parent_conv_id"] = pa.array(self.least[above], mask=outside)
            columns["parent_key"] = pa.array([known.get(p) for p in above.tolist()], pa.binary())
            columns["ends"] = pa.array([ends.get(node, EMPTY) for node in nodes.tolist()])
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if f.name in columns else pa.nulls(len(nodes), f.type) for f in PARTS], schema=PARTS
            )


def _flat(column, dtype, unit):
    """(values of all rows, their number in each row) of a binary or list column."""
    values = []
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype), lengths.astype(np.int64)
    values = b"".join(column.to_pylist())
    lengths = np.fromiter(map(len, column.to_pylist()), np.int64, len(column)) // unit
    return np.frombuffer(values, dtype), lengths


def _shard(batches):
    read = [
        (batch.column("conv_id").to_numpy(), *_flat(batch.column("path"), "S16", 16),
         _flat(batch.column("words"), np.int64, 1)[0])
        for batch in batches if batch.num_rows
    ]
    if read:
        conv, digest, length, words = (np.concatenate(x) for x in zip(*read))
        yield from Trie(conv, length, digest, words).parts(TaskContext.get().partitionId())


def _digests(batches):
    """sha256 of the joined pieces of every key; the rows come sorted by key and place."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for new, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if new != key:
                if state:
                    yield done()
                key, state = new, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state:
        yield done()


def _recombined(parts):
    """(key, ..) of every edge node, put together from the shards that hold it."""
    edges = parts.where(F.col("kind") == EDGE)
    whole = materialize(
        edges.groupBy("key").agg(
            F.min("shard").alias("owner"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("has_child").alias("has_child"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "member_words", "node_words")],
        ),
        "trie_edges",
    )
    # What a shard owns counts for every ancestor on the same path. Rows of a window: two paths.
    held = edges.select("key", "shard", "side", "depth", "common").join(
        whole.select("key", "owner", "words", "has_child"), "key"
    )
    own = F.col("shard") == F.col("owner")
    held = held.withColumns({
        "w": F.when(own, F.col("words")).otherwise(0),
        "leaf": F.when(own & ~F.col("has_child"), 1).otherwise(0).cast("long"),
    })
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    both = Window.partitionBy("shard")

    def credit(c):
        other = F.sum(F.when(F.col("side") == 1, F.col(c)).otherwise(0)).over(both)
        return F.sum(c).over(below) + F.when(F.col("common"), other).otherwise(0)

    credits = held.select("key", credit("w").alias("w"), credit("leaf").alias("leaf")).groupBy("key").agg(
        F.sum("w").alias("edge_words"), F.sum("leaf").alias("edge_leaves")
    )
    children = whole.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("edge_children")
    )
    ends = (
        parts.where(F.col("kind") == ENDS).select("key", "conv_id", "ends")
        .repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, ends_sha256 string")
    )
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    joined = (
        whole.join(credits, "key").join(children, "key", "left").join(ends, "key", "left").join(up, "parent_key", "left")
    )
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        (F.col("n_children") + F.coalesce("edge_children", F.lit(0))).alias("n_children"),
        (F.col("n_leaves") + F.col("edge_leaves")).alias("n_leaves"),
        (F.col("member_words") - F.col("node_words") - F.col("edge_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    ), up


def nodes(conversations, group=GROUP, shard=SHARD):
    """One row for every node of the trie of the rebuilt conversations (see ``rebuild``).

    conv_id is the smallest member, parent_conv_id that of the parent (null for the root);
    n_convs counts members, n_children children, n_leaves the childless nodes of the
    subtree, saved_tokens the words that members share over the subtree, and ends_sha256 is
    the digest of the ids that end in the node. A table without conversations has no
    node, not even a root. ``shard`` is the average number of turns and conversations of a task.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    rows = materialize(rebuild(conversations, group), "trie_conversations")
    size = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = min(max(-(-size // shard), 1), MOST_SHARDS)
    parts = materialize(
        rows.repartitionByRange(shards, "path", "conv_id").mapInArrow(_shard, PARTS_DDL), "trie_parts"
    )
    edges, up = _recombined(parts)
    inner = parts.where(F.col("kind") == INNER).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("member_words") - F.col("node_words")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
        "parent_key",
    )
    below = inner.where(F.col("parent_key").isNull()).select(*NODE_COLUMNS)
    border = inner.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(up, "parent_key")
    return below.unionByName(border.select(*NODE_COLUMNS)).unionByName(edges.select(*NODE_COLUMNS))
