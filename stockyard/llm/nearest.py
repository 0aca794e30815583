"""Nearest neighbours by inner product: a block matrix join.

Queries and candidates are dealt into blocks, and every query block meets every
candidate block in one task, a tile. In a tile both sides are rounded to int8, each
vector with a scale of its own; the product of the integer matrices gives every inner
product up to a known error, since |qc - q'c'| <= |q||c - c'| + |q - q'||c'|. A pair
whose upper bound stays under the 20th best lower bound of its query can't be among
the 20 nearest of the tile. The surviving pairs are computed again in double
precision, dimension by dimension, and the tiles' lists are merged by heaps.

Every candidate is compared, so recall is 1. Of equal vectors in a tile only the
``k + 1`` with the smallest ids can matter, so copies cost one comparison.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockyard.llm.common import ship_package
from stockyard.session import materialize

K = 20
QUERY_BLOCK = 2048
BLOCK = 8192
EVERY = 20   # queries: ids divisible by this
FAN = 64     # lists that one heap merge takes


def usable(vectors):
    """Rows that take part, as (vec_id, dim, embedding of doubles).

    Null ids, null vectors, and vectors that hold null or non-finite components or
    only zeros (so also empty ones) are left out. Rows that repeat an id are rows of their
    own: each is a query, if the id is one, and each a candidate for the others. Vectors
    meet only vectors of their own length.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    )
    rows = rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    return rows.select("vec_id", F.size("embedding").alias("dim"), "embedding")


def _matrix(table, name="embedding"):
    column = table.column(name).combine_chunks()
    column = column if not isinstance(column, pa.ChunkedArray) else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _rounded(matrix):
    """(int8 values, scale, norm, norm of what rounding lost) of every row. Rows are scaled by
    powers of two first, so squares of very large or small components lose nothing."""
    top = np.abs(matrix).max(1)
    power = np.frexp(top)[1]
    even = np.ldexp(matrix, -power[:, None])
    scale = np.abs(even).max(1) / 127.0
    small = np.rint(even / scale[:, None])
    lost = np.linalg.norm(even - small * scale[:, None], axis=1)
    norm = np.linalg.norm(even, axis=1)
    with np.errstate(over="ignore", under="ignore"):
        return small.astype(np.int8), *(np.ldexp(x, power) for x in (scale, norm, lost))


def _dot(a, b):
    """Row by row, summed from the first dimension to the last. A sum that overflows is infinite;
    one of infinities of both signs counts as minus infinity."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for d in range(a.shape[1]):
            total += a[:, d] * b[:, d]
    return np.where(np.isnan(total), -np.inf, total)


def tile(query_rows, queries, ids, rows, vectors, k=K):
    """(query position, candidate id, score): the ``k`` best candidates of each query,
    best first, equal scores by smaller id. ``query_rows`` and ``rows`` number the rows: a query's
    own row is no candidate. Without queries or candidates there are none."""
    if not len(queries) or not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.lexsort((rows, ids))
    ids, number, vectors = ids[order], rows[order], vectors[order]
    _, first, kind = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    kind = kind.reshape(-1)
    members = np.argsort(kind, kind="stable")  # by kind, then id
    count = np.bincount(kind, minlength=len(first))
    begin = np.cumsum(count) - count
    usual = np.minimum(count, k + 1)
    distinct = vectors[first]
    small, scale, norm, lost = _rounded(distinct)
    wide = small.astype(np.float32).T  # sums of int8 products are whole numbers: exact to 2 ** 24
    exact = distinct.shape[1] * 127 * 127 < 1 << 24
    wide = wide if exact else small.astype(np.float64).T
    q_small, q_scale, q_norm, q_lost = _rounded(queries)
    found = ([], [], [])
    for start in range(0, len(queries), 256):
        part = slice(start, start + 256)
        # what overflows has no bound, and survives
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            low, high = _bounds(q_small[part], q_scale[part], q_norm[part], q_lost[part], wide, scale, norm, lost)
        # kinds, best first, until k + 1 candidates are certain (one may be the query)
        need = min(k + 1, len(distinct))
        floor = -np.partition(-low, need - 1, axis=1)[:, need - 1]
        left, cols = np.nonzero(high >= floor[:, None])
        for at in range(0, len(left), 1 << 17):
            r, c = left[at : at + (1 << 17)], cols[at : at + (1 << 17)]
            score = _dot(queries[r + start], distinct[c])
            reach = usual[c]
            member = members[np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
                             + np.repeat(begin[c], reach)]
            for values, new in zip(found, (np.repeat(r + start, reach), member, np.repeat(score, reach))):
                values.append(new)
    row, member, score = (np.concatenate(x) for x in found)
    others = number[member] != query_rows[row]
    row, other, score = row[others], ids[member[others]], score[others]
    order = np.lexsort((other, -score, row))
    row, other, score = row[order], other[order], score[order]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
    return row[place < k], other[place < k], score[place < k]


def _bounds(q_small, q_scale, q_norm, q_lost, wide, scale, norm, lost):
    """(least, largest) that the inner product of every query and candidate can be."""
    about = (q_small.astype(wide.dtype) @ wide).astype(np.float64) * q_scale[:, None] * scale[None, :]
    error = q_norm[:, None] * lost[None, :] + q_lost[:, None] * (norm + lost)[None, :]
    error += 1e-9 * q_norm[:, None] * norm[None, :] + 1e-300  # rounding, also of the smallest numbers
    low, high = about - error, about + error
    low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
    return low, high


LIST = pa.schema([
    ("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()),
    ("_list", pa.int64()),
])


def _merge(k, ranked):
    """Merge sorted lists of one query in a heap; the lists are bounded by FAN."""

    def run(table):
        lists = {}
        for name, other, score in zip(*(table.column(c).to_pylist() for c in ("_list", "vec_id", "score"))):
            lists.setdefault(name, []).append((-score, other))
        best = []
        for item in heapq.merge(*[sorted(x) for x in lists.values()]):
            if len(best) == k:
                break
            best.append(item)
        first = {c: table.column(c)[0].as_py() for c in table.column_names}
        columns = {"query_id": [first["query_id"]] * len(best)}
        if ranked:
            columns["rank"] = pa.array(range(1, len(best) + 1), pa.int32())
        else:
            columns = {"query_row": [first["query_row"]] * len(best), **columns}
        columns |= {"vec_id": [o for _, o in best], "score": [-s for s, _ in best]}
        if not ranked:
            columns["_list"] = [first["_next"]] * len(best)
        return pa.table(columns)

    return run


def search(vectors, k=K, every=EVERY, query_block=QUERY_BLOCK, block=BLOCK):
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is
    divisible by ``every``, among all other rows that ``usable`` admits; all of them
    if there are fewer. Queries without a candidate give no row; an id on several rows gives a
    list for each.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = materialize(usable(vectors).withColumn("_row", F.monotonically_increasing_id()), "nearest_rows")
    is_query = F.col("vec_id") % every == 0
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    q_blocks, blocks = max(1, -(-counts["q"] // query_block)), max(1, -(-counts["n"] // block))
    # both sides of a key must have one type, or their hashes part what belongs together
    number = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(1)))
    queries = rows.where(is_query).withColumn("_q", number(q_blocks)).withColumn("_c", upto(blocks))
    candidates = rows.withColumn("_c", number(blocks)).withColumn("_q", upto(q_blocks)).select(
        *[F.col(c).alias(f"{c}_") for c in ("dim", "_q", "_c", "_row", "vec_id", "embedding")]
    )

    def run(left, right):
        if not len(left) or not len(right):
            return LIST.empty_table()
        own = left.column("_row").to_numpy()
        row, other, score = tile(
            own, _matrix(left), right.column("vec_id_").to_numpy(), right.column("_row_").to_numpy(),
            _matrix(right, "embedding_"), k,
        )
        lists = np.full(len(row), left.column("_c")[0].as_py())
        return pa.table([own[row], left.column("vec_id").to_numpy()[row], other, score, lists], schema=LIST)

    shape, query = "query_row long, query_id long, vec_id long, score double, _list long", ["query_row", "query_id"]
    found = queries.groupBy("dim", "_q", "_c").cogroup(candidates.groupBy("dim_", "_q_", "_c_")).applyInArrow(run, shape)
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        found = found.withColumn("_next", F.pmod("_list", F.lit(blocks)))
        found = found.groupBy(*query, "_next").applyInArrow(_merge(k, False), shape)
    return found.groupBy(*query).applyInArrow(
        _merge(k, True), "query_id long, rank int, vec_id long, score double"
    )
