"""Centroid clustering in whole numbers: an equal-average equal-variance search.

A component x counts as the integer floor(scale * x). For a vector and a centroid of k
components with sums S and s, and with R = sqrt(k * sum of squares - S * S),

    k * distance >= (S - s) ** 2 + (R - r) ** 2,

so the centroids are sorted by their mean, every vector starts at the centroid whose mean
is nearest to its own and scans outward: a side is closed by the first centroid whose
difference of means alone (in integers) is too large, a centroid is rejected if the
deviations (in doubles, with a margin for rounding) add too much, and what is left gets
its exact squared distance. A bound that equals the best distance rejects nothing, so of
equally near centroids the smallest number wins.

Every round is one pass over the vectors. A task sends at most one row of sums per centroid
and Arrow batch, which Spark adds up before the shuffle; the driver gets k centroids.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockyard.llm.common import ship_package
from stockyard.session import materialize

DIM = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 24  # squares of larger components times DIM squared leave 64 bits
ROWS = 4096        # vectors that are searched together


def usable(vectors, dim=DIM, scale=SCALE):
    """(vec_id, point array<long>): vectors of exactly ``dim`` components, none of them null
    or non-finite, as integers. A repeated row, a repeated id and a null id all stay. A
    component beyond ``LARGEST`` in magnitude, whose squares don't fit, raises an error."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(
        (F.size("e") == dim) & ~F.exists("e", bad)
    )
    whole = lambda x: F.when(
        F.abs(x * scale) < F.lit(float(LARGEST)), F.floor(x * scale).cast("long")
    ).otherwise(F.raise_error(F.lit("a component is too large to be clustered in whole numbers")).cast("long"))
    return rows.select("vec_id", F.transform("e", whole).alias("point"))


def first_centroids(points, k=CLUSTERS, seed="1"):
    """The ``k`` points with the smallest sha256 of ``seed:vec_id``, in that order; all, if
    there are fewer. Rows with one id are ordered by their components; null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    best = points.select(key.alias("_key"), "point").orderBy(F.asc_nulls_last("_key"), "point").limit(k)
    return np.array([r["point"] for r in best.collect()], np.int64)


class Search:
    """Nearest centroid of integer vectors."""

    def __init__(self, centroids):
        """Sorts (n, k) integers by mean; the row number is the centroid's number."""
        self.sums = centroids.sum(1)
        self.order = np.argsort(self.sums, kind="stable")
        self.points, self.sums = centroids[self.order], self.sums[self.order]
        self.spread = _spread(self.points, self.sums)

    def nearest(self, x):
        """(number, squared distance, distances computed) for the rows of ``x``."""
        n, k, count = len(x), x.shape[1], len(self.points)
        sums = x.sum(1)
        spread = _spread(x, sums)
        right = np.searchsorted(self.sums, sums)
        near_left = np.maximum(right - 1, 0)
        near_right = np.minimum(right, count - 1)
        closer = np.abs(self.sums[near_left] - sums) <= np.abs(self.sums[near_right] - sums)
        start = np.where(closer, near_left, near_right)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, count)
        computed = self._try(x, sums, spread, start, np.arange(n), best, number)
        for side in (-1, 1):
            rows, step = np.arange(n), 1
            while len(rows):
                at = start[rows] + side * step
                inside = (at >= 0) & (at < count)
                rows, at = rows[inside], at[inside]
                # sums grow outward: what the mean rejects here, it rejects beyond
                mean = (sums[rows] - self.sums[at]) ** 2
                open_ = mean <= k * best[rows]
                rows, at, mean = rows[open_], at[open_], mean[open_]
                apart = np.abs(spread[rows] - self.spread[at])
                apart = np.maximum(apart - 1e-14 * (spread[rows] + self.spread[at]), 0.0)
                maybe = (mean + apart * apart) * (1 - 1e-14) <= k * best[rows]
                computed += self._try(x, sums, spread, at[maybe], rows[maybe], best, number)
                step += 1
        return number, best, computed

    def _try(self, x, sums, spread, at, rows, best, number):
        if not len(rows):
            return 0
        far = ((x[rows] - self.points[at]) ** 2).sum(1)
        real = self.order[at]
        better = (far < best[rows]) | ((far == best[rows]) & (real < number[rows]))
        best[rows[better]] = far[better]
        number[rows[better]] = real[better]
        return len(rows)


def _spread(x, sums):
    """sqrt(k * sum of squares - square of the sum), exact under the root."""
    return np.sqrt((x.shape[1] * (x * x).sum(1) - sums * sums).astype(np.float64))


def _matrix(column, dim):
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def assign(points, centroids):
    """(vec_id, cluster, distance) of every point."""
    ship_package(points.sparkSession)
    dim = centroids.shape[1]

    def run(batches):
        search = Search(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                number, far, _ = search.nearest(_matrix(part.column("point"), dim))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(far)],
                    ["vec_id", "cluster", "distance"],
                )

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(points, centroids):
    """Centroids after one round: the floor of the mean of what each attracts; one that
    attracts nothing stays."""
    ship_package(points.sparkSession)
    count, dim = centroids.shape

    def run(batches):
        search = Search(centroids)
        sizes, sums = np.zeros(count, np.int64), np.zeros((count, dim), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(start, ROWS).column("point"), dim)
                number, _, _ = search.nearest(x)
                order = np.argsort(number, kind="stable")
                found, begin = np.unique(number[order], return_index=True)
                sizes[found] += np.diff(np.append(begin, len(x)))
                sums[found] += np.add.reduceat(x[order], begin)
        found = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(sizes[found]), pa.array(list(sums[found]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    partial = points.select("point").mapInArrow(run, "cluster long, n long, sums array<long>")
    totals = partial.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    )
    result = centroids.copy()
    for row in totals.collect():  # a row for each centroid
        result[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return result


def cluster(vectors, k=CLUSTERS, rounds=ROUNDS, dim=DIM, scale=SCALE, seed="1"):
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every
    vector that ``usable`` keeps; an empty table gives no rows. Distances are squared and
    whole; the digest is that of the final centroid's components, joined by commas.
    """
    spark = vectors.sparkSession
    points = usable(vectors, dim, scale)
    centroids = first_centroids(points, k, seed)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(centroids):
        return points.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in columns[2:5]],
            F.lit("").alias("centroid_sha256"),
        )
    for _ in range(rounds):
        centroids = moved(points, centroids)
    rows = materialize(assign(points, centroids), "centroid_rows")
    # k rows, whatever the size of the input
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame(
        [(c, s, total, digest[c]) for c, s in sorted(sums.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(known), "cluster").select(*columns)
