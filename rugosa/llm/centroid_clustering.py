"""Clustering of embeddings around centroids by equal-average equal-variance search.

Method. Vectors are whole numbers (floor(256 * component)). The centroids are sorted
by the mean of their components. The search for a vector's nearest centroid starts
where its own mean would stand and scans outward on both sides. With k components,
means m and deviations s (of the components around their mean),

    k (m_x - m_c)² <= k (m_x - m_c)² + k (s_x - s_c)² <= |x - c|²

so a side ends at the first centroid whose mean alone rules it out, and a centroid
whose deviation rules it out is passed over. Only bounds that exceed the best distance
by more than rounding reject; the distances of the rest are computed in whole numbers,
and equal ones go to the smaller centroid number.

A round is one pass over the vectors; tasks send sums and counts for each centroid,
and the driver holds only centroids. Sums are exact (decimals), as is the floor of
their quotients.

Defined results: rows whose vector is null, has another number of components than
``size``, or holds a null or non-finite one are left out; rows that repeat a vector or
a vec_id are rows like any other (rows of one vec_id that tie for a first centroid
are taken in the order of their vectors); a null vec_id is named by the empty text in
the draw of first centroids and stays null in the result; fewer vectors than centroids
give fewer centroids; an empty table gives an empty result; other columns are ignored.
Distances must fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rugosa.llm.common import release, store
from rugosa.llm.vectors import integer_vectors
from rugosa.session import ship_package

#: Rows that are searched at a time.
ROWS = 8192
#: Components up to which squared distances of 64 components and more fit a long.
SMALL = 1 << 26


class Centroids:
    """Centroids in the order of their means, with their deviations."""

    def __init__(self, centroids: list[list[int]]):
        given = np.array(centroids, dtype=np.int64)
        mean = given.mean(axis=1)
        self.order = np.lexsort((np.arange(len(given)), mean))
        self.points, self.mean = given[self.order], mean[self.order]
        self.deviation = np.sqrt(np.mean((self.points - self.mean[:, None]) ** 2, axis=1))
        self.small = bool(np.abs(given).max(initial=0) <= SMALL)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and exact squared distance of the centroid nearest to every row;
        also how many distances were computed."""
        n, k = x.shape
        count = len(self.points)
        mean = x.mean(axis=1)
        deviation = np.sqrt(np.mean((x - mean[:, None]) ** 2, axis=1))
        exact = np.int64 if self.small and np.abs(x).max(initial=0) <= SMALL else object
        # rounding of means and deviations, as a part of the largest component
        slack = 1e-9 * (1.0 + np.abs(x).max(initial=0) + np.abs(self.points).max(initial=0)) ** 2
        best = np.full(n, -1, dtype=exact)
        number = np.full(n, -1)
        computed = 0
        start = np.searchsorted(self.mean, mean)
        alive = np.ones((2, n), bool)
        for step in range(count):
            # the step-th centroid on the right and on the left of each vector
            open_ = False
            for side, at in enumerate((start + step, start - 1 - step)):
                row = np.flatnonzero(alive[side] & (at >= 0) & (at < count))
                gap = k * (mean[row] - self.mean[at[row]]) ** 2
                known = number[row] >= 0
                limit = np.where(known, best[row].astype(np.float64), np.inf)
                out = gap * (1 - 1e-9) - slack > limit
                alive[side][row[out]] = False
                row, gap, limit = row[~out], gap[~out], limit[~out]
                open_ |= bool(len(row))
                spread = gap + k * (deviation[row] - self.deviation[at[row]]) ** 2
                row = row[spread * (1 - 1e-9) - slack <= limit]
                if not len(row):
                    continue
                off = x[row].astype(exact) - self.points[at[row]].astype(exact)
                d = (off * off).sum(axis=1)
                computed += len(row)
                name = self.order[at[row]]
                better = (number[row] < 0) | (d < best[row]) | ((d == best[row]) & (name < number[row]))
                best[row[better]] = d[better]
                number[row[better]] = name[better]
            if not open_:
                break
        return number, best, computed


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(centroids: list[list[int]]):
    """Rows (cluster, n, sums of components) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        held: dict[int, list] = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), ROWS):
                part = x[i : i + ROWS]
                number = search.nearest(part)[0]
                for c in np.unique(number).tolist():
                    rows = part[number == c]
                    n, total = held.get(c, (0, 0))
                    # whole numbers of any size: the sums of a task never wrap
                    held[c] = (n + len(rows), total + rows.sum(axis=0).astype(object))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[int(v) for v in t] for _, t in held.values()], pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids)
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(0, len(x), ROWS):
                number, best, _ = search.nearest(x[i : i + ROWS])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, ROWS), pa.array(number.astype(np.int32)), pa.array(best.tolist(), pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def first_centroids(rows: DataFrame, count: int, seed: int = 2) -> list[list[int]]:
    """The vectors whose ``seed:vec_id`` has the least SHA-256."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in rows.select(named.alias("at"), "x").orderBy("at", "x").limit(count).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    size = len(centroids[0])
    parts = rows.select("x").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return out


def cluster(vectors: DataFrame, size: int = 64, count: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and the
    digest of its final centroid."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = store(integer_vectors(vectors, size), "clustering-vectors")
    centroids = first_centroids(rows, count, seed)
    if not centroids:
        release(rows)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = store(rows.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clustering-assigned")
    release(rows)
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(c, s, sum(sums.values()), name[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
