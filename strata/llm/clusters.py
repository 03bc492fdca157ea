"""Centroid clustering with Ptolemaic pivots: exact k-means steps over whole numbers
that look at few of the distances.

For any four points Ptolemy's inequality holds, so for a vector v, a centroid c and a
pair of pivots s, t

    d(v, c) >= |d(v, s) d(c, t) - d(v, t) d(c, s)| / d(s, t).

The pivots are the starting centroids that lie farthest apart, and stay. A vector's
distances to them are worked out once and stored next to it; those of the centroids
are new in each round, and few. In each round a vector's distance to the centroid of
the least bound is worked out, then to every other one whose bound does not exceed the
least distance so far. Bounds are rounded in the safe direction by ``SLACK``, which is
far more than floating point can lose, and distances that count are sums of whole
numbers; so the result is that of comparing everything with everything.

Each task adds up the vectors it gives to a centroid, and Spark adds those sums, as
decimals; the driver sees the centroids. Vectors have whole components, ``scale`` times
the given ones, rounded down.

Left out are rows whose vector is null, has another number of components, or a null,
a NaN or an infinity among them. Starting centroids are the vectors whose
``seed:id`` has the least SHA-256; of rows that share an id the smaller vector comes
first, rows without an id come last. With fewer vectors than centroids all are
starting centroids; without any there are no rows. Equally near centroids: the smaller
number. A centroid nothing is nearest to stays where it is. Repeated rows count as
often as they are there; other columns are not looked at. Components beyond ``BOUND``
are refused, since squares would not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, "2"
PIVOTS = 8
SLACK = 2.0**-40
BOUND = 1 << 27


def whole_vectors(embeddings: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, parts) of the rows that hold a whole vector, as whole numbers."""
    vector = F.col("embedding").cast("array<double>")
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = embeddings.where(F.size("embedding") == components).where(~F.exists(vector, broken))
    whole = lambda x: F.when(F.abs(x) * scale < BOUND, F.floor(x * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {BOUND}")).cast("int")
    )
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, whole).alias("parts"))


def starting(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("parts", order.alias("hash")).orderBy(F.col("hash").asc_nulls_last(), "parts").limit(clusters).collect()
    return np.array([row["parts"] for row in first], dtype=np.int64)


def squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The squared distance of each vector to a point, in whole numbers."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Pivots:
    """Fixed points, and the pairs of them that bounds are taken from."""

    points: np.ndarray

    def __post_init__(self):
        between = self.distances(self.points)
        self.pairs = [(i, j, between[i, j]) for i in range(len(self.points)) for j in range(i) if between[i, j] > 0]

    @classmethod
    def farthest(cls, points: np.ndarray, number: int = PIVOTS) -> Pivots:
        """The first point, then always the one farthest from those chosen."""
        chosen, nearest = [0], squares(points, points[0])
        while len(chosen) < number and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squares(points, points[chosen[-1]]))
        return cls(points[chosen])

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squares(vectors, p) for p in self.points], axis=1).astype(np.float64))

    def bounds(self, of_vectors: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
        """What the distance of each vector to each centroid is at least."""
        least = np.zeros((len(of_vectors), len(of_centroids)))
        for s, t, apart in self.pairs:
            one = of_vectors[:, s, None] * of_centroids[:, t]
            other = of_vectors[:, t, None] * of_centroids[:, s]
            np.maximum(least, (np.abs(one - other) - (one + other) * SLACK) / apart, out=least)
        return least * (1 - SLACK)


def nearest(
    vectors: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distance, and how many
    distances were worked out. ``cached``: the vectors' distances to the pivots."""
    bounds = pivots.bounds(cached, pivots.distances(centroids))
    cluster = bounds.argmin(axis=1)
    apart = vectors - centroids[cluster]
    distance = np.einsum("ij,ij->i", apart, apart)
    looked = len(vectors)
    for number, centroid in enumerate(centroids):
        reach = np.sqrt(distance.astype(np.float64)) * (1 + SLACK)
        near = np.flatnonzero((bounds[:, number] <= reach) & (cluster != number))
        looked += len(near)
        found = squares(vectors[near], centroid)
        better = (found < distance[near]) | ((found == distance[near]) & (number < cluster[near]))
        cluster[near[better]], distance[near[better]] = number, found[better]
    return cluster, distance, looked


def _table(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind, copy=False)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def with_pivots(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """The vectors with their distances to the pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches):
        pivots = shared.value
        for batch in batches:
            if batch.num_rows:
                parts = _table(batch.column("parts"), pivots.points.shape[1], np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(pivots.distances(parts))], ["vec_id", "parts", "apart"])

    return vectors.mapInArrow(measure, "vec_id long, parts array<int>, apart array<double>")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, pivots: Pivots):
    parts = _table(batch.column("parts"), centroids.shape[1], np.int64)
    cached = _table(batch.column("apart"), len(pivots.points), np.float64)
    return parts, *nearest(parts, cached, centroids, pivots)


def moved(cached: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The centroids after one round: each the mean of its vectors, rounded down."""
    shared = cached.sparkSession.sparkContext.broadcast((centroids, pivots))

    def add(batches):
        centroids, pivots = shared.value
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            parts, cluster, _, _ = _assigned(batch, centroids, pivots)
            count += np.bincount(cluster, minlength=len(centroids))
            for number in np.unique(cluster):
                total[number] += parts[cluster == number].sum(axis=0)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _lists(total[some])], ["cluster", "n", "total"])

    partial = cached.mapInArrow(add, "cluster long, n long, total array<long>")
    exact = F.col("part").cast("decimal(38,0)")
    sums = (
        partial.select("cluster", "n", F.posexplode("total").alias("place", "part"))
        .groupBy("cluster", "place").agg(F.sum(exact).alias("total"), F.sum("n").alias("n"))
    )
    after = centroids.copy()
    for row in sums.collect():  # one row for each component of a centroid
        after[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return after


def clustered(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every whole vector after ``rounds`` rounds, and
    the centroids."""
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, components, scale)
    centroids = starting(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    pivots = Pivots.farthest(centroids)
    cached = written(with_pivots(vectors, pivots), "vectors")
    for _ in range(rounds):
        centroids = moved(cached, centroids, pivots)
    shared = spark.sparkContext.broadcast((centroids, pivots))

    def place(batches):
        centroids, pivots = shared.value
        for batch in batches:
            _, cluster, distance, _ = _assigned(batch, centroids, pivots)
            columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return written(cached.mapInArrow(place, "vec_id long, cluster int, distance long"), "clusters"), centroids


def _round(number: int) -> str:
    """SQL for one round: every vector to its nearest centroid, then new centroids."""
    return f"""
assigned{number} AS (
    SELECT v.row, min(struct_pack(d := list_sum(list_transform(list_zip(v.parts, c.parts), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := c.cluster)) AS best
    FROM whole AS v CROSS JOIN centroids{number} AS c GROUP BY v.row
),
sums{number} AS (
    SELECT cluster, place, sum(part) AS total, count(*) AS n FROM (
        SELECT a.best.k AS cluster, unnest(range(1, {COMPONENTS} + 1)) AS place, unnest(v.parts) AS part
        FROM assigned{number} AS a JOIN whole AS v USING (row)
    ) GROUP BY cluster, place
),
centroids{number + 1} AS (
    SELECT c.cluster, coalesce(m.parts, c.parts) AS parts FROM centroids{number} AS c LEFT JOIN (
        SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS parts FROM sums{number} GROUP BY cluster
    ) AS m ON m.cluster = c.cluster
)"""


SQL = f"""
WITH whole AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
    FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
centroids0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), parts) - 1 AS cluster, parts
    FROM whole QUALIFY cluster < {CLUSTERS}
),
{','.join(_round(number) for number in range(ROUNDS))},
placed AS (
    SELECT v.row, min(struct_pack(d := list_sum(list_transform(list_zip(v.parts, c.parts), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), k := c.cluster)) AS best
    FROM whole AS v CROSS JOIN centroids{ROUNDS} AS c GROUP BY v.row
)
SELECT v.vec_id, CAST(p.best.k AS INTEGER) AS cluster, CAST(p.best.d AS BIGINT) AS distance,
    CAST(sum(p.best.d) OVER (PARTITION BY p.best.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(p.best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.parts, ',')) AS centroid_sha256
FROM placed AS p JOIN whole AS v USING (row) JOIN centroids{ROUNDS} AS c ON c.cluster = p.best.k
"""


@registered("op12_centroid_clustering", SQL)
def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """The cluster of every whole vector, and how tight clusters are."""
    return with_inertia(*clustered(load(spark, sf_dir, "embeddings")))


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds what the distances of a cluster and of all sum to, and the centroid's hash."""
    spark = placed.sparkSession
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    tightness = {row["cluster"]: int(row["total"]) for row in placed.groupBy("cluster").agg(exact.alias("total")).collect()}
    rows = [
        (cluster, tightness[cluster], sum(tightness.values()), ",".join(map(str, centroids[cluster].tolist())))
        for cluster in sorted(tightness)
    ]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, parts string")
    # a row for each cluster, so it is as small as ``clusters`` says
    return placed.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("parts", 256).alias("centroid_sha256")
    )
