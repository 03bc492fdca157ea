"""Centroid clustering against comparing everything with everything."""

import hashlib
import math

import numpy as np
import pytest

from strata.llm import clusters
from strata.llm.clusters import Pivots, clustered, nearest, squares, with_inertia

SCHEMA = "label int, vec_id long, embedding array<float>, cluster string, distance string, parts string"


def plain(rows, k, rounds, size, scale=256, seed="2"):
    """Every distance, in Python's whole numbers."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, assign(v)[1], assign(v)[0]) for i, v in kept), key=repr), centroids


def odd_vectors():
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(5, 4)) * 10
    rows = [(i, [float(np.float32(x)) for x in middles[i % 5] + draw.normal(size=4)]) for i in range(120)]
    rows += [(200, [0.0] * 4), (201, [0.0] * 4), (200, [0.0] * 4), (200, [1.0, 0.0, 0.0, 0.0]), (None, [-0.001] * 4), (None, [2.0] * 4)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0] * 5), (304, [1.0, None, 1.0, 1.0]), (305, [float("nan")] * 4)]
    return [*rows, (306, [float("inf"), 0.0, 0.0, 0.0]), (307, [-float("inf")] * 4), (308, [0.5, -0.5, 0.5, -0.5]), (309, [-0.5, 0.5, -0.5, 0.5])]


def framed(spark, rows):
    return spark.createDataFrame([(1, i, v, "x", "y", "z") for i, v in rows], SCHEMA)


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (7, 5), (40, 3), (500, 1), (9, 0)])
def test_clusters_are_those_of_all_distances(spark, k, rounds):
    rows = odd_vectors()
    placed, centroids = clustered(framed(spark, rows).repartition(5), k, rounds, 4)
    wanted, middles = plain(rows, k, rounds, 4)
    assert sorted(map(tuple, placed.collect()), key=repr) == wanted
    assert centroids.tolist() == middles


def test_inertia_and_digest(spark):
    rows = odd_vectors()
    found = with_inertia(*clustered(framed(spark, rows), 6, 4, 4)).collect()
    wanted, middles = plain(rows, 6, 4, 4)
    assert len(found) == len(wanted)
    for row in found:
        assert row["inertia"] == sum(d for _, _, d in wanted)
        assert row["cluster_inertia"] == sum(d for _, c, d in wanted if c == row["cluster"])
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, middles[row["cluster"]])).encode()).hexdigest()


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        placed, centroids = clustered(framed(spark, rows), 5, 3, 4)
        assert with_inertia(placed, centroids).collect() == [] and not len(centroids)


def test_components_that_cannot_be_squared_are_refused(spark):
    with pytest.raises(Exception, match="is beyond"):
        clustered(framed(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), 5, 3, 4)


def test_bounds_never_exceed_the_distance():
    draw = np.random.default_rng(5)
    for spread in (3, 1000, clusters.BOUND // 2):
        vectors = draw.integers(-spread, spread, size=(300, 8))
        centroids = np.concatenate([vectors[:20], draw.integers(-spread, spread, size=(10, 8))])
        pivots = Pivots.farthest(centroids)
        bounds = pivots.bounds(pivots.distances(vectors), pivots.distances(centroids))
        exact = np.sqrt(np.stack([squares(vectors, c) for c in centroids], axis=1).astype(np.float64))
        assert (bounds <= exact * (1 + 1e-15)).all() and bounds.max() > 0


def test_few_distances_are_worked_out_where_vectors_lie_in_groups():
    """The result hangs on the bounds: without them everything would be compared."""
    draw = np.random.default_rng(7)
    middles = draw.normal(size=(30, 16)) * 1000
    vectors = np.floor(middles[draw.integers(0, 30, 6000)] + draw.normal(size=(6000, 16)) * 20).astype(np.int64)
    centroids = np.floor(middles).astype(np.int64)
    pivots = Pivots.farthest(centroids, 8)
    cluster, distance, looked = nearest(vectors, pivots.distances(vectors), centroids, pivots)
    exact = np.stack([squares(vectors, c) for c in centroids], axis=1)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert looked < 0.1 * exact.size


def test_equal_pivots_bound_nothing():
    points = np.zeros((3, 4), dtype=np.int64)
    pivots = Pivots.farthest(points)
    cluster, distance, _ = nearest(points, pivots.distances(points), points, pivots)
    assert cluster.tolist() == [0, 0, 0] and distance.tolist() == [0, 0, 0]
