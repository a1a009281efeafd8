"""Near-duplicate clusters, cross counts and hashing against all pairs."""

from itertools import combinations

import numpy as np
import pytest

from sigeval.operators import neighbours as N
from sigeval.operators.components import components


def reached(nodes, links):
    low = {n: n for n in nodes}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


@pytest.fixture(scope="module")
def cloud(spark):
    """Clusters of near vectors, some with copies, and lone ones."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.normal(size=32)
        for j in range(int(rng.integers(1, 7))):
            v = (centre + rng.normal(size=32) * rng.choice([0.05, 0.15, 0.3])).tolist()
            rows += [(len(rows) + c, v) for c in range(3 if j == 2 else 1)]
    return rows, spark.createDataFrame(rows, "item long, v array<double>").repartition(4).cache()


def unit(rows):
    x = np.array([v for _, v in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 7), (7, 5), (4, 4), (None, 8), (20, 19), *[(k, k + 1) for k in range(30, 70)], *[(100, k) for k in range(101, 200)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "item_a long, item_b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reached({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "item_a long, item_b long")).count() == 0


@pytest.mark.parametrize("threshold", [0.95, 0.9])
def test_hashing_finds_most_pairs_and_no_others(cloud, threshold):
    rows, df = cloud
    u = unit(rows)
    first = {tuple(v): i for i, v in reversed(rows)}  # the smallest item of each vector
    reps = sorted(first.values())
    cos = u @ u.T
    want = {(a, b) for a, b in combinations(reps, 2) if cos[a, b] >= threshold}
    got = {(r.item_a, r.item_b) for r in N.lsh_pairs(df, "item", "v", 32, threshold).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 50
    exact = {(r.item_a, r.item_b) for r in N.all_pairs(df, "item", "v", 32, threshold).collect()}
    assert exact == want
    assert {(r.item_a, r.item_b) for r in N.lsh_pairs(df, "item", "v", 32, threshold, tables=3, block_rows=4).collect()} <= want  # crowded cells in blocks
    assert N.lsh_pairs(df.limit(0), "item", "v", 32, threshold).count() == 0


def test_clusters_and_cross_counts(spark, cloud):
    rows, df = cloud
    u = unit(rows)
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if (u[a] @ u[b]) >= 0.95]
    links = N.all_pairs(df, "item", "v", 32, 0.95)
    found = N.clusters(df, "item", "v", links)
    got = {r.item: r for r in found.collect()}
    low = reached(range(len(rows)), near)
    assert {i: r.cluster for i, r in got.items()} == low
    assert all(r.representative == min(i for i, v in rows if v == rows[r.item][1]) for r in got.values())
    members = found.selectExpr("representative", "item", "item % 2 AS label", "item % 3 AS corpus")
    (counts,) = N.link_counts(members, links, {"cross_label": "label", "cross_corpus": "corpus"}).collect()
    assert tuple(counts) == (len(rows), len(near), sum((a - b) % 2 != 0 for a, b in near), sum((a - b) % 3 != 0 for a, b in near))


def test_vectors_reach_few_cells_and_no_pair_is_missed(spark):
    """A grid lets a vector of many independent coordinates reach dozens of cells; near copies all lie in one cell."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x = np.vstack([x, x + rng.normal(size=x.shape) * rng.uniform(0.02, 0.2, size=(1500, 1)), x[:1] + rng.normal(size=(300, 64)) * 0.005])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<double>").repartition(4).cache()
    one_each = N._one_each(df, "item", "v")
    r = np.sqrt(0.02)
    pivots = N._pivots(one_each, r, N.PIVOTS)
    home, near = N._reached(u, pivots, N._gaps(pivots, r))
    assert near.sum() <= N.REACH * len(x) and len(pivots) > 50
    assert len(set(home[3000:])) == 1 and (pivots @ u[3000] > 0.99).sum() <= 1
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.99, 1)), strict=True)}
    got = [(q.item_a, q.item_b) for q in N.all_pairs(df, "item", "v", 64, 0.99, block_rows=64).collect()]
    assert set(got) == want and len(got) == len(want) > 45000
    assert all(near[a, home[b]] or near[b, home[a]] for a, b in want)
    df.unpersist()
