import numpy as np
import pytest
from pyspark.sql import functions as F

from sigeval.operators import mixtures as X
from sigeval.operators import spectral as S


def table(spark, parts):
    rows = [(y, v.tolist()) for y, x in parts.items() for v in x]
    return spark.createDataFrame(rows, "label int, x array<double>")


def density(x, w, mu, var):
    z = (x[:, None] - mu) ** 2 / var + np.log(2 * np.pi * var)
    a = np.log(w) - 0.5 * z.sum(axis=2)
    return a, np.logaddexp.reduce(a, axis=1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    means = {0: [[0, 0], [9, 0], [0, 9]], 1: [[5, 5], [-6, 3], [4, -7]]}
    return {y: np.vstack([rng.normal(m, 0.7, (60, 2)) for m in c]) + 1e5 for y, c in means.items()}


def test_fit_follows_plain_em_and_never_falls(spark, data):
    df = table(spark, data)
    got = X.fit(df, "x", "label", components=3, iterations=30, tolerance=1e-6)
    for y, x in data.items():
        h = np.array(got.likelihood[y])
        assert len(h) < 30 and (np.diff(h) > -1e-7).all() and h[-1] - h[-2] <= 1e-6
        w, mu, var = got.models[y]
        a, whole = density(x, w, mu, var)  # the plain value of the last likelihood, and a plain step that no longer moves
        assert whole.mean() == pytest.approx(h[-1], abs=1e-6)
        r = np.exp(a - whole[:, None])
        assert np.allclose(r.sum(axis=0) / len(x), w, atol=1e-3)
        assert np.allclose(r.T @ x / r.sum(axis=0)[:, None], mu, atol=1e-2)
        assert sorted(w) == pytest.approx([1 / 3] * 3, abs=0.02) and 0.3 < var.min() and var.max() < 0.8  # one component per heap

    marked = df.withColumn("item", (F.monotonically_increasing_id() % 7).cast("int"))
    want = {r.item: [] for r in marked.select("item").distinct().collect()}
    for r in marked.collect():
        x = np.array([r.x])
        want[r.item].append(density(x, *got.models[1])[1][0] - density(x, *got.models[0])[1][0])
    scores = {r.item: (r.logit, r.n_rows) for r in X.item_ratio(marked, ["item"], "x", got.models).collect()}
    assert {k: (pytest.approx(np.mean(v), rel=1e-5), len(v)) for k, v in want.items()} == scores


def test_start_finds_rare_and_hot_rows(spark):
    """A third of the rows are copies of one vector; a far heap holds one row in a hundred."""
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([3.0, 3.0], (100, 1)), rng.normal(0, 1, (197, 2)), rng.normal(50, 0.1, (3, 2))])
    df = table(spark, {0: x}).withColumns({"row": F.monotonically_increasing_id(), "y": F.col("label")})
    base = X.stage(df.select("row", "y", "x"))
    centres, sizes = X.start(base, 8)[0]
    assert len(centres) == 8 and sizes.sum() == 300
    assert np.abs(centres - 50).max(axis=1).min() < 1 and np.abs(centres - 3).max(axis=1).min() < 1


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [4.0, 4.0]), (None, [9.0, 9.0]), (1, None), (1, [None, 1.0]), (0, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "label int, x array<double>")
    got = X.fit(df, "x", "label", components=4)
    assert {y: (len(m[0]), m[1][0].tolist()) for y, m in got.models.items()} == {0: (1, [1.0, 2.0]), 1: (1, [4.0, 4.0])}
    assert X.item_ratio(df, ["label"], "x", got.models).count() == 3
    with pytest.raises(ValueError, match="no rows"):
        X.fit(df.limit(0), "x", "label")
    with pytest.raises(ValueError, match="no mixture"):
        X.item_ratio(df, ["label"], "x", {0: got.models[0]})


def test_frames_of_features(spark):
    values = np.arange(24.0).reshape(3, 2, 4)
    t = spark.createDataFrame([(7, 0, "lfcc", values.tolist())], "rec int, window long, feature string, values array<array<array<double>>>")
    got = {r.frame: r.x for r in S.frame_vectors(t).collect()}
    assert got == {k: values[:, :, k].ravel().tolist() for k in range(4)}
