import hashlib
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigeval.functions.hashing import numbered_seeds
from sigeval.functions.pvalues import _binomial_two_sided
from sigeval.operators import inference as I
from sigeval.operators import metrics as M


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 400
    c = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # cluster 0 holds a large share
    y = rng.integers(0, 2, n)
    a = np.round(rng.normal(y, 1.5), 2)
    pdf = pd.DataFrame({"k": "x", "cluster": c, "label": y, "score": a, "score_b": np.round(a + rng.normal(0, 1, n), 2)})
    return spark.createDataFrame(pdf)


def test_bootstrap_equals_resampled_rows(spark, scored, monkeypatch):
    draws = I.cluster_draws(scored, ["k"], "cluster", 8, 5, every=1).select("cluster", "b", "m").toPandas()
    pdf = scored.toPandas()
    assert (draws.groupby("b")["m"].sum() == pdf["cluster"].nunique()).all()
    want = {}
    for b, g in draws.groupby("b"):
        rows = pdf.merge(g, on="cluster")
        x = rows.loc[rows.index.repeat(rows["m"])]
        pos, neg = x.score[x.label == 1].to_numpy(), x.score[x.label == 0].to_numpy()
        want[b] = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    for salt in (65536, 10):  # salting a large cluster must not change anything
        monkeypatch.setattr(I, "ROWS_PER_SALT", salt)
        got = I.bootstrap_ranking(scored, ["k"], "cluster", "label", "score", 8, 5, every=1).toPandas().set_index("b")["auc"]
        assert len(got) == 8
        for b in want:
            assert got[b] == pytest.approx(want[b])


def test_chunks_hold_no_more_draws_than_asked(spark, scored):
    """Six draws used to travel, and be summed, as 64 columns."""
    n = scored.select("cluster").distinct().count()
    for n_boot, width in ((6, 6), (70, 35)):
        drawn = I.multiplicities(scored, ["k"], "cluster", n_boot, 5, every=1).toPandas()
        assert {len(m) for m in drawn["m"]} == {width}
        total = np.concatenate([np.stack(g["m"].to_numpy()).sum(axis=0) for _, g in drawn.groupby("chunk")])
        assert total.tolist() == [n] * n_boot


def _seed(text):
    return int(hashlib.sha1(text.encode()).hexdigest()[:8], 16)


def test_numbered_seeds():
    for prefix in ("", "0|a|5|", "x" * 54 + "|", "y" * 130):  # the last ones fill more than a block
        for first, last in ((0, 1200), (99_000, 101_000), (7, 7)):
            assert numbered_seeds(prefix.encode(), first, last).tolist() == [_seed(f"{prefix}{i}") for i in range(first, last + 1)]


def test_picks_of_all_blocks_and_parts(monkeypatch):
    """Slots are hashed in blocks and counted in parts; each draw picks as single hashes do."""
    monkeypatch.setattr(I, "SLOTS_OF_TASK", 700)
    monkeypatch.setattr(I, "SLOTS_OF_PART", 300)
    g, width, n_boot = 1500, 3, 5
    blocks = pd.DataFrame([{"k": "x", "_g": g, "_prefix": "5|x", "_block": b, "chunk": c} for b in range(3) for c in range(2)])
    picks = pd.concat(I._picks(["k"], width, n_boot)([blocks]))
    got, want = np.zeros((2 * width, g), dtype=int), np.zeros((2 * width, g), dtype=int)
    for _, part in picks.groupby(["chunk", "_part"]):
        for r in I._picked(["k"], width)(pa.Table.from_pandas(part, preserve_index=False)).to_pylist():
            got[r["chunk"] * width : (r["chunk"] + 1) * width, r["slot"]] += r["m"]
    for b in range(n_boot):
        np.add.at(want[b], [_seed(f"5|x|{b}|{slot}") % g for slot in range(g)], 1)
    assert (got == want).all()


@pytest.mark.parametrize("name", ["boot_row_ci", "compact_report"])
def test_intervals_rest_on_as_many_draws_as_the_method_asks(spark, monkeypatch, name):
    """They rested on six, whose percentiles are about the least and the largest of them."""
    import __spark_entry__ as entry

    values, plain = [], I.percentile_ci
    monkeypatch.setattr(I, "percentile_ci", lambda v, *args: (values.append(v), plain(v, *args))[1])
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert values
    for v in values:
        assert {(r["n"], r["draws"]) for r in v.groupBy("split").agg(F.count("b").alias("n"), F.countDistinct("b").alias("draws")).collect()} == {(1000, 1000)}


def test_user_statistic(spark, scored):
    got = I.bootstrap_statistic(scored, ["k"], "cluster", lambda m: F.sum(m * F.col("score")) / F.sum(m), 5, 5)
    assert got.count() == 5


def test_one_cluster_has_zero_width(spark, scored):
    one = scored.withColumn("cluster", F.lit(1))
    r = I.percentile_ci(I.bootstrap_ranking(one, ["k"], "cluster", "label", "score", 10), ["k"], ["auc", "eer"]).first()
    assert r["auc_lo"] == r["auc_hi"] and r["eer_lo"] == r["eer_hi"] and r["auc_draws"] == 10


def test_delong_of_a_run_with_itself(spark, scored):
    r = I.delong(scored, ["k"], "label", "score", "score").first()
    assert r["auc_a"] == r["auc_b"] and r["z"] is None and r["p_value"] is None


def test_delong_p(spark, scored):
    r = I.delong(scored, ["k"], "label", "score", "score_b").first()
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))
    s = I.delong(scored, ["k"], "label", "score_b", "score").first()
    assert r["z"] == pytest.approx(-s["z"])


def test_mcnemar_exact_p():
    def direct(k, n):
        k = min(k, n - k)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    for k, n in ((0, 0), (0, 5), (3, 10), (5, 10), (40, 130), (10, 400)):
        assert _binomial_two_sided(k, n) == pytest.approx(direct(k, n) if n else 1.0)
    assert _binomial_two_sided(100, 10_000_000) == 0.0


def test_mcnemar_counts(spark):
    df = spark.createDataFrame([(True, False)] * 3 + [(False, True)] * 7 + [(True, True)] * 5, "a boolean, b boolean").withColumn("k", F.lit(1))
    r = I.mcnemar(df, ["k"], F.col("a"), F.col("b")).first()
    assert (r["a_right_b_wrong"], r["a_wrong_b_right"]) == (3, 7)
    assert r["mcnemar_p"] == pytest.approx(0.34375)


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.005, None, 0.04]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "fam string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in I.holm(df, ["fam"], "p").collect()}
    assert got[4] is None
    np.testing.assert_allclose([got[i] for i in (3, 0, 2, 1, 5)], [0.025, 0.04, 0.09, 0.09, 0.09])


def test_holm_keeps_rows_whose_p_varies_in_its_last_digits(spark):
    """Sums that meet in another order give another last digit; rows then found no adjusted value and got NULL."""
    shaken = F.udf(lambda p: p * (1 + random.random() * 1e-9), "double").asNondeterministic()
    df = spark.createDataFrame([("f", i, (i + 1) / 1000) for i in range(20)], "fam string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in I.holm(df.withColumn("p", shaken("p")), ["fam"], "p").collect()}
    np.testing.assert_allclose([got[i] for i in range(10)], [(20 - i) * (i + 1) / 1000 for i in range(10)], rtol=1e-6)
    assert len(got) == 20 and None not in got.values()


def test_mann_whitney(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0, 6.0, 7.0]
    df = spark.createDataFrame([("k", 1, x) for x in a] + [("k", 0, x) for x in b], "k string, g int, v double")
    r = I.mann_whitney(df, ["k"], "g", "v", every=1).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u"] == u
    n1, n2, t = 4, 5, 3
    sd = math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (t**3 - t) / (9 * 8)))
    assert r["z"] == pytest.approx((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd)
    few = I.mann_whitney(df.where("g = 0 OR v > 2"), ["k"], "g", "v").first()
    assert few["z"] is None and few["p_value"] is None
