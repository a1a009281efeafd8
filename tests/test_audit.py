import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigeval.operators import audit as A
from sigeval.operators import neighbours as N
from sigeval.operators import probes as P
from sigeval.operators import sampling as S
from sigeval.operators.errors import with_quantile_levels


def brute_neighbours(x, ids, threshold, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    out = set()
    for i in range(len(ids)):
        near = sorted((-cos[i, j], ids[j]) for j in range(len(ids)) if j != i and cos[i, j] >= threshold)
        out |= {(ids[i], j, r) for r, (_, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    crowd = base[0] + rng.normal(scale=0.03, size=(40, 16))  # a third of all vectors in one place
    x = np.vstack([base, crowd, base[:20] + rng.normal(scale=0.1, size=(20, 16))])
    ids = list(range(len(x)))
    rows = [(i, [float(v) for v in row]) for i, row in zip(ids, x)] + [(1000 + i, [float(v) for v in x[i]]) for i in range(5)]
    x, ids = np.vstack([x, x[:5]]), ids + [1000 + i for i in range(5)]
    rows += [(2000 + i, [float(v) for v in x[3]]) for i in range(9)]  # more copies than a list holds
    x, ids = np.vstack([x, np.tile(x[3], (9, 1))]), ids + [2000 + i for i in range(9)]
    df = spark.createDataFrame(rows, "item long, v array<double>")
    for threshold in (0.995, 0.9):
        got = N.neighbours(df, "item", "v", 16, threshold, k=4, block_rows=block).collect()
        assert {(r["item"], r["neighbour"], r["rank"]) for r in got} == brute_neighbours(x, ids, threshold, 4)


@pytest.mark.parametrize("block", [4096, 7])
def test_all_pairs_keep_links_between_groups_of_copies(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    near = [base + rng.normal(scale=0.01, size=16) for _ in range(12)]  # more neighbours than a list of six holds
    far = rng.normal(size=(5, 16))
    rows = [(100 * g + c, [float(v) for v in x]) for g, x in enumerate([*near, *far]) for c in range(8 if g < 2 else 1)]
    df = spark.createDataFrame(rows, "item long, v array<double>")
    got = {(r["item_a"], r["item_b"]) for r in N.all_pairs(df, "item", "v", 16, 0.995, block_rows=block).collect()}
    assert got == {(100 * a, 100 * b) for a in range(12) for b in range(a + 1, 12)}
    lists = N.candidate_pairs(N.neighbours(df, "item", "v", 16, 0.995, k=6)).collect()
    assert not any({r["item_a"] // 100, r["item_b"] // 100} == {0, 1} for r in lists)  # what the lists of six cut
    got = {(r["representative"], r["member"]) for r in N.copies(df, "item", "v").collect()}
    assert got == {(100 * g, 100 * g + c) for g in range(2) for c in range(8)}


def test_confirm_finds_shifted_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    rows = [(1, x.tolist()), (2, np.r_[np.zeros(7), x[:-7]].tolist()), (3, rng.normal(size=200).tolist())]
    sig = spark.createDataFrame(rows, "item long, s array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "item_a long, item_b long")
    got = {r["item_b"]: r["confirmed"] for r in N.confirm(pairs, sig, "item", "s").collect()}
    assert got == {2: True, 3: False}


def test_duplicates_across_labels_and_sources(spark):
    rows = [(1, "x", 0, "a"), (2, "x", 1, "a"), (3, "y", 0, "a"), (4, "y", 0, "b"), (5, "z", 1, "a")]
    df = spark.createDataFrame(rows, "item int, h string, label int, source string")
    r = A.duplicate_summary(A.duplicate_groups(df, "h", "label", "source", "item")).first()
    assert r.asDict() == {"files_in_groups": 4, "groups": 2, "cross_label_groups": 1, "cross_source_groups": 1}


def test_separability_of_a_reversed_descriptor(spark):
    rows = [("c", 1, float(i)) for i in range(5)] + [("c", 0, float(i + 10)) for i in range(5)]
    r = A.separability(spark.createDataFrame(rows, "k string, label int, d double"), ["k"], "label", ["d"]).first()
    assert (r["auc_spoof_high"], r["separability"], r["direction"]) == (0.0, 1.0, "lower=>spoof")


def test_split_overlap_counts_and_zeros(spark):
    rows = [("train", "a"), ("train", "b"), ("test", "b"), ("test", "b"), ("val", "c"), ("train", None)]
    got = {(r["split_a"], r["split_b"]): r["shared_k"] for r in A.split_overlap(spark.createDataFrame(rows, "s string, k string"), "s", {"k": F.col("k")}).collect()}
    assert got == {("test", "train"): 1, ("test", "val"): 0, ("train", "val"): 0}


def test_profile_mode_takes_lowest_tie(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 1.0, 3.0, 2.0)], "k string, v double")
    r = A.profile(df, ["k"], "v").first()
    assert (r["mode"], r["median"], r["distinct"], r["count"]) == (1.0, 2.0, 3, 5)


def test_group_split_is_disjoint_and_exact(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(600)], "item int, g int")
    t = S.group_split(df, "g", [("train", 0.7), ("validation", 0.15), ("test", 0.15)], seed=3).toPandas()
    assert len(t) == 600 and (t.groupby("g")["split"].nunique() == 1).all()
    assert t.drop_duplicates("g")["split"].value_counts().to_dict() == {"train": 140, "validation": 30, "test": 30}


@pytest.mark.parametrize("auto", ["-1", "10m"])
def test_splits_and_levels_join_on_no_constant(spark, auto):
    """Without keys the cuts are scalars: no plan has a Cartesian product or a nested loop."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    try:
        df = spark.range(2000).select(F.col("id").alias("item"), (F.col("id") % 97).alias("g"), F.rand(1).alias("v"))
        split = S.group_split(df, "g", [("train", 0.7), ("test", 0.3)])
        levels = with_quantile_levels(df, [], {"a": (F.col("v"), ["low", "high"]), "b": (F.col("g"), ["x", "y", "z"])})
        sample = S.seeded_sample(df, "item", 10)
        for t in (split, levels, sample):
            plan = t._jdf.queryExecution().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert sample.count() == 10 and levels.where("a = 'low'").count() == 1000 and split.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stratified_sizes(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "item int, label int")
    t = S.stratified_split(df, "label", "item").toPandas()
    assert t[t.split == "validation"]["label"].value_counts().to_dict() == {0: 45, 1: 15}
    s = S.stratified_sample(df.repartition(7), "label", "item", 50).toPandas()
    assert s["label"].value_counts().to_dict() == {0: 50, 1: 50}
    a, b = (sorted(r["item"] for r in S.seeded_sample(df.repartition(p), "item", 30, 1).collect()) for p in (1, 9))
    assert a == b and len(a) == 30


def test_quantile_levels_and_duplicate_edges(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(9)], "k string, v double")
    t = with_quantile_levels(df, ["k"], {"lv": (F.col("v"), ["a", "b", "c"])}).toPandas()
    assert list(t.sort_values("v")["lv"]) == ["a"] * 3 + ["b"] * 3 + ["c"] * 3
    flat = df.withColumn("v", F.lit(1.0))
    with pytest.raises(Exception, match="not unique"):
        with_quantile_levels(flat, ["k"], {"lv": (F.col("v"), ["a", "b"])}).collect()
    assert with_quantile_levels(flat, ["k"], {"lv": (F.col("v"), ["a", "b"])}, drop_duplicates=True).first()["lv"] == "a"


def test_probes_learn_a_separable_problem(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), (rng.normal(size=6) + 3 * (i % 2)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "item int, label int, x array<double>")
    t = P.linear_probe(df, df, "x").toPandas()
    assert ((t["logit"] > 0).astype(int) == t["label"]).mean() > 0.97
    models = P.fit_mixtures(df, "x", "label", components=2, iterations=3)
    g = P.mixture_llr(df, "x", models).toPandas()
    assert ((g["logit"] > 0).astype(int) == g["label"]).mean() > 0.97


def test_channel_stats(spark):
    x = np.random.default_rng(0).normal(size=(4, 3, 2, 5))
    df = spark.createDataFrame([("mel", row.tolist()) for row in x], "feature string, values array<array<array<double>>>")
    got = {r["channel"]: r for r in A.channel_stats(df, ["feature"], "values").collect()}
    for c in range(3):
        assert got[c]["mean"] == pytest.approx(x[:, c].mean()) and got[c]["std"] == pytest.approx(x[:, c].std()) and got[c]["n_windows"] == 4


def test_channel_stats_far_from_zero(spark):
    """Mean 1e6 and SD 1: running sums of squares would lose the SD. NULL cells and channels without statistics."""
    rng = np.random.default_rng(3)
    cells = 1e6 + rng.normal(size=(40, 2, 3, 5))
    rows = [("a", i, x.tolist()) for i, x in enumerate(cells)] + [("b", 99, [[[None, 1.0]]])]
    df = spark.createDataFrame(rows, "feature string, i int, values array<array<array<double>>>")
    stats = A.channel_stats(df, ["feature"], "values")
    got = {(r.feature, r.channel): r for r in stats.collect()}
    for c in range(2):
        r = got["a", c]
        assert abs(r["mean"] - cells[:, c].mean()) < 1e-8 and abs(r["std"] - cells[:, c].std()) < 1e-8
        assert (r.n_cells, r.n_windows) == (600, 40)
    assert (got["b", 0].n_cells, got["b", 0].n_windows, got["b", 0]["mean"]) == (1, 1, 1.0)

    z = {r.i: r.z for r in A.channel_normalised(df, ["feature"], "values", stats.where("feature = 'a' AND channel = 1")).collect()}
    want = (cells[:, 1] - cells[:, 1].mean()) / (cells[:, 1].std() + 1e-8)
    assert np.allclose([z[i][1] for i in range(40)], want, atol=1e-7)
    assert z[0][0][0][0] is None and z[99][0][0][1] is None
    assert A.channel_stats(df.limit(0), ["feature"], "values").count() == 0


def joined_by(df, column):
    """Joins of the plan that shuffle both sides by one column alone."""
    return re.findall(rf"SortMergeJoin \[{column}#\d+\], ", df._jdf.queryExecution().executedPlan().toString())


def test_rows_are_not_shuffled_by_label(spark):
    """Nearly all rows have one label; a shuffle by label would put them into one task."""
    t = spark.range(3000).selectExpr("id AS item", "CASE WHEN id < 20 THEN 1 ELSE 0 END AS label")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample, split = S.stratified_sample(t, "label", "item", 50), S.stratified_split(t, "label", "item")
        assert not joined_by(sample, "label") and not joined_by(split, "label")
        assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 50, 1: 20}
        got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
        assert got == {(0, "validation"): 447, (0, "train"): 2533, (1, "validation"): 3, (1, "train"): 17}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_probes_fit_partitions_of_bounded_size(spark, monkeypatch):
    """Many rows in one compressed file are dealt out; few rows stay as they are."""
    t = spark.range(0, 1000, 1, 1).selectExpr("CAST(id % 2 AS int) AS label", "id % 2 + (id % 7) / 10.0 AS x")
    assert P._dealt(t, 1000) is t
    monkeypatch.setattr(P, "FIT_ROWS", 50)
    sizes = [len(p) for p in P._dealt(t, 1000).rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 60 and P._dealt(t, 1000).exceptAll(t).count() == 0
    got = P.tree_probe(t, t, ["x"], trees=2).where("(logit > 0) <> (label = 1)")
    assert got.count() == 0


@pytest.mark.parametrize("name", ["seeded_sample", "stratified_sample", "stratified_split", "split_semi"])
def test_samples_compute_their_items_once(spark, name):
    """The cut and the rows it selects read one staged table, not the joins below it again."""
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "stage-" in plan
