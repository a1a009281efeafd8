"""Queries over many runs: registry, status, seed summaries, cross-corpus tables, perturbation summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.registry import AUC, double, eer_ctes, query, score_points
from sigeval.catalog.scores import BIN_SQL, COUNTS_SQL, RATES_SQL
from sigeval.functions.columns import run_name, run_part, transfer_label
from sigeval.operators import metrics as M
from sigeval.operators import sweep as W
from sigeval.plans import runs as R
from sigeval.session import stage, stage_root
from sigeval.sources import documents as D

RUN_KEYS = ["model", "protocol", "seed", "split"]


def rnd(df, *names, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def results(spark, d):
    """Metrics of every run and split: the contents of the result documents."""
    base = stage(fx.runs(spark, d))
    counts = M.binary_metrics(base, RUN_KEYS, "label", "score", F.lit(4.0))
    ranks = M.auc_eer(M.score_points(base, RUN_KEYS, "label", "score"), RUN_KEYS, "score").drop("eer_threshold")
    cal = M.calibration(base.withColumn("score", F.col("score") - 4), RUN_KEYS, "label", "score")
    half = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")) * 1.96
    t = counts.join(ranks, RUN_KEYS).join(cal, RUN_KEYS).withColumn("run", run_name("model", "protocol", "seed"))
    return t.withColumns({"accuracy_ci95_lo": F.col("accuracy") - half, "accuracy_ci95_hi": F.col("accuracy") + half})


K = "model, protocol, seed, split"
RESULTS = f"""{score_points('rp', 'fx_runs', K, 'score')}, {eer_ctes('re', 'rp', K)},
  ra AS (SELECT {K}, {AUC} AS auc FROM rp GROUP BY ALL),
  rc AS (SELECT {K}, {COUNTS_SQL.format(p='score >= 4')} FROM fx_runs GROUP BY ALL),
  rr AS (SELECT {K}, {RATES_SQL} FROM rc),
  rb AS (SELECT {K}, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS mp, avg(label) AS fs, sum(pow(p - label, 2)) AS sq
         FROM (SELECT *, 1.0::DOUBLE/(1.0::DOUBLE+exp(-(score-4))) AS p FROM fx_runs) GROUP BY ALL),
  rk AS (SELECT {K}, sum(sq) / sum(n) AS brier, sum(n * abs(fs - mp)) / sum(n) AS ece FROM rb GROUP BY ALL),
  res AS (SELECT rr.*, auc, eer, brier, ece, concat(model, '__', protocol, '__seed', seed) AS run
          FROM rr LEFT JOIN ra USING ({K}) LEFT JOIN re USING ({K}) LEFT JOIN rk USING ({K}))"""


@query(
    "run_names",
    """SELECT concat(model, '__', protocol, '__seed', seed) AS run, model, protocol, cast(seed AS bigint) AS seed, count(*) AS n FROM fx_runs GROUP BY ALL""",
    ("fx_runs",),
)
def _(spark, d):
    t = fx.runs(spark, d).groupBy(run_name("model", "protocol", "seed").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("run", *[run_part("run", p).alias(p) for p in ("model", "protocol", "seed")], "n")


# a run is available as real results if its positives are even, as placeholder if divisible by 3
STORES = """st AS (SELECT concat(model, '__', protocol, '__seed', seed) AS run, sum(label) AS k FROM fx_runs GROUP BY ALL),
  ex AS (SELECT replace(p_brand, 'Brand#', 'model') AS model, protocol, unnest([42, 123, 2026]) AS seed
         FROM (SELECT DISTINCT p_brand, unnest(['P1', 'P2']) AS protocol FROM part)),
  rs AS (SELECT model, protocol, seed, e.run, CASE WHEN k % 2 = 0 THEN 'real' WHEN k % 3 = 0 THEN 'placeholder' ELSE 'missing' END AS status,
           CASE WHEN k % 2 = 0 THEN concat('runs/', e.run) WHEN k % 3 = 0 THEN concat('runs_placeholder/', e.run) ELSE '' END AS path
         FROM (SELECT *, concat(model, '__', protocol, '__seed', seed) AS run FROM ex) e LEFT JOIN st USING (run))"""


def stores(spark, d):
    registry = (
        fx.table(spark, d, "part")
        .select(F.regexp_replace("p_brand", "Brand#", "model").alias("model"))
        .distinct()
        .select("model", F.explode(F.array(F.lit("P1"), F.lit("P2"))).alias("protocol"))
        .withColumn("seeds", F.array(F.lit(42), F.lit(123), F.lit(2026)))
    )
    k = fx.runs(spark, d).groupBy(run_name("model", "protocol", "seed").alias("run")).agg(F.sum("label").alias("k"))
    real = k.where("k % 2 = 0").select("run", F.concat(F.lit("runs/"), "run").alias("path"), F.lit(False).alias("is_placeholder"))
    ph = k.where("k % 3 = 0").select("run", F.concat(F.lit("runs_placeholder/"), "run").alias("path"))
    return R.expected_runs(registry), real, ph


@query("run_status", f"WITH {STORES} SELECT run, model, protocol, seed, status, path FROM rs", ("fx_runs",))
def _(spark, d):
    return R.run_status(*stores(spark, d))


@query(
    "status_rollup",
    f"""WITH {STORES} SELECT model, protocol, count(*) AS n_runs, CASE WHEN bool_or(status = 'missing') THEN 'missing'
        WHEN bool_or(status = 'placeholder') THEN 'placeholder' ELSE 'real' END AS status FROM rs GROUP BY 1, 2""",
    ("fx_runs",),
)
def _(spark, d):
    return R.status_rollup(R.run_status(*stores(spark, d)), ["model", "protocol"])


@query("pending_runs", f"WITH {STORES} SELECT run, model, protocol, seed FROM rs WHERE status <> 'real'", ("fx_runs",))
def _(spark, d):
    expected, real, _ = stores(spark, d)
    return R.pending_runs(expected, real.select("run")).select("run", "model", "protocol", "seed")


@query(
    "comparison_plan",
    f"""WITH {STORES}, m AS (SELECT DISTINCT model FROM ex), ok AS (SELECT run FROM rs WHERE status <> 'missing')
      SELECT protocol, concat(first, '__', protocol, '__seed42') AS run_a, concat(model, '__', protocol, '__seed42') AS run_b
      FROM m, (SELECT unnest(['P1', 'P2']) AS protocol), (SELECT min(model) AS first FROM rs WHERE status <> 'missing' AND seed = 42) WHERE model <> first
        AND concat(first, '__', protocol, '__seed42') IN (SELECT run FROM ok) AND concat(model, '__', protocol, '__seed42') IN (SELECT run FROM ok)""",
    ("fx_runs",),
)
def _(spark, d):
    expected, real, ph = stores(spark, d)
    registered = R.run_status(expected, real, ph).where("status <> 'missing'")
    first = registered.where("seed = 42").agg(F.min("model").alias("a"))
    pairs = expected.select(first.scalar().alias("a"), F.col("model").alias("b")).where("a <> b").distinct()
    return R.comparison_plan(pairs, registered, ["P1", "P2"])


METRICS_SQL = ", ".join(
    f"count({m}) AS {m}_n, round(avg({m}), 5) AS {m}_mean, round(stddev_samp({m}), 5) AS {m}_sd" for m in R.METRICS
)


@query(
    "multiseed_summary",
    f"""WITH {RESULTS.replace(', 6) AS', ', 15) AS')} SELECT model, protocol, split, count(DISTINCT seed) AS n_seeds, {METRICS_SQL},
        round(max(accuracy - sqrt(accuracy * (1 - accuracy) / n) * 1.96::DOUBLE) FILTER (WHERE seed = 42), 5) AS accuracy_seed42_ci_low,
        round(max(accuracy + sqrt(accuracy * (1 - accuracy) / n) * 1.96::DOUBLE) FILTER (WHERE seed = 42), 5) AS accuracy_seed42_ci_high
      FROM res GROUP BY 1, 2, 3""",
    ("fx_runs",),
)
def _(spark, d):
    t = R.multiseed_summary(results(spark, d), ci_of=["accuracy"])
    return rnd(t, *[c for c, k in t.dtypes if k == "double"], digits=5)


SPLITS_SQL = """sx AS (SELECT * FROM (VALUES ('P1', 'internal_test', 'own'), ('P1', 'external_A', 'A'), ('P2', 'internal_test', 'own'),
  ('P2', 'external_B', 'B')) t(protocol, split, corpus))"""
SEEDS_SQL = f"""{RESULTS.replace(', 6) AS', ', 15) AS')}, {STORES}, {SPLITS_SQL},
  av AS (SELECT model, protocol, split, count(DISTINCT seed) AS n_seeds, count(auc) AS auc_n, avg(auc) AS auc_mean, stddev_samp(auc) AS auc_sd,
      count(accuracy) AS accuracy_n, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_sd
    FROM res SEMI JOIN (SELECT run FROM rs WHERE status <> 'missing') USING (run) GROUP BY 1, 2, 3),
  ex2 AS (SELECT model, protocol, count(*) AS n_seeds_expected, CASE WHEN bool_or(status = 'missing') THEN 'missing'
      WHEN bool_or(status = 'placeholder') THEN 'placeholder' ELSE 'real' END AS status FROM rs GROUP BY 1, 2),
  sd AS (SELECT model, protocol, split, corpus, n_seeds_expected, status, coalesce(n_seeds, 0) AS n_seeds, coalesce(auc_n, 0) AS auc_n, auc_mean, auc_sd,
      coalesce(accuracy_n, 0) AS accuracy_n, accuracy_mean, accuracy_sd
    FROM ex2 JOIN sx USING (protocol) LEFT JOIN av USING (model, protocol, split))"""


def seeds(spark, d):
    rows = [("P1", "internal_test", "own"), ("P1", "external_A", "A"), ("P2", "internal_test", "own"), ("P2", "external_B", "B")]
    splits = spark.createDataFrame(rows, "protocol string, split string, corpus string")
    return R.seed_table(results(spark, d), R.run_status(*stores(spark, d)), splits, ["auc", "accuracy"])


@query(
    "multiseed_status",
    f"""WITH {SEEDS_SQL} SELECT model, protocol, split, corpus, n_seeds_expected, status, n_seeds, auc_n, accuracy_n,
      {', '.join(f'round({m}_{s}, 5) AS {m}_{s}' for m in ('auc', 'accuracy') for s in ('mean', 'sd'))} FROM sd""",
    ("fx_runs",),
)
def _(spark, d):
    return rnd(seeds(spark, d), "auc_mean", "auc_sd", "accuracy_mean", "accuracy_sd", digits=5)


@query(
    "cross_corpus_status",
    f"""WITH {SEEDS_SQL} SELECT model, protocol, any_value(status) AS status,
      {', '.join(f"round(max(auc_mean) FILTER (WHERE corpus = '{c}'), 5) AS test_{c}" for c in ('own', 'A', 'B'))} FROM sd GROUP BY 1, 2""",
    ("fx_runs",),
)
def _(spark, d):
    t = R.cross_corpus(stage(seeds(spark, d)), "auc_mean", "protocol", "corpus", ["own", "A", "B"])
    return rnd(t, "test_own", "test_A", "test_B", digits=5)


@query(
    "calibration_table",
    f"""WITH {RESULTS}, {STORES} SELECT run, split, status, round(ece, 6) AS ece, round(brier, 6) AS brier, round(auc, 6) AS auc, accuracy
        FROM res JOIN (SELECT run, status FROM rs) USING (run) WHERE status <> 'missing' AND ece IS NOT NULL""",
    ("fx_runs",),
)
def _(spark, d):
    t = R.calibration_table(results(spark, d), R.run_status(*stores(spark, d)))
    return rnd(t, "ece", "brier", "auc", "accuracy")


CORPORA = ["internal_test", "external_A", "external_B"]


@query(
    "cross_corpus",
    f"""WITH {score_points('rp', 'fx_runs', K, 'score')}, a AS (SELECT {K}, {AUC} AS auc FROM rp GROUP BY ALL),
      m AS (SELECT model, protocol, split, avg(auc) AS auc FROM a GROUP BY 1, 2, 3)
      SELECT model, protocol, {', '.join(f"round(max(auc) FILTER (WHERE split = '{c}'), 6) AS test_{c}" for c in CORPORA)} FROM m GROUP BY 1, 2""",
    ("fx_runs",),
)
def _(spark, d):
    a = M.auc(M.score_points(fx.runs(spark, d), RUN_KEYS, "label", "score"), RUN_KEYS)
    summary = R.multiseed_summary(a, metrics=["auc"])
    return rnd(R.cross_corpus(summary, "auc_mean", "protocol", "split", CORPORA), *[f"test_{c}" for c in CORPORA])


@query(
    "transfer_label",
    f"""WITH {RESULTS}, m AS (SELECT model, protocol, split, avg(auc) AS auc, avg(((tp + tn)::DOUBLE / n)) AS acc FROM res GROUP BY 1, 2, 3)
      SELECT model, protocol, split, CASE WHEN split = 'internal_test' THEN 'in-corpus' WHEN auc < 0.5 THEN 'ranking inverted'
        WHEN auc < 0.52 THEN 'partial' WHEN acc < 0.5 THEN 'ranking transfers, threshold does not' WHEN auc IS NOT NULL THEN 'transfers' END AS transfer FROM m""",
    ("fx_runs",),
)
def _(spark, d):
    s = R.multiseed_summary(results(spark, d), metrics=["auc", "accuracy"])
    label = transfer_label(F.col("split") == "internal_test", "auc_mean", "accuracy_mean", partial=0.52, min_accuracy=0.5)
    return s.select("model", "protocol", "split", label.alias("transfer"))


@query(
    "result_docs_flatten",
    f"""WITH {RESULTS} SELECT run, split, n, tp, tn, fp, fn, accuracy, round(auc, 6) AS auc, round(eer, 6) AS eer, recall_spoof_sensitivity FROM res""",
    ("fx_runs",),
)
def _(spark, d):
    cols = ["n", "tp", "tn", "fp", "fn", "accuracy", "auc", "eer", "recall_spoof_sensitivity"]
    nan = F.lit(float("nan"))
    t = results(spark, d).select("run", "split", *[F.coalesce(c, nan).alias(c) if c not in cols[:5] else c for c in cols])
    docs = D.as_json(t, cols).withColumn("value", F.regexp_replace("value", '"NaN"', "NaN"))
    return rnd(D.flatten(docs).select("run", "split", *cols), "accuracy", "auc", "eer", "recall_spoof_sensitivity")


TRIP = (
    "accuracy", "balanced_accuracy", "precision_spoof", "recall_spoof_sensitivity", "specificity_bonafide_recall", "f1_spoof", "f1_macro",
    "fpr", "fnr", "auc", "eer", "brier", "ece",
)
TRIP_CI = ("accuracy_ci95_lo", "accuracy_ci95_hi")


@query(
    "result_docs_roundtrip",
    f"""WITH {RESULTS.replace(', 6) AS', ', 15) AS')}, ru AS (SELECT run, sum(n_spoof) % 3 = 0 AS is_placeholder FROM res GROUP BY run)
      SELECT run, split, concat('eer on validation of ', protocol) AS threshold_rule, 4.0::DOUBLE AS threshold_logit, is_placeholder, n, n_spoof, n_bonafide,
        tp, tn, fp, fn, {', '.join(f'round({c}, 6) AS {c}' for c in TRIP)}, round(accuracy - sqrt(accuracy * (1 - accuracy) / n) * 1.96::DOUBLE, 6) AS accuracy_ci95_lo,
        round(accuracy + sqrt(accuracy * (1 - accuracy) / n) * 1.96::DOUBLE, 6) AS accuracy_ci95_hi FROM res JOIN ru USING (run)""",
    ("fx_runs",),
)
def _(spark, d):
    """Whole result documents of all runs, written as one file per run and read again."""
    t = stage(results(spark, d))
    flags = t.groupBy("run").agg((F.sum("n_spoof") % 3 == 0).alias("is_placeholder"))
    rule = F.concat(F.lit("eer on validation of "), "protocol")
    nan = F.lit(float("nan"))
    whole = t.join(flags, "run").withColumns({"threshold_rule": rule, "threshold_logit": F.lit(4.0), **{c: F.coalesce(c, nan) for c in ("auc", "eer")}})
    path = f"{stage_root(spark)}/documents-{uuid.uuid4().hex}"
    D.write_runs(D.as_documents(whole), path)
    kept = ["run", "split", "threshold_rule", "threshold_logit", "is_placeholder", "n", "n_spoof", "n_bonafide", "tp", "tn", "fp", "fn"]
    return rnd(D.read_runs(spark, path).select(*kept, *TRIP, *TRIP_CI), *TRIP, *TRIP_CI)


# ---------------------------------------------------------------- perturbation scores
CONDITIONS = """fc AS (SELECT split, item, label, 'clean' AS condition, score, false AS input_changed, false AS clipped FROM fx_scores
  UNION ALL SELECT split, item, label, 'noise_snr10', score_b, true, false FROM fx_scores
  UNION ALL SELECT split, item, label, 'clip_+6dB', score - CASE WHEN max_pad_fraction > 0.05 THEN max_pad_fraction * 8 ELSE 0 END,
    max_pad_fraction > 0.05, max_pad_fraction > 0.05 FROM fx_scores)"""


def conditions(spark, d):
    s = fx.scores(spark, d)
    hit = F.col("max_pad_fraction") > 0.05
    rows = [
        ("clean", F.col("score"), F.lit(False), F.lit(False)),
        ("noise_snr10", F.col("score_b"), F.lit(True), F.lit(False)),
        ("clip_+6dB", F.col("score") - F.when(hit, F.col("max_pad_fraction") * 8).otherwise(0.0), hit, hit),
    ]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("condition"), v.alias("score"), c.alias("input_changed"), k.alias("clipped"))
            for n, v, c, k in rows
        ]
    )
    return s.select("split", "item", "label", F.inline(cells))


@query(
    "condition_shift",
    f"""WITH {CONDITIONS} SELECT split, item, condition, round(score - clean, 6) AS shift, (score >= 4) <> (clean >= 4) AS flipped
      FROM (SELECT *, max(score) FILTER (WHERE condition = 'clean') OVER (PARTITION BY split, item) AS clean FROM fc)""",
    ("fx_scores",),
)
def _(spark, d):
    t = W.condition_shift(stage(conditions(spark, d)), ["split"], "item", F.lit(4.0))
    return rnd(t.select("split", "item", "condition", "shift", "flipped"), "shift")


SUMMARY = f"""{CONDITIONS}, {score_points('cp', 'fc', 'split, condition', 'score')}, {eer_ctes('ce', 'cp', 'split, condition')},
  ca AS (SELECT split, condition, {AUC} AS auc FROM cp GROUP BY 1, 2),
  cx AS (SELECT a.*, a.score - c.score AS shift, ((a.score >= 4) <> (c.score >= 4))::INT AS flip FROM fc a JOIN fc c ON a.split = c.split AND a.item = c.item AND c.condition = 'clean'),
  cs AS (SELECT split, condition, count(*) AS n, avg(((score >= 4)::INT = label)::INT) AS accuracy, avg((score >= 4)::INT) FILTER (WHERE label = 1) AS sensitivity,
    avg((score < 4)::INT) FILTER (WHERE label = 0) AS specificity, avg(shift) FILTER (WHERE label = 0) AS mean_score_shift_bonafide,
    avg(shift) FILTER (WHERE label = 1) AS mean_score_shift_spoof, avg(flip) AS decision_flip_rate, avg(input_changed::INT) AS share_input_changed,
    avg(flip) FILTER (WHERE input_changed) AS decision_flip_rate_changed,
    avg(clipped::INT) FILTER (WHERE label = 0 AND condition LIKE 'clip_%') AS share_clipped_bonafide, avg(clipped::INT) FILTER (WHERE label = 1 AND condition LIKE 'clip_%') AS share_clipped_spoof
    FROM cx GROUP BY 1, 2)"""
SUMMARY_DOUBLES = (
    "auc", "eer", "accuracy", "sensitivity", "specificity", "mean_score_shift_bonafide", "mean_score_shift_spoof", "decision_flip_rate",
    "share_input_changed", "decision_flip_rate_changed", "share_clipped_bonafide", "share_clipped_spoof",
)


@query(
    "robustness_summary",
    f"""WITH {SUMMARY} SELECT split, condition, n, {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY_DOUBLES)}
      FROM cs JOIN ca USING (split, condition) LEFT JOIN ce USING (split, condition)""",
    ("fx_scores",),
)
def _(spark, d):
    return rnd(W.robustness_summary(stage(conditions(spark, d)), ["split"], "item", F.lit(4.0)), *SUMMARY_DOUBLES)


@query(
    "robustness_delta",
    f"""WITH {CONDITIONS}, {score_points('cp', 'fc', 'split, condition', 'score')}, ca AS (SELECT split, condition, {AUC} AS auc FROM cp GROUP BY 1, 2),
      dd AS (SELECT a.split, a.condition, a.auc, a.auc - c.auc AS delta FROM ca a JOIN ca c ON a.split = c.split AND c.condition = 'clean')
      SELECT 'main' AS model, condition, {', '.join(f"round(max(auc) FILTER (WHERE split = '{c}'), 6) AS {c}_auc, round(max(delta) FILTER (WHERE split = '{c}'), 6) AS {c}_delta" for c in CORPORA)}
      FROM dd GROUP BY condition""",
    ("fx_scores",),
)
def _(spark, d):
    by = ["split", "condition"]
    a = stage(M.auc(M.score_points(stage(conditions(spark, d)), by, "label", "score"), by).withColumn("model", F.lit("main")))
    t = W.robustness_delta(a, ["model"], "split", CORPORA)
    return rnd(t, *[c for c, k in t.dtypes if k == "double"])
