"""Queries on window and item scores: pooling, rates, ROC, EER, thresholds, calibration, error groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.inference import draws_sql
from sigeval.catalog.registry import ORACLES, AUC, double, eer_ctes, query, score_points, seed32
from sigeval.functions.columns import (
    auc_verdict,
    balance_verdict,
    fixed_cut,
    outcome,
    parent_id,
    recode,
    sigmoid,
    stable_seed,
    unknown_to_null,
)
from sigeval.operators import metrics as M
from sigeval.operators import ordering as O
from sigeval.operators.errors import error_groups, fn_vs_tp, with_quantile_levels
from sigeval.plans import evaluation as E
from sigeval.session import stage

P6 = 6


def r(c, n=P6):
    return F.round(c, n)


def two(df, *names):
    """Round the named double columns for comparison."""
    return df.withColumns({c: F.round(F.col(c), P6) for c in names})


RATES_SQL = """
  cast(tp+fn+tn+fp AS bigint) AS n, cast(tp+fn AS bigint) AS n_spoof, cast(tn+fp AS bigint) AS n_bonafide,
  cast(tp AS bigint) AS tp, cast(tn AS bigint) AS tn, cast(fp AS bigint) AS fp, cast(fn AS bigint) AS fn,
  round((tp+tn)::DOUBLE/(tp+fn+tn+fp), 6) AS accuracy,
  round(CASE WHEN tp+fn>0 AND tn+fp>0 THEN (tp::DOUBLE/(tp+fn) + tn::DOUBLE/(tn+fp))*0.5::DOUBLE END, 6) AS balanced_accuracy,
  round(tp::DOUBLE/nullif(tp+fp,0), 6) AS precision_spoof,
  round(tp::DOUBLE/nullif(tp+fn,0), 6) AS recall_spoof_sensitivity,
  round(tn::DOUBLE/nullif(tn+fp,0), 6) AS specificity_bonafide_recall,
  round((2*tp)::DOUBLE/nullif(2*tp+fp+fn,0), 6) AS f1_spoof,
  round(CASE WHEN tp+fn>0 AND tn+fp>0 THEN ((2*tp)::DOUBLE/nullif(2*tp+fp+fn,0) + (2*tn)::DOUBLE/nullif(2*tn+fn+fp,0))*0.5::DOUBLE END, 6) AS f1_macro,
  round(fp::DOUBLE/nullif(tn+fp,0), 6) AS fpr, round(fn::DOUBLE/nullif(tp+fn,0), 6) AS fnr"""

COUNTS_SQL = """count(*) FILTER (WHERE label=1 AND {p}) AS tp, count(*) FILTER (WHERE label=0 AND NOT ({p})) AS tn,
  count(*) FILTER (WHERE label=0 AND {p}) AS fp, count(*) FILTER (WHERE label=1 AND NOT ({p})) AS fn"""

RATE_NAMES = (
    "accuracy", "balanced_accuracy", "precision_spoof", "recall_spoof_sensitivity", "specificity_bonafide_recall",
    "f1_spoof", "f1_macro", "fpr", "fnr",
)


@query(
    "pool_scores",
    "SELECT item, label, dataset_id, speaker_id, text_group, split, score, n_windows, max_pad_fraction FROM fx_scores",
    ("fx_scores",),
)
def _(spark, d):
    return M.pool_scores(fx.windows(spark, d), "item", first=fx.ITEM_COLUMNS)


@query("split_filter", "SELECT item, label, score FROM fx_scores WHERE split = 'internal_test'", ("fx_scores",))
def _(spark, d):
    return E.split_rows(fx.scores(spark, d), "split", "internal_test", check=False).select("item", "label", "score")


@query(
    "window_enrich",
    """SELECT item, row_number() OVER (PARTITION BY item ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS win,
       logit, pad_fraction, label, dataset_id, speaker_id, text_group FROM fx_windows""",
    ("fx_windows",),
)
def _(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    w = O.row_index(stage(fx.windows(spark, d)), ["item"], order, "win")
    return w.select("item", "win", "logit", "pad_fraction", "label", "dataset_id", "speaker_id", "text_group")


@query("sigmoid_scores", "SELECT item, round(1.0::DOUBLE/(1.0::DOUBLE+exp(-score)), 6) AS prob_spoof FROM fx_scores", ("fx_scores",))
def _(spark, d):
    return fx.scores(spark, d).select("item", r(sigmoid("score")).alias("prob_spoof"))


@query(
    "recode_usage",
    """SELECT CASE split WHEN 'train' THEN 'Train_Validation' WHEN 'external_A' THEN 'Independent_Test'
         WHEN 'external_B' THEN 'Cross_Dataset_Test' ELSE split END AS usage, label, count(*) AS n
       FROM fx_scores GROUP BY 1, 2""",
    ("fx_scores",),
)
def _(spark, d):
    usage = recode("split", {"train": "Train_Validation", "external_A": "Independent_Test", "external_B": "Cross_Dataset_Test"})
    return fx.scores(spark, d).groupBy(usage.alias("usage"), "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "outcome_counts",
    """SELECT split, CASE WHEN label=1 AND score>=4 THEN 'TP' WHEN label=0 AND score<4 THEN 'TN'
         WHEN label=0 AND score>=4 THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS n, round(avg(abs(score-4)), 6) AS confidence
       FROM fx_scores GROUP BY 1, 2""",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d)
    return s.groupBy("split", outcome("label", "score", F.lit(4.0)).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("score") - 4))).alias("confidence")
    )


@query(
    "parent_id",
    """WITH names AS (SELECT concat('rec', o.o_orderkey, '_chk', o.o_custkey % 7, '_chk', l.l_linenumber) AS name FROM lineitem l
         JOIN orders o ON l.l_orderkey = o.o_orderkey UNION ALL SELECT concat('whole', o_orderkey) FROM orders)
       SELECT regexp_replace(name, '_chk[0-9]+$', '') AS parent, string_split(name, '_chk')[1] AS source, count(*) AS n FROM names GROUP BY 1, 2""",
)
def _(spark, d):
    li, o = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders")
    chunk = F.concat(
        F.lit("rec"), "o_orderkey", F.lit("_chk"), F.col("o_custkey") % 7, F.lit("_chk"), "l_linenumber"
    )
    names = li.join(o, li.l_orderkey == o.o_orderkey).select(chunk.alias("name")).unionByName(
        o.select(F.concat(F.lit("whole"), "o_orderkey").alias("name"))
    )
    ids = (parent_id("name").alias("parent"), parent_id("name", first=True).alias("source"))
    return names.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stable_seed",
    f"SELECT item, {seed32('cast(item AS varchar)', 'split')} AS seed FROM fx_scores",
    ("fx_scores",),
)
def _(spark, d):
    return fx.scores(spark, d).select("item", stable_seed("item", "split").alias("seed"))


@query(
    "fixed_cut",
    """SELECT item, CASE WHEN score > 0 AND score <= 2 THEN 'short' WHEN score > 2 AND score <= 4 THEN 'medium'
         WHEN score > 4 AND score <= 7 THEN 'standard' WHEN score > 7 THEN 'long' END AS level FROM fx_scores""",
    ("fx_scores",),
)
def _(spark, d):
    level = fixed_cut("score", [0, 2, 4, 7, float("inf")], ["short", "medium", "standard", "long"])
    return fx.scores(spark, d).select("item", level.alias("level"))


@query(
    "quantile_cut",
    """, e AS (SELECT split, quantile_cont(score, 1/3::DOUBLE) AS a, quantile_cont(score, 2/3::DOUBLE) AS b FROM fx_scores GROUP BY split)
       SELECT split, CASE WHEN score <= a THEN 'low' WHEN score <= b THEN 'mid' ELSE 'high' END AS level, count(*) AS n
       FROM fx_scores JOIN e USING (split) GROUP BY 1, 2""".lstrip(", ").replace("e AS", "WITH e AS", 1),
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d)
    return (
        with_quantile_levels(s, ["split"], {"level": (F.col("score"), ["low", "mid", "high"])})
        .groupBy("split", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("paired_scores", "SELECT item, label, score AS score_a, score_b FROM fx_scores", ("fx_scores",))
def _(spark, d):
    w = fx.windows(spark, d)
    a = w.groupBy("item").agg(M.one_value("label").alias("label"), F.avg("logit").alias("score"))
    b = w.groupBy("item").agg(F.avg("logit_b").alias("score"))
    return E.pair_runs(a, b, "item")


# ---------------------------------------------------------------- confusion and ranking
@query(
    "binary_metrics",
    f"SELECT split, {RATES_SQL} FROM (SELECT split, {COUNTS_SQL.format(p='score >= 4')} FROM fx_scores GROUP BY split)",
    ("fx_scores",),
)
def _(spark, d):
    return two(M.binary_metrics(fx.scores(spark, d), ["split"], "label", "score", F.lit(4.0)), *RATE_NAMES)


@query(
    "confusion_percent",
    f"""SELECT split, cast(tp AS bigint) AS tp, cast(tn AS bigint) AS tn, cast(fp AS bigint) AS fp, cast(fn AS bigint) AS fn,
        round(100 * tn::DOUBLE / nullif(tn + fp, 0), 4) AS pct_tn, round(100 * fp::DOUBLE / nullif(tn + fp, 0), 4) AS pct_fp,
        round(100 * fn::DOUBLE / nullif(tp + fn, 0), 4) AS pct_fn, round(100 * tp::DOUBLE / nullif(tp + fn, 0), 4) AS pct_tp
      FROM (SELECT split, {COUNTS_SQL.format(p='score >= 4')} FROM fx_scores GROUP BY split)""",
    ("fx_scores",),
)
def _(spark, d):
    counts = M.confusion(fx.scores(spark, d), ["split"], "label", F.col("score") >= 4.0)
    t = M.confusion_percent(counts).withColumns({c: F.round(c, 4) for c in ("pct_tn", "pct_fp", "pct_fn", "pct_tp")})
    return t.select("split", "tp", "tn", "fp", "fn", "pct_tn", "pct_fp", "pct_fn", "pct_tp")


@query("auc_exact", f"SELECT split, round({AUC}, 8) AS auc FROM pts GROUP BY split", ("pts",))
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    return M.auc(pts, ["split"]).withColumn("auc", r("auc", 8))


@query(
    "roc_points",
    """SELECT split, CASE WHEN isinf(thr) THEN NULL ELSE thr END AS threshold, round(fpr, 8) AS fpr, round(1 - fnr, 8) AS tpr
       FROM eers_roc""",
    ("eers",),
)
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    roc = M.roc_curve(pts, ["split"], "score")
    return roc.select(
        "split",
        F.when(F.col("threshold") != float("inf"), F.col("threshold")).alias("threshold"),
        r("fpr", 8).alias("fpr"),
        r("tpr", 8).alias("tpr"),
    )


@query("eer_interp", "SELECT split, round(eer, 8) AS eer, round(threshold, 8) AS threshold FROM eers", ("eers",))
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    return M.eer(pts, ["split"], "score").select("split", r("eer", 8).alias("eer"), r("threshold", 8).alias("threshold"))


@query(
    "eer_nearest",
    """WITH g AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY abs(fnr - fpr), thr DESC) AS rn FROM eers_roc)
       SELECT g.split, round(fpr, 8) AS eer_fpr, round((fpr + fnr) / 2, 8) AS eer_mean, round(eer, 8) AS eer_root
       FROM g JOIN eers USING (split) WHERE rn = 1""",
    ("eers",),
)
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    near = M.eer_nearest(pts, ["split"], "score").join(M.eer(pts, ["split"], "score"), "split")
    return near.select(
        "split", r("eer_fpr", 8).alias("eer_fpr"), r("eer_mean", 8).alias("eer_mean"), r("eer", 8).alias("eer_root")
    )


@query(
    "threshold_balanced",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY
           (pos_total - pos_before) * neg_total + neg_before * pos_total DESC, score) AS rn FROM pts)
       SELECT split, score AS threshold,
         round(((pos_total - pos_before)::DOUBLE / pos_total + neg_before::DOUBLE / neg_total) * 0.5::DOUBLE, 8) AS balanced_accuracy
       FROM t WHERE rn = 1""",
    ("pts",),
)
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    return M.balanced_threshold(pts, ["split"], "score").withColumn("balanced_accuracy", r("balanced_accuracy", 8))


@query(
    "threshold_grid",
    f"""WITH g AS (SELECT unnest([{', '.join(double(t) for t in M.GRID)}]) AS t),
       c AS (SELECT split, t, count(*) FILTER (WHERE label=1 AND p>t) AS tp, count(*) FILTER (WHERE label=0 AND p<=t) AS tn,
              count(*) FILTER (WHERE label=0 AND p>t) AS fp, count(*) FILTER (WHERE label=1 AND p<=t) AS fn
            FROM (SELECT split, label, 1.0::DOUBLE/(1.0::DOUBLE+exp(-(score-4))) AS p FROM fx_scores), g GROUP BY split, t),
       o AS (SELECT split, t, {RATES_SQL} FROM c),
       b AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(0.7::DOUBLE*f1_macro+0.3::DOUBLE*accuracy, 6) DESC, t) AS rn FROM o)
       SELECT split, t AS threshold, round(f1_macro, 4) AS f1_macro, round(accuracy, 4) AS accuracy FROM b WHERE rn = 1""",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d).withColumn("prob", sigmoid(F.col("score") - 4))
    g = M.threshold_grid(s, ["split"], "label", "prob")
    return g.select("split", "threshold", r("f1_macro", 4).alias("f1_macro"), r("accuracy", 4).alias("accuracy"))


PROB_SQL = "1.0::DOUBLE/(1.0::DOUBLE+exp(-(score-4)))"
BIN_SQL = " + ".join(f"(p >= {double(i * (1.0 / 15))})::INT" for i in range(1, 15))
RELIABILITY_SQL = f"""WITH rel AS (SELECT split, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS mean_pred, avg(label) AS frac_spoof
   FROM (SELECT split, label, {PROB_SQL} AS p FROM fx_scores) GROUP BY 1, 2)"""


@query(
    "brier",
    f"SELECT split, round(avg(pow({PROB_SQL} - label, 2)), 6) AS brier FROM fx_scores GROUP BY split",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d).withColumn("prob", sigmoid(F.col("score") - 4))
    return s.groupBy("split").agg(r(M.brier_aggregate("label", "prob")).alias("brier"))


@query(
    "reliability_bins",
    f"""{RELIABILITY_SQL} SELECT split, bin, round(bin / 15.0::DOUBLE, 6) AS lo, round((bin + 1) / 15.0::DOUBLE, 6) AS hi, n,
        round(mean_pred, 6) AS mean_pred, round(frac_spoof, 6) AS frac_spoof FROM rel""",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d).withColumn("prob", sigmoid(F.col("score") - 4))
    return two(M.reliability(s, ["split"], "label", "prob"), "lo", "hi", "mean_pred", "frac_spoof")


@query(
    "ece",
    f"{RELIABILITY_SQL} SELECT split, round(sum(n * abs(frac_spoof - mean_pred)) / sum(n), 6) AS ece FROM rel GROUP BY split",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d).withColumn("prob", sigmoid(F.col("score") - 4))
    return two(M.ece(M.reliability(s, ["split"], "label", "prob"), ["split"]), "ece")


@query(
    "midranks",
    """SELECT item, split, rank() OVER (PARTITION BY split ORDER BY score)
         + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS midrank FROM fx_scores""",
    ("fx_scores",),
)
def _(spark, d):
    s = stage(fx.scores(spark, d).select("item", "split", "score"))
    return O.midranks(s, ["split"], "score").select("item", "split", "midrank")


@query(
    "metrics_by_bin",
    "WITH b AS (SELECT *, CASE WHEN score > 0 AND score <= 2 THEN 'short' WHEN score > 2 AND score <= 4 THEN 'medium' "
    "WHEN score > 4 AND score <= 7 THEN 'standard' WHEN score > 7 THEN 'long' END AS level FROM fx_scores), "
    + score_points("bp", "b", "split, level", "score_b")
    + f""", a AS (SELECT split, level, {AUC} AS auc FROM bp WHERE pos_total > 0 AND neg_total > 0 AND pos_total + neg_total >= 2 GROUP BY 1, 2)
       SELECT split, level, count(*) AS n, round(avg(score), 6) AS mean_value,
         round(avg((CASE WHEN score_b >= 8 THEN 1 ELSE 0 END = label)::INT), 6) AS accuracy, round(max(auc), 6) AS auc
       FROM b JOIN a USING (split, level) GROUP BY 1, 2""",
    ("fx_scores",),
)
def _(spark, d):
    s = stage(fx.scores(spark, d).select("split", "label", "score", "score_b"))
    level = fixed_cut("score", [0, 2, 4, 7, float("inf")], ["short", "medium", "standard", "long"])
    out = E.metrics_by_level(s.withColumn("level", level), ["split", "level"], "label", "score_b", "score", F.lit(8.0))
    return two(out, "mean_value", "accuracy", "auc")


# ---------------------------------------------------------------- reports
DRAWS = 12
REPORT_DRAWS = score_points(
    "bp", "(SELECT s.split, d.b, s.score, s.label, d.m FROM sr s JOIN drawn d ON s.split = d.split AND s.cluster = d.cluster)",
    "split, b", "score", "sum(label * m)", "sum((1 - label) * m)",
)


def _ci(stat: str, source: str, only: str) -> str:
    ends = (("lo", 0.025), ("hi", 0.975))
    return ", ".join(f"round((SELECT quantile_cont({stat}, {q}) FROM {source} q WHERE q.split = c.split AND {only}), 6) AS {stat}_ci95_{e}" for e, q in ends)


_TWO, _ONE = "tp+fn>0 AND tn+fp>0", "NOT (tp+fn>0 AND tn+fp>0)"


@query(
    "split_report",
    f"""WITH sr AS (SELECT * FROM fx_scores),
      {score_points('sp', 'sr', 'split', 'score')}, {eer_ctes('se', 'sp', 'split')},
      c AS (SELECT split, {COUNTS_SQL.format(p='score >= thr')}, max(thr) AS thr FROM sr, thr GROUP BY split),
      a AS (SELECT split, {AUC} AS auc FROM sp GROUP BY split),
      p AS (SELECT split, {BIN_SQL} AS bin, count(*) AS n, avg(p) AS mp, avg(label) AS fs, sum(pow(p - label, 2)) AS sq
            FROM (SELECT split, label, 1.0::DOUBLE/(1.0::DOUBLE+exp(-score)) AS p FROM sr) GROUP BY 1, 2),
      k AS (SELECT split, sum(sq) / sum(n) AS brier, sum(n * abs(fs - mp)) / sum(n) AS ece FROM p GROUP BY split),
      g AS (SELECT split, count(DISTINCT cluster) AS n_clusters FROM sr GROUP BY split),
      {draws_sql(source='sr', b=DRAWS)}, {REPORT_DRAWS}, ba AS (SELECT split, b, {AUC} AS auc FROM bp GROUP BY split, b),
      {eer_ctes('be', 'bp', 'split, b')},
      x AS (SELECT s.split, d.b, s.label, d.m, CASE WHEN s.score >= thr THEN 1 ELSE 0 END AS p FROM sr s JOIN drawn d ON s.split = d.split AND s.cluster = d.cluster, thr),
      bc AS (SELECT split, b, sum(m * label * p)::DOUBLE AS tp, sum(m * (1 - label) * (1 - p))::DOUBLE AS tn,
          sum(m * (1 - label) * p)::DOUBLE AS fp, sum(m * label * (1 - p))::DOUBLE AS fn FROM x GROUP BY split, b),
      br AS (SELECT split, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp + fp) / (tp + tn + fp + fn) AS frac_pred_spoof,
          (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) * 0.5::DOUBLE AS f1_macro FROM bc)
      SELECT split, {RATES_SQL}, round(thr, 6) AS threshold, round(auc, 6) AS auc, round(eer, 6) AS eer,
        round(CASE WHEN {_TWO} THEN brier END, 6) AS brier, round(CASE WHEN {_TWO} THEN ece END, 6) AS ece, n_clusters,
        round(CASE WHEN {_ONE} THEN (tp + fp)::DOUBLE / (tp + tn + fp + fn) END, 6) AS frac_pred_spoof,
        {_ci('auc', 'ba', _TWO)}, {_ci('eer', 'be', _TWO)}, {_ci('accuracy', 'br', _TWO)}, {_ci('f1_macro', 'br', _TWO)}, {_ci('frac_pred_spoof', 'br', _ONE)}
      FROM c JOIN a USING (split) LEFT JOIN se USING (split) JOIN k USING (split) JOIN g USING (split)""",
    ("thr",),
)
def split_report(spark, d):
    """With intervals, over all items of every split."""
    return E.rounded(E.split_report(fx.scores(spark, d), n_boot=DRAWS))


@query("one_class_report")
def _(spark, d):
    """The same report where a split has one class: its rates of one class and their interval, and no ranking."""
    return E.rounded(E.split_report(fx.scores(spark, d).where("split <> 'external_B' OR label = 1"), n_boot=DRAWS))


ORACLES["one_class_report"] = ORACLES["split_report"].replace(
    "sr AS (SELECT * FROM fx_scores)", "sr AS (SELECT * FROM fx_scores WHERE split <> 'external_B' OR label = 1)"
)

TIERS = {"validation": "Tier 0: validation", "internal_test": "Tier 1: internal", "external_A": "Tier 2: independent", "external_B": "Tier 3: external"}


@query(
    "tier_report",
    f"""WITH a AS (SELECT split, {AUC} AS auc FROM pts GROUP BY split),
      n AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY abs(fnr - fpr), thr DESC) AS rn FROM eers_roc),
      c AS (SELECT split, count(*) AS sample_count, avg((CASE WHEN score >= thr THEN 1 ELSE 0 END = label)::INT) AS acc, max(thr) AS t
            FROM fx_scores, thr GROUP BY split)
      SELECT CASE split WHEN 'validation' THEN 'Tier 0: validation' WHEN 'internal_test' THEN 'Tier 1: internal'
          WHEN 'external_A' THEN 'Tier 2: independent' ELSE 'Tier 3: external' END AS tier,
        round(auc, 4) AS auc, round((fpr + fnr) / 2 * 100, 2) AS eer_pct, round(acc * 100, 2) AS accuracy_pct,
        round(t, 4) AS threshold, sample_count
      FROM c JOIN a USING (split) JOIN n USING (split) WHERE rn = 1 AND split <> 'train'""",
    ("thr", "pts"),
)
def _(spark, d):
    return E.tier_report(fx.scores(spark, d), TIERS)


@query(
    "verdict_bands",
    f"""WITH a AS (SELECT split, {AUC} AS auc, max(pos_total)::DOUBLE / (max(pos_total) + max(neg_total)) AS share FROM pts GROUP BY split)
       SELECT split, CASE WHEN auc > 0.8::DOUBLE THEN 'robust' WHEN auc > 0.7::DOUBLE THEN 'decaying' WHEN auc IS NOT NULL THEN 'sensitive' END AS verdict,
         CASE WHEN abs(share - 0.5) <= 0.05 THEN 'balanced' ELSE 'imbalanced' END AS balance FROM a""",
    ("pts",),
)
def _(spark, d):
    pts = M.score_points(fx.scores(spark, d), ["split"], "label", "score")
    a = pts.groupBy("split").agg(
        M.auc_aggregate().alias("auc"),
        (F.max("pos_total") / (F.max("pos_total") + F.max("neg_total"))).alias("share"),
    )
    return a.select("split", auc_verdict("auc").alias("verdict"), balance_verdict("share").alias("balance"))


# ---------------------------------------------------------------- error groups
def recordings(spark, d):
    """Descriptors and demographics kept apart from the scores; some recordings have none."""
    year = F.year("o_orderdate")
    return fx.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(
        F.col("o_orderkey").alias("item"),
        F.col("o_totalprice").alias("snr_proxy_db"),
        F.when(F.col("o_orderstatus") == "F", "f").when(F.col("o_orderstatus") == "P", "m").otherwise("unknown").alias("gender"),
        F.when(year != 1995, F.concat(F.lit("set"), year)).otherwise("unknown").alias("set_id"),
    )


@query(
    "error_groups",
    """WITH ds AS (SELECT o_orderkey AS item, o_totalprice AS snr, CASE o_orderstatus WHEN 'F' THEN 'f' WHEN 'P' THEN 'm' END AS gender,
        CASE WHEN year(o_orderdate) <> 1995 THEN concat('set', year(o_orderdate)) END AS set_id FROM orders WHERE o_orderkey % 7 <> 0),
      x AS (SELECT fx_scores.*, thr, abs(score - thr) AS confidence, snr, gender, set_id FROM fx_scores LEFT JOIN ds ON ds.item = fx_scores.item, thr WHERE split = 'internal_test'),
      q AS (SELECT quantile_cont(n_windows::DOUBLE, 1/3::DOUBLE) AS d1, quantile_cont(n_windows::DOUBLE, 2/3::DOUBLE) AS d2,
        quantile_cont(snr, 1/3::DOUBLE) AS s1, quantile_cont(snr, 2/3::DOUBLE) AS s2,
        quantile_cont(confidence, 0.2::DOUBLE) AS c1, quantile_cont(confidence, 0.4::DOUBLE) AS c2,
        quantile_cont(confidence, 0.6::DOUBLE) AS c3, quantile_cont(confidence, 0.8::DOUBLE) AS c4 FROM x),
      l AS (
        SELECT 'corpus' AS grouping, dataset_id AS level, label, score, thr FROM x
        UNION ALL SELECT 'speaker', cast(speaker_id AS varchar), label, score, thr FROM x
        UNION ALL SELECT 'duration_tertile', CASE WHEN n_windows <= d1 THEN 'short' WHEN n_windows <= d2 THEN 'medium' ELSE 'long' END, label, score, thr FROM x, q
        UNION ALL SELECT 'gender', gender, label, score, thr FROM x WHERE gender IS NOT NULL
        UNION ALL SELECT 'set', set_id, label, score, thr FROM x WHERE set_id IS NOT NULL
        UNION ALL SELECT 'snr_proxy_tertile', CASE WHEN snr <= s1 THEN 'low' WHEN snr <= s2 THEN 'mid' ELSE 'high' END, label, score, thr FROM x, q WHERE snr IS NOT NULL
        UNION ALL SELECT 'trailing_silence', CASE WHEN max_pad_fraction <= 0.05 THEN '<0.05s' WHEN max_pad_fraction <= 0.08 THEN '0.05-0.08s' ELSE '>0.08s' END, label, score, thr FROM x
        UNION ALL SELECT 'clipping', CASE WHEN max_pad_fraction > 0.09 THEN 'clipped' ELSE 'unclipped' END, label, score, thr FROM x
        UNION ALL SELECT 'confidence_quintile', CASE WHEN confidence <= c1 THEN 'q1 (least)' WHEN confidence <= c2 THEN 'q2'
            WHEN confidence <= c3 THEN 'q3' WHEN confidence <= c4 THEN 'q4' ELSE 'q5 (most)' END, label, score, thr FROM x, q)
      SELECT grouping, level, count(*) AS n, count(*) FILTER (WHERE label=1) AS n_spoof,
        count(*) FILTER (WHERE label=1 AND score<thr) AS fn,
        round(count(*) FILTER (WHERE label=1 AND score<thr)::DOUBLE / nullif(count(*) FILTER (WHERE label=1), 0), 6) AS fnr,
        count(*) FILTER (WHERE label=0) AS n_bonafide, count(*) FILTER (WHERE label=0 AND score>=thr) AS fp,
        round(count(*) FILTER (WHERE label=0 AND score>=thr)::DOUBLE / nullif(count(*) FILTER (WHERE label=0), 0), 6) AS fpr
      FROM l GROUP BY 1, 2""",
    ("thr",),
)
def _(spark, d):
    s = stage(fx.scores(spark, d))
    t = E.with_threshold(s, s.where("split = 'validation'")).where("split = 'internal_test'")
    x = t.join(recordings(spark, d), "item", "left").withColumn("confidence", F.abs(F.col("score") - F.col("threshold")))
    levels = {
        "duration_tertile": (F.col("n_windows"), ["short", "medium", "long"]),
        "snr_proxy_tertile": (F.col("snr_proxy_db"), ["low", "mid", "high"]),
        "confidence_quintile": (F.col("confidence"), ["q1 (least)", "q2", "q3", "q4", "q5 (most)"]),
    }
    x = with_quantile_levels(x, [], levels, drop_duplicates=True)
    groupings = {
        "corpus": F.col("dataset_id"),
        "speaker": F.col("speaker_id").cast("string"),
        "gender": unknown_to_null("gender"),
        "set": unknown_to_null("set_id"),
        "duration_tertile": F.col("duration_tertile"),
        "snr_proxy_tertile": F.col("snr_proxy_tertile"),
        "trailing_silence": fixed_cut("max_pad_fraction", [-1, 0.05, 0.08, 100], ["<0.05s", "0.05-0.08s", ">0.08s"]),
        "clipping": F.when(F.col("max_pad_fraction") > 0.09, "clipped").otherwise("unclipped"),
        "confidence_quintile": F.col("confidence_quintile"),
    }
    return two(error_groups(x, [], "label", "score", "threshold", groupings), "fnr", "fpr")


@query(
    "mann_whitney_u",
    """WITH u AS (SELECT split, 'n_windows' AS descriptor, n_windows::DOUBLE AS v, label, score FROM fx_scores
        UNION ALL SELECT split, 'score_b', score_b, label, score FROM fx_scores
        UNION ALL SELECT split, 'max_pad_fraction', max_pad_fraction, label, score FROM fx_scores),
      f AS (SELECT split, descriptor, v, CASE WHEN score < 4 THEN 1 ELSE 0 END AS g FROM u WHERE label = 1),
      r AS (SELECT *, rank() OVER (PARTITION BY split, descriptor ORDER BY v)
              + (count(*) OVER (PARTITION BY split, descriptor, v) - 1) / 2.0::DOUBLE AS mr,
              count(*) OVER (PARTITION BY split, descriptor, v) AS t FROM f),
      s AS (SELECT split, descriptor, count(*) FILTER (WHERE g=1)::DOUBLE AS n1, count(*) FILTER (WHERE g=0)::DOUBLE AS n2,
              sum(mr) FILTER (WHERE g=1) AS r1, sum(t::DOUBLE * t - 1) AS ties,
              median(v) FILTER (WHERE g=1) AS fn_median, median(v) FILTER (WHERE g=0) AS tp_median FROM r GROUP BY 1, 2),
      z AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s)
      SELECT split, descriptor, cast(n1 AS bigint) AS n_fn, cast(n2 AS bigint) AS n_tp, round(fn_median, 6) AS fn_median,
        round(tp_median, 6) AS tp_median, round(u, 6) AS u,
        round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) /
          sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM z""",
    ("fx_scores",),
)
def _(spark, d):
    s = stage(fx.scores(spark, d))
    t = fn_vs_tp(s, ["split"], "label", "score", F.lit(4.0), ["n_windows", "score_b", "max_pad_fraction"])
    return two(t.drop("mann_whitney_p"), "fn_median", "tp_median", "u", "z")


@query(
    "windows_per_parent",
    """SELECT split, label, count(*) AS n_windows, count(DISTINCT item) AS n_parents,
         round(count(*)::DOUBLE / count(DISTINCT item), 6) AS avg_windows FROM fx_windows GROUP BY 1, 2""",
    ("fx_windows",),
)
def _(spark, d):
    per_item = fx.windows(spark, d).groupBy("split", "label", "item").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("split", "label").agg(
        F.sum("n").alias("n_windows"), F.count(F.lit(1)).alias("n_parents"), r(F.avg("n")).alias("avg_windows")
    )
