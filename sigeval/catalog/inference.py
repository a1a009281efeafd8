"""Queries for bootstrap intervals, paired tests and multiple-testing adjustment."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.registry import AUC, eer_ctes, query, score_points, seed32
from sigeval.functions.columns import p_verdict, run_name
from sigeval.functions.pvalues import normal_two_sided
from sigeval.operators import inference as I
from sigeval.operators import metrics as M
from sigeval.plans import evaluation as E
from sigeval.plans import runs as R
from sigeval.session import stage

B = 12


def draws_sql(cluster: str = "cluster", source: str = "fx_scores", b: int = B, seed: int = 0, keys: str = "split") -> str:
    """CTE `drawn`: (keys, cluster, b, m)."""
    parts = ", ".join(f"cast({k.strip()} AS varchar)" for k in keys.split(","))
    return f"""cl AS (SELECT {keys}, {cluster}, row_number() OVER (PARTITION BY {keys} ORDER BY {cluster}) - 1 AS slot,
        count(*) OVER (PARTITION BY {keys}) AS g FROM (SELECT DISTINCT {keys}, {cluster} FROM {source})),
      pk AS (SELECT {keys}, b, {seed32(f"'{seed}'", parts, 'cast(b AS varchar)', 'cast(slot AS varchar)')} % g AS slot
        FROM cl, (SELECT unnest(range({b})) AS b)),
      drawn AS (SELECT {', '.join('cl.' + k.strip() for k in keys.split(','))}, cl.{cluster}, b, count(*) AS m
        FROM pk JOIN cl USING ({keys}, slot) GROUP BY ALL)"""


def ci_sql(stat: str, source: str, keys: str = "split", cols: str = "lo,hi") -> str:
    return f"""SELECT {keys}, round(quantile_cont({stat}, 0.025), 6) AS {stat}_lo, round(quantile_cont({stat}, 0.975), 6) AS {stat}_hi
      FROM {source} GROUP BY {keys}"""


BOOT_POINTS = score_points(
    "bp", "(SELECT s.split, d.b, s.score, s.label, d.m FROM fx_scores s JOIN drawn d ON s.split = d.split AND s.cluster = d.cluster)",
    "split, b", "score", "sum(label * m)", "sum((1 - label) * m)",
)


def boot_scores(spark, d):
    return stage(fx.scores(spark, d).select("item", "split", "cluster", "label", "score"))


def ci(values, stat, keys=("split",)):
    t = I.percentile_ci(values, list(keys), [stat])
    return t.select(*keys, F.round(f"{stat}_lo", 6).alias(f"{stat}_lo"), F.round(f"{stat}_hi", 6).alias(f"{stat}_hi"))


@query(
    "boot_auc_ci",
    f"WITH {draws_sql()}, {BOOT_POINTS}, a AS (SELECT split, b, {AUC} AS auc FROM bp GROUP BY split, b) {ci_sql('auc', 'a')}",
    ("fx_scores",),
)
def _(spark, d):
    return ci(I.bootstrap_ranking(boot_scores(spark, d), ["split"], "cluster", "label", "score", B), "auc")


@query(
    "boot_eer_ci",
    f"WITH {draws_sql()}, {BOOT_POINTS}, {eer_ctes('be', 'bp', 'split, b')} {ci_sql('eer', 'be')}",
    ("fx_scores",),
)
def _(spark, d):
    return ci(I.bootstrap_ranking(boot_scores(spark, d), ["split"], "cluster", "label", "score", B), "eer")


COUNT_DRAWS = f"""WITH {draws_sql()},
  x AS (SELECT s.split, d.b, s.label, d.m, CASE WHEN s.score >= 4 THEN 1 ELSE 0 END AS p
        FROM fx_scores s JOIN drawn d ON s.split = d.split AND s.cluster = d.cluster),
  c AS (SELECT split, b, sum(m * label * p)::DOUBLE AS tp, sum(m * (1 - label) * (1 - p))::DOUBLE AS tn,
          sum(m * (1 - label) * p)::DOUBLE AS fp, sum(m * label * (1 - p))::DOUBLE AS fn FROM x GROUP BY split, b),
  r AS (SELECT split, b, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp + fp) / (tp + tn + fp + fn) AS frac_pred_spoof,
          (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) * 0.5::DOUBLE AS f1_macro FROM c)"""


def count_draws(spark, d):
    return I.bootstrap_counts(boot_scores(spark, d), ["split"], "cluster", "label", F.col("score") >= 4.0, B)


@query("boot_acc_ci", f"{COUNT_DRAWS} {ci_sql('accuracy', 'r')}", ("fx_scores",))
def _(spark, d):
    return ci(count_draws(spark, d), "accuracy")


@query("boot_f1_ci", f"{COUNT_DRAWS} {ci_sql('f1_macro', 'r')}", ("fx_scores",))
def _(spark, d):
    return ci(count_draws(spark, d), "f1_macro")


ONE = "one AS (SELECT split, cluster, label, score FROM fx_scores WHERE label = 0)"


@query(
    "oneclass_rate",
    f"""WITH {ONE}, {draws_sql(source='one')},
      r AS (SELECT d.split, d.b, sum(m * (score >= 4)::INT)::DOUBLE / sum(m) AS frac FROM one s JOIN drawn d
            ON s.split = d.split AND s.cluster = d.cluster GROUP BY 1, 2),
      q AS (SELECT split, quantile_cont(frac, 0.025) AS lo, quantile_cont(frac, 0.975) AS hi FROM r GROUP BY split)
      SELECT split, count(*) AS n, round(avg((score >= 4)::INT), 6) AS frac_pred_spoof, round(max(lo), 6) AS frac_lo,
        round(max(hi), 6) AS frac_hi, count(DISTINCT cluster) AS n_clusters FROM one JOIN q USING (split) GROUP BY split""",
    ("fx_scores",),
)
def _(spark, d):
    one = stage(fx.scores(spark, d).where("label = 0").select("split", "cluster", "label", "score"))
    hit = F.col("score") >= 4.0
    per = one.groupBy("split", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("h"))
    base = per.groupBy("split").agg(
        F.sum("n").alias("n"),
        F.round(F.sum("h") / F.sum("n"), 6).alias("frac_pred_spoof"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    t = I.percentile_ci(I.bootstrap_counts(one, ["split"], "cluster", "label", hit, B), ["split"], ["frac_pred_spoof"])
    t = t.select("split", F.round("frac_pred_spoof_lo", 6).alias("frac_lo"), F.round("frac_pred_spoof_hi", 6).alias("frac_hi"))
    return base.join(t, "split")


ROW_DRAWS = 1000  # SURVEY D9b
ROW_POINTS = BOOT_POINTS.replace("s.cluster = d.cluster", "s.item = d.item")


@query(
    "boot_row_ci",
    f"""{COUNT_DRAWS.replace(draws_sql(), draws_sql('item', b=ROW_DRAWS)).replace("s.cluster = d.cluster", "s.item = d.item")}, {ROW_POINTS}, a AS (SELECT split, b, {AUC} AS auc FROM bp GROUP BY split, b),
      {eer_ctes('be', 'bp', 'split, b')}
      SELECT split, round(avg(auc), 6) AS auc_mean, round(quantile_cont(auc, 0.025), 6) AS auc_lo, round(quantile_cont(auc, 0.975), 6) AS auc_hi,
        round(avg(eer), 6) AS eer_mean, round(quantile_cont(eer, 0.025), 6) AS eer_lo, round(quantile_cont(eer, 0.975), 6) AS eer_hi,
        round(avg(accuracy), 6) AS accuracy_mean, round(quantile_cont(accuracy, 0.025), 6) AS accuracy_lo, round(quantile_cont(accuracy, 0.975), 6) AS accuracy_hi,
        round(avg(f1_macro), 6) AS f1_macro_mean, round(quantile_cont(f1_macro, 0.025), 6) AS f1_macro_lo, round(quantile_cont(f1_macro, 0.975), 6) AS f1_macro_hi
      FROM a JOIN be USING (split, b) JOIN r USING (split, b) GROUP BY split""",
    ("fx_scores",),
)
def _(spark, d):
    """Rows are their own clusters: intervals of ranking and of decisions at a fixed threshold."""
    s = boot_scores(spark, d)
    draws = stage(I.multiplicities(s, ["split"], "item", ROW_DRAWS, 0))
    ranks = I.percentile_ci(I.bootstrap_ranking(s, ["split"], "item", "label", "score", ROW_DRAWS, draws=draws), ["split"], ["auc", "eer"])
    rates = I.bootstrap_counts(s, ["split"], "item", "label", F.col("score") >= 4.0, ROW_DRAWS, draws=draws)
    rates = I.percentile_ci(rates, ["split"], ["accuracy", "f1_macro"])
    names = [f"{s}_{e}" for s in ("auc", "eer", "accuracy", "f1_macro") for e in ("mean", "lo", "hi")]
    return ranks.join(rates, "split").select("split", *[F.round(c, 6).alias(c) for c in names])


# ---------------------------------------------------------------- paired tests
@query(
    "mcnemar_counts",
    """SELECT split, count(*) FILTER (WHERE a AND NOT b) AS a_right_b_wrong, count(*) FILTER (WHERE NOT a AND b) AS a_wrong_b_right
       FROM (SELECT split, ((score >= 4)::INT = label) AS a, ((score_b >= 8)::INT = label) AS b FROM fx_scores) GROUP BY split""",
    ("fx_scores",),
)
def _(spark, d):
    y = F.col("label")
    a, b = (F.col("score") >= 4).cast("int") == y, (F.col("score_b") >= 8).cast("int") == y
    return I.mcnemar(fx.scores(spark, d), ["split"], a, b).drop("mcnemar_p")


DELONG = """
  x AS (SELECT split, label,
    (rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE
     - rank() OVER (PARTITION BY split, label ORDER BY score) - (count(*) OVER (PARTITION BY split, label, score) - 1) / 2.0::DOUBLE) AS a,
    (rank() OVER (PARTITION BY split ORDER BY score_b) + (count(*) OVER (PARTITION BY split, score_b) - 1) / 2.0::DOUBLE
     - rank() OVER (PARTITION BY split, label ORDER BY score_b) - (count(*) OVER (PARTITION BY split, label, score_b) - 1) / 2.0::DOUBLE) AS b,
    count(*) FILTER (WHERE label = 1) OVER (PARTITION BY split) AS m, count(*) FILTER (WHERE label = 0) OVER (PARTITION BY split) AS n
    FROM fx_scores),
  v AS (SELECT split, label, m, n, CASE WHEN label = 1 THEN a / n ELSE 1 - a / m END AS va, CASE WHEN label = 1 THEN b / n ELSE 1 - b / m END AS vb FROM x),
  g AS (SELECT split, label, max(m) AS m, max(n) AS n, avg(va) AS ma, avg(vb) AS mb, var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb) AS s FROM v GROUP BY 1, 2),
  dl AS (SELECT p.split, p.ma AS auc_a, p.mb AS auc_b, (p.ma - p.mb) / sqrt(p.s / p.m + q.s / q.n) AS z
         FROM g p JOIN g q ON p.split = q.split AND p.label = 1 AND q.label = 0)"""


@query(
    "delong_z",
    f"WITH {DELONG} SELECT split, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(z, 6) AS z FROM dl",
    ("fx_scores",),
)
def _(spark, d):
    s = stage(fx.scores(spark, d).select("split", "label", "score", "score_b"))
    t = I.delong(s, ["split"], "label", "score", "score_b")
    return t.select("split", *[F.round(c, 6).alias(c) for c in ("auc_a", "auc_b", "z")])


LONG = """lg AS (SELECT split, cluster, label, 'a' AS series, score FROM fx_scores
    UNION ALL SELECT split, cluster, label, 'b', score_b FROM fx_scores)"""
PAIR_POINTS = score_points(
    "pp", "(SELECT s.split, s.series, d.b, s.score, s.label, d.m FROM lg s JOIN drawn d ON s.split = d.split AND s.cluster = d.cluster)",
    "split, series, b", "score", "sum(label * m)", "sum((1 - label) * m)",
)


def paired_draws(spark, d, b):
    s = fx.scores(spark, d)
    pairs = F.inline(
        F.array(
            F.struct(F.lit("a").alias("series"), F.col("score").alias("score")),
            F.struct(F.lit("b").alias("series"), F.col("score_b").alias("score")),
        )
    )
    long = stage(s.select("split", "cluster", "label", pairs))
    t = I.bootstrap_ranking(long, ["split"], "cluster", "label", "score", b, series=["series"])
    return I.paired_deltas(t, ["split"], "series", "a", "b", ["auc", "eer"])


@query(
    "boot_delta_auc",
    f"""WITH {draws_sql(b=6)}, {LONG}, {PAIR_POINTS}, a AS (SELECT split, series, b, {AUC} AS auc FROM pp GROUP BY ALL),
      t AS (SELECT split, b, max(auc) FILTER (WHERE series = 'a') - max(auc) FILTER (WHERE series = 'b') AS delta_auc FROM a GROUP BY 1, 2)
      {ci_sql('delta_auc', 't')}""",
    ("fx_scores",),
)
def _(spark, d):
    return ci(paired_draws(spark, d, 6), "delta_auc")


@query(
    "boot_delta_eer",
    f"""WITH {draws_sql(b=6)}, {LONG}, {PAIR_POINTS}, {eer_ctes('be', 'pp', 'split, series, b')},
      t AS (SELECT split, b, max(eer) FILTER (WHERE series = 'a') - max(eer) FILTER (WHERE series = 'b') AS delta_eer FROM be GROUP BY 1, 2)
      {ci_sql('delta_eer', 't')}""",
    ("fx_scores",),
)
def _(spark, d):
    return ci(paired_draws(spark, d, 6), "delta_eer")


@query(
    "prop_ztest",
    """WITH c AS (SELECT split, count(*)::DOUBLE AS n, count(*) FILTER (WHERE (score >= 4)::INT = label)::DOUBLE AS k FROM fx_scores GROUP BY split),
      p AS (SELECT a.split AS split_a, b.split AS split_b, a.k AS ka, a.n AS na, b.k AS kb, b.n AS nb FROM c a JOIN c b ON a.split < b.split)
      SELECT split_a, split_b, round((ka/na - kb/nb) / sqrt((ka+kb)/(na+nb) * (1 - (ka+kb)/(na+nb)) * (1/na + 1/nb)), 6) AS z FROM p""",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d)
    hit = (F.col("score") >= 4).cast("int") == F.col("label")
    c = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("k"))
    a = c.select(F.col("split").alias("split_a"), F.col("n").alias("na"), F.col("k").alias("ka"))
    b = c.select(F.col("split").alias("split_b"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    pairs = a.join(b, F.col("split_a") < F.col("split_b"))  # one row per split on each side
    return pairs.select("split_a", "split_b", F.round(I.proportion_z("ka", "na", "kb", "nb"), 6).alias("z"))


HOLM = """WITH t AS (SELECT protocol, split, model, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM fx_runs GROUP BY 1, 2, 3),
  z AS (SELECT *, CASE WHEN n > 10 THEN round(least(1.0::DOUBLE, exp(-abs(k / n - 0.4::DOUBLE) * sqrt(n))), 9) END AS p FROM t),
  k AS (SELECT *, row_number() OVER (PARTITION BY protocol, split ORDER BY p) - 1 AS rk, count(*) OVER (PARTITION BY protocol, split) AS m FROM z WHERE p IS NOT NULL),
  h AS (SELECT *, max(least(1.0::DOUBLE, (m - rk) * p)) OVER (PARTITION BY protocol, split ORDER BY rk) AS p_holm FROM k)"""


@query(
    "holm_adjust",
    f"""{HOLM} SELECT z.protocol, z.split, z.model, round(z.p, 8) AS p, round(h.p_holm, 8) AS p_holm,
       CASE WHEN h.p_holm < 0.001 THEN 'highly significant' WHEN h.p_holm < 0.05 THEN 'significant' WHEN h.p_holm IS NOT NULL THEN 'not significant' END AS verdict
       FROM z LEFT JOIN h USING (protocol, split, model)""",
    ("fx_runs",),
)
def _(spark, d):
    t = fx.runs(spark, d).groupBy("protocol", "split", "model").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("k")
    )
    p = F.round(F.least(F.lit(1.0), F.exp(-F.abs(F.col("k") / F.col("n") - 0.4) * F.sqrt("n"))), 9)
    t = t.withColumn("p", F.when(F.col("n") > 10, p))
    h = I.holm(t, ["protocol", "split"], "p")
    return h.select(
        "protocol", "split", "model", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"),
        p_verdict("p_holm").alias("verdict"),
    )


def _p_normal(z: str) -> str:
    """Two-sided p of the normal law in SQL, by the series of the error function with positive terms."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    terms = f"list_transform(range(120), lambda k: exp(2 * k * ln(2.0::DOUBLE) + lgamma(k + 1.0::DOUBLE) - lgamma(2.0::DOUBLE * k + 2) + (2 * k + 1) * ln({x})))"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum({terms}) END"


_P_MCNEMAR = """CASE WHEN ab IS NULL THEN NULL WHEN 2 * least(ab, ba) = ab + ba THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(ab, ba) + 1),
  lambda i: exp(lgamma(ab + ba + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(ab + ba - i + 1.0::DOUBLE) - (ab + ba) * ln(2.0::DOUBLE))))) END"""
PAIRED_DOUBLES = (
    "auc_a", "auc_b", "delong_z", "delong_p", "delta_auc", "mcnemar_p", "acc_a", "acc_b", "eer_a", "eer_b", "delta_auc_lo", "delta_auc_hi",
    "delta_eer_lo", "delta_eer_hi", "delong_p_holm",
)
_KEY = "concat_ws('|', protocol, split, run_a, run_b)"
PAIRED_SQL = f"""WITH ms AS (SELECT unnest(['base', 'other', 'blend']) AS model), pt AS (SELECT unnest(['P1', 'P2']) AS protocol),
  rs AS (SELECT concat(model, '__', protocol, '__seed42') AS run, model, protocol, split, item, cluster, label,
      CASE model WHEN 'base' THEN score WHEN 'other' THEN score_b ELSE score + score_b END AS score
    FROM fx_scores, ms, pt WHERE split = 'validation' OR (protocol = 'P1' AND (split = 'internal_test' OR (split = 'external_A' AND label = 1)))
      OR (protocol = 'P2' AND split = 'external_B')),
  rv AS (SELECT * FROM rs WHERE split = 'validation'), {score_points('rp', 'rv', 'run', 'score')}, {eer_ctes('re', 'rp', 'run')},
  cm AS (SELECT protocol, concat(a, '__', protocol, '__seed42') AS run_a, concat(b, '__', protocol, '__seed42') AS run_b
    FROM (VALUES ('base', 'other'), ('base', 'blend'), ('other', 'blend')) t(a, b), pt),
  pl AS (SELECT * FROM cm JOIN (SELECT DISTINCT protocol, split FROM rs WHERE split <> 'validation') USING (protocol)),
  px AS (SELECT {_KEY} AS split, a.item, a.cluster, a.label, a.score, b.score AS score_b, ta.threshold AS thr_a, tb.threshold AS thr_b
    FROM pl JOIN rs a USING (protocol, split) JOIN rs b USING (protocol, split, item) JOIN re ta ON ta.run = run_a JOIN re tb ON tb.run = run_b
    WHERE a.run = run_a AND b.run = run_b),
  pz AS (SELECT * FROM px WHERE split IN (SELECT split FROM px GROUP BY split HAVING count(DISTINCT label) = 2)),
  {DELONG.replace('fx_scores', 'pz')}, {LONG.replace('fx_scores', 'pz')}, {draws_sql(source='pz', b=6)}, {PAIR_POINTS},
  da AS (SELECT split, series, b, {AUC} AS auc FROM pp GROUP BY ALL), {eer_ctes('de', 'pp', 'split, series, b')},
  ta AS (SELECT split, b, max(auc) FILTER (WHERE series = 'a') - max(auc) FILTER (WHERE series = 'b') AS d FROM da GROUP BY 1, 2),
  te AS (SELECT split, b, max(eer) FILTER (WHERE series = 'a') - max(eer) FILTER (WHERE series = 'b') AS d FROM de GROUP BY 1, 2),
  ci AS (SELECT split, quantile_cont(ta.d, 0.025) AS delta_auc_lo, quantile_cont(ta.d, 0.975) AS delta_auc_hi,
      quantile_cont(te.d, 0.025) AS delta_eer_lo, quantile_cont(te.d, 0.975) AS delta_eer_hi FROM ta JOIN te USING (split, b) GROUP BY split),
  {score_points('sp', 'lg', 'split, series', 'score')}, {eer_ctes('se', 'sp', 'split, series')},
  ee AS (SELECT split, max(eer) FILTER (WHERE series = 'a') AS eer_a, max(eer) FILTER (WHERE series = 'b') AS eer_b FROM se GROUP BY split),
  ac AS (SELECT split, count(*) AS n, avg(ra::INT) AS acc_a, avg(rb::INT) AS acc_b, count(*) FILTER (WHERE ra AND NOT rb) AS ab, count(*) FILTER (WHERE NOT ra AND rb) AS ba
    FROM (SELECT split, ((score >= thr_a)::INT = label) AS ra, ((score_b >= thr_b)::INT = label) AS rb FROM pz) GROUP BY split),
  al AS (SELECT pl.*, CASE WHEN run_b LIKE 'blend%' THEN 'placeholder' ELSE 'real' END AS status, n, auc_a, auc_b, z AS delong_z, {_p_normal('z')} AS delong_p,
      auc_a - auc_b AS delta_auc, ab AS a_right_b_wrong, ba AS a_wrong_b_right, {_P_MCNEMAR} AS mcnemar_p, acc_a, acc_b, eer_a, eer_b,
      delta_auc_lo, delta_auc_hi, delta_eer_lo, delta_eer_hi
    FROM pl LEFT JOIN dl ON dl.split = {_KEY.replace('split,', 'pl.split,')} LEFT JOIN ac ON ac.split = dl.split LEFT JOIN ee ON ee.split = dl.split LEFT JOIN ci ON ci.split = dl.split),
  hm AS (SELECT protocol, split, run_a, run_b, max(least(1.0::DOUBLE, (m - rn + 1) * delong_p)) OVER (PARTITION BY protocol, split ORDER BY rn) AS delong_p_holm
    FROM (SELECT *, row_number() OVER (PARTITION BY protocol, split ORDER BY delong_p) AS rn, count(*) OVER (PARTITION BY protocol, split) AS m
      FROM al WHERE delong_p IS NOT NULL))
  SELECT protocol, split, run_a, run_b, status, n, a_right_b_wrong, a_wrong_b_right, {', '.join(f'round({c}, 6) AS {c}' for c in PAIRED_DOUBLES)}
  FROM al LEFT JOIN hm USING (protocol, split, run_a, run_b)"""


@query("paired_table", PAIRED_SQL, ("fx_scores",))
def _(spark, d):
    """Three detectors compared in pairs under two protocols; one split has one class, one detector is a placeholder."""
    s = fx.scores(spark, d).select("item", "split", "cluster", "label", "score", "score_b")
    models = {"base": F.col("score"), "other": F.col("score_b"), "blend": F.col("score") + F.col("score_b")}
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), v.alias("score")) for m, v in models.items()]))
    long = s.select("item", "split", "cluster", "label", each).withColumn("protocol", F.explode(F.array(F.lit("P1"), F.lit("P2"))))
    first = F.col("split").isin("internal_test") | ((F.col("split") == "external_A") & (F.col("label") == 1))
    own = F.when(F.col("protocol") == "P1", first).otherwise(F.col("split") == "external_B")
    runs = stage(long.where((F.col("split") == "validation") | own).withColumn("run", run_name("model", "protocol", F.lit(42))).drop("model"))
    pairs = spark.createDataFrame([("base", "other"), ("base", "blend"), ("other", "blend")], "a string, b string")
    names = runs.select("run").distinct()
    status = names.withColumn("status", F.when(F.col("run").startswith("blend"), "placeholder").otherwise("real"))
    t = E.paired_table(R.comparison_plan(pairs, names, ["P1", "P2"]), runs, status, n_boot=6)
    t = t.withColumns({c: F.round(c, 6) for c in PAIRED_DOUBLES})
    return t.select("protocol", "split", "run_a", "run_b", "status", "n", "a_right_b_wrong", "a_wrong_b_right", *PAIRED_DOUBLES)


REPORT_DRAWS = 1000  # SURVEY X6


def _compact_sql():
    return f"""WITH w AS (SELECT split, item, label, speaker_id AS grp, logit FROM fx_windows),
      s AS (SELECT split, item, min(label) AS label, min(grp) AS grp, avg(logit) AS score FROM w GROUP BY 1, 2),
      {score_points('sp', 's', 'split', 'score')}, {eer_ctes('se', 'sp', 'split')},
      a AS (SELECT split, {AUC} AS auc FROM sp GROUP BY split),
      {draws_sql('grp', 's', b=REPORT_DRAWS)},
      {score_points('bp', '(SELECT s.split, d.b, s.score, s.label, d.m FROM s JOIN drawn d ON s.split = d.split AND s.grp = d.grp)', 'split, b', 'score', 'sum(label * m)', 'sum((1 - label) * m)')},
      ba AS (SELECT split, b, {AUC} AS auc FROM bp GROUP BY split, b),
      q AS (SELECT split, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM ba GROUP BY split)
      SELECT split, count(*) AS n, round(max(auc), 6) AS auc, round(max(eer), 6) AS eer, round(max(lo), 6) AS auc_lo, round(max(hi), 6) AS auc_hi,
        round(avg(((score >= 4)::INT = label)::INT), 6) AS acc,
        round(count(*) FILTER (WHERE score < 4 AND label = 0)::DOUBLE / greatest(count(*) FILTER (WHERE label = 0), 1), 6) AS spec,
        round(count(*) FILTER (WHERE score >= 4 AND label = 1)::DOUBLE / greatest(count(*) FILTER (WHERE label = 1), 1), 6) AS sens
      FROM s JOIN a USING (split) JOIN se USING (split) JOIN q USING (split) GROUP BY split"""


@query("compact_report", _compact_sql(), ("fx_windows",))
def _(spark, d):
    w = fx.windows(spark, d).select("split", "item", "label", F.col("speaker_id").alias("grp"), "logit")
    t = E.compact_report(w, ["split"], "item", "grp", F.lit(4.0), n_boot=REPORT_DRAWS)
    return t.withColumns({c: F.round(c, 6) for c in ("auc", "eer", "auc_lo", "auc_hi", "acc", "spec", "sens")})
