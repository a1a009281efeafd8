"""Queries that fit or apply models, and the spectral feature job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog import signals as SG
from sigeval.catalog.registry import ORACLES, query
from sigeval.functions.columns import stable_seed
from sigeval.operators import audit as A
from sigeval.operators import metrics as M
from sigeval.operators import mixtures as X
from sigeval.operators import probes as P
from sigeval.operators.errors import unpivot
from sigeval.operators.ordering import quantiles
from sigeval.operators import signal as G
from sigeval.operators import spectral as S
from sigeval.operators import sweep as W
from sigeval.session import stage

SMALL = S.Spectrum(rate=20, n_fft=16, hop=8, n_mels=6, n_ceps=4)


def arrays(spark, d, win=SG.WINDOW):
    w = G.segment(SG.signal(spark, d), "trim_repeat", win, frame=SG.WIN, frame_hop=SG.HOP, top_db=SG.TOP)
    return G.window_arrays(w)


@query("spectral_features")
def _(spark, d):
    """All three feature kinds of every window, summarised per channel; windows of ten frames, so that slopes exist."""
    t = S.spectral_features(arrays(spark, d, 72), ["mel", "lfcc", "mfcc"], SMALL)
    cells = t.select("rec", "window", "feature", F.posexplode("values").alias("channel", "m"))
    x = F.flatten("m")
    return cells.select(
        "rec", "window", "feature", "channel", F.size("m").alias("bins"), F.size(F.col("m")[0]).alias("frames"),
        F.array_min(x).alias("lowest"), F.array_max(x).alias("highest"),
    )


LONG, LONG_STEP, FRAMES = 72, 64, 10
MIDDLES = (4, 5)  # frames around which nine frames lie

# power spectra, filterbanks as (filter, bin, weight), and the features (rec, window, feature, bin, t, x)
CEPSTRA = f"""{SG.repeat_ctes(LONG, LONG_STEP)},
  fr AS (SELECT rec, "window", t, pos + 8 - 8 * t AS m, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (pos + 8 - 8 * t) / 16)) AS x
         FROM (SELECT *, unnest(range({FRAMES})) AS t FROM wn) WHERE pos + 8 - 8 * t BETWEEN 0 AND 15),
  pw AS (SELECT rec, "window", t, k, pow(sum(x * cos(2 * pi() * k * m / 16)), 2) + pow(sum(x * sin(2 * pi() * k * m / 16)), 2) AS p
         FROM (SELECT *, unnest(range(9)) AS k FROM fr) GROUP BY 1, 2, 3, 4),
  mb AS (SELECT n, i, k, greatest(0, least((k * 1.25::DOUBLE - i * w) / w, ((i + 2) * w - k * 1.25::DOUBLE) / w)) / w AS weight
         FROM (SELECT n, w, unnest(range(n)) AS i FROM (VALUES (6, 10::DOUBLE / 7), (4, 10::DOUBLE / 5)) AS b(n, w)) f, (SELECT unnest(range(9)) AS k) g),
  lc AS (SELECT i, i * 8 // 5 AS lo, (i + 1) * 8 // 5 AS mid, (i + 2) * 8 // 5 AS hi FROM (SELECT unnest(range(4)) AS i)),
  lb AS (SELECT i, k, CASE WHEN k < lo OR k >= hi THEN 0 WHEN k < mid THEN (k - lo)::DOUBLE / (mid - lo) ELSE (hi - k)::DOUBLE / (hi - mid) END AS weight
         FROM lc, (SELECT unnest(range(9)) AS k) g),
  wide AS (SELECT rec, "window", i, t, 10 * log10(greatest(sum(weight * p), 1e-10::DOUBLE)) AS db FROM pw JOIN mb USING (k) WHERE n = 6 GROUP BY 1, 2, 3, 4),
  logs AS (SELECT 'mfcc' AS feature, rec, "window", i, t, ln(sum(weight * p) + 1e-9::DOUBLE) AS e FROM pw JOIN mb USING (k) WHERE n = 4 GROUP BY 2, 3, 4, 5
           UNION ALL SELECT 'lfcc', rec, "window", i, t, ln(sum(weight * p) + 1e-9::DOUBLE) FROM pw JOIN lb USING (k) GROUP BY 2, 3, 4, 5),
  c0 AS (SELECT 'mel' AS feature, rec, "window", i AS bin, t, greatest(db - max(db) OVER (PARTITION BY rec, "window"), -80) AS x FROM wide
         UNION ALL SELECT feature, rec, "window", j, t, sum(e * sqrt(CASE WHEN j = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) * cos(pi() * j * (2 * i + 1) / 8))
           FROM (SELECT *, unnest(range(4)) AS j FROM logs) GROUP BY 1, 2, 3, 4, 5),
  sk AS (SELECT c, c + j AS t, j / 60::DOUBLE AS w1, (3 * j * j - 20) / 462::DOUBLE AS w2
         FROM (SELECT c, unnest(range(-4, 5)) AS j FROM (SELECT unnest({list(MIDDLES)}) AS c))),
  sl AS (SELECT feature, rec, "window", bin, c, sum(x * w1) AS s1, sum(x * w2) AS s2 FROM c0 JOIN sk USING (t) GROUP BY 1, 2, 3, 4, 5),
  ft AS (SELECT feature, rec, "window", 0 AS channel, bin, t, x FROM c0
         UNION ALL SELECT feature, rec, "window", channel, bin, t, CASE channel WHEN 1 THEN s1 ELSE s2 END
           FROM sl, (SELECT unnest([1, 2]) AS channel) h, (SELECT unnest(range({FRAMES})) AS t) f
           WHERE c = CASE WHEN t <= {MIDDLES[0]} THEN {MIDDLES[0]} ELSE {MIDDLES[1]} END)"""


SPECTRUM = f"""{SG.REPEAT},
  fr AS (SELECT rec, "window", t, pos + 8 - 8 * t AS m, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (pos + 8 - 8 * t) / 16)) AS x
         FROM (SELECT *, unnest(range(3)) AS t FROM wn) WHERE pos + 8 - 8 * t BETWEEN 0 AND 15),
  pw AS (SELECT rec, "window", t, k, pow(sum(x * cos(2 * pi() * k * m / 16)), 2) + pow(sum(x * sin(2 * pi() * k * m / 16)), 2) AS p
         FROM (SELECT *, unnest(range(9)) AS k FROM fr) GROUP BY 1, 2, 3, 4),
  sp AS (SELECT rec, "window", k, k * 1.25::DOUBLE AS f, sum(p) AS p FROM pw GROUP BY 1, 2, 3)"""


@query(
    "spectral_descriptors",
    f"""WITH {SPECTRUM} SELECT rec, "window", round(sum(p) FILTER (WHERE f < 1) / sum(p), 6) AS lf_ratio,
        round(sum(p) FILTER (WHERE f > 6) / sum(p), 6) AS hf_ratio, round(sum(f * p) / sum(p), 6) AS centroid_hz FROM sp GROUP BY 1, 2""",
    ("fx_signal",),
)
def _(spark, d):
    t = S.spectral_descriptors(arrays(spark, d), SMALL, low_hz=1.0, high_hz=6.0)
    return t.select("rec", "window", *[F.round(c, 6).alias(c) for c in ("lf_ratio", "hf_ratio", "centroid_hz")])


def cepstra(spark, d):
    """All kinds of every window of ten frames, in double precision."""
    return S.spectral_features(arrays(spark, d, LONG), ["mel", "lfcc", "mfcc"], SMALL, cell="double")


@query(
    "spectral_values",
    f"""WITH {CEPSTRA} SELECT rec, "window", feature, cast(channel AS integer) AS channel, cast(bin AS integer) AS bin, round(avg(x), 6) + 0.0 AS mean,
        round(max(x) FILTER (WHERE t = 0), 6) + 0.0 AS first, round(max(x) FILTER (WHERE t = {FRAMES - 1}), 6) + 0.0 AS last FROM ft GROUP BY 1, 2, 3, 4, 5""",
    ("fx_signal",),
)
def _(spark, d):
    """Mean over frames, first and last frame of every bin of every feature, its slope and its curvature."""
    rows = cepstra(spark, d).select("rec", "window", "feature", F.posexplode("values").alias("channel", "m"))
    bins = rows.select("rec", "window", "feature", "channel", F.posexplode("m").alias("bin", "x"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    values = {"mean": mean, "first": F.element_at("x", 1), "last": F.element_at("x", -1)}
    return bins.select("rec", "window", "feature", "channel", "bin", *[(F.round(v, 6) + 0.0).alias(c) for c, v in values.items()])


CHANNELS = """chs AS (SELECT feature, channel, avg(x) AS mean, stddev_pop(x) AS std, count(*) AS n_cells, count(DISTINCT (rec, "window")) AS n_windows
  FROM ft WHERE rec % 4 <> 0 GROUP BY 1, 2)"""


@query(
    "channel_norm_stats",
    f"""WITH {CEPSTRA}, {CHANNELS} SELECT feature, cast(channel AS integer) AS channel, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, n_cells, n_windows FROM chs""",
    ("fx_signal",),
)
def _(spark, d):
    """Statistics of each feature's channels over all training windows."""
    t = A.channel_stats(cepstra(spark, d).where("rec % 4 <> 0"), ["feature"], "values")
    return t.withColumns({"mean": F.round("mean", 6) + 0.0, "std": F.round("std", 6)})


@query(
    "channel_normalize",
    f"""WITH {CEPSTRA}, {CHANNELS}, z AS (SELECT rec, "window", feature, channel, (x - mean) / (std + 1e-8::DOUBLE) AS z FROM ft JOIN chs USING (feature, channel))
        SELECT rec, "window", feature, cast(channel AS integer) AS channel, round(avg(z), 5) + 0.0 AS mean, round(min(z), 5) + 0.0 AS lowest,
          round(max(z), 5) + 0.0 AS highest FROM z GROUP BY 1, 2, 3, 4""",
    ("fx_signal",),
)
def _(spark, d):
    """All windows, normalised by the statistics of the training windows; mean and extremes of each channel."""
    t = stage(cepstra(spark, d))
    z = A.channel_normalised(t, ["feature"], "values", A.channel_stats(t.where("rec % 4 <> 0"), ["feature"], "values"))
    rows = z.select("rec", "window", "feature", F.posexplode("z").alias("channel", "m")).withColumn("x", F.flatten("m"))
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")
    values = {"mean": mean, "lowest": F.array_min("x"), "highest": F.array_max("x")}
    return rows.select("rec", "window", "feature", "channel", *[(F.round(v, 5) + 0.0).alias(c) for c, v in values.items()])


SPECTRAL_NAMES = ("lf_ratio", "hf_ratio", "centroid_hz")
TABLE_NAMES = (*SG.DESCRIPTOR_NAMES, *SPECTRAL_NAMES)
TABLE_SQL = f"""SELECT * FROM ({ORACLES['window_descriptors']}) a JOIN ({ORACLES['spectral_descriptors']}) b USING (rec, "window")"""


def window_table(spark, d):
    """All eleven descriptors of every window, from windows cut once."""
    w = stage(G.segment(SG.signal(spark, d), "trim_repeat", SG.WINDOW, frame=SG.WIN, frame_hop=SG.HOP, top_db=SG.TOP))
    levels = G.window_descriptors(w, SG.WIN, SG.HOP, floor_db=-10.0, quiet_db=3.0)
    spectra = S.spectral_descriptors(G.window_arrays(w), SMALL, low_hz=1.0, high_hz=6.0).select("rec", "window", *SPECTRAL_NAMES)
    return SG.rnd(levels.join(spectra, ["rec", "window"]), *TABLE_NAMES)


@query("window_descriptor_table", TABLE_SQL)
def _(spark, d):
    return window_table(spark, d)


@query(
    "window_table_medians",
    f"SELECT rec % 3 AS dataset_id, rec % 2 AS label, {', '.join(f'round(median({c}), 5) AS {c}' for c in TABLE_NAMES)} FROM ({TABLE_SQL}) GROUP BY 1, 2",
)
def _(spark, d):
    t = window_table(spark, d).withColumns({"dataset_id": F.col("rec") % 3, "label": F.col("rec") % 2})
    long = stage(unpivot(t, ["dataset_id", "label"], TABLE_NAMES))
    q = quantiles(long, ["dataset_id", "label", "descriptor"], "value", {"median": 0.5})
    wide = q.groupBy("dataset_id", "label").pivot("descriptor", list(TABLE_NAMES)).agg(F.first("median"))
    return SG.rnd(wide, *TABLE_NAMES, digits=5)


def vectors(spark, d):
    h = stable_seed("item") % 10
    split = F.when(h < 6, "train").when(h < 8, "validation").otherwise("test")
    return fx.vectors(spark, d).select("item", "embedding", F.col("binary").alias("label"), split.alias("split"))


def ranked(df, keys, score="logit"):
    return M.auc_eer(M.score_points(df, keys, "label", score), keys, score).drop("eer_threshold")


@query("linear_probe")
def _(spark, d):
    v = stage(vectors(spark, d))
    return ranked(stage(P.linear_probe(v.where("split = 'train'"), v, "embedding")), ["split"])


@query("gmm_llr")
def _(spark, d):
    v = stage(vectors(spark, d))
    models = P.fit_mixtures(v.where("split = 'train'"), "embedding", "label", components=4, iterations=4)
    return ranked(stage(P.mixture_llr(v, "embedding", models).select("item", "label", "split", "logit")), ["split"])


@query("gmm_frames")
def _(spark, d):
    """Two mixtures of 256 components over all cepstral frames of the training recordings; mean ratio of each recording."""
    h = stable_seed("rec") % 10
    f = S.frame_vectors(S.spectral_features(arrays(spark, d, LONG), ["lfcc"], SMALL, cell="double"))
    split = F.when(h < 6, "train").when(h < 8, "validation").otherwise("test")
    f = stage(f.select("rec", (F.col("rec") % 2).cast("int").alias("label"), split.alias("split"), "x"))
    fitted = X.fit(f.where("split = 'train'"), "x", "label")
    return X.item_ratio(f, ["rec", "label", "split"], "x", fitted.models)


@query(
    "score_windows",
    "SELECT vec_id AS item, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(range(64), lambda j: (j - 31.5)::DOUBLE / 64)), 5) AS logit FROM embeddings",
)
def _(spark, d):
    weights = (np.arange(64) - 31.5) / 64
    t = P.score_windows(fx.vectors(spark, d), "embedding", lambda x: x.astype(float) @ weights)
    return t.select("item", F.round("logit", 5).alias("logit"))


@query("shortcut_probe")
def _(spark, d):
    s = fx.scores(spark, d).select("split", "label", "n_windows", "max_pad_fraction", "score_b", F.lit(1.0).alias("sample_rate"))
    groups = {"duration": ["n_windows"], "padding": ["max_pad_fraction"], "loudness": ["score_b"], "rate": ["sample_rate"]}
    return P.shortcut_probes(s, groups, trees=3)


@query("stats_baseline")
def _(spark, d):
    """Boosted trees on window descriptors, mean log-odds per recording, report per split."""
    x = SG.descriptors(spark, d).na.drop()
    h = stable_seed("rec") % 10
    x = stage(x.withColumns({"label": (F.col("rec") % 2).cast("int"), "split": F.when(h < 6, "train").when(h < 8, "validation").otherwise("test")}))
    scored = P.tree_probe(x.where("split = 'train'"), x, SG.DESCRIPTOR_NAMES, trees=5)
    pooled = M.pool_scores(scored, "rec", first=("label", "split"))
    return ranked(stage(pooled), ["split"], "score")


@query("perturb_scores")
def _(spark, d):
    """The whole sweep: perturb every signal, window it, score it, and compare with clean."""
    sig = SG.signal(spark, d)
    return sweep_summary(sig, ["clean", "clip_+40dB", "add_dc_neg", "remove_dc", "trim_trailing", "noise_snr10"])


def sweep_summary(sig, conditions):
    from sigeval.plans.sweep import condition_scores

    scaled = stage(sig.withColumn("v", F.col("v") / 500))
    scores = condition_scores(
        scaled.select("rec", "i", "v"), scaled.select("rec", "label").distinct(), conditions, score=lambda x: np.abs(x).mean(axis=1),
        scheme="trim_repeat", win=SG.WINDOW, frame=SG.WIN, frame_hop=SG.HOP, top_db=SG.TOP, rate=20,
    )
    return W.robustness_summary(stage(scores.withColumn("split", F.lit("all"))), ["split"], "rec", F.lit(0.2))
