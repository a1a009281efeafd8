"""Queries on long-format signals: frames, trimming, windows, descriptors and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.registry import normal, query
from sigeval.functions import columns as C
from sigeval.operators import signal as G
from sigeval.operators import sweep as W
from sigeval.session import stage

WIN, HOP, WINDOW, STEP, TOP = 8, 4, 20, 18, 10.0


def signal(spark, d):
    """The signals, staged once: every signal query reads them several times."""
    return stage(fx.signal(spark, d))


def rnd(df, *names, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def frames_sql(source: str, keys: str = "rec", index: str = "i", win: int = WIN, hop: int = HOP, n: str = "n") -> str:
    return f"""(SELECT {keys}, frame, 10 * log10(sum(v * v) / {win} + 1e-12::DOUBLE) AS e FROM (
        SELECT {keys}, v, unnest(range(greatest(0, ceil(({index} - {win - 1}) / {hop}.0)::BIGINT), floor({index} / {hop}.0)::BIGINT + 1)) AS frame FROM {source})
      GROUP BY {keys}, frame HAVING count(*) = {win})"""


# length, frame energies and active range of each signal; v scaled to peak 1 in `sn`
LEN = "ln AS (SELECT rec, count(*) AS n, max(abs(v)) AS peak, avg(v) AS mean, avg(v * v) AS power FROM fx_signal GROUP BY rec)"


def bounds_ctes(source: str, p: str = "") -> str:
    return f"""{p}en AS (SELECT * FROM {frames_sql(source)}),
      {p}ac AS (SELECT rec, min(frame) FILTER (WHERE e > top - {TOP}) AS f0, max(frame) FILTER (WHERE e > top - {TOP}) AS f1, max(frame) AS fl,
               avg((e > top - {TOP})::INT) AS activity FROM (SELECT *, max(e) OVER (PARTITION BY rec) AS top FROM {p}en) GROUP BY rec),
      {p}bd AS (SELECT rec, n, CASE WHEN f0 IS NULL OR n <= {WIN} THEN 0 ELSE f0 * {HOP} END AS s,
               CASE WHEN f0 IS NULL OR n <= {WIN} THEN n ELSE least(n, f1 * {HOP} + {WIN}) END AS t,
               CASE WHEN f0 IS NULL OR n <= {WIN} OR f1 = fl THEN n ELSE least(n, f1 * {HOP} + {WIN}) END AS tt FROM ln LEFT JOIN {p}ac USING (rec))"""


@query("frame_energy", f"SELECT rec, frame, round(e, 6) AS energy_db FROM {frames_sql('fx_signal')}", ("fx_signal",))
def _(spark, d):
    return rnd(G.frame_energy(signal(spark, d), WIN, HOP), "energy_db")


@query("trim_bounds", f"WITH {LEN}, {bounds_ctes('fx_signal')} SELECT rec, n, s AS start, t AS \"end\" FROM bd", ("fx_signal",))
def _(spark, d):
    return G.trim_bounds(signal(spark, d), WIN, HOP, TOP)


@query("trim_trailing", f"WITH {LEN}, {bounds_ctes('fx_signal')} SELECT rec, n, cast(0 AS bigint) AS start, tt AS \"end\" FROM bd", ("fx_signal",))
def _(spark, d):
    return G.trim_bounds(signal(spark, d), WIN, HOP, TOP, trailing_only=True)


ORIGINAL = f"""{LEN},
  wo AS (SELECT rec, unnest(CASE WHEN n <= {WINDOW} THEN [0] ELSE range(0, (n - {WINDOW}) // {STEP} + 1) END) AS w, n FROM ln),
  wr AS (SELECT wo.rec, w AS "window", w * {STEP} AS start, CASE WHEN n <= {WINDOW} THEN 1.0::DOUBLE - n / {WINDOW}.0::DOUBLE ELSE 0.0 END AS pad_fraction,
           pos, coalesce(v / nullif(peak, 0), v, 0.0) AS v FROM (SELECT wo.*, unnest(range({WINDOW})) AS pos FROM wo) wo
         LEFT JOIN (SELECT rec, i, v FROM fx_signal) s ON s.rec = wo.rec AND s.i = w * {STEP} + pos JOIN (SELECT rec, peak FROM ln) k ON k.rec = wo.rec),
  wn AS (SELECT *, max(abs(v)) OVER (PARTITION BY rec, "window") AS m FROM wr)"""


@query(
    "windows_original",
    f"""WITH {ORIGINAL} SELECT rec, "window", start, round(pad_fraction, 6) AS pad_fraction, pos, round(CASE WHEN m > 0 THEN v / m ELSE v END, 6) AS v FROM wn""",
    ("fx_signal",),
)
def _(spark, d):
    return rnd(G.segment(signal(spark, d), "original", WINDOW), "pad_fraction", "v")


def repeat_ctes(window: int = WINDOW, step: int = STEP) -> str:
    """Windows of the trimmed signals as `wn`, the last one ending with its signal."""
    return f"""{LEN}, sn AS (SELECT s.rec, i, CASE WHEN peak > 0 THEN v / peak ELSE v END AS v FROM fx_signal s JOIN ln USING (rec)),
  {bounds_ctes('sn')},
  tr AS (SELECT sn.rec, i - s AS i, v, t - s AS n FROM sn JOIN bd USING (rec) WHERE i >= s AND i < t),
  tl AS (SELECT rec, t - s AS n FROM bd),
  st AS (SELECT rec, n, unnest(CASE WHEN n <= {window} THEN [0] ELSE list_distinct(list_concat(list_transform(range(0, (n - {window}) // {step} + 1), lambda x: x * {step}), [n - {window}])) END) AS start FROM tl),
  wx AS (SELECT rec, n, start, row_number() OVER (PARTITION BY rec ORDER BY start) - 1 AS w FROM st),
  wr AS (SELECT x.rec, w AS "window", start, CASE WHEN n <= {window} THEN 1.0::DOUBLE - n / {window}.0::DOUBLE ELSE 0.0 END AS pad_fraction, pos, v
         FROM (SELECT *, unnest(range({window})) AS pos FROM wx) x JOIN (SELECT rec, i, v FROM tr) s ON s.rec = x.rec AND s.i = CASE WHEN n <= {window} THEN pos % n ELSE start + pos END),
  wm AS (SELECT *, max(abs(v)) OVER (PARTITION BY rec, "window") AS m FROM wr),
  wn AS (SELECT * REPLACE (CASE WHEN m > 0 THEN v / m ELSE v END AS v) FROM wm)"""


REPEAT = repeat_ctes()


@query(
    "windows_repeat",
    f"""WITH {REPEAT} SELECT rec, "window", start, round(pad_fraction, 6) AS pad_fraction, pos, round(v, 6) AS v FROM wn""",
    ("fx_signal",),
)
def _(spark, d):
    w = G.segment(signal(spark, d), "trim_repeat", WINDOW, frame=WIN, frame_hop=HOP, top_db=TOP)
    return rnd(w, "pad_fraction", "v")


CONTROLLED = f"""{REPEAT}, wc AS (SELECT rec, "window", start, pad_fraction, pos, v - avg(v) OVER (PARTITION BY rec, "window")
   + 0.001::DOUBLE * {normal("'0'", 'cast(rec AS varchar)', 'cast("window" AS varchar)', 'cast(pos AS varchar)')} AS v FROM wn)"""


@query(
    "windows_controlled",
    f"""WITH {CONTROLLED} SELECT rec, "window", start, round(pad_fraction, 6) AS pad_fraction, pos, round(v, 6) AS v FROM wc""",
    ("fx_signal",),
)
def _(spark, d):
    w = G.segment(signal(spark, d), "controlled", WINDOW, frame=WIN, frame_hop=HOP, top_db=TOP)
    return rnd(w, "pad_fraction", "v")


@query(
    "signal_descriptors",
    f"""WITH {LEN}, {bounds_ctes('fx_signal')},
      z AS (SELECT a.rec, avg((sign(a.v - mean) * sign(b.v - mean) < 0)::INT) AS zcr FROM fx_signal a JOIN fx_signal b ON a.rec = b.rec AND b.i = a.i + 1
            JOIN ln ON ln.rec = a.rec GROUP BY 1),
      s AS (SELECT rec, max(e) - min(e) AS snr FROM en GROUP BY rec),
      b AS (SELECT rec, count(*) AS n, max(abs(v)) AS pk, avg((abs(v) >= 0.999::DOUBLE * 100)::INT) AS cr, avg((v = 0)::INT) AS zr, avg(v) AS dc,
              10 * log10(avg(v * v) + 1e-12::DOUBLE) AS rms FROM fx_signal GROUP BY rec)
      SELECT rec, b.n AS n, pk AS peak_abs, round(cr, 6) AS clip_ratio, round(zr, 6) AS exact_zero_ratio, round(dc, 6) AS dc_offset, round(rms, 6) AS rms_dbfs,
        s AS leading_silence, b.n - t AS trailing_silence, round(activity, 6) AS activity_ratio, round(snr, 6) AS snr_proxy_db, round(zcr, 6) AS zcr
      FROM b JOIN bd USING (rec) LEFT JOIN ac USING (rec) LEFT JOIN s USING (rec) LEFT JOIN z USING (rec)""",
    ("fx_signal",),
)
def _(spark, d):
    t = G.signal_descriptors(signal(spark, d), WIN, HOP, TOP, full_scale=100.0)
    return rnd(t, "clip_ratio", "exact_zero_ratio", "dc_offset", "rms_dbfs", "activity_ratio", "snr_proxy_db", "zcr")


WINDOW_FRAMES = frames_sql("wn", 'rec, "window"', "pos")
DESCRIPTORS = f"""{REPEAT}, fe AS (SELECT *, max(e) OVER (PARTITION BY rec, "window") AS top FROM {WINDOW_FRAMES}),
  fd AS (SELECT rec, "window", count(*) AS f, avg((e <= -10)::INT) AS floor_frame_ratio, min(frame) FILTER (WHERE e > -10) AS a, max(frame) FILTER (WHERE e > -10) AS b,
           avg((e < top - 3)::INT) AS quiet_frame_ratio, quantile_cont(e, 0.1::DOUBLE) AS noise_floor_db FROM fe GROUP BY 1, 2),
  sd AS (SELECT rec, "window", max(pad_fraction) AS pad_fraction, avg(v) AS dc, avg((abs(v) >= 0.999::DOUBLE)::INT) AS clip_ratio FROM wn GROUP BY 1, 2),
  wd AS (SELECT rec, "window", pad_fraction, floor_frame_ratio, coalesce(a, f)::DOUBLE / f AS lead_floor_frac, (f - 1 - coalesce(b, -1))::DOUBLE / f AS trail_floor_frac,
           quiet_frame_ratio, noise_floor_db, dc, clip_ratio FROM sd LEFT JOIN fd USING (rec, "window"))"""
DESCRIPTOR_NAMES = (
    "pad_fraction", "floor_frame_ratio", "lead_floor_frac", "trail_floor_frac", "quiet_frame_ratio", "noise_floor_db", "dc", "clip_ratio",
)


def descriptors(spark, d):
    w = stage(G.segment(signal(spark, d), "trim_repeat", WINDOW, frame=WIN, frame_hop=HOP, top_db=TOP))
    return G.window_descriptors(w, WIN, HOP, floor_db=-10.0, quiet_db=3.0)


@query(
    "window_descriptors",
    f"""WITH {DESCRIPTORS} SELECT rec, "window", {', '.join(f'round({c}, 6) AS {c}' for c in DESCRIPTOR_NAMES)} FROM wd""",
    ("fx_signal",),
)
def _(spark, d):
    return rnd(descriptors(spark, d), *DESCRIPTOR_NAMES)


@query(
    "window_medians",
    f"""WITH {DESCRIPTORS} SELECT rec % 3 AS dataset_id, rec % 2 AS label, {', '.join(f'round(median({c}), 6) AS {c}' for c in DESCRIPTOR_NAMES)} FROM wd GROUP BY 1, 2""",
    ("fx_signal",),
)
def _(spark, d):
    from sigeval.operators.errors import unpivot
    from sigeval.operators.ordering import quantiles

    t = descriptors(spark, d).withColumns({"dataset_id": F.col("rec") % 3, "label": F.col("rec") % 2})
    long = stage(unpivot(t, ["dataset_id", "label"], DESCRIPTOR_NAMES))
    q = quantiles(long, ["dataset_id", "label", "descriptor"], "value", {"median": 0.5})
    wide = q.groupBy("dataset_id", "label").pivot("descriptor", list(DESCRIPTOR_NAMES)).agg(F.first("median"))
    return rnd(wide, *DESCRIPTOR_NAMES)


@query(
    "array_conditioning",
    f"""WITH {ORIGINAL}, a AS (SELECT rec, "window", list(v ORDER BY pos) AS x, max(abs(v)) AS pk, avg(v) AS m FROM wr GROUP BY 1, 2)
      SELECT rec, "window", round(list_sum(list_transform(x, lambda v: v / pk)), 6) AS peak_sum, round(list_sum(list_transform(x, lambda v: abs(v - m))), 6) AS centred_sum,
        round(list_sum(list_slice(list_concat(x, x, x), 1, 50)), 6) AS tiled_sum, round(list_sum(list_slice(x, 5, 16)), 6) AS cropped_sum, round(list_sum(x), 6) AS padded_sum,
        cast(27 AS bigint) AS appended FROM a""",
    ("fx_signal",),
)
def _(spark, d):
    a = G.window_arrays(G.cut_windows(G.scale_to_peak(signal(spark, d)), WINDOW)).withColumnRenamed("samples", "x")

    def total(x):
        return F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 6)

    return a.select(
        "rec",
        "window",
        total(C.peak_normalise("x")).alias("peak_sum"),
        total(F.transform(C.remove_mean("x"), lambda v: F.abs(v))).alias("centred_sum"),
        total(C.tile_to("x", 50)).alias("tiled_sum"),
        total(C.pad_or_crop("x", 12)).alias("cropped_sum"),
        total(C.pad_or_crop("x", 30)).alias("padded_sum"),
        F.size(C.append_zeros("x", 7)).cast("long").alias("appended"),
    )


@query(
    "input_difference",
    f"""WITH {REPEAT}, wa AS (SELECT rec, "window", pos, v FROM wn),
      r2 AS (SELECT rec, "window", pos, v - avg(v) OVER (PARTITION BY rec, "window") AS v FROM wn WHERE NOT (rec % 5 = 0 AND "window" = 0))
      SELECT rec, CASE WHEN max((b.v IS NULL)::INT) = 1 THEN NULL ELSE round(max(abs(a.v - b.v)), 6) END AS input_max_abs_diff
      FROM wa a LEFT JOIN r2 b USING (rec, "window", pos) GROUP BY rec""",
    ("fx_signal",),
)
def _(spark, d):
    w = stage(G.segment(signal(spark, d), "trim_repeat", WINDOW, frame=WIN, frame_hop=HOP, top_db=TOP))
    a = G.window_arrays(w)
    b = G.window_arrays(G.condition_windows(w, None)).where("NOT (rec % 5 = 0 AND window = 0)")
    t = G.input_difference(a, b)
    x = F.col("input_max_abs_diff")
    return t.select("rec", F.round(F.when(x != float("inf"), x), 6).alias("input_max_abs_diff"))


@query(
    "perturb_sweep",
    f"""WITH {LEN}, {bounds_ctes('fx_signal')}, x AS (SELECT s.rec, i, v / 100 AS v, n, peak / 100 AS peak, mean / 100 AS mean, tt FROM fx_signal s JOIN ln USING (rec) JOIN (SELECT rec, tt FROM bd) q USING (rec))
      SELECT rec, 'clean' AS condition, i, round(v, 8) AS v FROM x
      UNION ALL SELECT rec, 'clip_+6dB', i, round(greatest(least(v, pow(10, -6 / 20.0::DOUBLE)), -pow(10, -6 / 20.0::DOUBLE)), 8) FROM x
      UNION ALL SELECT rec, 'append_silence_0.44', i, round(v, 8) FROM x
      UNION ALL SELECT rec, 'append_silence_0.44', unnest(range(n, n + 4)), 0.0 FROM ln
      UNION ALL SELECT rec, 'trim_trailing', i, round(v, 8) FROM x WHERE i < tt
      UNION ALL SELECT rec, 'add_dc_neg', i, round(v - 0.001::DOUBLE * peak, 8) FROM x
      UNION ALL SELECT rec, 'remove_dc', i, round(v - mean, 8) FROM x""",
    ("fx_signal",),
)
def _(spark, d):
    s = stage(fx.signal(spark, d).select("rec", "i", (F.col("v") / 100).alias("v")))
    conditions = ["clean", "clip_+6dB", "append_silence_0.44", "trim_trailing", "add_dc_neg", "remove_dc"]
    return rnd(W.perturb(s, conditions, rate=10, frame=WIN, hop=HOP, top_db=TOP), "v", digits=8)


def _noise(name: str) -> str:
    return normal("'0'", "cast(rec AS varchar)", f"'{name}'", "cast(i AS varchar)")


@query(
    "perturb_noise",
    f"""WITH {LEN} SELECT rec, 'noise_snr20' AS condition, i, round(v + {_noise('noise_snr20')} * sqrt((power + 1e-12::DOUBLE) / 100.0::DOUBLE), 6) AS v FROM fx_signal JOIN ln USING (rec)
      UNION ALL SELECT rec, 'noise_snr5', i, round(v + {_noise('noise_snr5')} * sqrt((power + 1e-12::DOUBLE) / pow(10, 0.5::DOUBLE)), 6) FROM fx_signal JOIN ln USING (rec)
      UNION ALL SELECT rec, 'dither_-60dBFS', i, round(v + 0.001::DOUBLE * {_noise('dither_-60dBFS')}, 6) FROM fx_signal""",
    ("fx_signal",),
)
def _(spark, d):
    return rnd(W.perturb(signal(spark, d), ["noise_snr20", "noise_snr5", "dither_-60dBFS"]), "v")


@query(
    "perturb_speed",
    f"""WITH {LEN}, j AS (SELECT rec, n, unnest(range(0, floor((n - 1) / 1.05::DOUBLE)::BIGINT + 2)) AS i FROM ln),
      p AS (SELECT rec, n, i, i * 1.05::DOUBLE AS pt, floor(i * 1.05::DOUBLE)::BIGINT AS k FROM j WHERE i * 1.05::DOUBLE <= n - 1)
      SELECT p.rec, 'speed_1.05' AS condition, p.i, round(a.v + (pt - k) * coalesce(b.v - a.v, 0), 6) AS v FROM p JOIN fx_signal a ON a.rec = p.rec AND a.i = k
      LEFT JOIN fx_signal b ON b.rec = p.rec AND b.i = k + 1""",
    ("fx_signal",),
)
def _(spark, d):
    return rnd(W.perturb(signal(spark, d), ["speed_1.05"]), "v")


@query(
    "perturb_reverb",
    f"""WITH h0 AS (SELECT rec, k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE {normal("'0'", "cast(rec AS varchar)", "'reverb_rt0.3'", "cast(k AS varchar)")}
        * pow(10.0::DOUBLE, -3.0::DOUBLE * k / 30) END AS h FROM (SELECT DISTINCT rec FROM fx_signal), (SELECT unnest(range(30)) AS k)),
      hn AS (SELECT rec, k, h / sqrt(sum(h * h) OVER (PARTITION BY rec)) AS h FROM h0),
      y AS (SELECT s.rec, s.i + k AS i, sum(v * h) AS y FROM fx_signal s JOIN hn ON s.rec = hn.rec GROUP BY 1, 2),
      n AS (SELECT rec, count(*) AS n, max(abs(v)) AS peak FROM fx_signal GROUP BY rec),
      z AS (SELECT y.rec, i, y, peak, max(abs(y)) OVER (PARTITION BY y.rec) AS top FROM y JOIN n ON y.rec = n.rec WHERE i < n)
      SELECT rec, 'reverb_rt0.3' AS condition, i, round(y / top * peak, 5) AS v FROM z""",
    ("fx_signal",),
)
def _(spark, d):
    return rnd(W.perturb(signal(spark, d), ["reverb_rt0.3"], rate=100), "v", digits=5)
