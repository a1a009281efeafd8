import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigeval.operators import signal as G
from sigeval.operators import spectral as S
from sigeval.operators import sweep as W

WIN, HOP, FRAME, FHOP, TOP = 20, 18, 8, 4, 20.0


def arrays():
    rng = np.random.default_rng(0)
    out = {}
    for rec, (lead, body, trail) in enumerate([(0, 5, 0), (0, 20, 0), (9, 61, 13), (0, 57, 0), (30, 8, 3), (0, 7, 0), (0, 200, 31)]):
        out[rec] = np.r_[np.full(lead, 1e-4), rng.normal(size=body), np.full(trail, 1e-4)]
    out[90] = np.zeros(33)
    return out


def frame(spark, data):
    rows = [(int(r), int(i), float(v)) for r, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec long, i long, v double").repartition(5)


def peak(x):
    p = np.max(np.abs(x)) if len(x) else 0
    return x / p if p > 0 else x


def energies(x):
    n = 1 + (len(x) - FRAME) // FHOP
    return np.array([10 * np.log10(np.mean(x[f * FHOP : f * FHOP + FRAME] ** 2) + 1e-12) for f in range(n)])


def trimmed(x):
    if len(x) <= FRAME:
        return x
    on = np.nonzero(energies(x) > energies(x).max() - TOP)[0]
    return x[on[0] * FHOP : min(len(x), on[-1] * FHOP + FRAME)]


def windows(x, repeat):
    x = trimmed(peak(x)) if repeat else peak(x)
    if len(x) <= WIN:
        full = np.tile(x, WIN)[:WIN] if repeat else np.r_[x, np.zeros(WIN - len(x))]
        return [(0, 1 - len(x) / WIN, peak(full))]
    starts = list(range(0, len(x) - WIN + 1, HOP))
    if repeat and starts[-1] + WIN < len(x):
        starts.append(len(x) - WIN)
    return [(s, 0.0, peak(x[s : s + WIN])) for s in starts]


@pytest.mark.parametrize("scheme,repeat", [("original", False), ("trim_repeat", True)])
def test_segments_match_plain_slicing(spark, scheme, repeat):
    data = arrays()
    w = G.window_arrays(G.segment(frame(spark, data), scheme, WIN, 0.1, FRAME, FHOP, TOP)).toPandas()
    for rec, x in data.items():
        g = w[w.rec == rec].sort_values("window")
        want = windows(x, repeat)
        assert list(g["window"]) == list(range(len(want)))
        for (_, row), (start, pad, samples) in zip(g.iterrows(), want):
            assert row["start"] == start and row["pad_fraction"] == pytest.approx(pad)
            np.testing.assert_allclose(row["samples"], samples, atol=1e-12)


def test_controlled_is_reproducible_and_centred(spark):
    sig = frame(spark, arrays())
    one, two = (G.segment(sig.repartition(p), "controlled", WIN, 0.1, FRAME, FHOP, TOP).toPandas().sort_values(["rec", "window", "pos"]) for p in (1, 6))
    np.testing.assert_array_equal(one["v"], two["v"])
    assert one.groupby(["rec", "window"])["v"].mean().abs().max() < 2e-3


def test_unknown_scheme(spark):
    with pytest.raises(ValueError):
        G.segment(frame(spark, arrays()), "other", WIN)


def test_trailing_trim(spark):
    data = arrays()
    b = G.trim_bounds(frame(spark, data), FRAME, FHOP, TOP, trailing_only=True).toPandas().set_index("rec")
    for rec, x in data.items():
        end = len(x)
        if len(x) > FRAME:
            e = energies(x)
            last = np.nonzero(e > e.max() - TOP)[0][-1]
            end = len(x) if last == len(e) - 1 else last * FHOP + FRAME
        assert b.loc[rec, "end"] == end and b.loc[rec, "start"] == 0


def test_speed_and_reverb(spark):
    data = arrays()
    sig = frame(spark, data)
    y = W.change_speed(sig, 1.05).toPandas()
    for rec, x in data.items():
        got = y[y.rec == rec].sort_values("i")["v"].to_numpy()
        at = np.arange(len(got)) * 1.05
        assert at[-1] <= len(x) - 1 < at[-1] + 1.05
        np.testing.assert_allclose(got, np.interp(at, np.arange(len(x)), x), atol=1e-12)
    z = W.reverberate(sig, 0.3, rate=100, seed=4, block=16).toPandas()
    rooms = {r.rec: r.room for r in sig.select("rec").distinct().withColumn("room", W.room_response(0.3, 100, 4)).collect()}
    assert len({tuple(r.h) for r in rooms.values()}) == len(data)  # a room of its own for each recording
    for rec, x in data.items():
        h = np.array(rooms[rec].h)
        assert h[0] == 1.0 and len(h) == 30 and rooms[rec].norm == pytest.approx(np.sqrt(h @ h))
        want = np.convolve(x, h)[: len(x)]
        want = want * (np.abs(x).max() / max(np.abs(want).max(), 1e-300))  # silence stays silent
        np.testing.assert_allclose(z[z.rec == rec].sort_values("i")["v"], want, atol=1e-9)


def test_input_difference_counts_windows(spark):
    sig = frame(spark, arrays())
    a = G.window_arrays(G.segment(sig, "original", WIN))
    same = {r["rec"]: r["input_max_abs_diff"] for r in G.input_difference(a, a).collect()}
    assert set(same.values()) == {0.0}
    less = {r["rec"]: r["input_max_abs_diff"] for r in G.input_difference(a, a.where("NOT (rec = 6 AND window = 1)")).collect()}
    assert less[6] == float("inf") and less[1] == 0.0


def test_unknown_condition(spark):
    with pytest.raises(ValueError):
        W.perturb(frame(spark, arrays()), ["clean", "nonsense"])


def test_missing_clean_score_is_an_error(spark):
    df = spark.createDataFrame([("s", 1, 0, "noise_snr5", 0.1)], "split string, item int, label int, condition string, score double")
    with pytest.raises(Exception, match="no clean score"):
        W.condition_shift(df, ["split"], "item", F.lit(0.0)).collect()


def test_spectral_kernels():
    s = S.Spectrum()
    basis = S.cosine_basis(40)
    np.testing.assert_allclose(basis @ basis.T, np.eye(40), atol=1e-12)
    ramp = np.tile(np.arange(30.0), (2, 1))
    np.testing.assert_allclose(S.slope(ramp, 1), 1.0)
    np.testing.assert_allclose(S.slope(ramp**2, 2), 2.0, atol=1e-9)
    t = np.arange(96000) / s.rate
    power = S.power_spectrum(np.sin(2 * np.pi * 1000 * t), s)
    assert power.shape == (513, 188) and np.argmax(power[:, 90]) == 64
    bank = S.linear_bank(s, 40)
    assert bank.shape == (40, 513) and bank.max() == 1.0
    mel = S.mel_bank(s, 128)
    assert mel.shape == (128, 513) and (mel.sum(axis=1) > 0).all()
    ex = S.extractors(s)
    assert S.stack_slopes(ex["mel"](power)).shape == (3, 128, 188)
    assert S.stack_slopes(ex["lfcc"](power)).shape == (3, 40, 188)
    assert ex["mel"](power).max() == 0.0 and ex["mel"](power).min() >= -80.0


def test_spectral_job(spark):
    x = [float(v) for v in np.random.default_rng(0).normal(size=6000)]
    w = spark.createDataFrame([(1, 0, x), (1, 1, x)], "rec long, window long, samples array<double>")
    t = S.spectral_features(w, ["mfcc", "mel"]).collect()
    assert {(r["window"], r["feature"]) for r in t} == {(0, "mfcc"), (0, "mel"), (1, "mfcc"), (1, "mel")}
    assert all(len(r["values"]) == 3 and len(r["values"][0]) == (40 if r["feature"] == "mfcc" else 128) for r in t)
    with pytest.raises(ValueError):
        S.spectral_features(w, ["other"])
    d = S.spectral_descriptors(w).first()
    assert 3000 < d["centroid_hz"] < 5000


def test_sweep_reports_only_real_changes(spark):
    from sigeval.plans.sweep import condition_scores

    data = {r: x / 4 for r, x in arrays().items() if r in (1, 6)}
    data[6] = peak(data[6])  # only recording 6 reaches full scale, so only it can clip
    data[1] = peak(data[1]) * 0.4
    items = spark.createDataFrame([(1, 0), (6, 1)], "rec long, label int")
    t = condition_scores(
        frame(spark, data), items, ["clean", "clip_+6dB", "append_silence_0.44"], lambda x: np.abs(x).mean(axis=1),
        scheme="controlled", win=WIN, frame=FRAME, frame_hop=FHOP, top_db=TOP, rate=100,
    ).toPandas().set_index(["rec", "condition"])
    assert not t.loc[(1, "clip_+6dB"), "input_changed"] and not t.loc[(1, "clip_+6dB"), "clipped"]
    assert t.loc[(6, "clip_+6dB"), "input_changed"] and t.loc[(6, "clip_+6dB"), "clipped"]
    assert not t.loc[(1, "clean"), "input_changed"] and not t.loc[(6, "append_silence_0.44"), "input_changed"]
    with pytest.raises(ValueError):
        condition_scores(frame(spark, data), items, ["clip_+6dB"], lambda x: x[:, 0])


def test_spectral_features_leave_a_task_in_small_parts():
    """The features of a whole Arrow batch are never held as lists."""

    class Windows:
        dtypes = [("rec", "bigint")]

        def select(self, *names):
            return self

        def mapInPandas(self, kernel, schema):
            return kernel

    rng = np.random.default_rng(3)
    batch = pd.DataFrame({"rec": range(300), "window": 0, "samples": list(rng.normal(size=(300, 8000)))})
    parts = list(S.spectral_features(Windows(), ["lfcc"])(iter([batch])))
    assert [r for p in parts for r in p["rec"]] == list(range(300)) and max(len(p) for p in parts) <= 64
