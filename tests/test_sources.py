import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigeval.functions import columns as C
from sigeval.plans import runs as R
from sigeval.sources import documents as D
from sigeval.sources import manifest as MF
from sigeval.sources import tables as T
from sigeval.sources import wav as WV


def write_wav(path, channels, frames, rate=16000):
    path.parent.mkdir(parents=True, exist_ok=True)
    x = (np.arange(frames * channels) % 2000 - 1000).astype("<i2")
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(x.tobytes())
    return x.reshape(-1, channels).mean(axis=1) / 32768.0


def test_wav(spark, tmp_path):
    want = {"a.wav": write_wav(tmp_path / "real" / "a.wav", 1, 70000), "b.wav": write_wav(tmp_path / "fake" / "b.wav", 2, 333, 8000)}
    (tmp_path / "fake" / "broken.wav").write_bytes(b"not audio")
    h = {r["path"].split("/")[-1]: r for r in WV.headers(spark, str(tmp_path)).collect()}
    assert set(h) == {"a.wav", "b.wav"} and h["b.wav"]["frames"] == 333 and h["b.wav"]["duration_sec"] == 333 / 8000
    (tmp_path / "fake" / "broken.wav").unlink()
    s = WV.samples(spark, str(tmp_path)).toPandas()
    for name, x in want.items():
        g = s[s.rec.str.endswith(name)].sort_values("i")
        np.testing.assert_allclose(g["v"], x)
    m = MF.classify_paths(MF.list_files(spark, str(tmp_path)), [("/real/", "A"), ("/fake/", "A")], [("/real/", 0), ("/fake/", 1)], "/([^/]+)$")
    assert {(r["role"], r["label"]) for r in m.collect()} == {("a.wav", 0), ("b.wav", 1)}
    hashes = MF.file_hashes(spark, str(tmp_path), "*.wav")
    good = hashes.withColumnRenamed("actual", "expected")
    assert MF.checksum_mismatch(good, hashes, "path").count() == 0
    bad = good.withColumn("expected", F.when(F.col("path").contains("a.wav"), "0").otherwise(F.col("expected")))
    assert MF.checksum_mismatch(bad, hashes, "path").first()["status"] == "mismatch"


def test_wav_header_behind_long_chunks(spark, tmp_path):
    for name, before in {"a": [100_000], "b": [65_482], "c": [99_999, 7], "d": [10] * 100, "plain": []}.items():
        write_wav(tmp_path / f"{name}.wav", 1, 40_000)
        raw = (tmp_path / f"{name}.wav").read_bytes()
        at = raw.index(b"data")
        extra = b"".join(b"LIST" + n.to_bytes(4, "little") + b"data" * (n // 4) + bytes(n % 4 + n % 2) for n in before)
        size = (len(raw) + len(extra) - 8).to_bytes(4, "little")
        (tmp_path / f"{name}.wav").write_bytes(raw[:4] + size + raw[8:at] + extra + raw[at:])
    (tmp_path / "broken.wav").write_bytes(b"RIFF" + bytes(100_000))
    got = {r["path"].split("/")[-1]: r["frames"] for r in WV.headers(spark, str(tmp_path)).collect()}
    assert got == {f"{n}.wav": 40_000 for n in ("a", "b", "c", "d", "plain")}


def test_metadata_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("audio_path,utterance_id,label,duration_sec\nx/1.wav,0007,1,2.5\nx/2.wav,0008,0,NaN\n")
    cols = ["audio_path", "utterance_id", "label", "duration_sec"]
    rows = T.read_metadata(spark, str(tmp_path / "m.csv"), cols).orderBy("audio_path").collect()
    assert rows[0]["utterance_id"] == "0007" and rows[0]["label"] == 1 and rows[1]["duration_sec"] is None
    with pytest.raises(ValueError):
        T.read_metadata(spark, str(tmp_path / "m.csv"), ["nonsense"])
    with pytest.raises(Exception):
        T.read_metadata(spark, str(tmp_path / "m.csv"), ["audio_path", "speaker_id", "label", "duration_sec"]).collect()


def test_split_list_and_scores(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a.wav \n\n b.wav\n")
    items = T.read_split_list(spark, str(tmp_path / "s.txt"))
    assert {r["item"] for r in items.collect()} == {"a.wav", "b.wav"}
    T.write_scores(items, str(tmp_path / "out"))
    T.write_scores(items, str(tmp_path / "out"), mode="append")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 4
    assert list((tmp_path / "out").glob("*.csv.gz"))


def test_feature_cache(spark, tmp_path):
    items = spark.createDataFrame([("b",), ("a",)], "item string")
    k1 = T.manifest_key(items, "item", {"scheme": "controlled", "window": 6.0})
    assert k1 == T.manifest_key(items.repartition(5), "item", {"window": 6.0, "scheme": "controlled"}) and len(k1) == 16
    assert k1 != T.manifest_key(items, "item", {"scheme": "original", "window": 6.0})
    first = T.cached(items, str(tmp_path), k1, "train")
    again = T.cached(items.where("item = 'a'"), str(tmp_path), k1, "train")  # complete: not written again
    assert first.count() == 2 and again.count() == 2


def test_result_documents(spark, tmp_path):
    run = tmp_path / "m__P1__seed42"
    run.mkdir()
    m = {"n": 3, "auc": float("nan"), "accuracy": 0.5, "accuracy_ci95": [0.1, 0.9]}
    (run / "metrics.json").write_text(json.dumps({"threshold_rule": "eer", "threshold_logit": -0.5, "splits": {"external": m, "internal": {"n": 1}}}))
    rows = {r["split"]: r for r in D.read(spark, str(tmp_path / "*" / "metrics.json")).collect()}
    assert rows["external"]["run"] == "m__P1__seed42" and rows["external"]["auc"] is None
    assert (rows["external"]["accuracy_ci95_lo"], rows["external"]["accuracy_ci95_hi"]) == (0.1, 0.9)
    assert rows["internal"]["accuracy"] is None and rows["internal"]["threshold_logit"] == -0.5


def test_result_documents_are_written_whole(spark, tmp_path):
    rows = [("007", "a", 3, float("nan"), 0.5, 0.1, 0.9, "eer \"NaN\"", -0.5, True), ("007", "b", 1, 0.25, None, None, None, "eer \"NaN\"", -0.5, True)]
    schema = "run string, split string, n long, auc double, accuracy double, accuracy_ci95_lo double, accuracy_ci95_hi double, threshold_rule string, threshold_logit double, is_placeholder boolean"
    df = spark.createDataFrame(rows, schema)
    doc = json.loads(D.as_documents(df).first()["value"])
    assert (doc["threshold_rule"], doc["threshold_logit"], doc["PLACEHOLDER"]) == ('eer "NaN"', -0.5, True)
    assert math.isnan(doc["splits"]["a"]["auc"]) and doc["splits"]["a"]["accuracy_ci95"] == [0.1, 0.9]
    assert doc["splits"]["b"] == {"n": 1, "auc": 0.25}
    D.write_runs(D.as_documents(df), str(tmp_path / "runs"))
    back = {r.split: r for r in D.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert (back["a"].run, back["a"].auc, back["a"].accuracy_ci95_hi, back["b"].auc, back["b"].is_placeholder) == ("007", None, 0.9, 0.25, True)
    with pytest.raises(Exception, match="disagree on the threshold"):
        D.as_documents(df.withColumn("threshold_logit", F.col("n") * 1.0)).collect()
    bare = D.as_documents(df.withColumns({c: F.lit(None) for c in ("threshold_rule", "threshold_logit", "is_placeholder")})).first()["value"]
    assert set(json.loads(bare)) == {"splits"}


def test_placeholder_in_real_store(spark):
    reg = spark.createDataFrame([("m", "P1", [42])], "model string, protocol string, seeds array<int>")
    real = spark.createDataFrame([("m__P1__seed42", "runs/m", True)], "run string, path string, is_placeholder boolean")
    none = spark.createDataFrame([], "run string, path string")
    with pytest.raises(Exception, match="placeholder data"):
        R.run_status(R.expected_runs(reg), real, none).collect()
    assert R.run_status(R.expected_runs(reg), real.where("false"), none).first()["status"] == "missing"


def test_seed_summary(spark):
    rows = [("m", "P1", s, "x", a) for s, a in ((42, 0.5), (123, float("nan")), (2026, 0.7))]
    df = spark.createDataFrame(rows, "model string, protocol string, seed int, split string, auc double")
    r = R.multiseed_summary(df, metrics=["auc"]).first()
    assert (r["n_seeds"], r["auc_n"]) == (3, 2) and r["auc_mean"] == pytest.approx(0.6) and r["auc_sd"] == pytest.approx(0.1414213562)
    assert R.multiseed_summary(df.where("seed = 42"), metrics=["auc"]).first()["auc_sd"] is None


def test_names_and_arrays(spark):
    df = spark.createDataFrame([("a_chk1_chk2", [3.0, -4.0], "main__P1__seed42")], "n string, x array<double>, run string")
    r = df.select(
        C.parent_id("n").alias("p"), C.peak_normalise("x").alias("pk"), C.tile_to("x", 5).alias("t"), C.pad_or_crop("x", 4).alias("c"),
        C.run_part("run", "seed").alias("s"), C.stable_seed(F.lit("a"), F.lit(1)).alias("h"), C.cluster_id(F.lit("MEN"), F.lit(None).cast("string"), F.lit("q")).alias("cl"),
        C.parent_id(F.lit("plain")).alias("w"),
    ).first()
    assert r["p"] == "a_chk1" and r["w"] == "plain" and r["pk"] == [0.75, -1.0] and r["t"] == [3.0, -4.0, 3.0, -4.0, 3.0]
    assert r["c"] == [3.0, -4.0, 0.0, 0.0] and r["s"] == 42 and r["cl"] == "SPK:nan"
    import hashlib

    assert r["h"] == int(hashlib.sha1(b"a|1").hexdigest()[:8], 16)


def test_staged_tables_are_dropped(spark):
    from sigeval import session

    kept, session._STAGED[:] = list(session._STAGED), []  # tables of other tests stay
    t = session.stage(spark.range(5))
    assert t.count() == 5 and session.drop_staged() == 1 and session.drop_staged() == 0
    with pytest.raises(Exception):
        spark.read.schema(t.schema).parquet(t.inputFiles()[0]).count()
    session._STAGED[:] = kept


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    from sigeval import session

    assert session.ROWS_PER_TASK <= 1 << 17
    monkeypatch.setattr(session, "ROWS_PER_TASK", 1000)
    staged = session.stage(spark.range(11500))
    assert session.tasks_for(staged) == 12 and session.spread(staged, "id").rdd.getNumPartitions() == 12
