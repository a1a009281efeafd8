"""The queries against their SQL, and the pipeline against a plain version."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import LOW, PASSAGE, fingerprint, groups_within, plain
from test_queries import SF, plain as rounded, rows

import corpus_pipeline
from sigeval import session
from sigeval.llm import near_copies
from sigeval.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, rel.fetchall())
    assert rounded(0.1234567) == 0.12346


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("prefix", ["op4", "op7"])
def test_scoring_queries_return_every_row(spark, prefix):
    (name,) = [q for q in QUERIES if q.startswith(prefix + "_")]
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert got.score.between(0, 1).all()


def near_groups(texts):
    """Lowest position each text is linked to: fingerprints within two bits, or 0.8 of the shingles of five words."""
    w = [plain((t or "").translate(LOW)) for t in texts]
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in w]
    fps = [fingerprint(t) for t in texts]
    alike = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = [[j for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2 or alike(i, j)] for i in range(len(texts))]
    label = list(range(len(texts)))
    while label != (new := [min(label[j] for j in near[i]) for i in range(len(texts))]):
        label = new
    return label


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    odd = [(1000, None, "en", "s0", 0), (1001, "", "en", "s1", 0), (1002, "123", "en", "s1", 3), (1003, f"x {PASSAGE} y", "en", "s2", 9)]
    first = docs.where("doc_id = 1").first()
    odd += [(1004, first.text, first.lang, "s2", 9), (1, first.text, first.lang, "s1", 9)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(1, PASSAGE), (2, " ".join(plain(docs.where("doc_id = 7").first().text)[20:40]))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in table.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    label = near_groups([r.text for r in kept])
    best = {}
    for g, r in zip(label, kept):
        best[g] = min(best.get(g, r), r, key=lambda x: x.doc_id)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    wins = {tuple(w[k : k + 10]) for r in bench.collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9))}
    clean = [r for r in best.values() if not any(tuple(w[k : k + 10]) in wins for w in [words(r.text)] for k in range(len(w)))]
    assert 1003 not in {r.doc_id for r in clean} and 7 not in {r.doc_id for r in clean}

    assert {r.doc_id for r in got} <= {r.doc_id for r in clean}
    docs = table
    for _, stage in corpus_pipeline.STAGES[:3]:  # exactly the clean documents come to the mixing stage
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in clean)
    size, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        size[r.source] += len(plain(r.text))
    for r in got:
        taken[r.source] += len(plain(r.text))
    assert max(Counter(r.doc_id for r in got).values()) <= 2
    largest = max(len(plain(r.text)) for r in clean)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 1.5 * largest
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_a_stage_of_an_empty_table(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_copies_above_a_shingle_similarity(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(30)]
    texts = [" ".join(passage + [word() for _ in range(40)]) for _ in range(12)]  # a common passage links nothing
    for k in range(8):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = word()
            texts += [" ".join(copy), " ".join(copy).upper()]
    texts += ["one two three", "One  two\tthree", "one two", "", None, "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    label = near_groups(texts)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == set(label)
    assert len(got) < len(set(groups_within([fingerprint(t) for t in texts])))  # two bits alone keep more


def test_near_copies_of_one_text_are_not_compared_pairwise(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    base, texts = [word() for _ in range(150)], []
    for k in range(160):  # from 4 changes on copies are linked neither to the text nor to most others
        copy = list(base)
        for at in rng.sample(range(len(copy)), 1 + k % 6):
            copy[at] = word()
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verified, compared, before = near_copies._verified, [], session.staged_tables()

    def counted(texts, first, pairs, *rest):
        compared.append(pairs.count())
        return verified(texts, first, pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    got = sorted(r.doc_id for r in near_copies.deduplicated(docs).collect())
    label = near_groups(texts)
    assert got == sorted(k for k, own in enumerate(label) if own == k)
    assert len(set(label)) > 20 and sum(compared) < 4 * len(texts)
    assert session.staged_tables() == before + 2  # only what the result reads stays on disk


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(4)
    at, drawn = near_copies.SIMILAR, rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = []
    for size in [1, 5, 80, 330, 3000]:
        for changed in (0.0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.9):
            kept = int(round(size * (1 - changed)))
            sets.append(np.unique(np.concatenate([drawn[:kept], rng.integers(0, 1 << 63, size - kept).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    sketches = near_copies._sketches(np.concatenate(sets), first, sizes)
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    left, right = (np.array(x) for x in zip(*pairs))
    columns = [left, right, sizes[left].astype(np.int32), sizes[right].astype(np.int32)]
    columns += [pa.array([sketches[k] for k in x], pa.binary()) for x in (left, right)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "na", "nb", "ka", "kb"])
    got = {(r["a"], r["b"]) for out in near_copies._possible(at)([batch]) for r in out.to_pylist()}
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    similar = {(i, j) for i, j in pairs if both(i, j) >= at * (sizes[i] + sizes[j] - both(i, j))}
    assert similar <= got
    assert len(similar) < len(got) < len(pairs) / 2


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_kept_documents_stay_in_their_partitions(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "KEPT", most)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(0, 5000, 1, 7).select(F.struct("id").alias("doc"), F.monotonically_increasing_id().alias("row"))
        docs = session.stage(docs)
        firsts = session.stage(docs.where("doc.id % 3 = 0").select("row"))
        found = near_copies._those(docs, firsts)
        assert sorted(r.id for r in found.select("doc.*").collect()) == list(range(0, 5000, 3))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
