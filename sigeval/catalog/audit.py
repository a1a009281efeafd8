"""Queries for the corpus audit: inventories, separability, duplicates, leakage, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigeval.catalog import fixtures as fx
from sigeval.catalog.registry import AUC, query, score_points, seed32
from sigeval.functions.columns import stable_seed
from sigeval.operators import audit as A
from sigeval.operators import neighbours as N
from sigeval.operators import sampling as S
from sigeval.session import stage
from sigeval.sources import manifest as MF


def rnd(df, *names, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


# ---------------------------------------------------------------- manifests
@query(
    "manifest_from_path",
    """WITH p AS (SELECT url, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
       SELECT path, CASE WHEN contains(path, 'example.com/') THEN 'A' WHEN contains(path, 'example.net/') THEN 'B' END AS corpus,
         regexp_extract(path, '/([a-z]{2})/', 1) AS role,
         CASE WHEN contains(path, '/en/') THEN 0 ELSE 1 END AS label
       FROM p WHERE (contains(path, 'example.com/') OR contains(path, 'example.net/')) AND regexp_matches(path, '/(en|de|fr|es)/')""",
)
def _(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    paths = fx.table(spark, d, "pages").select(path.alias("path"))
    return MF.classify_paths(
        paths,
        corpus=[("example.com/", "A"), ("example.net/", "B")],
        label=[("/en/", 0), ("/de/", 1), ("/fr/", 1), ("/es/", 1)],
        role_pattern="/([a-z]{2})/",
    )


@query(
    "checksum_mismatch",
    """WITH e AS (SELECT doc_id AS item, sha256(trim(text, ' ')) AS expected FROM documents),
         o AS (SELECT doc_id AS item, sha256(text) AS actual FROM documents WHERE lang <> 'es')
       SELECT e.item, CASE WHEN actual IS NULL THEN 'missing' ELSE 'mismatch' END AS status
       FROM e LEFT JOIN o USING (item) WHERE actual IS NULL OR actual <> expected""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    expected = docs.select(F.col("doc_id").alias("item"), F.sha2(F.trim("text"), 256).alias("expected"))
    actual = docs.where("lang <> 'es'").select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("actual"))
    return MF.checksum_mismatch(expected, actual, "item")


@query(
    "top_components",
    """SELECT component, count(*) AS n FROM (SELECT unnest(string_split(url, '/')) AS component FROM pages)
       GROUP BY 1 ORDER BY n DESC, component LIMIT 50""",
)
def _(spark, d):
    return A.top_components(fx.table(spark, d, "pages"), "url")


# ---------------------------------------------------------------- inventories
@query(
    "class_crosstab",
    """SELECT dataset_id, split, count(*) FILTER (WHERE label = 0) AS class_0, count(*) FILTER (WHERE label = 1) AS class_1,
         round(count(*) FILTER (WHERE label = 1)::DOUBLE / nullif(count(*) FILTER (WHERE label = 0), 0), 6) AS ratio
       FROM fx_scores GROUP BY 1, 2""",
    ("fx_scores",),
)
def _(spark, d):
    return rnd(A.class_crosstab(fx.scores(spark, d), ["dataset_id", "split"], "label"), "ratio")


@query(
    "corpus_counts",
    "SELECT source, lang, count(*) AS files, round(sum(n_chars) / 3600.0::DOUBLE, 6) AS hours FROM documents GROUP BY 1, 2",
)
def _(spark, d):
    return rnd(A.corpus_counts(fx.table(spark, d, "documents"), ["source", "lang"], "n_chars"), "hours")


@query(
    "duration_stats",
    """SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, min(n_chars) AS min, max(n_chars) AS max,
         round(avg((n_chars <= 600)::INT), 6) AS frac_le_limit, round(quantile_cont(n_chars::DOUBLE, 0.5::DOUBLE), 6) AS median,
         round(quantile_cont(n_chars::DOUBLE, 0.05::DOUBLE), 6) AS p05, round(quantile_cont(n_chars::DOUBLE, 0.95::DOUBLE), 6) AS p95
       FROM documents GROUP BY lang""",
)
def _(spark, d):
    t = A.distribution(fx.table(spark, d, "documents"), ["lang"], "n_chars", 600)
    return rnd(t, "mean", "sd", "frac_le_limit", "median", "p05", "p95")


@query(
    "signal_stats",
    """WITH u AS (SELECT dataset_id, label, 'score' AS descriptor, score AS value FROM fx_scores
         UNION ALL SELECT dataset_id, label, 'score_b', score_b FROM fx_scores
         UNION ALL SELECT dataset_id, label, 'max_pad_fraction', max_pad_fraction FROM fx_scores)
       SELECT dataset_id, label, descriptor, count(*) AS n, round(quantile_cont(value, 0.5::DOUBLE), 6) AS median,
         round(quantile_cont(value, 0.25::DOUBLE), 6) AS q25, round(quantile_cont(value, 0.75::DOUBLE), 6) AS q75
       FROM u GROUP BY 1, 2, 3""",
    ("fx_scores",),
)
def _(spark, d):
    t = A.descriptor_stats(fx.scores(spark, d), ["dataset_id", "label"], ["score", "score_b", "max_pad_fraction"])
    return rnd(t, "median", "q25", "q75")


@query(
    "format_census",
    "SELECT lang, source, toxic, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3",
)
def _(spark, d):
    docs = fx.docs(spark, d).withColumnRenamed("label", "toxic")
    return A.census(docs, ["lang", "source", "toxic"])


@query(
    "audit_profile",
    """SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) + 0.0 AS min,
         max(value) AS max, count(DISTINCT value) AS distinct,
         (SELECT v FROM (SELECT value + 0.0 AS v, count(*) AS n FROM events i WHERE i.event_type = o.event_type GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode
       FROM events o GROUP BY event_type""",
)
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_type", (F.col("value") + F.lit(0.0)).alias("value"))
    return rnd(A.profile(e, ["event_type"], "value"), "mean", "median")


@query(
    "timing_summary",
    """SELECT event_type, count(*) AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, round(sum(s) / sum(w), 6) AS per_window,
         round(sum(s) / sum(a), 6) AS real_time_factor, round(quantile_cont(s, 0.5::DOUBLE), 6) AS median, round(quantile_cont(s, 0.95::DOUBLE), 6) AS p95
       FROM (SELECT event_type, value / 1000 AS s, 1 + event_id % 5 AS w, (1 + event_id % 5) * 6.0::DOUBLE AS a FROM events) GROUP BY 1""",
)
def _(spark, d):
    w = 1 + F.col("event_id") % 5
    e = fx.table(spark, d, "events").select(
        "event_type", (F.col("value") / 1000).alias("s"), w.alias("w"), (w * F.lit(6.0)).alias("a")
    )
    t = A.timing_summary(e, ["event_type"], "s", "a", "w")
    return rnd(t, "mean", "sd", "per_window", "real_time_factor", "median", "p95")


# ---------------------------------------------------------------- separability and leakage
DOC_NUM = """SELECT lang, label, 'n_chars' AS descriptor, n_chars::DOUBLE AS value FROM fx_docs WHERE label IS NOT NULL
  UNION ALL SELECT lang, label, 'n_lines', (length(text) - length(replace(text, chr(10), '')))::DOUBLE FROM fx_docs WHERE label IS NOT NULL"""


@query(
    "separability",
    f"""WITH u AS ({DOC_NUM}), {score_points('up', 'u', 'lang, descriptor', 'value')},
         a AS (SELECT lang, descriptor, {AUC} AS auc, max(pos_total) + max(neg_total) AS n FROM up GROUP BY 1, 2)
       SELECT lang, descriptor, round(auc, 6) AS auc_spoof_high, round(greatest(auc, 1 - auc), 6) AS separability,
         CASE WHEN auc >= 0.5 THEN 'higher=>spoof' ELSE 'lower=>spoof' END AS direction, n FROM a WHERE auc IS NOT NULL""",
    ("fx_docs",),
)
def _(spark, d):
    x = fx.docs(spark, d).select(
        "lang", "label", "n_chars", (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).alias("n_lines")
    )
    return rnd(A.separability(x, ["lang"], "label", ["n_chars", "n_lines"]), "auc_spoof_high", "separability")


@query(
    "id_leakage",
    f"""WITH u AS (SELECT lang, label, item::DOUBLE AS value FROM fx_docs WHERE label IS NOT NULL),
         {score_points('up', 'u', 'lang', 'value')}, a AS (SELECT lang, {AUC} AS auc, max(pos_total) + max(neg_total) AS n FROM up GROUP BY 1)
       SELECT lang, round(auc, 6) AS auc_id_number, round(greatest(auc, 1 - auc), 6) AS separability, n FROM a WHERE auc IS NOT NULL""",
    ("fx_docs",),
)
def _(spark, d):
    x = fx.docs(spark, d).withColumn("id_number", A.id_number(F.concat(F.lit("doc_"), F.col("item"), F.lit(".wav"))))
    t = A.separability(x, ["lang"], "label", ["id_number"])
    return t.select(
        "lang", F.round("auc_spoof_high", 6).alias("auc_id_number"), F.round("separability", 6).alias("separability"), "n"
    )


@query(
    "exact_dups",
    """WITH g AS (SELECT h, count(*) AS files, min(label) <> max(label) AS cl, min(source) <> max(source) AS cs FROM fx_docs GROUP BY h HAVING count(*) > 1)
       SELECT cast(coalesce(sum(files), 0) AS bigint) AS files_in_groups, count(*) AS groups, count(*) FILTER (WHERE cl) AS cross_label_groups,
         count(*) FILTER (WHERE cs) AS cross_source_groups FROM g""",
    ("fx_docs",),
)
def _(spark, d):
    return A.duplicate_summary(A.duplicate_groups(fx.docs(spark, d), "h", "label", "source", "item"))


SPLIT_SQL = f"CASE WHEN {seed32('cast(item AS varchar)')} % 10 < 7 THEN 'train' WHEN {seed32('cast(item AS varchar)')} % 10 < 8 THEN 'validation' ELSE 'internal_test' END"


@query(
    "split_overlap",
    f"""WITH s AS (SELECT *, {SPLIT_SQL} AS split FROM fx_docs),
         k AS (SELECT DISTINCT split, 'sha256' AS kind, h AS key FROM s UNION ALL SELECT DISTINCT split, 'first_line', string_split(text, chr(10))[1] FROM s
               UNION ALL SELECT DISTINCT split, 'source', source FROM s),
         p AS (SELECT DISTINCT a.split AS split_a, b.split AS split_b FROM s a JOIN (SELECT DISTINCT split FROM s) b ON a.split < b.split),
         c AS (SELECT a.split AS split_a, b.split AS split_b, a.kind, count(*) AS n FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.split < b.split GROUP BY 1, 2, 3)
       SELECT split_a, split_b, cast(coalesce(sum(n) FILTER (WHERE kind = 'sha256'), 0) AS bigint) AS shared_sha256,
         cast(coalesce(sum(n) FILTER (WHERE kind = 'first_line'), 0) AS bigint) AS shared_first_line,
         cast(coalesce(sum(n) FILTER (WHERE kind = 'source'), 0) AS bigint) AS shared_source
       FROM p LEFT JOIN c USING (split_a, split_b) GROUP BY 1, 2""",
    ("fx_docs",),
)
def _(spark, d):
    h = stable_seed("item") % 10
    s = fx.docs(spark, d).withColumn("split", F.when(h < 7, "train").when(h < 8, "validation").otherwise("internal_test"))
    kinds = {"sha256": F.col("h"), "first_line": F.split("text", "\n")[0], "source": F.col("source")}
    return A.split_overlap(s, "split", kinds)


@query(
    "id_pairing",
    """WITH t AS (SELECT conv_id % 3 AS dataset_id, conv_id, max((role = 'user')::INT) AS r, max((role = 'assistant')::INT) AS f FROM conversations
                  WHERE role <> 'system' GROUP BY 1, 2)
       SELECT dataset_id, count(*) FILTER (WHERE r=1) AS real_ids, count(*) FILTER (WHERE f=1) AS fake_ids, count(*) FILTER (WHERE r=1 AND f=1) AS ids_in_both,
         min(conv_id) FILTER (WHERE r=1) AS real_min, max(conv_id) FILTER (WHERE r=1) AS real_max,
         min(conv_id) FILTER (WHERE f=1) AS fake_min, max(conv_id) FILTER (WHERE f=1) AS fake_max FROM t GROUP BY 1""",
)
def _(spark, d):
    t = fx.table(spark, d, "conversations").where("role <> 'system'")
    t = t.select((F.col("conv_id") % 3).alias("dataset_id"), "conv_id", (F.col("role") == "assistant").cast("int").alias("label"))
    return A.id_pairing(t, ["dataset_id"], "conv_id", "label")


# ---------------------------------------------------------------- neighbours
PLANTED = """planted AS (
    SELECT vec_id AS item, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings UNION ALL
    SELECT vec_id + 1000000 * unnest(range(2, 11)), list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id % 50 = 7 UNION ALL
    SELECT vec_id + 1000000, list_transform(embedding, lambda x, j: x::DOUBLE + ((vec_id * 7919 + (j - 1) * 104729) % 1000 / 1000.0::DOUBLE - 0.5::DOUBLE) * (0.02::DOUBLE + 0.02::DOUBLE * (vec_id % 3))) FROM embeddings),
  un AS (SELECT item, list_transform(v, lambda x: x / n) AS u FROM (SELECT item, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM planted)),
  nn AS (SELECT a.item, b.item AS neighbour, list_dot_product(a.u, b.u) AS cosine FROM un a JOIN un b ON a.item <> b.item WHERE list_dot_product(a.u, b.u) >= 0.99),
  kn AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY cosine DESC, neighbour) AS rank FROM nn)"""


def planted(spark, d):
    """The vectors, one jittered copy of each (some copies are near duplicates, some are not), and nine identical copies of
    every fiftieth."""
    v = fx.vectors(spark, d).select("item", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    amp = F.lit(0.02) + F.lit(0.02) * (F.col("item") % 3)
    jitter = F.transform(
        "v", lambda x, j: x + ((F.col("item") * 7919 + j * 104729) % 1000 / F.lit(1000.0) - F.lit(0.5)) * amp
    )
    # two steps: inside a lambda, `item` would mean the new column of the same select
    copies = v.withColumn("w", jitter).select((F.col("item") + 1000000).alias("item"), F.col("w").alias("v"))
    same = v.where("item % 50 = 7").select(F.explode(F.sequence(F.lit(2), F.lit(10))).alias("n"), "item", "v")
    same = same.select((F.col("item") + F.col("n") * 1000000).alias("item"), "v")
    return v.unionByName(copies).unionByName(same)


@query("knn_topk", f"WITH {PLANTED} SELECT item, neighbour, round(cosine, 6) AS cosine, rank FROM kn WHERE rank <= 6")
def _(spark, d):
    t = N.neighbours(planted(spark, d), "item", "v", 64, 0.99, k=6)
    return rnd(t.withColumn("rank", F.col("rank").cast("long")), "cosine")


@query(
    "near_dup_pairs",
    f"WITH {PLANTED} SELECT DISTINCT least(item, neighbour) AS item_a, greatest(item, neighbour) AS item_b, round(cosine, 6) AS cosine FROM kn WHERE rank <= 6 AND cosine >= 0.995",
)
def _(spark, d):
    return rnd(N.candidate_pairs(N.neighbours(planted(spark, d), "item", "v", 64, 0.995, k=6)), "cosine")


@query(
    "near_dup_confirm",
    f"""WITH {PLANTED},
      pr AS (SELECT least(item, neighbour) AS item_a, greatest(item, neighbour) AS item_b, max(cosine) AS cosine FROM kn WHERE rank <= 6 AND cosine >= 0.995 GROUP BY 1, 2),
      ce AS (SELECT item, list_transform(v, lambda x: x - list_avg(v)) AS c FROM planted),
      lg AS (SELECT item_a, item_b, cosine, a.c AS a, b.c AS b, unnest(range(-63, 64)) AS lag FROM pr JOIN ce a ON a.item = item_a JOIN ce b ON b.item = item_b),
      cr AS (SELECT item_a, item_b, cosine, max(list_dot_product(a[greatest(1, 1 - lag):least(64, 64 - lag)], b[greatest(1, 1 + lag):least(64, 64 + lag)])
          / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) AS correlation FROM lg GROUP BY 1, 2, 3)
      SELECT item_a, item_b, round(cosine, 6) AS cosine, round(correlation, 6) AS correlation, correlation >= 0.95 AS confirmed FROM cr""",
)
def _(spark, d):
    v = planted(spark, d)
    pairs = stage(N.candidate_pairs(N.neighbours(v, "item", "v", 64, 0.995, k=6)))
    return rnd(N.confirm(pairs, v, "item", "v", 0.95), "cosine", "correlation")


@query(
    "near_dup_all_pairs",
    f"""WITH {PLANTED}, rp AS (SELECT min(item) AS item FROM planted GROUP BY v), ru AS (SELECT item, u FROM un SEMI JOIN rp USING (item))
      SELECT a.item AS item_a, b.item AS item_b, round(list_dot_product(a.u, b.u), 6) AS cosine
      FROM ru a JOIN ru b ON a.item < b.item WHERE list_dot_product(a.u, b.u) >= 0.995""",
)
def _(spark, d):
    return rnd(N.all_pairs(planted(spark, d), "item", "v", 64, 0.995), "cosine")


@query(
    "near_dup_copies",
    f"WITH {PLANTED} SELECT min(item) OVER (PARTITION BY v) AS representative, item AS member FROM planted QUALIFY count(*) OVER (PARTITION BY v) > 1",
)
def _(spark, d):
    return N.copies(planted(spark, d), "item", "v")


# ---------------------------------------------------------------- features
@query(
    "norm_stats",
    """WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE label < 8)
       SELECT cast(pos AS integer) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) AS n FROM x GROUP BY 1""",
)
def _(spark, d):
    return rnd(A.norm_stats(fx.vectors(spark, d).where("label < 8"), "embedding"), "mean", "std")


@query(
    "class_residual",
    """WITH x AS (SELECT (label < 5)::INT AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
       SELECT cast(pos AS integer) AS pos, round(avg(x) FILTER (WHERE y=0), 6) AS mean_0, round(avg(x) FILTER (WHERE y=1), 6) AS mean_1,
         round(var_pop(x), 6) AS variance, round(abs(avg(x) FILTER (WHERE y=0) - avg(x) FILTER (WHERE y=1)), 6) AS residual FROM x GROUP BY 1""",
)
def _(spark, d):
    return rnd(A.class_residual(fx.vectors(spark, d), "embedding", "binary"), "mean_0", "mean_1", "variance", "residual")


@query(
    "feature_sanity",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings),
         e AS (SELECT vec_id, label, count(*) AS k, bool_or(isnan(x) OR isinf(x)) AS bad FROM x GROUP BY 1, 2),
         n AS (SELECT label, count(*) AS n, min(k) AS dim_min, max(k) AS dim_max, count(*) FILTER (WHERE bad) AS n_undefined FROM e GROUP BY 1)
       SELECT label, max(n) AS n, cast(max(dim_min) AS integer) AS dim_min, cast(max(dim_max) AS integer) AS dim_max, round(min(x), 6) AS min, round(max(x), 6) AS max,
         max(n_undefined) AS n_undefined, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM x JOIN n USING (label) GROUP BY label""",
)
def _(spark, d):
    return rnd(A.feature_sanity(fx.vectors(spark, d), ["label"], "embedding"), "min", "max", "mean", "sd")


@query(
    "normalize",
    """WITH x AS (SELECT vec_id AS item, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, label FROM embeddings),
         s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE label < 8 GROUP BY 1)
       SELECT item, cast(pos AS integer) AS pos, round((x - m) / (sd + 1e-8::DOUBLE), 5) AS z FROM x JOIN s USING (pos)""",
)
def _(spark, d):
    v = fx.vectors(spark, d)
    stats = A.norm_stats(v.where("label < 8"), "embedding")
    z = A.normalised(v, "embedding", stats)
    return z.select("item", F.posexplode("z").alias("pos", "z")).select("item", "pos", F.round("z", 5).alias("z"))


@query(
    "band_mask",
    f"""WITH x AS (SELECT vec_id AS item, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
         m AS (SELECT unnest([0.0, 0.1, 0.3, 0.5]::DOUBLE[]) AS p)
       SELECT p AS mask_prob, item, count(*) FILTER (WHERE p = 0 OR {seed32('cast(item AS varchar)', 'cast(pos AS varchar)')} / 4294967296.0::DOUBLE > p) AS kept,
         round(sum(CASE WHEN p = 0 OR {seed32('cast(item AS varchar)', 'cast(pos AS varchar)')} / 4294967296.0::DOUBLE > p THEN x * x ELSE 0 END), 6) AS energy
       FROM x, m GROUP BY 1, 2""",
)
def _(spark, d):
    from sigeval.operators.sweep import band_mask

    v = fx.vectors(spark, d).withColumn("mask_prob", F.explode(F.array(*[F.lit(p) for p in (0.0, 0.1, 0.3, 0.5)])))
    m = v.withColumn("masked", band_mask("embedding", "item", F.col("mask_prob")))
    return m.select(
        "mask_prob",
        "item",
        F.aggregate("masked", F.lit(0).cast("long"), lambda s, c: s + c.keep.cast("long")).alias("kept"),
        F.round(F.aggregate("masked", F.lit(0.0), lambda s, c: s + c.x * c.x), 6).alias("energy"),
    )


# ---------------------------------------------------------------- samples, sets and splits
@query(
    "first_n_per_class",
    "SELECT item, label, cast(rank AS integer) AS rank FROM (SELECT item, label, row_number() OVER (PARTITION BY label ORDER BY item) AS rank FROM fx_scores) WHERE rank <= 30",
    ("fx_scores",),
)
def _(spark, d):
    return S.first_per_class(fx.scores(spark, d), "label", "item", 30).select("item", "label", "rank")


@query(
    "stratified_sample",
    "SELECT item, label FROM (SELECT item, label, row_number() OVER (PARTITION BY label ORDER BY sha1(concat_ws('|', '0', item)), item) AS r FROM fx_scores) WHERE r <= 100",
    ("fx_scores",),
)
def _(spark, d):
    return S.stratified_sample(stage(fx.scores(spark, d).select("item", "label")), "label", "item", 100)


@query("seeded_sample", "SELECT item, label FROM fx_scores ORDER BY sha1(concat_ws('|', '7', item)), item LIMIT 500", ("fx_scores",))
def _(spark, d):
    return S.seeded_sample(stage(fx.scores(spark, d).select("item", "label")), "item", 500, 7)


@query(
    "stack_runs",
    """SELECT run, split, count(*) AS n, count(score_b) AS n_b, round(avg(score), 6) AS score FROM (
         SELECT 'a' AS run, split, score, NULL::DOUBLE AS score_b FROM fx_scores UNION ALL SELECT 'b', split, score_b, score_b FROM fx_scores) GROUP BY 1, 2""",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d)
    a = s.select(F.lit("a").alias("run"), "split", "score")
    b = s.select(F.lit("b").alias("run"), "split", F.col("score_b").alias("score"), "score_b")
    t = a.unionByName(b, allowMissingColumns=True)
    return t.groupBy("run", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count("score_b").alias("n_b"), F.round(F.avg("score"), 6).alias("score")
    )


@query(
    "split_intersect",
    "SELECT DISTINCT speaker_id FROM fx_scores WHERE label = 0 INTERSECT SELECT DISTINCT speaker_id FROM fx_scores WHERE label = 1",
    ("fx_scores",),
)
def _(spark, d):
    s = fx.scores(spark, d)
    return s.where("label = 0").select("speaker_id").intersect(s.where("label = 1").select("speaker_id"))


@query("distinct_parents", "SELECT DISTINCT item, label FROM fx_windows", ("fx_windows",))
def _(spark, d):
    return fx.windows(spark, d).select("item", "label").dropDuplicates()


GROUP_ORDER = "SELECT g, row_number() OVER (ORDER BY sha1(concat_ws('|', '0', g))) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {g} AS g FROM {t})"


@query(
    "group_split",
    f"""WITH o AS ({GROUP_ORDER.format(g='h', t='fx_docs')})
       SELECT item, CASE WHEN k < floor(0.7::DOUBLE * n) THEN 'train' WHEN k < floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'internal_test' END AS split
       FROM fx_docs JOIN o ON h = g""",
    ("fx_docs",),
)
def _(spark, d):
    docs = fx.docs(spark, d).select("item", "h")
    shares = [("train", 0.7), ("validation", 0.15), ("internal_test", 0.15)]
    return S.group_split(docs, "h", shares).select("item", "split")


@query(
    "stratified_split",
    """WITH o AS (SELECT item, label, row_number() OVER (PARTITION BY label ORDER BY sha1(concat_ws('|', '0', item))) - 1 AS k,
                    count(*) OVER (PARTITION BY label) AS n FROM fx_scores)
       SELECT item, label, CASE WHEN k < floor(0.15::DOUBLE * n) THEN 'validation' ELSE 'train' END AS split FROM o""",
    ("fx_scores",),
)
def _(spark, d):
    return S.stratified_split(stage(fx.scores(spark, d).select("item", "label")), "label", "item")


@query(
    "split_semi",
    """WITH o AS (SELECT item, label, row_number() OVER (PARTITION BY label ORDER BY sha1(concat_ws('|', '0', item))) - 1 AS k,
                    count(*) OVER (PARTITION BY label) AS n FROM fx_scores)
       SELECT item, label, logit FROM fx_windows SEMI JOIN (SELECT item FROM o WHERE k < floor(0.15::DOUBLE * n)) v USING (item)""",
    ("fx_scores",),
)
def _(spark, d):
    w = stage(fx.windows(spark, d).select("item", "label", "logit"))
    parents = S.stratified_split(w.select("item", "label").distinct(), "label", "item")
    return w.join(parents.where("split = 'validation'"), "item", "left_semi").select("item", "label", "logit")


LINKED = f"""{PLANTED},
  cand AS (SELECT item AS item_a, neighbour AS item_b FROM nn WHERE item < neighbour AND cosine >= 0.995),
  ce AS (SELECT item, list_transform(v, lambda x: x - list_avg(v)) AS c FROM planted),
  lg AS (SELECT item_a, item_b, a.c AS a, b.c AS b, unnest(range(-63, 64)) AS lag FROM cand JOIN ce a ON a.item = item_a JOIN ce b ON b.item = item_b),
  linked AS (SELECT item_a, item_b FROM lg GROUP BY item_a, item_b
    HAVING max(list_dot_product(a[greatest(1, 1 - lag):least(64, 64 - lag)], b[greatest(1, 1 + lag):least(64, 64 + lag)])
      / sqrt(list_dot_product(a, a) * list_dot_product(b, b))) >= 0.95),
  reps AS (SELECT item, min(item) OVER (PARTITION BY v) AS representative FROM planted)"""


def confirmed(spark, v):
    """Pairs of different vectors whose cross-correlation confirms them, none left out."""
    pairs = stage(N.all_pairs(v, "item", "v", 64, 0.995))
    return stage(N.confirm(pairs, v, "item", "v", 0.95).where("confirmed").select("item_a", "item_b"))


@query(
    "near_dup_clusters",
    f"""WITH RECURSIVE {LINKED},
      rl AS (SELECT a.representative AS x, b.representative AS y FROM linked JOIN reps a ON a.item = item_a JOIN reps b ON b.item = item_b
        WHERE a.representative <> b.representative),
      both_ways AS (SELECT x, y FROM rl UNION SELECT y, x FROM rl),
      reach AS (SELECT DISTINCT representative AS x, representative AS y FROM reps UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
      least_of AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x),
      degree AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
      SELECT item, representative, cluster, coalesce(n_links, 0) AS n_links
      FROM reps JOIN least_of l ON l.x = representative LEFT JOIN degree d ON d.x = representative""",
)
def _(spark, d):
    v = planted(spark, d)
    return N.clusters(v, "item", "v", confirmed(spark, v))


@query(
    "near_dup_summary",
    f"""WITH {LINKED},
      own AS (SELECT item, CASE WHEN item >= 1000000 THEN 'copy' ELSE 'original' END AS corpus,
        CASE WHEN item % 7 = 0 THEN 1 ELSE 0 END AS label FROM reps)
      SELECT (SELECT count(*) FROM own) AS n_items_checked, count(*) AS confirmed_pairs,
        count(*) FILTER (WHERE a.label <> b.label) AS confirmed_cross_label, count(*) FILTER (WHERE a.corpus <> b.corpus) AS confirmed_cross_dataset
      FROM linked JOIN own a ON a.item = item_a JOIN own b ON b.item = item_b""",
)
def _(spark, d):
    v = planted(spark, d)
    links = confirmed(spark, v)
    members = N.clusters(v, "item", "v", links).select(
        "representative", "item", (F.col("item") % 7 == 0).cast("int").alias("label"), F.when(F.col("item") >= 1000000, "copy").otherwise("original").alias("corpus")
    )
    return N.link_counts(stage(members), links, {"confirmed_cross_label": "label", "confirmed_cross_dataset": "corpus"})


@query("near_dup_lsh")
def _(spark, d):
    """Pairs at a cosine of 0.9, at which the grid compares most of all pairs. tests measure the recall against all pairs."""
    return rnd(N.lsh_pairs(planted(spark, d), "item", "v", 64, 0.9), "cosine")
