"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, context_mixing, decontaminate, dialogue, exact_dedup, language, mixing, secrets, separators, sharding, simhash, toxicity, url_reputation
from .common import read_table
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark, sf_dir):
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", "mixed.taken")


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


@query
def op5_host_reputation(spark, sf_dir):
    return url_reputation.judge(read_table(spark, sf_dir, "pages"))


@query
def op9_shards(spark, sf_dir):
    out = sharding.shard(read_table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_secrets(spark, sf_dir):
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(language.train_rows(docs))
    found = language.predict(docs, model)
    return found.select("doc_id", F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    held = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_token_counts(spark, sf_dir):
    root = separators.token_folder(spark)
    order = separators.write_tokens(read_table(spark, sf_dir, "documents"), root)
    counted = separators.scan(order.where("ordinal = 0"), root)
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "ordinal", "start", "n_tokens")


@query
def op13_dialogue_repair(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.report(rows, dialogue.damaged(rows))


@query
def op12_token_alignment(spark, sf_dir):
    return alignment.alignment(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_context_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = context_mixing.held_out(F.col("doc_id")).alias("held_out")
    model = context_mixing.fit(docs.where(~held))
    scored = context_mixing.score(docs, model)
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
