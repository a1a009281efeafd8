"""Column expressions: stable hashes, scores, decisions, bins, names and array conditioning.

All of them are built-in Spark expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ---------------------------------------------------------------- stable randomness
def stable_seed(*parts) -> Column:
    """32-bit seed: the first 8 hex digits of SHA-1 over the parts joined with `|`."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts) -> Column:
    """Uniform number in (0, 1) that depends only on the parts, never on partitioning."""
    return (stable_seed(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def hash_normal(*parts) -> Column:
    """Standard normal number by Box-Muller on two hash uniforms."""
    u = hash_uniform(*parts, F.lit("u"))
    v = hash_uniform(*parts, F.lit("v"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def cache_key(settings: dict, files: Column) -> Column:
    """16-hex-digit key of a configuration and a sorted file list column."""
    text = ",".join(f"{k}={settings[k]}" for k in sorted(settings))
    return F.substring(F.sha1(F.concat(F.lit(text), F.array_join(F.array_sort(files), ""))), 1, 16)


# ---------------------------------------------------------------- scores and decisions
def unknown_to_null(x) -> Column:
    return F.nullif(as_col(x), F.lit("unknown"))


def ratio(num, den) -> Column:
    """num / den as double, NULL on a zero denominator."""
    den = as_col(den).cast("double")
    return as_col(num).cast("double") / F.when(den != 0, den)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def decision(score, threshold) -> Column:
    return as_col(score) >= as_col(threshold)


def outcome(label, score, threshold) -> Column:
    label, pred = as_col(label), decision(score, threshold)
    return (
        F.when((label == 1) & pred, "TP")
        .when((label == 0) & ~pred, "TN")
        .when((label == 0) & pred, "FP")
        .otherwise("FN")
    )


def cluster_id(dataset, speaker, text_group, speaker_corpus: str = "MEN") -> Column:
    """Resampling unit: the speaker for one corpus, the sentence group for all others.

    A missing id becomes the text `nan`, so such items form one cluster instead of vanishing.
    """
    return F.when(
        as_col(dataset) == speaker_corpus,
        F.concat(F.lit("SPK:"), F.coalesce(as_col(speaker).cast("string"), F.lit("nan"))),
    ).otherwise(F.concat(F.lit("SEN:"), F.coalesce(as_col(text_group).cast("string"), F.lit("nan"))))


# ---------------------------------------------------------------- bins
def equal_width_bin(p, n_bins: int = 15) -> Column:
    """Index of the right-open equal-width bin of a probability; 1.0 falls in the last bin."""
    p = as_col(p)
    hits = [(p >= F.lit(i * (1.0 / n_bins))).cast("int") for i in range(1, n_bins)]
    return sum(hits[1:], hits[0])


def fixed_cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (edges[i], edges[i+1]]; values outside give NULL."""
    x = as_col(x)
    out = None
    for lo, hi, name in zip(edges[:-1], edges[1:], labels):
        inside = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def edge_cut(x, edges: Column, labels: Sequence[str], drop_duplicates: bool = False) -> Column:
    """Quantile bins from an array of len(labels)+1 ordered edges: right-closed, lowest included.

    Repeated edges are an error unless `drop_duplicates`, where the merged bin keeps the first label.
    """
    x = as_col(x)
    out = F.when(x < edges[0], F.lit(None).cast("string"))
    for i, name in enumerate(labels):
        out = out.when(x <= edges[i + 1], name)
    if drop_duplicates:
        return out
    return F.when(
        F.size(F.array_distinct(edges)) < len(labels) + 1, F.raise_error(F.lit("bin edges are not unique"))
    ).otherwise(out)


# ---------------------------------------------------------------- names
def parent_id(name, marker: str = "_chk", first: bool = False) -> Column:
    """Part before the last marker, or before the first one; the whole name if there is none."""
    name = as_col(name)
    if first:
        return F.substring_index(name, marker, 1)
    return F.coalesce(F.nullif(F.regexp_extract(name, f"(?s)^(.*){marker}", 1), F.lit("")), name)


def run_name(model, protocol, seed) -> Column:
    return F.concat_ws("__", as_col(model), as_col(protocol), F.concat(F.lit("seed"), as_col(seed).cast("string")))


def run_part(name, part: str) -> Column:
    pieces = F.split(as_col(name), "__")
    if part == "seed":
        return F.regexp_extract(F.element_at(pieces, -1), r"^seed(\d+)$", 1).cast("long")
    return F.element_at(pieces, 1 if part == "model" else 2)


def recode(x, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep all others."""
    x = as_col(x)
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), x)


# ---------------------------------------------------------------- verdicts
def auc_verdict(auc) -> Column:
    auc = as_col(auc)
    return F.when(auc > 0.80, "robust").when(auc > 0.70, "decaying").when(auc.isNotNull(), "sensitive")


def p_verdict(p) -> Column:
    p = as_col(p)
    return F.when(p < 0.001, "highly significant").when(p < 0.05, "significant").when(p.isNotNull(), "not significant")


def balance_verdict(share) -> Column:
    share = as_col(share)
    return F.when(F.abs(share - 0.5) <= 0.05, "balanced").when(share.isNotNull(), "imbalanced")


def transfer_label(same_corpus, auc, accuracy, inverted=0.5, partial=0.8, min_accuracy=0.7) -> Column:
    """How a detector carries over to a test corpus (cut-offs are parameters)."""
    auc = as_col(auc)
    return (
        F.when(as_col(same_corpus), "in-corpus")
        .when(auc < inverted, "ranking inverted")
        .when(auc < partial, "partial")
        .when(as_col(accuracy) < min_accuracy, "ranking transfers, threshold does not")
        .when(auc.isNotNull(), "transfers")
    )


# ---------------------------------------------------------------- arrays (one bounded window)
def array_peak(a) -> Column:
    return F.array_max(F.transform(as_col(a), lambda v: F.abs(v)))


def array_mean(a) -> Column:
    a = as_col(a)
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def peak_normalise(a) -> Column:
    a = as_col(a)
    peak = array_peak(a)
    return F.when(peak > 0, F.transform(a, lambda v: v / peak)).otherwise(a)


def remove_mean(a) -> Column:
    a = as_col(a)
    mean = array_mean(a)
    return F.transform(a, lambda v: v - mean)


def tile_to(a, length: int) -> Column:
    """Repeat an array until it has `length` elements."""
    a = as_col(a)
    copies = F.ceil(F.lit(float(length)) / F.size(a)).cast("int")
    return F.slice(F.flatten(F.array_repeat(a, copies)), 1, length)


def pad_or_crop(a, length: int) -> Column:
    """Centre-crop a longer array, zero-pad a shorter one at the end."""
    a = as_col(a)
    n = F.size(a)
    start = F.floor((n - length) / 2).cast("int") + 1
    return F.when(n >= length, F.slice(a, start, F.lit(length))).otherwise(
        F.concat(a, F.array_repeat(F.lit(0.0), F.lit(length) - n))
    )


def append_zeros(a, count: int) -> Column:
    return F.concat(as_col(a), F.array_repeat(F.lit(0.0), count))
