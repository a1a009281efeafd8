"""Error-group tables and the comparison of missed with detected positives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigeval.functions.columns import as_col, edge_cut, outcome, ratio
from sigeval.operators.inference import mann_whitney
from sigeval.operators.ordering import quantiles


def with_quantile_levels(
    df: DataFrame, keys: Sequence[str], levels: dict[str, tuple[Column, Sequence[str]]], drop_duplicates: bool = False
) -> DataFrame:
    """Add quantile bins within a key (right-closed, lowest included): {new column: (value, labels)}.

    The edges of all values come from one unpivoted pass. They are joined back as one row per key, or read as scalars if
    there is no key.
    """
    by = list(keys)
    work = df.withColumns({f"_v_{n}": v.cast("double") for n, (v, _) in levels.items()})
    long = unpivot(work, by, [f"_v_{n}" for n in levels], "_name", "_value")
    sizes = sorted({len(labels) for _, labels in levels.values()})
    probs = {f"q{k}_{i}": i / k for k in sizes for i in range(k + 1)}
    q = quantiles(long, [*by, "_name"], "_value", probs)
    edges = q.groupBy(*by).agg(
        *[
            F.max(
                F.when(F.col("_name") == f"_v_{n}", F.array(*[F.col(f"q{len(labels)}_{i}") for i in range(len(labels) + 1)]))
            ).alias(f"_e_{n}")
            for n, (_, labels) in levels.items()
        ]
    )
    out = work.join(edges, by, "left") if keys else work.withColumns({f"_e_{n}": edges.select(f"_e_{n}").scalar() for n in levels})
    out = out.withColumns(
        {n: edge_cut(f"_v_{n}", F.col(f"_e_{n}"), labels, drop_duplicates) for n, (_, labels) in levels.items()}
    )
    return out.select(*df.columns, *levels)


def error_groups(
    df: DataFrame, keys: Sequence[str], label: str, score: str, threshold, groupings: dict[str, Column]
) -> DataFrame:
    """Misses and false alarms per level of each grouping; NULL levels are skipped.

    All groupings are expanded from one scan and counted by one partial/final aggregation.
    """
    flat = df.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(g).alias("grouping"), c.cast("string").alias("level")) for g, c in groupings.items()])
        ),
        as_col(label).alias("_y"),
        outcome(label, score, threshold).alias("_o"),
    ).where(F.col("level").isNotNull())
    counts = flat.groupBy(*keys, "grouping", "level").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_y") == 1, 1)).alias("n_spoof"),
        F.count(F.when(F.col("_o") == "FN", 1)).alias("fn"),
        F.count(F.when(F.col("_y") == 0, 1)).alias("n_bonafide"),
        F.count(F.when(F.col("_o") == "FP", 1)).alias("fp"),
    )
    return counts.withColumns({"fnr": ratio("fn", "n_spoof"), "fpr": ratio("fp", "n_bonafide")})


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "descriptor", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )


def fn_vs_tp(
    df: DataFrame, keys: Sequence[str], label: str, score: str, threshold, descriptors: Sequence[str]
) -> DataFrame:
    """Median of each descriptor for missed and detected positives, with a Mann-Whitney test."""
    pos = df.where(as_col(label) == 1).withColumn("_missed", (as_col(score) < as_col(threshold)).cast("int"))
    long = unpivot(pos, [*keys, "_missed"], descriptors).where(F.col("value").isNotNull())
    by = [*keys, "descriptor"]
    med = quantiles(long, [*by, "_missed"], "value", {"median": 0.5})
    wide = med.groupBy(*by).agg(
        F.max(F.when(F.col("_missed") == 1, F.col("median"))).alias("fn_median"),
        F.max(F.when(F.col("_missed") == 0, F.col("median"))).alias("tp_median"),
    )
    test = mann_whitney(long, by, "_missed", "value").withColumnsRenamed(
        {"n1": "n_fn", "n2": "n_tp", "p_value": "mann_whitney_p"}
    )
    return test.join(wide, by)
