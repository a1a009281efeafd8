"""Registered queries against DuckDB. A sample runs by default; SIGEVAL_ALL_QUERIES=1 runs every one."""

import math
import os

import duckdb
import pytest

SF = os.environ.get("SIGEVAL_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = {
    "split_report", "eer_interp", "error_groups", "boot_auc_ci", "boot_delta_eer", "delong_z", "compact_report", "split_overlap", "knn_topk",
    "group_split", "windows_controlled", "window_descriptors", "perturb_sweep", "robustness_summary", "multiseed_summary", "result_docs_flatten",
    "near_dup_pairs", "near_dup_confirm", "norm_stats", "normalize", "perturb_reverb", "parent_id", "confusion_percent", "status_rollup", "midranks",
    "auc_exact", "multiseed_status", "window_table_medians", "boot_row_ci", "paired_table",
    "spectral_values", "channel_norm_stats", "channel_normalize", "result_docs_roundtrip", "stream_windows", "stream_late",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def names():
    import __spark_entry__ as entry

    known = entry.oracle_sql()
    assert set(known) <= set(entry.queries())
    return sorted(known if os.environ.get("SIGEVAL_ALL_QUERIES") else SAMPLE)


@pytest.mark.parametrize("name", names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
