"""A query of each kind against DuckDB at the smallest size."""

import os

import pytest

from metricloom import queries, request_queries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
NAMES = [n for n in ("flagship", "op_point", "op_window", "op_lead", "op_trend", "op_weighted_window", "op_filtered_compare", "range_full_year", "cut_rank", "cut_abc_class", "hook_slope", "hook_streak", "hook_cohort_retention", "agg_percentile", "agg_mode", "agg_list_agg", "filter_ilike", "filter_mask", "cuts_ignore_filters", "over_last_n", "fn_date_diff", "fn_json_extract", "mfn_weighted_avg_scalars", "source_physical_join", "source_sql_model", "filter_is_null", "fn_hash_bucket", "cut_zscore", "cut_normalize", "cut_contribution", *request_queries.QUERIES)]


def close(a, b):
    return a == b or (isinstance(a, float) and abs(a - b) <= 1e-5 * max(1, abs(a)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r)
    a = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=order)
    b = sorted((tuple(r[want.columns.index(c)] for c in sorted(want.columns)) for r in want.fetchall()), key=order)
    assert len(a) == len(b) and all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
