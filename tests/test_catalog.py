"""The registered queries: contract, plans, and a cross-section against the SQL."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

SAMPLE = (
    "country_rollup", "day_stats", "interpolate_gaps", "gap_runs", "distribution_stats", "rank_of_cell", "area_summary", "describe_cell",
    "acf_peaks", "periodogram_peaks", "component_strength", "kpss", "anomaly_enrich", "holiday_enrichment", "check_splits", "design_matrix",
    "metric_table", "copying_report", "worst_windows", "cross_area_mase", "fact_dataset", "log_best", "scan_run_log", "baseline_mase",
)


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 140


@needs_data
def test_entry_runs(spark):
    rows = entry(spark).collect()
    assert len(rows) == 12 and {r["model"] for r in rows} == {"persistence", "seasonal_naive"}


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_queries import TABLES, norm

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda row: tuple("" if x is None else x for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)
