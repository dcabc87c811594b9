"""Every third query with an SQL form, and some more, agree with it at the smallest scale; the driver compares them all."""

import os

import duckdb
import pytest

from barlake.plans.catalogue import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


def table(p):
    p = p[sorted(p.columns)].copy()
    for k in p.columns:
        number = p[k].dtype.kind in "iufb" and p[k].dtype != object
        p[k] = p[k].astype(float).round(5) + 0.0 if number else p[k].astype(str).replace({"None": "-", "nan": "-", "NaT": "-", "<NA>": "-"})
    return p.sort_values(list(p.columns)).reset_index(drop=True)


SAMPLE = sorted(ORACLES)[::3] + ["h02_metrics", "j01_rebalance_orders", "i04_causal_periods", "k01_stream_bars", "j01_guarded_order_plan", "k02_corrected_bars", "k03_once_per_bar", "k04_fill_events", "e06_decorrelated_variants", "h05_parameter_sweep", "e19_setup_regression", "l01_bundle_rules"]


@pytest.mark.parametrize("name", sorted(set(SAMPLE)))
def test_query_equals_sql(name, spark, duck, sf):
    x, y = table(QUERIES[name](spark, sf).toPandas()), table(duck.sql(ORACLES[name]).df())
    assert list(x.columns) == list(y.columns)
    assert len(x) == len(y)
    for k in x.columns:
        assert ((x[k] == y[k]) | (x[k].isna() & y[k].isna())).all(), k


def test_every_query_has_a_name_once_and_flagship_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
