"""Small cases of what larger tables showed, most of them against the query's own SQL."""

import datetime as dt
import json
import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from barlake.operators import bundles, selection, universe
from barlake.plans.catalogue import ORACLES, QUERIES


def tables(path, **columns):
    """Writes each table as Parquet, as the driver's files are; the folder and a DuckDB connection with its views."""
    duck = duckdb.connect()
    for name, of in columns.items():
        pq.write_table(pa.table(of), f"{path}/{name}.parquet")
        duck.sql(f"create view {name} as select * from '{path}/{name}.parquet'")
    return str(path), duck


def lines(suppliers, days, discount):
    """lineitem with a line for each supplier and day; discount(supplier, day) says its discount."""
    cells = [(s, d) for s in suppliers for d in range(days)]
    when = [dt.datetime(1995, 1, 2) + dt.timedelta(days=d) for _, d in cells]
    return {
        "l_orderkey": pa.array([d for _, d in cells], pa.int64()), "l_partkey": pa.array([s for s, _ in cells], pa.int64()), "l_suppkey": pa.array([s for s, _ in cells], pa.int64()),
        "l_linenumber": pa.array([1] * len(cells), pa.int32()), "l_quantity": pa.array([1.0] * len(cells)), "l_extendedprice": pa.array([10.0] * len(cells)),
        "l_discount": pa.array([discount(s, d) for s, d in cells]), "l_tax": pa.array([0.04] * len(cells)), "l_shipdate": pa.array(when, pa.timestamp("us")),
    }


def test_overlap_of_two_empty_sets_is_that_of_its_sql(spark, tmp_path):
    path, duck = tables(tmp_path, lineitem=lines(range(3), 4, lambda s, d: 0.05))  # prices stay, so no name has a signal
    mine, want = QUERIES["f08_signal_overlap"](spark, path).first(), duck.sql(ORACLES["f08_signal_overlap"]).fetchall()[0]
    assert tuple(mine)[:4] == want[:4] == (0, 0, 0, 0)
    assert math.isnan(want[4]) and mine["jaccard"] is not None and math.isnan(mine["jaccard"])
    none = spark.createDataFrame([], "timestamp int, symbol string")
    assert universe.overlap(none, none, ["timestamp", "symbol"]).first()["jaccard"] is None  # the operator's missing is null


def test_candidates_are_few_and_give_what_whole_pools_give(spark):
    r = np.random.default_rng(8)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(12)]
    rows = []
    for d in dates:
        rows += [(d, f"N{i}", k + 1, f"G{0 if k < 12 else i % 4}", bool(r.random() < 0.8)) for k, i in enumerate(r.permutation(60))]  # the first are of one sector
    pools = spark.createDataFrame(rows, "timestamp date, symbol string, rank int, sector string, usable boolean")
    grid = spark.createDataFrame([(0, 3, 2, 1, 0.2), (1, 2, 3, 2, 0.6), (2, 1, 1, 1, 0.9)], "variant_id int, n int, exit_rank int, per_sector int, max_corr double")
    pairs = spark.createDataFrame([(d, f"N{i}", f"N{j}", float(r.random())) for d in dates for i in range(60) for j in range(60) if f"N{i}" < f"N{j}"], "timestamp date, a string, b string, corr double")
    days = spark.createDataFrame([(d,) for d in dates], "timestamp date")
    few = selection.candidates(pools, grid).cache()
    assert few.groupBy("timestamp").count().agg({"count": "max"}).first()[0] <= 15 + 4 * 2 < 60
    walked = few.where("walked").select("timestamp", "symbol")
    near = pairs.join(walked.withColumnRenamed("symbol", "a"), ["timestamp", "a"], "left_semi").join(walked.withColumnRenamed("symbol", "b"), ["timestamp", "b"], "left_semi")
    whole = selection.select_held(pools.crossJoin(grid), days, pairs).collect()
    assert len(whole) > 30 and sorted(selection.select_held(few.drop("walked").crossJoin(grid), days, near).collect()) == sorted(whole)


def test_decorrelated_variants_pair_walked_names_only(spark, tmp_path, monkeypatch):
    from barlake.operators import portfolio

    r = np.random.default_rng(2)
    path, _ = tables(tmp_path, supplier={"s_suppkey": list(range(600))}, lineitem=lines(range(60), 7 * 24, lambda s, d: float(r.random() / 10)))
    given, of_names = [], portfolio.trailing_pairs
    monkeypatch.setattr(portfolio, "trailing_pairs", lambda panel, names, *more: given.append(names) or of_names(panel, names, *more))
    assert QUERIES["e06_decorrelated_variants"](spark, path).count() > 0
    assert 0 < given[0].groupBy("timestamp").count().agg({"count": "max"}).first()[0] <= 15  # max(3 * 5, 5 * 3), of up to 60 names


def values(x, path="$"):
    """(path, name, kind) of all values below x."""
    kinds = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID"}
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        here = f"{path}.{k}" if isinstance(x, dict) else f"{path}[{k}]"
        yield here, k if isinstance(x, dict) else None, kinds[type(v)]
        yield from values(v, here)


ODD = [
    {"a": {"b": [1, {"c": None, "d": [[], {}, [True, 2.5]]}], "": "x"}, 'q"u\\o\nte': [{"eval": 1}]}, {"text": "x{[" * 70000, "deep": {"Exec now": "y"}}, [[["z"]]], 3, "s", {}, [],
    {"a": "run eval: {\"eval\": 1}", "medieval": {"lambda\nnow": 0, "command ": {"Ünshell": 1, "ünd-SHELL": 2}}}, {"ev\nal": 1, "é": {"python": 1}},
]


def test_walk_gives_all_values_of_odd_and_of_long_texts(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(ODD)] + [(90, "{bad"), (91, None), (92, "[" * 70 + "]" * 70), (93, '{"a":1,"a":2}')], "k int, json string")
    found = bundles.walk(rows, "k")
    want = [(i, *v) for i, x in enumerate(ODD) for v in values(x)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # a text is parsed once, not once for each level


def test_rules_move_no_rows_and_see_keys_behind_escapes(spark):
    hidden = '{"\\u0065val":{"x":[{"sub\\u002dshell":1}]},"value":"eval","a\\\\eval":1,"b\\"":{"reduce\\"d":1}}'
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(ODD)] + [(50, hidden), (51, "[" * 70 + "]" * 70)], "k int, json string")
    names = {r.k: r.names for r in bundles.forbidden_keys(rows, "k").collect()}
    assert names == {0: ["eval"], 1: ["Exec now"], 7: ["command ", "lambda\nnow", "ünd-SHELL"], 8: ["python"], 50: ["a\\eval", "eval", 'reduce"d', "sub-shell"]}
    checked = bundles.validate_bundles(rows, "k")
    assert {r.k: [e[10:] for e in r.errors if e.startswith("forbidden:")] for r in checked.where("k in (1, 7, 50)").collect()} == {k: names[k] for k in (1, 7, 50)}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_import_judges_a_bundle_once(spark, tmp_path):
    orders = {"o_orderkey": pa.array(range(200), pa.int64()), "o_custkey": pa.array([0] * 200, pa.int64())}
    path, duck = tables(tmp_path, orders=orders)
    got = QUERIES["l07_bundle_import"](spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(ORACLES["l07_bundle_import"]).fetchall())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
