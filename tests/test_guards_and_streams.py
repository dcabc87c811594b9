"""Order rules, streams, bundles, scans, selections and statistics on small exact cases."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.operators import bundles, diagnostics, order_plan, selection, session_entries, statistics, sweep, tables
from barlake.operators import evaluate as V
from barlake.operators import orders as O
from barlake.operators import preprocess as R
from barlake.sources import ingest
from barlake.streaming import corrections, fills, once


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=k)


def at(minute):
    return datetime.datetime(2024, 1, 2, 14, 30) + datetime.timedelta(minutes=minute)


# ---- orders

ACCOUNT = "account int, as_of timestamp, equity double, last_equity double, cash double, buying_power double, shorting_enabled boolean, allow_short boolean, unmanaged_notional double"


def planned(spark, targets, positions, account, policy, waiting=(), prices=(("A", 10.0), ("B", 20.0), ("C", 50.0)), easy=True, limits=()):
    frame = spark.createDataFrame
    out = order_plan.order_plan(
        frame(targets, "account int, symbol string, target_weight double"), frame(positions, "account int, symbol string, quantity double"), frame(list(prices), "symbol string, price double"), frame([account], ACCOUNT),
        frame(list(waiting), "account int, symbol string"), frame([(s, easy, easy) for s, _ in prices], "symbol string, shortable boolean, easy_to_borrow boolean"),
        frame(list(limits), "symbol string, max_weight double, max_notional double, max_share double"), policy,
    )
    return {r.symbol: r for r in out.collect()}


def account(equity=10000.0, last=10000.0, cash=5000.0, power=0.0, shorts=True, unmanaged=0.0):
    return (1, at(0), equity, last, cash, power, True, shorts, unmanaged)


def test_orders_flatten_first_borrow_and_spend_in_symbol_order(spark):
    policy = order_plan.Policy(max_position_weight=0.5, max_gross_exposure=1.0, max_order_notional=1e9)
    got = planned(spark, [(1, "A", -0.2), (1, "B", 0.4), (1, "C", 0.4)], [(1, "A", 30.0)], account(cash=3000.0), policy)
    assert (got["A"].reason, got["A"].quantity, got["A"].side) == ("flatten_before_reverse", 30.0, "sell")
    # 3,000 of cash and 300 of the sale: B gets 3,300 of its 4,000, nothing is left for C
    assert (got["B"].reason, got["B"].quantity) == ("open_long", 165.0) and (got["C"].sent, got["C"].reason, got["C"].quantity) == (False, "no_budget", None)
    assert got["B"].client_order_id == "plan-202401021430-strategy-B-b"
    short = planned(spark, [(1, "A", -0.1255)], [], account(), policy)["A"]
    assert (short.reason, short.quantity, short.side) == ("open_short", 125.0, "sell")
    assert planned(spark, [(1, "A", -0.1)], [], account(), policy, easy=False)["A"].reason == "not_borrowable"
    assert {r.reason for r in planned(spark, [(1, "A", -0.1), (1, "B", 0.1)], [], account(shorts=False), policy).values()} == {"short_targets_refused"}
    cover = planned(spark, [(1, "A", -0.05)], [(1, "A", -100.0)], account(cash=0.0), policy)["A"]
    assert (cover.reason, cover.quantity, cover.side) == ("cover_short", 50.0, "buy")


def test_orders_after_a_loss_with_limits_and_without_reason(spark):
    policy = order_plan.Policy(max_position_weight=0.5, max_order_notional=500.0, min_trade_notional=50.0, limit_offset_bps=10.0, market_exits=True)
    lost = planned(spark, [(1, "A", 0.3)], [(1, "A", 1.0), (1, "B", -3.0)], account(equity=9000.0), policy)
    assert (lost["A"].reason, lost["A"].quantity, lost["A"].limit_price) == ("daily_loss_exit", 1.0, None) and (lost["B"].reason, lost["B"].side) == ("daily_loss_exit", "buy")
    got = planned(spark, [(1, "A", 0.3), (1, "B", 0.2), (1, "C", 0.001), (1, "D", 0.1)], [(1, "B", 100.0)], account(), policy, waiting=[(1, "E")])
    assert (got["A"].limit_price, round(got["A"].quantity, 6)) == (10.01, round(math.floor(500 / 10.01 * 1e6) / 1e6, 6))
    assert (got["B"].reason, got["C"].reason, got["D"].reason) == ("at_target", "below_minimum", "no_price")
    assert planned(spark, [(1, "A", 0.1)], [], account(), policy, waiting=[(1, "A")])["A"].reason == "open_order"
    assert planned(spark, [(1, "A", 0.1)], [], account(equity=0.0), policy)["A"].reason == "no_equity"
    assert planned(spark, [(1, "A", -0.0005)], [], account(), order_plan.Policy(min_trade_notional=1.0))["A"].reason == "at_target"
    capped = planned(spark, [(1, "A", 0.3)], [], account(), policy, limits=[("A", 0.01, None, None)])["A"]
    assert capped.target_weight == pytest.approx(0.01)
    held = planned(spark, [(1, "A", 0.4), (1, "B", 0.4)], [], account(unmanaged=5000.0), policy)
    assert held["A"].target_weight == held["B"].target_weight == pytest.approx(0.25)
    assert planned(spark, [], [], account(), policy) == {}


def test_latest_fills_keep_the_last_report(spark):
    rows = [("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, 1.0), ("a", 2, 4.0)]
    assert {(r.client_order_id, r.filled_quantity) for r in O.latest_fills(spark.createDataFrame(rows, "client_order_id string, seen_at int, filled_quantity double")).collect()} == {("a", 4.0), ("b", 1.0)}


# ---- streams

def streamed(spark, tmp_path, batches, schema):
    """A stream that reads one file for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


VERSION = "timestamp timestamp, symbol string, open double, high double, low double, close double, volume double, seen_at int"


def version(minute, close, seen, symbol="A"):
    return (at(minute), symbol, close, close, close, close, 1.0, seen)


def test_corrected_and_late_bars_are_those_of_the_newest_batch(spark, tmp_path):
    batches = [[version(0, 1.0, 1), version(15, 2.0, 2), version(15, 2.5, 9)], [version(15, 2.1, 3), version(30, 3.0, 4)], [version(0, 1.1, 5), version(45, 4.0, 6), version(15, 2.2, 7)]]
    stream = streamed(spark, tmp_path, batches, VERSION)
    sink = corrections.merge_bars(spark, f"{tmp_path}/bars", stream.schema, "r")
    once.run_into(stream, sink, f"{tmp_path}/c")
    sink(spark.createDataFrame(batches[1], VERSION), 1)  # a batch that is run again
    want = [(0, 1.1), (15, 2.5), (30, 3.0), (45, 4.0)]
    got = lambda path: sorted((int((r.timestamp - at(0)).total_seconds() // 60), r.close) for r in corrections.merged_bars(spark, path, stream.schema).collect())
    assert got(f"{tmp_path}/bars") == want
    corrections.compact_bars(spark, f"{tmp_path}/bars", f"{tmp_path}/small", stream.schema)
    assert got(f"{tmp_path}/small") == want and once.read_ledger(spark, f"{tmp_path}/small", corrections._shape(stream.schema, corrections.VALUES, "seen_at")).count() == 4
    closed = corrections.latest_bars(stream, "30 minutes")
    closed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    left = sorted((int((r.timestamp - at(0)).total_seconds() // 60), r.close) for r in spark.read.schema(closed.schema).parquet(f"{tmp_path}/out").collect())
    assert left == [(0, 1.1), (15, 2.5)]


def test_each_bar_is_taken_once_whatever_is_run_again(spark, tmp_path):
    schema = "symbol string, timestamp timestamp, close double"
    batches = [[("A", at(0), 1.0), ("A", at(0), 1.0), ("B", at(0), 2.0)], [("A", at(15), 3.0), ("B", at(-15), 9.0)]]
    stream = streamed(spark, tmp_path, batches, schema)
    shape = StructType.fromDDL(schema)
    once.start_ledger(spark, f"{tmp_path}/l", shape)
    sink = once.once_per_bar(f"{tmp_path}/l", shape, once.run_name("one"), ["symbol"], "timestamp")
    ledger = lambda: sorted((r.symbol, r.close) for r in once.read_ledger(spark, f"{tmp_path}/l", shape).collect())
    want = [("A", 1.0), ("A", 3.0), ("B", 2.0)]  # B's late bar is not newer than its mark
    for _ in range(2):
        once.run_into(stream, sink, f"{tmp_path}/c")
        assert ledger() == want
    sink(spark.createDataFrame(batches[0], schema), 0)
    assert ledger() == want
    once.run_into(stream, once.once_per_bar(f"{tmp_path}/l", shape, once.run_name("two"), ["symbol"], "timestamp"), f"{tmp_path}/c2")
    assert ledger() == want
    doubled = once.once_per_bar(f"{tmp_path}/m", shape, "r", ["symbol"], "timestamp", lambda new: new.withColumn("close", F.col("close") * 2))
    once.start_ledger(spark, f"{tmp_path}/m", shape)
    doubled(spark.createDataFrame(batches[1], schema), 0)
    assert sorted(r.close for r in once.read_ledger(spark, f"{tmp_path}/m", shape).collect()) == [6.0, 18.0]


def test_fill_events_of_a_short_and_of_quotes_that_do_not_come(spark, tmp_path):
    quote = lambda minute, bid, ask, reference, target, easy=True, symbol="A": (symbol, at(minute), bid, ask, reference, target, easy, easy, "status")
    schema = "symbol string, timestamp timestamp, bid double, ask double, reference_price double, target_weight double, shortable boolean, easy_to_borrow boolean, borrow_status string"
    rows = [
        [quote(0, 99.9, 100.1, 100.0, -0.1), quote(0, 9.0, 9.1, 9.0, -0.1, symbol="B"), quote(0, 5.0, 5.1, 5.0, -0.1, symbol="C")],
        [quote(15, 99.99, 100.01, 100.0, 0.0), quote(15, 9.0, 9.1, 9.0, -0.1, easy=False, symbol="B"), quote(15, 4.0, 5.1, 5.0, 0.0, symbol="C")],
        [quote(50, 99.48, 99.5, 99.0, 0.0), quote(60, 99.48, 99.5, 99.49, 0.0), quote(60, 99.48, 99.5, 99.49, 0.0), quote(55, 1.0, 1.1, 1.0, -0.5)],
        [quote(200, 9.0, 9.1, 9.0, 0.0, symbol="B")],
    ]
    events = fills.fill_events(streamed(spark, tmp_path, rows, schema), 100_000.0, 2.0, 15, "10 minutes")
    events.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(events.schema).parquet(f"{tmp_path}/out").orderBy("symbol", "observed_at").collect()
    minute = lambda t: int((t - at(0)).total_seconds() // 60)
    quiet = [("A", k, "missed_exit", "no_quote") for k in range(75, 190, 15)]  # told by the timer
    assert [(r.symbol, minute(r.observed_at), r.action, r.reason) for r in got] == [
        ("A", 15, "entry", "marketable_etb"), ("A", 30, "missed_exit", "no_quote"), ("A", 45, "missed_exit", "no_quote"), ("A", 50, "missed_exit", "limit_not_marketable"), ("A", 55, "missed_exit", "limit_not_marketable"), *quiet,
        ("B", 15, "blocked_entry", "not_easy_to_borrow"), ("B", 200, "entry", "marketable_etb"), ("C", 15, "blocked_entry", "limit_not_marketable"),
    ]
    entry = got[0]
    assert entry.quantity == pytest.approx(0.1 * 100_000 / 99.99) and entry.spread_bps == pytest.approx(2.0) and minute(entry.signal_timestamp) == 0 and entry.limit_price == pytest.approx(99.98)


# ---- bundles

GOOD = {
    "bundle_schema_version": "candidate_bundle_v1", "candidate_id": "c", "name": "n", "source_project_version": "1", "signal_spec": {"kind": "expression", "expression": "close"}, "economic_hypothesis": "h",
    "required_inputs": ["close"], "frequency": "1Day", "lookback": 5, "approval_status": "approved", "created_at": "2024-01-01", "data_fingerprint": "x",
}


def judged(spark, *texts):
    rows = [(i, t if isinstance(t, str) or t is None else json.dumps(t)) for i, t in enumerate(texts)]
    out = bundles.validate_bundles(spark.createDataFrame(rows, "k int, json string"), "k").orderBy("k").collect()
    return [(r.errors, r.warnings, r.ok) for r in out]


def test_bundles_are_data_at_any_depth(spark):
    deep = "[" * 70 + "]" * 70
    executable = '{"schema_version":"1","candidate_id":"c","expression":{"eval":{"pickle":1}},"lookback":"5","expected_sign":"1"}'
    got = judged(spark, GOOD, {**GOOD, "evaluation_summary": {"a": [{"b": {"Lambda_x": 1}}]}}, "[1]", "{bad", None, '{"a":1,"a":2}', {**GOOD, "evaluation_summary": {"x": json.loads(deep)}}, {**GOOD, "name": 'a "eval": {[ b', "approval_status": "draft"}, executable)
    assert got[0] == ([], [], True) and got[1] == (["forbidden:Lambda_x"], [], False)
    assert [g[0] for g in got[2:6]] == [["json"]] * 4 and got[6][0] == ["depth"] and got[7] == ([], ["not_approved"], True)
    assert {"forbidden:eval", "forbidden:pickle"} <= set(got[8][0]) and not got[8][2]
    flat = tables.check_bundles(spark.createDataFrame([(executable,)], "json string")).collect()[0]
    assert not flat.ok and flat.errors == ["executable:eval", "executable:pickle"]
    kept, rejected = bundles.import_bundles(spark.createDataFrame([(1, json.dumps(GOOD)), (2, executable)], "k int, json string"), "k")
    assert [(r.k, r.state, r.paper_enabled) for r in kept.collect()] == [(1, "quarantined", False)] and [r.k for r in rejected.collect()] == [2]
    empty = spark.createDataFrame([], "k int, json string")
    assert bundles.validate_bundles(empty, "k").collect() == [] and bundles.walk(empty, "k").collect() == []


def test_whole_numbers_and_types_of_bundles(spark):
    got = judged(spark, *[{**GOOD, "lookback": v} for v in (1, 0, -3, 2.5, "7", True, None)], json.dumps(GOOD).replace('"lookback": 5', '"lookback": 123456789012345678901'))
    assert [g[2] for g in got] == [True, False, False, False, False, False, False, True]


def test_steps_that_bundles_ask_for(spark):
    texts = ['{"winsorize": false}', '{"winsorize": "", "cross_sectional_zscore": 1}', '[{"kind": "", "op": "Winsor"}]', "[]", "3", None, '[{"x": 1}]', '[{"kind": "zscore"}, 4]']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, json string").select("k", R.bundle_steps(F.col("json")).alias("s")).orderBy("k").collect()
    assert [(r.s.winsor, r.s.zscore) for r in rows] == [(False, True), (False, True), (True, False), (True, True), (True, True), (True, True), (True, True), (False, True)]


# ---- scans

def test_company_facts_with_odd_values(spark, tmp_path):
    point = {"val": 1.5, "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01", "start": "2024-01-01", "end": "2024-03-31", "accn": "1"}
    facts = {"us-gaap": {"Assets": {"units": {"USD": [point, {"val": 2, "end": "never"}]}}, "None": {"units": {}}}, "dei": {"Shares": {"units": {"shares": [point]}}}}
    rows = [("abc", json.dumps({"cik": 3, "facts": facts})), ("bad", "{"), ("none", json.dumps({"facts": {}})), ("null", None)]
    got = ingest.company_facts(spark.createDataFrame(rows, "symbol string, json string")).collect()
    assert [(r.symbol, r.concept, r.unit, r.val, r.fy, r.end) for r in got] == [("ABC", "Assets", "USD", 1.5, 2024, datetime.date(2024, 3, 31)), ("ABC", "Assets", "USD", 2.0, None, None)]
    (tmp_path / "xyz.json").write_text(json.dumps({"facts": facts}, indent=1))
    assert {(r.symbol, r.concept) for r in ingest.scan_company_facts(spark, str(tmp_path)).collect()} == {("XYZ", "Assets")}
    ingest.write_company_facts(ingest.scan_company_facts(spark, str(tmp_path)), f"{tmp_path}/out")
    assert ingest.scan_company_facts(spark, f"{tmp_path}/out").count() == 2


# ---- selections

def held_by_hand(rows, dates, n, exit_rank, per_sector, rivals):
    held, out = [], []
    for d in dates:
        names = [r for r in rows if r[0] == d]
        info = {r[1]: r for r in names}
        order = [r[1] for r in sorted(names, key=lambda r: (r[2], r[1]))]
        kept = [s for s in held if s in info and info[s][2] <= exit_rank]
        chosen = []
        for walk, test in ((kept + [s for s in order[: max(3 * exit_rank, 5 * n)] if s not in kept], True), (order, False)):
            for s in walk:
                full = sum(info[x][3] == info[s][3] for x in chosen) >= per_sector
                if len(chosen) < n and s not in chosen and not full and not (test and any(frozenset((d, s, x)) in rivals for x in chosen)):
                    chosen.append(s)
        held = [s for s in chosen if info[s][4]]
        out += [(d, s, k) for k, s in enumerate(held)]
    return out


def test_selection_in_runs_equals_the_fold_by_hand(spark):
    r = np.random.default_rng(3)
    dates = [day(k) for k in range(40)]
    rows = []
    for d in dates:
        names = [f"N{i}" for i in r.permutation(14)][: 0 if r.random() < 0.2 else 12]
        rows += [(d, s, k + 1, f"G{int(s[1:]) % 3}", bool(r.random() < 0.9)) for k, s in enumerate(names)]
    pairs = [(d, f"N{i}", f"N{j}", float(r.random())) for d in dates for i in range(14) for j in range(14) if f"N{i}" < f"N{j}"]
    frame = spark.createDataFrame(rows, "timestamp date, symbol string, rank int, sector string, usable boolean")
    grid = spark.createDataFrame([(0, 3, 4, 2, 0.4), (1, 2, 2, 1, 0.9), (2, 4, 3, 2, 0.1)], "variant_id int, n int, exit_rank int, per_sector int, max_corr double")
    days = spark.createDataFrame([(d,) for d in dates], "timestamp date")
    ranked = frame.crossJoin(grid)
    got = selection.select_held(ranked, days, spark.createDataFrame(pairs, "timestamp date, a string, b string, corr double")).collect()
    assert selection.with_runs(ranked, days).select("variant_id", "run").distinct().count() > 9
    for v, n, exit_rank, per_sector, limit in ((0, 3, 4, 2, 0.4), (1, 2, 2, 1, 0.9), (2, 4, 3, 2, 0.1)):
        rivals = {frozenset((d, a, b)) for d, a, b, c in pairs if c > limit}
        assert sorted((x.timestamp, x.symbol, x.place) for x in got if x.variant_id == v) == sorted(held_by_hand(rows, dates, n, exit_rank, per_sector, rivals))


# ---- statistics

def test_sweep_equals_variants_run_one_by_one(spark):
    r = np.random.default_rng(5)
    rows = []
    for s in "ABCDE":
        price = 100 * np.exp(np.cumsum(r.normal(0, 0.02, 60)))
        rows += [(day(k), s, float(p * (1 + r.normal(0, 0.001))), None if r.random() < 0.03 else float(p)) for k, p in enumerate(price)]
    panel = spark.createDataFrame(rows, "timestamp date, symbol string, open double, close double").cache()
    close = {s: np.array([x[3] if x[3] is not None else np.nan for x in rows if x[1] == s]) for s in "ABCDE"}
    signals = {(x.timestamp, x.symbol, x.lookback, x.volatility): x.score for x in sweep.momentum_signals(panel, [(3, 4), (5, 6)]).collect()}
    for s, c in close.items():
        ret = np.append(np.nan, c[1:] / c[:-1] - 1)
        for k in range(60):
            for look, v in ((3, 4), (5, 6)):
                score = (c[k] / c[k - look] - 1) / (np.std(ret[k - v + 1 : k + 1], ddof=1) * np.sqrt(252)) if k >= max(look, v) else np.nan
                assert (signals.get((day(k), s, look, v)) == pytest.approx(score, rel=1e-6)) if score > 0 else (day(k), s, look, v) not in signals
    grid = statistics.grid(spark, {"lookback": [3, 5], "volatility": [4], "top_n": [1, 3], "every": [1, 5]})
    got = {(x.variant_id, x.timestamp): (x.daily_return, x.turnover) for x in sweep.sweep_returns(panel, grid, 1.0, 10.0).collect()}
    for g in grid.collect():
        targets = sweep.momentum_signals(panel, [(g.lookback, g.volatility)])
        one = V.variant_returns(panel, targets, spark.createDataFrame([(g.variant_id, g.every, 10.0, g.top_n)], "variant_id int, every long, bps double, limit long"))
        for x in one.collect():
            assert got[g.variant_id, x.timestamp] == (pytest.approx(x.daily_return, abs=1e-12), pytest.approx(x.turnover, abs=1e-12))
    ranked = sweep.sweep(panel, grid).orderBy("place").collect()
    assert len(ranked) == 8 and [x.robust_score for x in ranked] == sorted((x.robust_score for x in ranked), reverse=True) and all(x.robust_score == min(x.train_sharpe, x.test_sharpe) for x in ranked)


def test_bootstrap_draws_each_stream_alone(spark):
    rows = [("a", day(k), 0.01 * (k % 5 - 2)) for k in range(30)] + [("b", day(k), 0.5) for k in range(3)]
    got = {x.variant_id: x for x in statistics.session_bootstrap(spark.createDataFrame(rows, "variant_id string, session date, daily_return double"), 1203).collect()}
    values = np.array([x[2] for x in rows if x[0] == "a"])
    b, j = np.arange(1203, dtype=np.int64)[:, None], np.arange(30, dtype=np.int64)
    sums = values[statistics.bootstrap_index(b, j, 30)].sum(axis=1)
    assert (got["a"].sessions, got["a"].p50) == (30, pytest.approx(np.quantile(sums, 0.5), abs=1e-12)) and got["a"].p975 == pytest.approx(np.quantile(sums, 0.975), abs=1e-12)
    assert (got["b"].p025, got["b"].positive) == (pytest.approx(1.5), 1.0)


def test_diagnostics_of_positions_and_forced_exits(spark):
    rows = [(1, f"p{k}", "AB"[k % 2], day(k % 4), v, 100.0) for k, v in enumerate((5.0, -1.0, 2.0, -3.0, 4.0, 1.0))]
    positions = spark.createDataFrame(rows, "variant_id int, position string, symbol string, session date, pnl double, gross_notional double")
    x = diagnostics.position_report(positions, spark.createDataFrame([(day(k),) for k in range(6)], "session date"), 100.0, (1,)).collect()[0]
    d = np.array([9.0, 0.0, 2.0, -3.0, 0.0, 0.0]) / 100
    assert (x.positions, x.sessions, x.active_sessions, x.win_rate) == (6, 6, 3, pytest.approx(4 / 6)) and x.autocorrelation_1 == pytest.approx(np.corrcoef(d[1:], d[:-1])[0, 1])
    assert x.top_position_share == pytest.approx(5 / 8) and x.return_without_positions == pytest.approx((8 - 11) / 100) and x.return_without_symbols == pytest.approx(0.0)
    units = {(r.unit, r.name): r.return_without for r in diagnostics.leave_out(positions, 100.0).collect()}
    assert units["symbol", "A"] == pytest.approx(-0.03) and units["session", str(day(0))] == pytest.approx(-0.01)
    prices = [(day(k), s, c) for s, cs in (("L", (10.0, None, None, None, 12.0)), ("S", (20.0, None, None, 21.0, None))) for k, c in enumerate(cs)]
    weights = [(day(k), s, w) for s, w in (("L", 0.5), ("S", -0.2)) for k in range(5)]
    out = diagnostics.forced_exits(spark.createDataFrame(prices, "timestamp date, symbol string, close double"), spark.createDataFrame(weights, "timestamp date, symbol string, weight double"), 2, 0.1)
    got = {(r.symbol, (r.timestamp - day(0)).days): (r.weight, r.side, r.exit_price, r.exit_return, r.exit_reason) for r in out.collect()}
    assert got["L", 2] == (0.0, "sell", 9.0, pytest.approx(-0.05), diagnostics.MISSING) and got["S", 2][1:3] == ("buy", 22.0)
    assert got["L", 1] == (0.5, None, None, None, None) and got["L", 3][0] == 0.0 and got["L", 4][0] == 0.5 and got["S", 4][0] == -0.2


def test_walk_forward_pays_for_turnover(spark):
    rows = [(datetime.date(2020 + y, 1 + m, 1), v, 0.01 * (1 + (m + v) % 2), 5.0 * v) for y in range(3) for m in range(12) for v in (0, 1)]
    returns = spark.createDataFrame(rows, "timestamp date, variant_id int, daily_return double, turnover double")
    got = {r.year: r for r in diagnostics.walk_forward(returns, 2).collect()}
    assert set(got) == {2022} and got[2022].variant_id == 0 and got[2022].test_return > 0
    regimes = spark.createDataFrame([("all", datetime.date(2019, 1, 1), datetime.date(2030, 1, 1)), ("none", datetime.date(1990, 1, 1), datetime.date(1990, 2, 1))], "name string, start date, end date")
    assert {(r.variant_id, r.regime, r.n) for r in diagnostics.regime_table(returns, regimes).collect()} == {(0, "all", 36), (1, "all", 36)}


def test_entries_need_market_liquidity_and_recovery(spark):
    rows = []
    for s, closes, volume in (("X", (100, 99, 98, 98.5), 1e6), ("Y", (50, 49, 48, 47), 1e6), ("Z", (20, 19, 18, 18.5), 10.0), ("M", (10, 10.1, 10.2, 10.3), 1e6)):
        rows += [(datetime.datetime(2024, 1, 2, 15, 15 * k), s, day(1), float(c), float(c), float(c), float(c), volume) for k, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "timestamp timestamp, symbol string, session date, open double, high double, low double, close double, volume double")
    rule = session_entries.Entry(signal=645, flat=660, lookback=2, threshold=0.001, top_n=2, cap=0.6, gross=1.0, min_dollars=1000.0)
    names = lambda **k: {r.symbol: r.target_weight for r in session_entries.daily_entries(bars, session_entries.Entry(**{**rule.__dict__, **k}), "M").collect()}
    assert names() == {"X": 0.5, "Y": 0.5} and names(recovery=True) == {"X": 0.6} and names(min_dollars=1.0, recovery=True) == {"X": 0.5, "Z": 0.5}
    down = bars.withColumn("close", F.when((F.col("symbol") == "M") & (F.minute("timestamp") == 45), 9.0).otherwise(F.col("close")))
    assert session_entries.daily_entries(down, rule, "M").collect() == [] and names(flat=645)["X"] == 0.0
    book = session_entries.ranked_book(bars, session_entries.Book(signal=645, flat=660, lookback=2, per_side=1, cap=0.3, min_dollars=0.0), "M").collect()
    weights = sorted((r.symbol, r.target_weight) for r in book if r.target_weight)
    assert weights == [("X", 0.3), ("Y", -0.3)]  # relative to the benchmark X has lost least over two bars, Y most
