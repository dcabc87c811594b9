"""Queries of files and ingest, lifecycle records, resampled statistics and small joins."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.operators import lineage, orders, statistics, tables, universe
from barlake.operators import preprocess as R
from barlake.operators import weights as W
from barlake.sources import bars as B
from barlake.sources import files, ingest

from .intraday_queries import _work_dir
from .portfolio_queries import _r6, six
from .registry import bars, panel_of, query, table, with_bars, with_panel
from .strategy_queries import _SCORE, _T, _TOP, _scores
from .table_queries import _CAND, _CUST, _EQ, _P, _candidates, _equities, _variant_metrics


def _folder(spark) -> str:
    return f"{_work_dir(spark)}/{uuid.uuid4().hex}"


# ---- files

@query(with_bars("SELECT CAST(timestamp AS TIMESTAMP) + INTERVAL 14 HOUR AS timestamp, symbol, open, high, low, close, volume FROM bars WHERE symbol IN ('S1', 'S3') AND CAST(timestamp AS TIMESTAMP) + INTERVAL 14 HOUR BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-06-30 13:59:59'"))
def a01_csv_bars(spark, sf_dir):
    """Bars written as CSV, half of the times with an offset and half without one, and read as UTC."""
    path = _folder(spark)
    b = bars(spark, sf_dir)
    local = F.date_format("timestamp", "yyyy-MM-dd")
    text = F.when(F.col("symbol") == "S1", F.concat(local, F.lit("T09:00:00-05:00"))).otherwise(F.concat(local, F.lit(" 14:00:00")))
    b.withColumn("timestamp", text).withColumn("symbol", F.lower("symbol")).select(*B.BAR_COLUMNS).write.option("header", True).csv(path)
    out = B.read_csv_bars(spark, path, ["s1", "S3"], "1995-01-01", "1995-06-30T08:59:59-05:00")
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(with_bars("SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, symbol, CASE WHEN EXTRACT(month FROM timestamp) = 3 AND EXTRACT(year FROM timestamp) = 1995 THEN close * 2 ELSE close END AS close FROM bars WHERE symbol IN ('S1', 'S2') AND timestamp >= DATE '1995-01-01'"))
def a03_bar_dataset(spark, sf_dir):
    """A dataset of bars, refreshed for one month and read for two names."""
    path = _folder(spark)
    b = bars(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("volume", F.col("volume").cast("double"))
    files.write_bars(b, path)
    fresh = b.where("year(timestamp) = 1995 and month(timestamp) = 3").withColumn("close", F.col("close") * 2)
    files.refresh_bars(spark, path, fresh)
    return files.read_bars(spark, path, ["S1", "S2"], "1995-01-01").select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", "close")


_VENDOR = """SELECT CAST(p_partkey AS VARCHAR) AS permno, '2024-01-' || LPAD(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS d, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE LOWER(LEFT(p_brand, 5)) END AS tic, -p_retailprice AS prc, p_size % 4 AS fac FROM part"""


@query(
    f"""WITH v AS ({_VENDOR}) SELECT timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP))) AS timestamp, UPPER(CASE WHEN tic = '' THEN permno ELSE tic END) AS symbol,
  {_r6('ABS(prc) / CASE WHEN fac = 0 THEN 1 ELSE fac END')} AS open, {_r6('ABS(prc) / CASE WHEN fac = 0 THEN 1 ELSE fac END')} AS close, CASE WHEN fac = 1 THEN 0.0 ELSE 100.0 END AS volume FROM v"""
)
def a07_vendor_daily(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = p.select(
        F.col("p_partkey").alias("PERMNO"), F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("Date"),
        F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.lower(F.substring("p_brand", 1, 5))).alias("Ticker"), (-F.col("p_retailprice")).alias("PRC"), F.lit(None).cast("double").alias("OPENPRC"),
        F.lit(0.0).alias("ASKHI"), F.lit("x").alias("BIDLO"), F.when(F.col("p_size") % 4 == 1, -5.0).otherwise(100.0).alias("VOL"), (F.col("p_size") % 4).alias("CFACPR"), F.lit(1.0).alias("CFACSHR"),
    )
    names = dict(zip("permno date ticker close open high low volume price_factor share_factor".split(), "permno date ticker prc openprc askhi bidlo vol cfacpr cfacshr".split(), strict=True))
    out = ingest.vendor_daily(raw, names)
    return out.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", six(F.col("open")).alias("open"), six(F.col("close")).alias("close"), "volume")


@query(with_bars(f"SELECT CAST(timestamp AS TIMESTAMP) AS timestamp, symbol, {_r6('open * 0.5')} AS open, {_r6('close * 0.5')} AS close, CAST(volume AS DOUBLE) AS volume FROM bars WHERE EXTRACT(day FROM timestamp) <> 3", "weekly10"))
def a08_chart_rows(spark, sf_dir):
    """Chart documents, one a symbol and year, with holes; adjusted closes are half of the closes."""
    b = bars(spark, sf_dir, "weekly10").withColumn("volume", F.col("volume").cast("double"))
    null = F.when(F.dayofmonth("timestamp") != 3, F.col("close"))
    point = F.struct(F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("t"), "open", "high", "low", null.alias("close"), "volume", (F.col("close") / 2).alias("adj"))
    docs = b.groupBy("symbol", F.year("timestamp").alias("y")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    pick = lambda f, name: F.transform("p", lambda x: x[f]).alias(name)
    json = F.to_json(F.struct("symbol", pick("t", "timestamp"), *[pick(c, c) for c in ("open", "high", "low", "close", "volume")], pick("adj", "adjclose")))
    out = ingest.chart_rows(docs.select(json.alias("json")))
    return out.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", six(F.col("open")).alias("open"), six(F.col("close")).alias("close"), "volume")


_LISTS = f"""ls AS (SELECT timestamp AS d, symbol FROM chosen WHERE EXTRACT(month FROM timestamp) % 3 = 0),
mo2 AS (SELECT DISTINCT CAST(DATE_TRUNC('month', timestamp) AS DATE) AS month FROM bars), ld AS (SELECT DISTINCT d FROM ls),
mm AS (SELECT month, MAX(d) AS d FROM mo2 JOIN ld ON d <= month GROUP BY month),
cm AS (SELECT DISTINCT REPLACE(symbol, 'S', 'S-') AS symbol, month FROM mm JOIN ls ON ls.d = mm.d),
ci AS (SELECT *, month - CAST(ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY month) AS INTEGER) * INTERVAL 1 MONTH AS island FROM cm)"""


@query(with_bars("""SELECT symbol, MIN(month) AS "start", LAST_DAY(MAX(month)) AS "end" FROM ci GROUP BY symbol, island""", extra=_CAND + "," + _LISTS))
def a09_constituents(spark, sf_dir):
    """Quarterly lists of members, some marked as former ones, as periods of membership."""
    b = bars(spark, sf_dir)
    chosen = universe.top_liquid(_candidates(spark, sf_dir), 4).where(F.month("timestamp") % 3 == 0)
    name = F.concat(F.regexp_replace("symbol", "S", "s."), F.when(F.substring("symbol", 2, 1).cast("int") % 2 == 0, "-202401").otherwise(""))
    lists = chosen.groupBy(F.col("timestamp").alias("date")).agg(F.array_join(F.collect_list(name), ",").alias("members"))
    return files.constituents(lists, b.select(F.trunc("timestamp", "MM").alias("month")).distinct())


_RULES = r"""CASE WHEN ex NOT IN ('NYSE', 'AMEX') THEN 'exchange' WHEN LENGTH(s) > 6 THEN 'symbol_length' WHEN regexp_matches(s, '[0-9]') THEN 'numeric_symbol' WHEN regexp_matches(s, '[/^\- ]') OR regexp_matches(s, '\.(U|W|WS|R)$') THEN 'security_suffix'
  WHEN regexp_matches(n, '\b(FUND|UNITS?|NOTES?|VANGUARD)\b') THEN 'security_type' WHEN CONTAINS(n, ' TRUST') AND NOT regexp_matches(n, 'COMMON|CLASS [ABC]') THEN 'trust_without_common_shares' ELSE 'candidate' END"""
_ASSETS = """las AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'AB-C' WHEN 1 THEN 'A1' WHEN 2 THEN 'ABC.WS' WHEN 3 THEN 'TOOLONGX' ELSE 'ABC' END AS s, CASE p_size % 6 WHEN 0 THEN 'Vanguard Index' WHEN 1 THEN 'Acme Trust' WHEN 2 THEN 'Acme Trust Class A' WHEN 3 THEN 'Some Fund' ELSE 'Acme Corp' END AS n0,
  CASE WHEN p_brand = 'Brand#11' THEN 'OTC' WHEN p_partkey % 2 = 0 THEN 'nyse' ELSE 'AMEX' END AS ex0 FROM part), la AS (SELECT p_partkey, s, UPPER(n0) AS n, UPPER(ex0) AS ex FROM las)"""


@query(f"WITH {_ASSETS} SELECT p_partkey, {_RULES} AS classification FROM la")
def a12_classify_listings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, z = F.col("p_partkey") % 7, F.col("p_size") % 6
    symbol = F.when(k == 0, "AB-C").when(k == 1, "A1").when(k == 2, "ABC.WS").when(k == 3, "TOOLONGX").otherwise("abc")
    name = F.when(z == 0, "Vanguard Index").when(z == 1, "Acme Trust").when(z == 2, "Acme Trust Class A").when(z == 3, "Some Fund").otherwise("Acme Corp")
    exchange = F.when(F.col("p_brand") == "Brand#11", "OTC").when(F.col("p_partkey") % 2 == 0, "nyse").otherwise("AMEX")
    rows = p.select("p_partkey", symbol.alias("symbol"), name.alias("name"), exchange.alias("exchange"))
    return rows.select("p_partkey", ingest.classify_listing("symbol", "name", "exchange").alias("classification"))


@query(with_bars("SELECT timestamp, symbol, CAST(liquidity_rank AS INTEGER) AS liquidity_rank FROM chosen WHERE timestamp = (SELECT MAX(timestamp) FROM chosen)", extra=_CAND))
def a13_universe_snapshot(spark, sf_dir):
    return universe.snapshot(universe.top_liquid(_candidates(spark, sf_dir), 4))


_BUNDLE = "SELECT s_suppkey, 'c' || s_suppkey AS id, s_suppkey % 3 AS k FROM supplier"


def _bundle_json(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 3
    signal = F.when(k != 2, F.struct(F.concat(F.lit("ts_mean(close,"), F.col("s_suppkey"), F.lit(")")).alias("expression")))
    summary = F.when(k == 0, F.create_map(F.lit("approval_state"), F.lit("approved"))).when(k == 1, F.create_map(F.lit("approval_state"), F.lit("")))
    body = F.struct(F.concat(F.lit("c"), F.col("s_suppkey")).alias("candidate_id"), F.when(k == 0, F.sha2("s_name", 256)).alias("code_hash"), signal.alias("signal_spec"), summary.alias("evaluation_summary"), F.lit("draft").alias("approval_status"))
    return s.select("s_suppkey", F.to_json(body).alias("json"))


@query(
    f"""WITH b AS ({_BUNDLE}) SELECT id AS candidate_id, CASE WHEN k = 0 THEN sha256(s_name) ELSE '' END AS code_hash, CASE WHEN k <> 2 THEN 'ts_mean(close,' || b.s_suppkey || ')' END AS expression,
  CASE WHEN k = 0 THEN 'approved' ELSE 'draft' END AS approval_state FROM b JOIN supplier s ON s.s_suppkey = b.s_suppkey"""
)
def l06_candidate_lineage(spark, sf_dir):
    """Bundles of all suppliers, written as lines, read back and picked apart."""
    path = _folder(spark)
    files.append_ledger(_bundle_json(spark, sf_dir), path)
    found = files.read_ledger(spark, path, "s_suppkey long, json string")
    return lineage.candidate_lineage(found).select("candidate_id", "code_hash", "expression", "approval_state")


@query("SELECT 'c' || s_suppkey AS candidate_id FROM supplier")
def a14_read_bundles(spark, sf_dir):
    """A folder with a file for each supplier's bundle."""
    path = _folder(spark)
    _bundle_json(spark, sf_dir).select(F.concat(F.lit("c"), "s_suppkey").alias("name"), "json").repartition("name").write.partitionBy("name").text(path)
    return files.read_bundles(spark, path, "*.txt").select(F.get_json_object("json", "$.candidate_id").alias("candidate_id"))


@query("""SELECT l_suppkey % 4 AS run_id, CAST(l_shipdate AS DATE) AS timestamp, ROUND(AVG(l_discount), 6) * CASE WHEN l_suppkey % 4 = 2 THEN 2 ELSE 1 END AS daily_return FROM lineitem GROUP BY 1, 2, l_suppkey % 4""")
def a15_saved_results(spark, sf_dir):
    """Results of four runs; one is saved again, and what is read holds its second form only."""
    path = _folder(spark)
    r = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("run_id"), F.to_date("l_shipdate").alias("timestamp")).agg(F.round(F.avg("l_discount"), 6).alias("daily_return"))
    files.save_results(path, {"equity": r})
    files.save_results(path, {"equity": r.where("run_id = 2").withColumn("daily_return", F.col("daily_return") * 2)})
    return spark.read.schema("timestamp date, daily_return double, run_id long").parquet(f"{path}/equity").select("run_id", "timestamp", "daily_return")


@query("SELECT c_custkey AS account, CAST(2 AS BIGINT) AS records, ROUND(2 * c_acctbal + 1, 4) AS total FROM customer")
def a16_append_ledger(spark, sf_dir):
    path = _folder(spark)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("equity"))
    files.append_ledger(c, path)
    files.append_ledger(c.withColumn("equity", F.col("equity") + 1), path)
    return files.read_ledger(spark, path, "account long, equity double").groupBy("account").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("equity"), 4).alias("total"))


# ---- lifecycle

_EVENTS = """le AS (SELECT user_id AS candidate, ts AS seen_at, event_id, CASE event_type WHEN 'view' THEN 'validated_oos' WHEN 'click' THEN 'shadow' WHEN 'purchase' THEN 'paper' WHEN 'error' THEN 'rejected' ELSE 'quarantined' END AS state, event_id % 2 = 0 AS manual FROM events),
ln AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY candidate ORDER BY seen_at, event_id) AS k FROM le),
"""
_STEP = """(f = 'quarantined' AND e.state IN ('validated_oos', 'rejected') OR f = 'validated_oos' AND e.state IN ('shadow', 'rejected') OR f = 'shadow' AND (e.state = 'rejected' OR e.state = 'paper' AND e.manual) OR f = 'paper' AND e.state = 'rejected')"""
_WALK = f"""lw AS (SELECT candidate, CAST(0 AS BIGINT) AS k, 'quarantined' AS f, CAST(NULL AS VARCHAR) AS f0, CAST(NULL AS VARCHAR) AS t, TRUE AS ok, CAST(NULL AS TIMESTAMP) AS seen_at, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT candidate FROM le)
UNION ALL SELECT e.candidate, e.k, CASE WHEN {_STEP} THEN e.state ELSE f END, f, e.state, {_STEP}, e.seen_at, e.event_id FROM lw JOIN ln e ON e.candidate = lw.candidate AND e.k = lw.k + 1)"""


def _lifecycle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    state = F.when(t == "view", "validated_oos").when(t == "click", "shadow").when(t == "purchase", "paper").when(t == "error", "rejected").otherwise("quarantined")
    return e.select(F.col("user_id").alias("candidate"), F.col("ts").alias("seen_at"), "event_id", state.alias("state"), (F.col("event_id") % 2 == 0).alias("manual"))


@query(f'WITH RECURSIVE {_EVENTS}{_WALK} SELECT candidate, event_id, f0 AS "from", t AS "to" FROM lw WHERE k > 0 AND NOT ok')
def l02_lifecycle_audit(spark, sf_dir):
    return lineage.audit_transitions(_lifecycle(spark, sf_dir)).select("candidate", "event_id", "from", "to")


@query(f"WITH RECURSIVE {_EVENTS}{_WALK} SELECT candidate, ARG_MAX(f, k) AS state FROM lw GROUP BY candidate")
def l03_legal_state(spark, sf_dir):
    return lineage.legal_state(_lifecycle(spark, sf_dir))


@query("SELECT s_suppkey, s_suppkey % 2 = 1 AS quarantined FROM supplier")
def l07_quarantine(spark, sf_dir):
    """Bundles of all suppliers, every other one with an unknown key; valid ones are quarantined with nothing enabled."""
    s = table(spark, sf_dir, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    body = F.struct(F.lit("1").alias("schema_version"), F.col("s_name").alias("candidate_id"), F.lit("close").alias("expression"), F.lit("5").alias("lookback"), F.lit("1").alias("expected_sign"), F.when(~odd, "x").alias("extra"))
    kept, rejected = lineage.quarantine(tables.check_bundles(s.select("s_suppkey", F.to_json(body).alias("json"))))
    return kept.where("state = 'quarantined' and not paper_enabled").select("s_suppkey", F.lit(True).alias("quarantined")).union(rejected.select("s_suppkey", F.lit(False)))


# ---- statistics

_DRAW = "((b + 1) * 48271 + (j + 1) * 69621) % 2147483647"


@query(
    f"""WITH sr AS (SELECT l_suppkey % 5 AS variant_id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS session, AVG(l_discount) - 0.05 AS r FROM lineitem GROUP BY 1, 2),
sk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant_id ORDER BY session) - 1 AS j, COUNT(*) OVER (PARTITION BY variant_id) AS n FROM sr),
sh AS (SELECT variant_id, b, j, n, {_DRAW} AS h FROM sk CROSS JOIN (SELECT UNNEST(RANGE(300)) AS b)),
sg AS (SELECT *, h * h % 2147483647 AS g FROM sh), si AS (SELECT variant_id, b, (g * g + 11 * h + 7) % 2147483647 % n AS k FROM sg),
sb AS (SELECT si.variant_id, b, SUM(r) AS s FROM si JOIN sk ON sk.variant_id = si.variant_id AND sk.j = si.k GROUP BY 1, 2)
SELECT variant_id, (SELECT COUNT(*) FROM sk WHERE sk.variant_id = sb.variant_id) AS sessions, {_r6('QUANTILE_CONT(s, 0.025)')} AS p025, {_r6('QUANTILE_CONT(s, 0.5)')} AS p50, {_r6('QUANTILE_CONT(s, 0.975)')} AS p975,
  {_r6('AVG(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM sb GROUP BY variant_id"""
)
def h14_session_bootstrap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    r = lines.groupBy((F.col("l_suppkey") % 5).alias("variant_id"), F.trunc("l_shipdate", "month").alias("session")).agg((F.avg("l_discount") - 0.05).alias("daily_return"))
    out = statistics.session_bootstrap(r, 300)
    return out.select("variant_id", "sessions", *[six(F.col(c)).alias(c) for c in ("p025", "p50", "p975", "positive")])


@query(
    f"""WITH {_CUST}, {_P}, pg AS (SELECT mt.variant_id, ROUND(p_value, 6) AS p_value, COALESCE(total_return > 0, FALSE) AS a, COALESCE(sharpe >= 0.3, FALSE) AS b FROM mt JOIN pv ON pv.variant_id = mt.variant_id),
pr AS (SELECT variant_id, p_value, ROW_NUMBER() OVER (ORDER BY p_value, variant_id) AS k, COUNT(*) OVER () AS m FROM pg WHERE a AND b),
pz AS (SELECT variant_id, COALESCE(k <= MAX(CASE WHEN p_value <= 0.6 * k / m THEN k END) OVER (), FALSE) AS kept FROM pr)
SELECT pg.variant_id, CASE WHEN NOT a AND NOT b THEN 'return,sharpe' WHEN NOT a THEN 'return' WHEN NOT b THEN 'sharpe' WHEN NOT kept THEN 'fails_fdr' ELSE '' END AS failed, CASE WHEN COALESCE(kept, FALSE) THEN 'promote' ELSE 'reject' END AS verdict
FROM pg LEFT JOIN pz ON pz.variant_id = pg.variant_id"""
)
def h18_batch_promotion(spark, sf_dir):
    _, m = _variant_metrics(spark, sf_dir)
    out = statistics.promote_batch(m, 0.6, (("return", "total_return", ">", 0.0), ("sharpe", "sharpe", ">=", 0.3)), "sharpe", "n")
    return out.select("variant_id", F.array_join("failed", ",").alias("failed"), "verdict")


@query(with_panel(f"SELECT variant_id, timestamp, symbol, ROUND(close / LAG(close, lookback) OVER (PARTITION BY variant_id, symbol ORDER BY timestamp) - 1, 6) + 0.0 AS score FROM p CROSS JOIN (VALUES (0, 4), (1, 8), (2, 13)) v(variant_id, lookback)", "weekly10"))
def f09_parameter_grid(spark, sf_dir):
    """One panel for all lookbacks: the grid joins it once, and each lookback is a lag of its own."""
    p = panel_of(spark, sf_dir, "weekly10")
    g = statistics.grid(spark, {"lookback": [4, 8, 13]})
    w = Window.partitionBy("symbol").orderBy("timestamp")
    lags = p.select("timestamp", "symbol", "close", *[F.lag("close", n).over(w).alias(f"l{n}") for n in (4, 8, 13)])
    rows = lags.crossJoin(F.broadcast(g))
    before = F.when(F.col("lookback") == 4, F.col("l4")).when(F.col("lookback") == 8, F.col("l8")).otherwise(F.col("l13"))
    return rows.select("variant_id", "timestamp", "symbol", six(F.try_divide("close", before) - 1).alias("score"))


# ---- universes, selections and joins

@query(with_bars("SELECT b.symbol, MIN(b.timestamp) AS first, r.best AS best_rank FROM bars b JOIN (SELECT symbol, CAST(MIN(liquidity_rank) AS INTEGER) AS best FROM chosen GROUP BY 1) r ON r.symbol = b.symbol WHERE r.best % 2 = 1 GROUP BY 1, 3 HAVING MIN(b.timestamp) <= DATE '1996-12-31'", extra=_CAND))
def i08_seasoned_alternating(spark, sf_dir):
    return universe.seasoned(bars(spark, sf_dir), datetime.date(1996, 12, 31), universe.top_liquid(_candidates(spark, sf_dir), 4), 1)


@query(with_bars("SELECT symbol AS universe, MAX(timestamp) AS newest, CAST(DATE_DIFF('day', MAX(timestamp), DATE '1998-12-31') AS INTEGER) AS age_days, DATE_DIFF('day', MAX(timestamp), DATE '1998-12-31') > 60 AS stale FROM chosen GROUP BY symbol", extra=_CAND))
def i09_snapshot_staleness(spark, sf_dir):
    chosen = universe.top_liquid(_candidates(spark, sf_dir), 4).withColumnRenamed("symbol", "universe")
    return universe.staleness(chosen, F.lit("1998-12-31").cast("date"), 60)


@query(
    """WITH ex AS (SELECT 'K' || (o_custkey % 200) AS symbol, CAST(o_orderdate AS DATE) AS exit_date FROM orders WHERE o_orderkey % 8 = 0 GROUP BY 1, 2),
ac AS (SELECT o_orderkey AS action_id, o_orderpriority AS action_type, CAST(o_orderdate AS DATE) AS action_date, UNNEST(LIST_DISTINCT(['K' || (o_custkey % 200), 'K' || (o_orderkey % 200)])) AS symbol FROM orders WHERE o_orderkey % 5 = 0),
nr AS (SELECT ex.symbol, exit_date, action_id, action_type, action_date, ROW_NUMBER() OVER (PARTITION BY ex.symbol, exit_date ORDER BY action_date DESC, action_id DESC) AS k FROM ex JOIN ac ON ac.symbol = ex.symbol AND action_date BETWEEN exit_date - 30 AND exit_date)
SELECT ex.symbol, ex.exit_date, action_id, action_type, action_date FROM ex LEFT JOIN nr ON nr.symbol = ex.symbol AND nr.exit_date = ex.exit_date AND k = 1"""
)
def f11_exit_actions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    name = lambda c: F.concat(F.lit("K"), (F.col(c) % 200).cast("string"))
    exits = o.where("o_orderkey % 8 = 0").select(name("o_custkey").alias("symbol"), F.col("d").alias("exit_date")).distinct()
    actions = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("action_id"), F.col("o_orderpriority").alias("action_type"), F.col("d").alias("action_date"), name("o_custkey").alias("old"), name("o_orderkey").alias("new"))
    return universe.match_actions(exits, actions, ["old", "new"], 30)


@query(with_panel(f"SELECT timestamp, symbol, CASE WHEN symbol IN ('S1', 'S4') THEN 0.0 ELSE ROUND(1.0 / COUNT(*) OVER ({_T}), 6) END AS target_weight FROM top", "weekly10", _SCORE + "," + _TOP))
def e23_disabled(spark, sf_dir):
    off = spark.createDataFrame([("S1",), ("S4",), ("S1",)], "symbol string")
    return W.disable(W.top_n(_scores(spark, sf_dir), 3), off).select("timestamp", "symbol", F.round("target_weight", 6).alias("target_weight"))


@query(with_panel(f"SELECT timestamp, symbol, ROUND(w, 6) AS target_weight FROM (SELECT *, 1.0 / COUNT(*) OVER ({_T}) AS w FROM top) WHERE timestamp = (SELECT MAX(timestamp) FROM top)", "weekly10", _SCORE + "," + _TOP))
def e24_latest_targets(spark, sf_dir):
    return W.latest_targets(W.top_n(_scores(spark, sf_dir), 3)).select("timestamp", "symbol", F.round("target_weight", 6).alias("target_weight"))


@query(with_bars("""SELECT DISTINCT b.timestamp, b.symbol FROM bars b JOIN (VALUES ('S1', DATE '1994-01-01', DATE '1994-06-30'), ('S1', DATE '1994-06-01', NULL), ('S2', DATE '1995-01-01', DATE '1995-12-31')) m(symbol, a, z) ON m.symbol = b.symbol AND b.timestamp >= a AND (z IS NULL OR b.timestamp <= z)"""))
def f02_membership_join(spark, sf_dir):
    m = spark.sql("SELECT * FROM VALUES ('S1', DATE '1994-01-01', DATE '1994-06-30'), ('S1', DATE '1994-06-01', NULL), ('S2', DATE '1995-01-01', DATE '1995-12-31') AS m(symbol, start, end)")
    return W.in_membership(bars(spark, sf_dir).select("timestamp", "symbol"), m)


@query(with_panel(f"SELECT timestamp, symbol, {_r6('CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, QUANTILE_CONT(r, 0.02) OVER (PARTITION BY timestamp)), QUANTILE_CONT(r, 0.98) OVER (PARTITION BY timestamp)) END')} AS value FROM (SELECT timestamp, symbol, CASE WHEN COUNT(r) OVER (PARTITION BY timestamp) >= 0.5 * COUNT(*) OVER (PARTITION BY timestamp) THEN r END AS r FROM p)"))
def c31_named_steps(spark, sf_dir):
    """Preprocessing by the step names of a bundle's settings."""
    out = R.preprocess(panel_of(spark, sf_dir), "r", R.Steps.named(["winsor_2pct"], lag=0))
    return out.select("timestamp", "symbol", six(F.col("value")).alias("value"))


# ---- what earlier queries leave out

@query(
    f"""WITH {_EQ}, s AS (SELECT *, ROW_NUMBER() OVER w AS seq, equity / LAG(equity) OVER w - 1 AS ret, equity / MAX(equity) OVER w - 1 AS dd FROM eq WINDOW w AS (PARTITION BY account ORDER BY timestamp)),
g AS (SELECT account, ARG_MAX(dd, timestamp) AS drawdown, ARG_MAX(COALESCE(ret, 0), timestamp) AS today, MAX(seq) - COALESCE(MAX(CASE WHEN COALESCE(ret, 0) >= 0 THEN seq END), 0) AS down_streak FROM s GROUP BY account)
SELECT account, ROUND(drawdown, 6) AS drawdown, down_streak, CASE WHEN drawdown <= -0.2 OR today <= -0.03 THEN 'halt' WHEN drawdown <= -0.05 OR down_streak >= 3 THEN 'warn' ELSE 'ok' END AS verdict FROM g"""
)
def j07_daily_loss_breaker(spark, sf_dir):
    out = orders.circuit_breaker(_equities(spark, sf_dir), halt=-0.2, daily_limit=0.03)
    return out.withColumn("drawdown", F.round("drawdown", 6))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a.shell_x,eval' WHEN 1 THEN '' WHEN 2 THEN 'pre-exec' ELSE '' END AS keys FROM orders""")
def l01_executable_keys(spark, sf_dir):
    """Bundles with keys of executable content two levels down, beside values and longer words that only look so."""
    k = F.col("o_orderkey") % 4
    inner = F.when(k == 0, '{"eval" : 1, "list": [{"a.shell_x": 2}]}').when(k == 1, '{"evaluation": "exec", "note": "say \\"eval\\": no"}').when(k == 2, '{"deep": {"pre-exec": null}}').otherwise("{}")
    json = F.concat(F.lit('{"candidate_id": "'), F.col("o_orderkey").cast("string"), F.lit('", "signal_spec": '), inner, F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tables.executable_keys(json), ",").alias("keys"))
