"""Ingest of vendor tables, nested facts and the asset master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import MARKET_ZONE


def classify_asset(symbol: str, name: str, exchange: str, bad_exchanges: tuple[str, ...] = (), max_length: int = 6, type_pattern: str = r"\b(ETF|FUND|WARRANT|UNIT|RIGHT|NOTE|PREFERRED)S?\b") -> Column:
    """The first rule that an asset breaks, or candidate."""
    s, n = F.upper(symbol), F.upper(name)
    return (
        F.when(F.col(exchange).isin(*bad_exchanges), "exchange")
        .when((F.length(s) == 0) | (F.length(s) > max_length), "symbol_length")
        .when(s.rlike("^[0-9]+$"), "numeric_symbol")
        .when(s.rlike(r"[.\-/](W|WS|U|R|P[A-Z]?)$"), "security_suffix")
        .when(n.rlike(type_pattern), "security_type")
        .otherwise("candidate")
    )


def dedupe_master(assets: DataFrame) -> DataFrame:
    """One row for each symbol: included ones first, then active ones."""
    order = Window.partitionBy("symbol").orderBy(F.col("included").desc(), (F.col("status") == "ACTIVE").desc(), "name")
    return assets.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def vendor_daily(raw: DataFrame, names: dict[str, str], zone: str = MARKET_ZONE) -> DataFrame:
    """Bars of a vendor's daily file. names: our name to theirs, matched whatever the case.

    Prices are absolute values over the price factor, volumes times the share factor (a factor of 0 counts as 1);
    a missing or non-positive open, high or low is the close; the symbol is the ticker or else the permanent number.
    """
    have = {c.lower(): c for c in raw.columns}
    missing = [n for n in names.values() if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    col = lambda n: F.col(have[names[n].lower()])
    number = lambda n: F.expr(f"try_cast(`{have[names[n].lower()]}` as double)")
    factor = lambda n: F.coalesce(F.nullif(number(n), F.lit(0.0)), F.lit(1.0))
    close = F.abs(number("close")) / factor("price_factor")
    price = lambda n: F.when(number(n) > 0, number(n) / factor("price_factor")).otherwise(close)
    return raw.select(
        F.to_utc_timestamp(F.to_timestamp(F.to_date(col("date").cast("string"))), zone).alias("timestamp"),
        F.upper(F.coalesce(F.nullif(F.trim(col("ticker").cast("string")), F.lit("")), col("permno").cast("string"))).alias("symbol"),
        price("open").alias("open"), price("high").alias("high"), price("low").alias("low"), close.alias("close"),
        F.greatest(F.coalesce(number("volume"), F.lit(0.0)) * factor("share_factor"), F.lit(0.0)).alias("volume"),
    ).where(F.col("close") > 0)


def chart_rows(raw: DataFrame, json: str = "json") -> DataFrame:
    """Bars of chart documents with parallel arrays; open, high and low are scaled by adjusted close over close."""
    schema = "symbol string, timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>, adjclose array<double>"
    x = raw.select(F.from_json(json, schema).alias("c")).select("c.*")
    rows = x.select("symbol", F.explode(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume", "adjclose")).alias("r")).select("symbol", "r.*")
    rows = rows.where("open is not null and high is not null and low is not null and close is not null")
    ratio = F.coalesce(F.try_divide("adjclose", "close"), F.lit(1.0))
    return rows.select(F.timestamp_seconds("timestamp").alias("timestamp"), F.upper("symbol").alias("symbol"), *[(F.col(c) * ratio).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def pack_facts(facts: DataFrame, unit: str = "USD") -> DataFrame:
    """(symbol, facts) with facts as nested JSON: concept -> units -> unit -> points."""
    point = F.struct("val", "fy", "fp")
    by_concept = facts.groupBy("symbol", "concept").agg(F.create_map(F.lit(unit), F.array_sort(F.collect_list(point))).alias("units"))
    by_symbol = by_concept.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("m"))
    return by_symbol.select("symbol", F.to_json("m").alias("facts"))


def unpack_facts(packed: DataFrame) -> DataFrame:
    """(symbol, concept, unit, val, fy, fp) of every point of nested facts."""
    schema = "map<string, struct<units: map<string, array<struct<val: double, fy: int, fp: int>>>>>"
    concepts = packed.select("symbol", F.explode(F.from_json("facts", schema)).alias("concept", "c"))
    units = concepts.select("symbol", "concept", F.explode("c.units").alias("unit", "points"))
    return units.select("symbol", "concept", "unit", F.explode("points").alias("p")).select("symbol", "concept", "unit", "p.*")


def fundamental_features(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row for each (symbol, fy, fp): wanted concepts, returns on assets and growth on the year before."""
    wide = facts.groupBy("symbol", "fy", "fp").agg(*[F.max(F.when(F.col("concept") == theirs, F.col("val"))).alias(ours) for theirs, ours in names.items()])
    prior = wide.select("symbol", (F.col("fy") + 1).alias("fy"), "fp", F.col("revenue").alias("_before"))
    out = wide.join(prior, ["symbol", "fy", "fp"], "left")
    growth = (F.col("revenue") - F.col("_before")) / F.greatest(F.abs("_before"), F.when(F.col("_before").isNotNull(), F.lit(1e-9)))
    return out.withColumn("return_on_assets", F.try_divide("income", F.abs("assets"))).withColumn("revenue_growth", growth).drop("_before")


_POINT = "val: double, fy: int, fp: string, form: string, filed: string, start: string, end: string, accn: string"
_COMPANY = f"cik string, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<{_POINT}>>>>>>"


def company_facts(documents: DataFrame, taxonomy: str = "us-gaap", symbol: str = "symbol", json: str = "json") -> DataFrame:
    """(symbol, concept, unit, val, fy, fp, form, filed, start, end, accn) of every point of companies' filed facts.

    documents: (symbol, json), a text for each company: facts -> taxonomy -> concept -> units -> unit -> points. Other
    taxonomies are left out; symbols are upper-cased. A field that is missing or has another type is null, and dates
    that are none are null; a text that is no JSON has no points.
    """
    whole = documents.select(F.upper(symbol).alias("symbol"), F.from_json(json, _COMPANY).alias("d"))
    concepts = whole.select("symbol", F.explode(F.try_element_at("d.facts", F.lit(taxonomy))).alias("concept", "c"))
    units = concepts.select("symbol", "concept", F.explode("c.units").alias("unit", "points"))
    points = units.select("symbol", "concept", "unit", F.explode("points").alias("p"))
    return points.select("symbol", "concept", "unit", "p.val", "p.fy", "p.fp", "p.form", *[F.expr(f"try_cast(p.{c} AS date)").alias(c) for c in ("filed", "start", "end")], "p.accn")


def scan_company_facts(spark: SparkSession, path: str, taxonomy: str = "us-gaap") -> DataFrame:
    """company_facts of JSON files, one whole file a company: <symbol>.json, or any name in a folder symbol=<symbol>."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    folder, name = F.regexp_extract("file", "/symbol=([^/]+)/", 1), F.regexp_extract("file", r"/([^/]+?)(\.json|\.txt)?$", 1)
    return company_facts(files.select(F.when(folder != "", folder).otherwise(name).alias("symbol"), F.col("value").alias("json")), taxonomy)


def write_company_facts(points: DataFrame, path: str, taxonomy: str = "us-gaap") -> None:
    """The inverse: points written as a file for each company in a folder symbol=<symbol>; null fields are left out."""
    point = F.struct("val", "fy", "fp", "form", *[F.col(c).cast("string").alias(c) for c in ("filed", "start", "end")], "accn")
    units = points.groupBy("symbol", "concept", "unit").agg(F.array_sort(F.collect_list(point)).alias("points"))
    concepts = units.groupBy("symbol", "concept").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "points"))).alias("units")).alias("c"))
    facts = concepts.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", "c"))).alias("m"))
    body = F.to_json(F.struct(F.col("symbol").alias("entityName"), F.create_map(F.lit(taxonomy), "m").alias("facts")))
    facts.select("symbol", body.alias("value")).repartition("symbol").write.partitionBy("symbol").text(path)


#: Forms that count, and the days that a reported period may last.
QUARTERLY, ANNUAL = ("10-Q",), ("10-K", "20-F", "40-F")
QUARTER_DAYS, YEAR_DAYS = (60, 120), (300, 430)


def filing_features(points: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """(symbol, form, fy, fp, fiscal_period_end, available_at, seven ratios) of each filing, known from its filing date on.

    points: (symbol, concept, val, fy, fp, form, filed, start, end, accn). Quarterly and annual forms count, with periods of the
    usual length where a start is given. names: our name to theirs in order of preference; a company's first alias
    with any point is used. A filing's later period wins. Ratios are over the size of assets, gross profit falls back to
    revenue less its cost; growth is against the last filing of the year before with the same period that was out by then,
    earnings growth is that of earnings a share or else of net income.
    """
    days = F.datediff("end", "start")
    fits = lambda forms, span: F.col("form").isin(*forms) & (F.col("start").isNull() | days.between(*span))
    aliases = [(ours, theirs, k) for ours, many in names.items() for k, theirs in enumerate(many)]
    known = points.sparkSession.createDataFrame(aliases, "name string, concept string, rank int")
    named = points.join(known, "concept")
    best = Window.partitionBy("symbol", "name")
    named = named.withColumn("_best", F.min("rank").over(best)).where(F.col("rank") == F.col("_best"))
    usable = named.where((fits(QUARTERLY, QUARTER_DAYS) | fits(ANNUAL, YEAR_DAYS)) & F.col("filed").isNotNull() & F.col("end").isNotNull())
    keys = ["symbol", "accn", "filed", "fy", "fp", "form", "end"]
    wide = usable.groupBy(*keys).agg(*[F.max_by(F.when(F.col("name") == c, F.col("val")), F.when(F.col("name") == c, F.struct("start", "val"))).alias(c) for c in names])
    last = Window.partitionBy("symbol", "filed", "fp", "fy").orderBy(F.col("end").desc(), "accn")
    rows = wide.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    grown = ["shares", "revenue", "eps", "net_income"]
    prior = rows.select("symbol", (F.col("fy") + 1).alias("fy"), "fp", F.col("filed").alias("_filed"), F.struct(*grown).alias("_p"))
    near = rows.join(prior, ["symbol", "fy", "fp"]).where("_filed <= filed").groupBy("symbol", "filed", "fp", "fy").agg(F.max_by("_p", "_filed").alias("_p"))
    rows = rows.join(near, ["symbol", "filed", "fp", "fy"], "left").withColumn("gross_profit", F.coalesce("gross_profit", F.col("revenue") - F.col("cost_of_revenue")))
    over = lambda x: F.try_divide(x, F.abs("assets"))
    growth = lambda c: (F.col(c) - F.col(f"_p.{c}")) / F.when(F.col(f"_p.{c}").isNotNull(), F.greatest(F.abs(f"_p.{c}"), F.lit(1e-9)))
    return rows.select(
        "symbol", "form", "fy", "fp", F.col("end").alias("fiscal_period_end"), F.col("filed").alias("available_at"),
        over(F.col("gross_profit")).alias("gross_profitability"), over(F.col("operating_cash_flow")).alias("cash_profitability"),
        over(F.col("net_income") - F.col("operating_cash_flow")).alias("accruals"), over(F.col("liabilities")).alias("leverage"),
        growth("shares").alias("share_growth"), growth("revenue").alias("revenue_growth"), F.coalesce(growth("eps"), growth("net_income")).alias("earnings_growth"),
    )


#: Exchanges that count, and names of securities that are no common shares.
EXCHANGES = ("NYSE", "NASDAQ", "AMEX")
NO_SHARES = (
    r"(?i)\b(ETF|ETN|EXCHANGE[- ]TRADED|FUND|PORTFOLIO|WARRANT|RIGHTS?|UNITS?|PREFERRED|PFD|DEPOSITARY|ADS|ADR|NOTES?|BONDS?|DEBENTURES?|"
    r"BENEFICIAL INTEREST|INCOME SHARES|CONTRA)\b"
)
FUND_BRANDS = r"(?i)\b(SPDR|ISHARES|PROSHARES|DIREXION|VANGUARD|GLOBAL X|WISDOMTREE|INNOVATOR ETF|INVESCO ETF|FIRST TRUST ETF)\b"


def classify_listing(symbol: str, name: str, exchange: str, exchanges: tuple[str, ...] = EXCHANGES) -> Column:
    """The first rule that a listed asset breaks, or candidate: exchange, symbol, security type, trusts without shares."""
    s, n = F.upper(F.trim(F.coalesce(symbol, F.lit("")))), F.trim(F.coalesce(name, F.lit("")))
    return (
        F.when(~F.coalesce(F.upper(exchange).isin(*exchanges), F.lit(False)), "exchange")
        .when((F.length(s) == 0) | (F.length(s) > 6), "symbol_length")
        .when(s.rlike("[0-9]"), "numeric_symbol")
        .when(s.rlike(r"[/^\- ]") | s.rlike(r"\.(U|W|WS|R)$"), "security_suffix")
        .when(n.rlike(NO_SHARES) | n.rlike(FUND_BRANDS), "security_type")
        .when(F.contains(F.upper(n), F.lit(" TRUST")) & ~n.rlike("(?i)COMMON|ORDINARY|CLASS [ABC]"), "trust_without_common_shares")
        .otherwise("candidate")
    )
