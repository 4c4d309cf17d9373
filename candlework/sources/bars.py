"""Bars as one long table (ticker, ts, open, high, low, close, volume), the universe table, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, order) -> DataFrame:
    """Bars of rows (ticker, ts, price, quantity); order tells which row of a bar is first. Partial aggregation, one shuffle."""
    at = F.struct(*order)
    return rows.groupBy("ticker", "ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").cast("double").alias("volume")
    )


def from_lineitem(spark: SparkSession, sf_dir: str, ticker) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return _bars(lines.withColumns({"ticker": ticker, "ts": F.to_date("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity"), "quantity": F.col("l_quantity")}), ORDER)


def bars_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few tickers with long daily series."""
    return from_lineitem(spark, sf_dir, F.concat("l_returnflag", "l_linestatus"))


def bars_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many tickers: one for each supplier."""
    return from_lineitem(spark, sf_dir, F.col("l_suppkey").cast("string"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events; volume counts them."""
    events = table(spark, sf_dir, "events")
    return _bars(events.select(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("quantity"), F.col("ts").alias("t"), "event_id"), ("t", "event_id"))


def bars_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_broad brought to share prices and volumes: small noise on a wave of 40 bars, so that screens let some tickers pass."""
    bars = bars_broad(spark, sf_dir)
    i = F.row_number().over(Window.partitionBy("ticker").orderBy("ts"))
    wave = F.abs((i + 7 * F.col("ticker").cast("int")) % 40 - 20).cast("double")
    calm = {c: F.col(c) / 500.0 + 100.0 + F.col("_wave") for c in ("open", "high", "low", "close")}
    return bars.withColumn("_wave", wave).withColumns({**calm, "volume": F.col("volume") * 200_000.0}).drop("_wave")


# Names of periods and how far they reach back, and of intervals and their length
PERIODS = {"1d": "1 day", "5d": "5 days", "1mo": "1 month", "3mo": "3 months", "6mo": "6 months", "1y": "1 year", "2y": "2 years", "5y": "5 years", "10y": "10 years"}
INTERVALS = {"1m": "1 minute", "2m": "2 minutes", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "60m": "60 minutes", "90m": "90 minutes", "1h": "1 hour", "5d": "5 days"}
CALENDAR = {"1d": "day", "1wk": "week", "1mo": "month", "3mo": "quarter"}


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars: those of calendar units begin with the unit (weeks on Monday), others at multiples of their length."""
    if interval in CALENDAR:
        at = F.date_trunc(CALENDAR[interval], "ts")
        at = at.cast("date") if bars.schema["ts"].dataType.simpleString() == "date" else at
    elif interval in INTERVALS:
        at = F.window(F.col("ts").cast("timestamp"), INTERVALS[interval])["start"]
    else:
        raise ValueError(f"unknown interval {interval}")
    first, last = F.min_by("open", "ts"), F.max_by("close", "ts")
    rows = bars.withColumn("_at", at).groupBy("ticker", "_at").agg(first.alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), F.sum("volume").alias("volume"))
    return rows.withColumnRenamed("_at", "ts")


def scan(bars: DataFrame, tickers: DataFrame | list[str] | None = None, start=None, end=None, period: str | None = None, interval: str | None = None) -> DataFrame:
    """Bars of some tickers (a list, or a table with a ticker column) in a range of time; the filters reach the file scan.

    A period (of PERIODS, ytd or max) reaches back from end, or from the latest bar of all; an interval makes longer bars.
    """
    if period is not None and period != "max":
        last = F.lit(end).cast("timestamp") if end is not None else bars.agg(F.max("ts").cast("timestamp").alias("last")).scalar()
        if period != "ytd" and period not in PERIODS:
            raise ValueError(f"unknown period {period}")
        bars = bars.where(F.col("ts") >= (F.date_trunc("year", last) if period == "ytd" else last - F.expr(f"INTERVAL {PERIODS[period]}")))
    if interval is not None:
        return resample(scan(bars, tickers, start, end), interval)
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(end))
    if isinstance(tickers, list):
        return bars.where(F.col("ticker").isin(tickers))
    return bars if tickers is None else bars.join(tickers.select("ticker"), "ticker", "left_semi")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, sector, industry) of all suppliers."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.select(clean_ticker(F.col("s_suppkey").cast("string")).alias("ticker"), F.trim("s_name").alias("name"), F.trim("r_name").alias("sector"), F.trim("n_name").alias("industry"))


# Columns of the published table of constituents and their names here
DETAILS = {"Symbol": "ticker", "Security": "name", "GICS Sector": "sector", "GICS Sub-Industry": "industry", "CIK": "cik", "Founded": "founded", "Date added": "date_added", "Headquarters Location": "headquarters"}


def detailed_universe(rows: DataFrame) -> DataFrame:
    """A constituents table with our names for the columns it has; others keep theirs, without blanks around them."""
    rows = rows.toDF(*[DETAILS.get(c.strip(), c.strip()) for c in rows.columns])
    return rows.withColumn("ticker", clean_ticker(F.col("ticker"))) if "ticker" in rows.columns else rows


def first_tickers(universe_: DataFrame, n: int) -> DataFrame:
    """The first n tickers in order of ticker: a top-k plan."""
    return universe_.orderBy("ticker").limit(n)


def clean_ticker(c):
    return F.replace(F.trim(c), F.lit("."), F.lit("-"))


def universe_from_html(pages: DataFrame, page: str = "html") -> DataFrame:
    """Tickers of a page's constituents table, else of its first sortable wiki table: first cell of each row after the header."""
    whole = F.regexp_extract(F.col(page), r"(?is)<table[^>]*id=[\"']?constituents[\"']?[^>]*>(.*?)</table>", 1)
    other = F.regexp_extract(F.col(page), r"(?is)<table[^>]*class=[\"'][^\"']*wikitable[^\"']*sortable[^\"']*[\"'][^>]*>(.*?)</table>", 1)
    body = F.when(whole != "", whole).otherwise(other)
    rows = pages.select(F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("pos", "row")).where("pos > 0")
    cell = F.regexp_replace(F.regexp_extract("row", r"(?is)<td[^>]*>(.*?)</td>", 1), "<[^>]*>|\\s+", "")
    return rows.select("pos", clean_ticker(cell).alias("ticker")).where("ticker <> ''")


def latest_price(bars: DataFrame) -> DataFrame:
    """Close, volume and time of each ticker's last bar; partial aggregation, no sort."""
    last = F.max_by(F.struct("close", "volume", "ts"), "ts")
    return bars.groupBy("ticker").agg(last.alias("x")).select("ticker", F.col("x.close").alias("price"), F.col("x.volume").alias("volume"), F.col("x.ts").alias("ts"))


def fundamentals(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """One record for each ticker asked for, with defaults for what is unknown and a status instead of an error."""
    texts, numbers = ("name", "sector", "industry"), ("market_cap", "avg_volume", "shares_outstanding")
    others = ("pe_ratio", "forward_pe", "dividend_yield", "beta", "high_52w", "low_52w")
    have = set(rows.columns)
    known = rows.withColumn("_known", F.lit(True))
    both = tickers.select("ticker").join(known, "ticker", "left")
    pick = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    out = [F.coalesce(pick(c, "string"), F.lit("N/A")).alias(c) for c in texts] + [F.coalesce(pick(c, "long"), F.lit(0)).alias(c) for c in numbers] + [pick(c, "double").alias(c) for c in others]
    return both.select("ticker", *out, F.when(F.col("_known"), "ok").otherwise("missing").alias("status"))


def sector_distribution(universe_: DataFrame) -> DataFrame:
    return universe_.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
