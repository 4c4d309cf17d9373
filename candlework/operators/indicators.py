"""Technical indicators, their latest values, score and signals.

Conventions: Wilder's and exponential means begin with the first value and are null until n values are there; Bollinger
bands use the sample deviation; MACD's parts are named, not taken by position; VWAP is anchored to the day.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions.windows import KEY, TIME, div, full, lag, last_rows, mean, ordered, recursive_means, span, std
from candlework.operators.returns import true_range

LEAST_BARS = 200
#: Rows of the longest frame of _trailing
LONGEST = 200


#: Indicators that come from recursive means, and the columns whose means they take.
RECURSIVE = {"rsi": ("_gain", "_loss"), "atr": ("_tr",), "adx": ("_tr", "_up", "_down"), **{x: ("_e12", "_e26") for x in ("macd", "macd_signal", "macd_hist", "ema_12", "ema_26")}}


def indicators(bars: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Bars with rsi, macd, macd_signal, macd_hist, Bollinger bands, moving averages, obv, vwap, atr, adx, stochastics.

    With only, recursive means that none of these needs are left out: the optimizer can't see into them, and without any
    the plan has no Python at all. All other columns that aren't selected are pruned from the plan.
    """
    wanted = set(RECURSIVE) if only is None else set(RECURSIVE) & set(only)
    return _trailing(_running(_recursive(_inputs(bars, wanted), wanted)), wanted)


def _needed(wanted: set[str]) -> set[str]:
    return {c for x in wanted for c in RECURSIVE[x]}


def _inputs(bars: DataFrame, wanted: set[str]) -> DataFrame:
    """Adds the columns whose recursive means are needed."""
    diff = F.col("close") - lag("close")
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    inputs = {
        "_gain": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "_loss": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))), "_tr": true_range(),
        "_up": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_down": F.when(down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }
    return bars.withColumns({k: x for k, x in inputs.items() if k in _needed(wanted)})


def _dx():
    """The function of which adx is the mean; made here, so that it travels to the workers whole."""

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)

    def dx(column) -> np.ndarray:
        plus, minus = over(100 * column("_up_w"), column("_tr_w")), over(100 * column("_down_w"), column("_tr_w"))
        return over(100 * np.abs(plus - minus), plus + minus)

    return dx


def _recursive(frame: DataFrame, wanted: set[str], keep: str | None = None) -> DataFrame:
    """Adds the recursive means, those of means too, in one pass."""
    need = _needed(wanted)
    means = {k: ("close", span(n)) for k, n in (("_e12", 12), ("_e26", 26)) if k in need} | {f"{k}_w": (k, 1 / 14) for k in ("_gain", "_loss", "_tr", "_up", "_down") if k in need}
    if wanted & {"macd_signal", "macd_hist"}:
        means["_signal"] = (lambda column: column("_e12") - column("_e26"), span(9))
    if "adx" in wanted:
        means["_adx"] = (_dx(), 1 / 14)
    return recursive_means(frame, means, keep) if means else frame


def _running(frame: DataFrame) -> DataFrame:
    """Adds what runs from a series' first row: obv, and how many values there are of columns that need some."""
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    diff = F.col("close") - lag("close")
    counts = {f"{c}_n": F.count(c).over(so_far) for c in ("_gain", "_tr") if c in frame.columns}
    return frame.withColumns({"obv": F.sum(F.coalesce(F.signum(diff) * F.col("volume"), F.lit(0.0))).over(so_far), **counts})


def _trailing(frame: DataFrame, wanted: set[str]) -> DataFrame:
    """Adds what looks back over at most LONGEST rows or the day, and what is made of the columns of the other steps."""
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    lowest, highest = full(14, F.min("low"), "low"), full(14, F.max("high"), "high")
    staged = frame.withColumns({"bb_middle": mean("close", 20), "_sd": std("close", 20), "_k": div(100 * (c - lowest), highest - lowest), "sma_20": mean("close", 20), "sma_50": mean("close", 50), "sma_200": mean("close", LONGEST), "volume_sma": mean("volume", 20)})
    day = Window.partitionBy(KEY, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = {
        "bb_upper": F.col("bb_middle") + 2 * F.col("_sd"), "bb_lower": F.col("bb_middle") - 2 * F.col("_sd"), "bb_width": div(400 * F.col("_sd"), F.col("bb_middle")), "stoch_k": mean("_k", 3),
        "vwap": div(F.sum((h + low + c) / 3 * v).over(day), F.sum("volume").over(day)), "volume_ratio": F.when(F.col("volume_sma") > 0, div(v, F.col("volume_sma"))),
    }
    macd = lambda: F.col("_e12") - F.col("_e26")
    made = {
        "rsi": lambda: F.when(F.col("_gain_n") >= 14, div(100 * F.col("_gain_w"), F.col("_gain_w") + F.col("_loss_w"))), "macd": macd, "macd_signal": lambda: F.col("_signal"), "macd_hist": lambda: macd() - F.col("_signal"),
        "ema_12": lambda: F.col("_e12"), "ema_26": lambda: F.col("_e26"), "atr": lambda: F.when(F.col("_tr_n") >= 14, F.col("_tr_w")), "adx": lambda: F.when(F.col("_tr_n") >= 28, F.col("_adx")),
    }
    staged = staged.withColumns(out | {k: made[k]() for k in made if k in wanted}).withColumn("stoch_d", mean("stoch_k", 3))
    return staged.drop(*[x for x in staged.columns if x.startswith("_")])


def rsi_signal(rsi: Column) -> Column:
    return F.when(rsi <= 30, "oversold").when(rsi >= 70, "overbought").otherwise("neutral")


def macd_crossover(macd: Column, signal: Column) -> Column:
    return F.when(macd > signal, "bullish").when(macd < signal, "bearish").otherwise("neutral")


def bb_signal(percent: Column) -> Column:
    return F.when(percent < 0, "below_lower").when(percent > 1, "above_upper").when(percent < 0.2, "near_lower").when(percent > 0.8, "near_upper").otherwise("normal")


def analyze(bars: DataFrame) -> DataFrame:
    """A row for each ticker: its last bar's indicators and signals, nulls where it has fewer than 200 bars."""
    whole, wanted = Window.partitionBy(KEY), set(RECURSIVE)
    staged = _running(_inputs(bars, wanted)).withColumns({"n_bars": F.count(F.lit(1)).over(whole), "_last": F.max(TIME).over(whole), "_at": F.row_number().over(ordered())})
    # The last row's frames reach back over so many rows, or over its day: no others are needed after the recursion.
    near = (F.col("n_bars") - F.col("_at") < LONGEST) | (F.to_date(TIME) == F.to_date("_last"))
    staged = _recursive(staged.withColumn("_near", F.coalesce(near, F.lit(False))).drop("_last", "_at"), wanted, "_near")
    last = last_rows(_trailing(staged, wanted))
    enough = F.col("n_bars") >= LEAST_BARS
    keep = [c for c in last.columns if c not in (*bars.columns, "n_bars")]
    last = last.withColumns({c: F.when(enough, F.col(c)) for c in keep})
    width = F.col("bb_upper") - F.col("bb_lower")
    percent = F.when(width > 0, div(F.col("close") - F.col("bb_lower"), width)).when(width.isNotNull(), 0.5)
    last = last.withColumn("bb_percent", percent)
    return last.withColumns({"rsi_signal": rsi_signal(F.col("rsi")), "macd_crossover": macd_crossover(F.col("macd"), F.col("macd_signal")), "bb_signal": bb_signal(F.col("bb_percent"))})


def score(last: DataFrame) -> DataFrame:
    """Adds score, 0 to 100."""
    c = lambda x: F.col(x)
    steps = [
        F.when(c("rsi").between(50, 65), 15).when((c("rsi") > 65) & (c("rsi") <= 75), 5).when(c("rsi") > 75, -10).when(c("rsi") < 40, -10),
        F.when(c("macd_crossover") == "bullish", 15).when(c("macd_crossover") == "bearish", -15),
        F.when(c("bb_percent").between(0.6, 0.9), 10).when(c("bb_percent") > 0.9, 5).when(c("bb_percent") < 0.3, -10),
        F.when(c("bb_signal") == "above_upper", 5),
        F.when(c("adx") > 30, 15).when(c("adx") >= 25, 10).when(c("adx") >= 20, 5).when(c("adx") < 20, -5),
        F.when(c("volume_ratio") > 2, 15).when(c("volume_ratio") >= 1.5, 10).when(c("volume_ratio") >= 1.2, 5).when(c("volume_ratio") < 0.8, -10),
        F.when((c("sma_20") > c("sma_50")) & (c("sma_50") > c("sma_200")), 15).when(c("sma_20") > c("sma_50"), 8).when((c("sma_20") < c("sma_50")) & (c("sma_50") < c("sma_200")), -15),
        F.when(c("stoch_k").between(40, 80), 5).when(c("stoch_k") > 80, -5).when(c("stoch_k") < 20, -10),
    ]
    total = sum((F.coalesce(s, F.lit(0)) for s in steps), F.lit(50))
    return last.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))


def signals(last: DataFrame) -> DataFrame:
    """Adds signals, the bullish tags that hold, in order."""
    c = lambda x: F.col(x)
    tags = [
        F.when(c("rsi").between(50, 70), "RSI_MOMENTUM").when(c("rsi") > 70, "RSI_STRONG_MOMENTUM"),
        F.when(c("macd_crossover") == "bullish", "MACD_BULLISH_CROSS"),
        F.when(c("bb_signal").isin("near_upper", "above_upper"), "BB_BREAKOUT"),
        F.when(c("adx") > 30, "VERY_STRONG_TREND").when(c("adx") > 25, "STRONG_TREND"),
        F.when(c("volume_ratio") > 2, "MAJOR_VOLUME_SURGE").when(c("volume_ratio") > 1.5, "VOLUME_SURGE"),
        F.when(c("stoch_k").between(40, 80), "STOCH_MOMENTUM"),
        F.when((c("sma_20") > c("sma_50")) & (c("sma_50") > c("sma_200")), "MA_PERFECT_ALIGNMENT").when(c("sma_20") > c("sma_50"), "MA_BULLISH_ALIGNMENT"),
        F.when(c("bb_percent") > 0.8, "APPROACHING_BREAKOUT"),
        F.when((c("macd") > c("macd_signal")) & (c("macd") > 0), "MACD_ABOVE_ZERO"),
    ]
    return last.withColumn("signals", F.array_compact(F.array(*tags)))


def summary(last: DataFrame) -> DataFrame:
    """Adds summary, a nested record of the indicators."""
    part = lambda **x: F.struct(*[F.col(v).alias(k) for k, v in x.items()])
    return last.withColumn(
        "summary",
        F.struct(
            part(value="rsi", signal="rsi_signal").alias("rsi"), part(line="macd", signal="macd_signal", histogram="macd_hist", crossover="macd_crossover").alias("macd"),
            part(upper="bb_upper", middle="bb_middle", lower="bb_lower", percent="bb_percent", signal="bb_signal").alias("bollinger_bands"), part(sma_20="sma_20", sma_50="sma_50", sma_200="sma_200", ema_12="ema_12", ema_26="ema_26").alias("moving_averages"),
            part(ratio="volume_ratio", obv="obv", vwap="vwap").alias("volume"), part(adx="adx", atr="atr", stoch_k="stoch_k", stoch_d="stoch_d").alias("trend"),
        ),
    )
