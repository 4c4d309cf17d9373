"""The 205 engineered columns of a bar table, family by family.

All window expressions of a family share one exchange and sort by ticker; a family that needs a window over a window is
staged with withColumns, on the same partitioning. Columns that are not selected are pruned from the plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.functions.windows import before, change, div, flag, full, lag, mean, ordered, recursive_means, run_length, span, std, trailing
from candlework.operators.returns import true_range

EPS = 1e-10


def _bars():
    return tuple(F.col(c) for c in ("open", "high", "low", "close", "volume"))


def price(bars: DataFrame) -> DataFrame:
    o, h, low, c, _ = _bars()
    out: dict[str, Column] = {"high_low_ratio": div(h, low), "close_open_ratio": div(c, o), "price_position": div(c - low, h - low + EPS), "gap": o - lag("close"), "gap_percentage": div(o - lag("close"), lag("close"))}
    for p in (1, 2, 3, 5, 10, 20, 30):
        out[f"return_{p}d"] = change("close", p)
        out[f"log_return_{p}d"] = F.ln(div(c, lag("close", p)))
    for p in (5, 10, 20):
        out[f"high_change_{p}d"] = change("high", p)
        out[f"low_change_{p}d"] = change("low", p)
    body, up, down = F.abs(c - o), h - F.greatest(c, o), F.least(c, o) - low
    out |= {"body_size": body, "upper_shadow": up, "lower_shadow": down, "body_to_shadow_ratio": div(body, up + down + EPS), "is_doji": flag(div(body, h - low + EPS) < 0.1), "is_hammer": flag((down > 2 * body) & (up < body))}
    return bars.withColumns(out)


def _corr(x: str, y: str, k: int) -> Column:
    """Pearson's, null where either is constant (corr() raises an error there)."""
    cov = full(k, F.covar_samp(x, y), F.when(F.col(x).isNotNull(), F.col(y)))
    return F.try_divide(cov, std(x, k) * std(y, k))


def volume(bars: DataFrame) -> DataFrame:
    _, h, low, c, v = _bars()
    staged = bars.withColumns({"_pv": change("close") * v, "money_flow": div((c - low) - (h - c), h - low + EPS) * v})
    out: dict[str, Column] = {}
    for p in (1, 5, 10, 20):
        out[f"volume_change_{p}d"] = change("volume", p)
        out[f"volume_ratio_{p}d"] = div(v, mean("volume", p))
    for p in (5, 10, 20, 50):
        out[f"volume_ma_{p}"] = mean("volume", p)
        out[f"volume_std_{p}"] = std("volume", p)
    out |= {"price_volume_trend": full(10, F.sum("_pv"), "_pv"), "volume_price_correlation": _corr("close", "volume", 20), "money_flow_ma": mean("money_flow", 14), "volume_spike": div(v - mean("volume", 20), std("volume", 20) + EPS)}
    return staged.withColumns(out).drop("_pv")


def momentum(bars: DataFrame) -> DataFrame:
    c = F.col("close")
    diff = c - lag("close")
    staged = bars.withColumns({"_gain": F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))), "_loss": F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))), "_move": F.abs(diff), "momentum_5": c - lag("close", 5)})
    out: dict[str, Column] = {f"roc_{p}": div(100 * (c - lag("close", p)), lag("close", p)) for p in (5, 10, 20, 30)}
    out |= {f"momentum_{p}": c - lag("close", p) for p in (10, 20)}
    out |= {"price_acceleration": F.col("momentum_5") - lag("momentum_5")}
    out |= {f"rs_{p}": div(mean("_gain", p), mean("_loss", p) + EPS) for p in (7, 14, 21)}
    out |= {f"efficiency_{p}": div(c - lag("close", p), full(p, F.sum("_move"), "_move") + EPS) for p in (10, 20)}
    return staged.withColumns(out).drop("_gain", "_loss", "_move")


STATISTICAL = (5, 10, 20, 30, 60)


def statistical(bars: DataFrame) -> DataFrame:
    """Moments and quantiles of sliding windows.

    Window aggregates would go through all rows of a frame for each row, here some 125 by eleven aggregates, with a hash
    map for each exact quantile. A ticker's closes are one array instead, on which all windows of a size are one view.
    """
    names = [f"{s}_{p}" for p in STATISTICAL for s in ("mean", "std", "skew", "kurt", "min", "max", "range", "position_in_range", "quantile_25", "quantile_75", "iqr")] + [f"zscore_{p}" for p in (10, 20, 30)]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        close = rows["close"].to_numpy("float64")
        out = {name: np.full(len(close), np.nan) for name in names}
        for p in STATISTICAL:
            ends = np.arange(p - 1, len(close))
            for part in np.array_split(ends, max(1, len(ends) * p >> 20)):
                if not len(part):
                    continue
                x = np.lib.stride_tricks.sliding_window_view(close[part[0] - p + 1 : part[-1] + 1], p)
                mean, low, high = x.mean(1), x.min(1), x.max(1)
                d = x - mean[:, None]
                m2, m3, m4 = ((d**k).sum(1) for k in (2, 3, 4))
                std = np.sqrt(m2 / (p - 1))
                flat = np.where(m2 > 0, m2, np.nan)
                g1, g2 = math.sqrt(p) * m3 / flat**1.5, p * m4 / flat**2 - 3
                ordered_ = np.sort(x, axis=1)
                q = []
                for share in (0.25, 0.75):
                    i, rest = divmod(share * (p - 1), 1)
                    a, b = ordered_[:, int(i)], ordered_[:, min(int(i) + 1, p - 1)]
                    q.append(a + (b - a) * rest)
                span_, last = high - low, close[part]
                values = {
                    "mean": mean, "std": std, "skew": g1 * (math.sqrt(p * (p - 1)) / (p - 2)), "kurt": (g2 * (p + 1) + 6) * ((p - 1) / ((p - 2) * (p - 3))), "min": low, "max": high, "range": span_,
                    "position_in_range": (last - low) / (span_ + EPS), "quantile_25": q[0], "quantile_75": q[1], "iqr": q[1] - q[0], "zscore": (last - mean) / (std + EPS),
                }
                for name, v in values.items():
                    if f"{name}_{p}" in out:
                        out[f"{name}_{p}"][part] = v
        return pd.concat([rows, pd.DataFrame(out, index=rows.index)], axis=1)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"`{n}` double" for n in names])
    return bars.groupBy("ticker").applyInPandas(run, schema)


def pattern(bars: DataFrame) -> DataFrame:
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    frame = bars.withColumn("_rn", F.row_number().over(ordered()))
    out: dict[str, Column] = {}
    for p in (5, 10, 20):
        out[f"higher_high_{p}"] = flag(h > full(p, F.max("high"), "high", before(p)))
        out[f"lower_low_{p}"] = flag(low < full(p, F.min("low"), "low", before(p)))
    for p in (10, 20, 30):
        out[f"trend_slope_{p}"] = full(p, F.regr_slope("close", "_rn"), "close")
        out[f"trend_strength_{p}"] = div(F.abs(full(p, F.regr_slope("close", "_rn"), "close")), std("close", p) + EPS)
    for p in (20, 50):
        top, bottom = full(p, F.max("high"), "high"), full(p, F.min("low"), "low")
        out[f"_at_top_{p}"] = flag(div(F.abs(h - top), top) < 0.01)
        out[f"_at_bottom_{p}"] = flag(div(F.abs(low - bottom), bottom) < 0.01)
        out[f"breakout_up_{p}"] = flag(c > full(p, F.max("high"), "high", before(p)))
        out[f"breakout_down_{p}"] = flag(c < full(p, F.min("low"), "low", before(p)))
    frame = frame.withColumns(out)
    touches = {}
    for p in (20, 50):
        for name, of in (("resistance", "_at_top"), ("support", "_at_bottom")):
            touches[f"{name}_touches_{p}"] = F.when(F.col("_rn") >= p, F.sum(f"{of}_{p}").over(trailing(p)))
    frame = frame.withColumns(touches)
    for p in (5, 10, 20):
        frame = run_length(frame, f"higher_high_{p}", f"consecutive_higher_highs_{p}")
        frame = run_length(frame, f"lower_low_{p}", f"consecutive_lower_lows_{p}")
    return frame.drop("_rn", *[f"{n}_{p}" for n in ("_at_top", "_at_bottom") for p in (20, 50)])


def technical(bars: DataFrame, recursive: bool = True) -> DataFrame:
    """Without the recursive ones, the exponential means and what is made of them, the plan has no Python."""
    c = F.col("close")
    spans = (5, 10, 20, 50, 100, 200)
    frame = recursive_means(bars, {f"ema_{p}": ("close", span(p)) for p in spans}) if recursive else bars
    frame = frame.withColumns({"_tr": true_range(), **{f"sma_{p}": mean("close", p) for p in spans}})
    out: dict[str, Column] = {}
    for p in spans:
        out[f"close_to_sma_{p}"] = div(c, F.col(f"sma_{p}"))
        if recursive:
            out[f"close_to_ema_{p}"] = div(c, F.col(f"ema_{p}"))
    for a, b in ((5, 20), (20, 50), (50, 200)):
        out[f"ma_cross_{a}_{b}"] = flag(F.col(f"sma_{a}") > F.col(f"sma_{b}"))
    for p in (10, 20, 30):
        m, s = mean("close", p), std("close", p)
        out |= {f"bb_upper_{p}": m + 2 * s, f"bb_lower_{p}": m - 2 * s, f"bb_width_{p}": 4 * s, f"bb_position_{p}": div(c - (m - 2 * s), 4 * s + EPS)}
    for p in (7, 14, 21):
        out |= {f"atr_{p}": mean("_tr", p), f"atr_ratio_{p}": div(mean("_tr", p), c)}
    return frame.withColumns(out).drop("_tr")


def cyclical(bars: DataFrame) -> DataFrame:
    d = F.to_date("ts")
    turn = lambda x, n: (F.lit(2 * math.pi) * x) / n
    out: dict[str, Column] = {}
    for name, x, n in (("day", F.weekday(d), 7), ("month_day", F.dayofmonth(d), 30), ("month", F.month(d), 12)):
        out |= {f"{name}_sin": F.sin(turn(x, n)), f"{name}_cos": F.cos(turn(x, n))}
    first, last = F.dayofmonth(d) == 1, d == F.last_day(d)
    out |= {"quarter": F.quarter(d), "is_month_start": first.cast("int"), "is_month_end": last.cast("int"), "is_quarter_start": (first & (F.month(d) % 3 == 1)).cast("int"), "is_quarter_end": (last & (F.month(d) % 3 == 0)).cast("int")}
    return bars.withColumns(out)


FAMILIES = {"price": price, "volume": volume, "momentum": momentum, "statistical": statistical, "pattern": pattern, "technical": technical, "cyclical": cyclical}


def features(bars: DataFrame, families=tuple(FAMILIES)) -> DataFrame:
    """Bars with the columns of some families, by default all: 205 and the bars' own."""
    for name in families:
        bars = FAMILIES[name](bars)
    return bars


def importance(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, importance, category): absolute correlation of each column with the next bar's return, the largest first."""
    # One row for each value: aggregates for all columns at once would be too much code to compile.
    nxt = frame.withColumn("_next", F.lead("close").over(ordered()) / F.col("close") - 1).where("_next is not null")
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = nxt.select("_next", F.explode(pairs).alias("p")).select("p.feature", "p.x", F.when(F.col("p.x").isNotNull(), F.col("_next")).alias("y"))
    # A constant has no correlation; its deviation, merged from the sums of several tasks, need not be exactly 0.
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    value = F.when(varies, F.abs(F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")))).alias("importance")
    out = long.groupBy("feature").agg(value).withColumn("category", category(F.col("feature")))
    return out.orderBy(F.desc_nulls_last("importance"), "feature")


def category(name: Column) -> Column:
    # Substrings of a column's name that tell its family; the first rule that fits counts
    rules = [("volume", ("volume",)), ("momentum", ("momentum", "roc")), ("moving_average", ("ma",)), ("bollinger", ("bb",)), ("pattern", ("pattern", "higher", "lower")), ("statistical", ("stat", "std", "mean")), ("cyclical", ("sin", "cos"))]
    out = F.lit("price")
    for label, parts in reversed(rules):
        test = name.contains(parts[0])
        for p in parts[1:]:
            test = test | name.contains(p)
        out = F.when(test, label).otherwise(out)
    return out
