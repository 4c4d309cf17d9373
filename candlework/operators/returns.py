"""Returns, volatilities and true range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions.windows import change, div, full, lag, mean, ordered, std, trailing

YEAR = 252


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def returns(bars: DataFrame) -> DataFrame:
    first = F.first("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    staged = bars.withColumns({"daily_return": change("close"), "log_return": F.ln(div("close", lag("close"))), "cumulative_return": F.when(lag("close").isNotNull(), div("close", first) - 1), "ma5": mean("close", 5), "ma20": mean("close", 20)})
    return staged.withColumns({"ma5_return": change("ma5"), "ma20_return": change("ma20")})


def volatility(bars: DataFrame, window: int = 20) -> DataFrame:
    staged = bars.withColumns({"daily_return": change("close"), "hl2": F.pow(F.ln(div("high", "low")), F.lit(2)), "tr": true_range()})
    return staged.withColumns(
        {"volatility": std("daily_return", window) * math.sqrt(YEAR), "parkinson_vol": F.sqrt(mean("hl2", window) * (YEAR / (4 * math.log(2)))), "atr": full(window, F.avg("tr"), "tr", trailing(window))}
    )
