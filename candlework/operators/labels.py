"""Rule-based chart patterns on windows of 60 bars, forward returns, backtests and augmentation.

A window is an array column made by one window aggregate; the rules are array functions on it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions.windows import KEY, TIME, div, lead, ordered

W = 60
#: Pattern numbers and names
PATTERNS = {0: "no_pattern", 1: "bull_flag", 2: "bear_flag", 3: "ascending_triangle", 4: "descending_triangle", 5: "symmetrical_triangle", 6: "cup_and_handle", 7: "inverse_cup_and_handle", 8: "head_shoulders", 9: "inverse_head_shoulders", 10: "double_bottom", 11: "double_top"}
BULLISH, BEARISH = (1, 6, 10), (8,)


def _slice(name: str, a, b) -> Column:
    """Half-open, from 0; the bounds may be columns."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.slice(name, (a + 1).cast("int"), (b - a).cast("int"))


def _at(name: str, i: int) -> Column:
    return F.element_at(name, i + 1)


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def _std(x: Column) -> Column:
    mean = _mean(x)
    return F.sqrt(F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / (F.size(x) - 1))


def windows(bars: DataFrame, start: bool = True) -> DataFrame:
    """Adds arrays w_o, w_h, w_l, w_c, w_v of the 60 bars from each row on (or up to it), null where there are fewer, and the bars' count."""
    frame = ordered().rowsBetween(0, W - 1) if start else ordered().rowsBetween(-(W - 1), 0)
    full = F.count("close").over(frame) == W
    arrays = {a: F.when(full, F.collect_list(c).over(frame)) for a, c in (("w_o", "open"), ("w_h", "high"), ("w_l", "low"), ("w_c", "close"), ("w_v", "volume"))}
    return bars.withColumns({**arrays, "_i": F.row_number().over(ordered()) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(KEY))})


def bull_flag() -> Column:
    c24, c0, last = _at("w_c", 24), _at("w_c", 0), _at("w_c", W - 1)
    up = div(c24 - c0, c0)
    changes = F.transform(F.sequence(F.lit(25), F.lit(47)), lambda i: F.element_at("w_c", i + 1) / F.element_at("w_c", i) - 1)
    vol = _std(changes)
    top = F.array_max(_slice("w_h", 24, 48))
    spread = div(top - F.array_min(_slice("w_l", 24, 48)), c24)
    sma = _mean(_slice("w_c", 21, 41))
    trend = div(last - sma, sma)
    return F.least(
        F.lit(1.0),
        F.when(up > 0.10, 0.3).when(up > 0.05, 0.15).otherwise(0.0)
        + F.when(trend > 0.10, 0.2).when(trend > 0.05, 0.1).otherwise(0.0)
        + F.when((vol < 0.02) & (spread < 0.05), 0.25).when((vol < 0.03) & (spread < 0.08), 0.1).otherwise(0.0)
        + F.when(last > top, 0.25).otherwise(0.0),
    )


def cup_and_handle() -> Column:
    left, bottom, right, handle = F.array_max(_slice("w_c", 0, 15)), F.array_min(_slice("w_c", 15, 45)), F.array_max(_slice("w_c", 45, 55)), F.array_min(_slice("w_c", 55, 60))
    rim = 1 - div(F.abs(left - right), left)
    depth = div(left - bottom, left)
    return F.when(rim > 0.95, 0.4).when(rim > 0.90, 0.2).otherwise(0.0) + F.when(depth.between(0.10, 0.30), 0.3).otherwise(0.0) + F.when(handle > bottom + 0.5 * (right - bottom), 0.3).otherwise(0.0)


def head_shoulders() -> Column:
    parts = [_slice("w_h", a, a + 20) for a in (0, 20, 40)]
    left, centre, right = (F.array_max(p) for p in parts)
    at = [F.array_position(p, F.array_max(p)).cast("int") - 1 + a for p, a in zip(parts, (0, 20, 40))]
    alike = 1 - div(F.abs(left - right), left)
    neck = F.least(F.array_min(_slice("w_h", at[0], at[1])), F.array_min(_slice("w_h", at[1], at[2])))
    return F.when((centre > left) & (centre > right), 0.4).otherwise(0.0) + F.when(alike > 0.90, 0.3).otherwise(0.0) + F.when(_at("w_c", W - 1) < neck, 0.3).otherwise(0.0)


def double_bottom() -> Column:
    a, b = _slice("w_l", 0, 30), _slice("w_l", 30, 60)
    first, second = F.array_min(a), F.array_min(b)
    i1, i2 = F.array_position(a, first).cast("int") - 1, F.array_position(b, second).cast("int") + 29
    alike = 1 - div(F.abs(first - second), first)
    peak = F.array_max(_slice("w_h", i1, i2))
    height = div(peak - first, first)
    return F.when(alike > 0.97, 0.4).when(alike > 0.95, 0.2).otherwise(0.0) + F.when(height > 0.05, 0.3).otherwise(0.0) + F.when(_at("w_c", W - 1) > peak, 0.3).otherwise(0.0)


def labelled(frame: DataFrame) -> DataFrame:
    """Adds pattern_id and confidence to rows with window arrays: the best rule, the first of equals; under 0.4 none, surely."""
    names = {1: "s_bull_flag", 6: "s_cup_and_handle", 8: "s_head_shoulders", 10: "s_double_bottom"}
    scores = F.struct(*[s.alias(n) for n, s in zip(names.values(), (bull_flag(), cup_and_handle(), head_shoulders(), double_bottom()))])
    # Exploding an array of one keeps the optimizer from copying each rule into every place that uses its score.
    frame = frame.withColumn("_scores", F.explode(F.array(scores))).select("*", "_scores.*").drop("_scores")
    best = F.greatest(*names.values())
    which = F.lit(None).cast("int")
    for number, name in reversed(names.items()):
        which = F.when(F.col(name) == best, number).otherwise(which)
    none = best < 0.4
    return frame.withColumns({"pattern_id": F.when(none, 0).otherwise(which), "confidence": F.when(none, 1.0).otherwise(best)})


def dataset(bars: DataFrame, stride: int = 5, ahead: int = 20) -> DataFrame:
    """Labelled windows: (ticker, date, pattern_id, confidence, future_return), contradicted labels set to 0, unsure ones dropped.

    Windows start at every stride-th bar, of tickers with 110 bars or more, and leave the last ahead bars for the outcome.
    """
    frame = windows(bars).withColumns({"_end": lead(TIME, W - 1), "_last": lead("close", W - 1), "_then": lead("close", W - 1 + ahead)})
    frame = frame.where((F.col("_n") >= W + 50) & (F.col("_i") % stride == 0) & (F.col("_i") < F.col("_n") - W - ahead))
    frame = labelled(frame).withColumn("future_return", div(F.col("_then") - F.col("_last"), "_last"))
    fr, p = F.col("future_return"), F.col("pattern_id")
    wrong = (p.isin(*BULLISH) & (fr < -0.05)) | (p.isin(*BEARISH) & (fr > 0.05))
    frame = frame.withColumn("pattern_id", F.when(wrong, 0).otherwise(p)).where((F.col("confidence") > 0.6) | (F.col("pattern_id") == 0))
    start = F.col("_i").cast("long").alias("start_idx")
    return frame.select(KEY, F.col("_end").alias("date"), "pattern_id", "confidence", "future_return", start, "w_o", "w_h", "w_l", "w_c", "w_v")


def records(rows: DataFrame, back: int = 20) -> DataFrame:
    """Adds to rows with pattern_id, start_idx and window arrays: pattern (its name), end_idx, and breakout_idx.

    Places are of bars in the ticker's series. The breakout is at the window's last bar if its close is above 0.99 of the
    highest high of its last bars, else null.
    """
    names = F.create_map(*[F.lit(x) for pair in PATTERNS.items() for x in pair])
    end = F.col("start_idx") + W - 1
    out = _at("w_c", W - 1) > 0.99 * F.array_max(_slice("w_h", W - back, W))
    return rows.withColumns({"pattern": names[F.col("pattern_id")], "end_idx": end, "breakout_idx": F.when(out, end)})


def collect(bars: DataFrame, prices: str = "raw", most: int = 100, least_bars: int = 250) -> DataFrame:
    """A data set for training: labelled windows of the tickers that pass the loose screen, the best ones by score.

    prices: windows of the bars as they are, or "scaled": of each ticker's scaled columns, so that thresholds on relative
    changes apply to deviations from the mean, as in the pipeline this follows. Tickers need more than least_bars bars.
    """
    from candlework.operators import prepare, screen

    good = screen.ranked(screen.screen(bars, screen.MODES["loose"]), most).select(KEY)
    some = bars.join(good, KEY, "left_semi").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KEY))).where(F.col("_n") > least_bars).drop("_n")
    if prices == "scaled":
        some = prepare.preprocess(some)[0]
    elif prices != "raw":
        raise ValueError("prices must be raw or scaled")
    return dataset(some)


def distribution(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each pattern


def held_back(bars: DataFrame, ahead: int = 20) -> DataFrame:
    """The windows of 60 bars before each ticker's last ahead ones, with actual_return, what came after.

    A row for each ticker with enough bars, that of the window's first bar, with its arrays as windows() makes them: only
    the last bars are collected, once for each ticker, not a window at each bar.
    """
    counted = bars.withColumns({"_i": F.row_number().over(ordered()) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(KEY))})
    last = counted.where((F.col("_i") >= F.col("_n") - W - ahead) & (F.col("_n") >= W + ahead))
    held = F.array_sort(F.collect_list(F.struct("_i", F.struct(*counted.columns).alias("row")))).alias("_held")
    frame = last.groupBy(KEY).agg(held).select(F.col("_held")[0]["row"].alias("_first"), F.slice(F.col("_held")["row"], 1, W).alias("_rows"), F.col("_held")[W - 1]["row"]["close"].alias("_last"), F.col("_held")[W + ahead - 1]["row"]["close"].alias("_then"))
    value = lambda c: F.filter(F.col("_rows")[c], lambda x: x.isNotNull())
    full = F.size(value("close")) == W
    arrays = {a: F.when(full, value(c)) for a, c in (("w_o", "open"), ("w_h", "high"), ("w_l", "low"), ("w_c", "close"), ("w_v", "volume"))}
    frame = frame.select("_first.*", *[x.alias(a) for a, x in arrays.items()], "_last", "_then")
    return frame.withColumns({"actual_return": div(F.col("_then") - F.col("_last"), "_last"), "start_idx": F.col("_i").cast("long")})


def judged(rows: DataFrame) -> DataFrame:
    """Adds correct: whether actual_return went the way of pattern_id."""
    r, p = F.col("actual_return"), F.col("pattern_id")
    return rows.withColumn("correct", F.when(p.isin(*BULLISH), r > 0).when(p.isin(2, 8), r < 0).otherwise(F.abs(r) < 0.03))


def backtest(bars: DataFrame, ahead: int = 20) -> DataFrame:
    """A row for each ticker with 80 bars or more: what the rules find in its window that is held back, and whether the
    direction was right. model.backtest does the same with a model's detections."""
    return judged(labelled(held_back(bars, ahead))).select(KEY, "pattern_id", "confidence", "actual_return", "correct")


def accuracy(tested: DataFrame) -> DataFrame:
    return tested.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def breakout_point(bars: DataFrame, k: int = 20) -> DataFrame:
    """(ticker, ts, breakout): whether each ticker's last close is above 0.99 of the highest high of k bars; null with fewer."""
    from candlework.functions.windows import full, last_rows

    out = bars.withColumn("breakout", F.col("close") > 0.99 * full(k, F.max("high"), "high"))
    return last_rows(out).select(KEY, TIME, "breakout")


def pattern_box(bars: DataFrame, k: int = W) -> DataFrame:
    """(ticker, start, end, low, high, marked): the rectangle around each ticker's last k bars that a chart would highlight,
    and the time of the breakout that it would mark, or null."""
    from candlework.functions.windows import last_rows

    box = last_rows(bars, k).groupBy(KEY).agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.min("low").alias("low"), F.max("high").alias("high"))
    return box.join(breakout_point(bars), KEY, "left").select(KEY, "start", "end", "low", "high", F.when(F.col("breakout"), F.col(TIME)).alias("marked"))


def _uniform(*parts: Column) -> Column:
    """On [0, 1), from 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def augment(rows: DataFrame, column: str, label: str = "pattern_id", keys: tuple[str, ...] = (KEY, "date"), seed: int = 1, deviation: float = 0.01) -> DataFrame:
    """Variants of each row's array: as it is, with normal noise, scaled by 0.95 to 1.05, and (labelled rows) rolled by up
    to two places to either side; a roll by none makes no row. Seeded by the row's keys."""
    named = [F.col(k).cast("string") for k in keys]
    u = lambda *what: _uniform(F.lit(str(seed)), *named, *what)
    normal = lambda i: F.sqrt(-2 * F.ln(1 - u(F.lit("a"), i.cast("string")))) * F.cos(2 * math.pi * u(F.lit("b"), i.cast("string")))
    noise = F.transform(column, lambda x, i: x + deviation * normal(i))
    scaled = F.transform(column, lambda x: x * (0.95 + 0.1 * u(F.lit("scale"))))
    shift = F.floor(u(F.lit("roll")) * 5).cast("int") - 2
    n = F.size(column)
    cut = F.pmod(n - shift, n)
    rolled = F.concat(F.slice(column, cut + 1, n - cut), F.slice(column, F.lit(1), cut))
    kinds = [("original", F.col(column)), ("noise", noise), ("scaled", scaled), ("rolled", F.when((F.col(label) != 0) & (shift != 0), rolled))]
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("x")) for k, v in kinds])
    out = rows.withColumn("_v", F.explode(F.filter(variants, lambda v: v["x"].isNotNull())))
    return out.withColumns({"variant": F.col("_v.variant"), column: F.col("_v.x")}).drop("_v")
