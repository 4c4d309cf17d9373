"""One query for each operator of the market side, on bars built from the tables.

Values that sum many numbers depend on the order of summation in their last bits; these come divided by the close where
they are prices, and rounded to eight digits, so that they can be compared between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.functions.windows import KEY, TIME
from candlework.operators import features, indicators, labels, model, prepare, returns, screen
from candlework.sources import bars as B


def _rel(*names: str):
    """Columns over the close, rounded."""
    return [F.round(F.try_divide(F.col(n).cast("double"), F.col("close")), 8).alias(n) for n in names]


def _r(*names: str, digits: int = 8):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def _feature(family: str, exact=(), rounded=(), relative=(), coarse=(), **options):
    def query(spark, sf_dir) -> DataFrame:
        return features.FAMILIES[family](B.bars_deep(spark, sf_dir), **options).select(KEY, TIME, *exact, *_r(*rounded), *_r(*coarse, digits=6), *_rel(*relative))

    query.plain, query.relative = (*exact, *rounded, *coarse), tuple(relative)
    return query


def bars_daily(spark, sf_dir):
    return B.bars_deep(spark, sf_dir)


def bars_hourly(spark, sf_dir):
    return B.bars_hourly(spark, sf_dir)


def universe_info(spark, sf_dir):
    return B.universe(spark, sf_dir)


def sector_distribution(spark, sf_dir):
    return B.sector_distribution(B.universe(spark, sf_dir))


def latest_price(spark, sf_dir):
    return B.latest_price(B.bars_broad(spark, sf_dir))


def returns_basic(spark, sf_dir):
    return returns.returns(B.bars_deep(spark, sf_dir)).select(KEY, TIME, *_r("daily_return", "log_return", "cumulative_return", "ma5_return", "ma20_return"))


def volatility_hist(spark, sf_dir):
    return returns.volatility(B.bars_deep(spark, sf_dir)).select(KEY, TIME, *_r("volatility", "parkinson_vol"), *_rel("atr"))


def _windowed_ps(*stems, ps):
    return [f"{s}_{p}" for s in stems for p in ps]


PS = (5, 10, 20, 30, 60)
feat_price = _feature("price", exact=["gap"], rounded=["high_low_ratio", "close_open_ratio", "price_position", "gap_percentage", *[f"{k}_{p}d" for k in ("return", "log_return") for p in (1, 2, 3, 5, 10, 20, 30)], *[f"{k}_change_{p}d" for k in ("high", "low") for p in (5, 10, 20)]])
feat_candles = _feature("price", exact=["body_size", "upper_shadow", "lower_shadow", "is_doji", "is_hammer"])


def feat_shadows(spark, sf_dir):
    """Without shadows the ratio is some 1e14; beyond 10,000 it is given as that."""
    return features.price(B.bars_deep(spark, sf_dir)).select(KEY, TIME, F.round(F.least("body_to_shadow_ratio", F.lit(1e4)), 8).alias("body_to_shadow_ratio"))


feat_volume = _feature("volume", rounded=[*[f"volume_{k}_{p}d" for k in ("change", "ratio") for p in (1, 5, 10, 20)], *[f"volume_{k}_{p}" for k in ("ma", "std") for p in (5, 10, 20, 50)], "volume_price_correlation", "volume_spike"], relative=["price_volume_trend"])
feat_money_flow = _feature("volume", rounded=["money_flow", "money_flow_ma"])
feat_momentum = _feature("momentum", exact=["momentum_5", "momentum_10", "momentum_20"], rounded=["roc_5", "roc_10", "roc_20", "roc_30"], relative=["price_acceleration"])
feat_rs_efficiency = _feature("momentum", rounded=["rs_7", "rs_14", "rs_21", "efficiency_10", "efficiency_20"])
feat_stats_moments = _feature("statistical", exact=_windowed_ps("min", "max", "range", ps=PS), rounded=_windowed_ps("position_in_range", "skew", ps=PS), coarse=_windowed_ps("kurt", ps=PS), relative=_windowed_ps("mean", "std", ps=PS))
feat_stats_quantiles = _feature("statistical", relative=_windowed_ps("quantile_25", "quantile_75", "iqr", ps=PS))
feat_zscore = _feature("statistical", rounded=_windowed_ps("zscore", ps=(10, 20, 30)))
feat_higher_high_runs = _feature("pattern", exact=_windowed_ps("higher_high", "lower_low", "consecutive_higher_highs", "consecutive_lower_lows", ps=(5, 10, 20)))
feat_trend_slope = _feature("pattern", rounded=_windowed_ps("trend_strength", ps=(10, 20, 30)), relative=_windowed_ps("trend_slope", ps=(10, 20, 30)))
feat_touches = _feature("pattern", exact=_windowed_ps("resistance_touches", "support_touches", ps=(20, 50)))
feat_breakout = _feature("pattern", exact=_windowed_ps("breakout_up", "breakout_down", ps=(20, 50)))
SP = (5, 10, 20, 50, 100, 200)
feat_sma_cross = _feature("technical", recursive=False, exact=["ma_cross_5_20", "ma_cross_20_50", "ma_cross_50_200"], rounded=_windowed_ps("close_to_sma", ps=SP), relative=_windowed_ps("sma", ps=SP))
feat_ema = _feature("technical", rounded=_windowed_ps("close_to_ema", ps=SP), relative=_windowed_ps("ema", ps=SP))
feat_bollinger = _feature("technical", recursive=False, rounded=_windowed_ps("bb_position", ps=(10, 20, 30)) + _windowed_ps("atr_ratio", ps=(7, 14, 21)), relative=_windowed_ps("bb_upper", "bb_lower", "bb_width", ps=(10, 20, 30)) + _windowed_ps("atr", ps=(7, 14, 21)))
feat_cyclical = _feature("cyclical", exact=["quarter", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end"], rounded=["day_sin", "day_cos", "month_day_sin", "month_day_cos", "month_sin", "month_cos"])


def _indicators(exact=(), rounded=(), relative=()):
    return lambda spark, sf_dir: indicators.indicators(B.bars_deep(spark, sf_dir), (*exact, *rounded, *relative)).select(KEY, TIME, *exact, *_r(*rounded), *_rel(*relative))


ind_rsi = _indicators(rounded=["rsi"])
ind_macd = _indicators(relative=["macd", "macd_signal", "macd_hist", "ema_12", "ema_26"])
ind_stoch = _indicators(rounded=["stoch_k", "stoch_d"])
ind_obv_vwap = _indicators(exact=["obv"], rounded=["volume_ratio"], relative=["vwap"])
ind_atr_adx = _indicators(rounded=["adx"], relative=["atr"])


ind_bands = _indicators(rounded=["bb_width"], relative=["bb_upper", "bb_middle", "bb_lower", "sma_20", "sma_50", "sma_200", "volume_sma"])


def ind_vwap_intraday(spark, sf_dir):
    return indicators.indicators(B.bars_hourly(spark, sf_dir), ("vwap",)).select(KEY, TIME, *_rel("vwap"))


def ind_snapshot_score(spark, sf_dir):
    last = indicators.summary(indicators.score(indicators.analyze(B.bars_trending(spark, sf_dir))))
    return last.select(KEY, TIME, "n_bars", "score", F.col("summary.rsi.signal").alias("rsi_signal"), F.col("summary.macd.crossover").alias("macd_crossover"), F.col("summary.bollinger_bands.signal").alias("bb_signal"), *_r("bb_percent", "volume_ratio", "rsi", "adx", "stoch_k"))


def ind_signals(spark, sf_dir):
    last = indicators.signals(indicators.analyze(B.bars_trending(spark, sf_dir)))
    return last.select(KEY, F.array_join("signals", ",").alias("signals"))


def _checked(spark, sf_dir):
    rows = screen.by_mode(screen.metrics(B.bars_trending(spark, sf_dir)), screen.MODES)
    return screen.scored(screen.checks(rows, "criteria"))


def screen_metrics(spark, sf_dir):
    rows = screen.metrics(B.bars_trending(spark, sf_dir))
    return rows.select(KEY, TIME, "avg_volume", "consecutive_up_days", "is_near_resistance", "relative_strength", "accumulation_score", *_r("current_price", "weekly_change", "daily_change", "volume_ratio", "momentum", "volatility"))


def screen_checks(spark, sf_dir):
    return _checked(spark, sf_dir).select("mode", KEY, "passed", F.array_join("passed_checks", ",").alias("passed_checks"), F.array_join("failed_checks", ",").alias("failed_checks"))


def screen_scores(spark, sf_dir):
    return _checked(spark, sf_dir).select("mode", KEY, *_r("quality_score"), "setup_quality", "recommendation")


def screen_rank(spark, sf_dir):
    rows = screen.screen(B.bars_trending(spark, sf_dir), screen.MODES["loose"])
    return screen.ranked(rows.withColumn("quality_score", F.round("quality_score", 8)), 50, only_passed=False).select(KEY, "quality_score", "setup_quality", "recommendation", "passed")


def screen_pass_rate(spark, sf_dir):
    return screen.pass_rate(_checked(spark, sf_dir)).select("mode", "n", "n_passed", *_r("rate"))


def screen_report(spark, sf_dir):
    return screen.report(screen.screen(B.bars_trending(spark, sf_dir), screen.MODES["loose"])).select(KEY, "line")


def bars_trending(spark, sf_dir):
    return B.bars_trending(spark, sf_dir)


def bars_weekly(spark, sf_dir):
    return B.scan(B.bars_deep(spark, sf_dir), interval="1wk")


def bars_scan(spark, sf_dir):
    return B.scan(B.bars_broad(spark, sf_dir), ["1", "5", "7", "none"], end="1998-01-01", period="1y")


def bars_last_year(spark, sf_dir):
    return B.scan(B.bars_broad(spark, sf_dir), B.first_tickers(B.universe(spark, sf_dir), 5), period="1y")


def universe_limit(spark, sf_dir):
    return B.first_tickers(B.universe(spark, sf_dir), 20).select("ticker")


def universe_detailed(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    published = s.select(F.concat(F.lit(" S."), F.col("s_suppkey")).alias("Symbol "), F.col("s_name").alias("Security"), F.col("s_nationkey").alias("CIK"), F.col("s_acctbal").alias("Notes"))
    return B.detailed_universe(published)


def universe_html(spark, sf_dir):
    """A page with a table of constituents, made from the suppliers, and what is read from it."""
    row = F.concat(F.lit("<tr><td> <a href='/q'>S."), "s_suppkey", F.lit("</a></td><td>"), "s_name", F.lit("</td></tr>"))
    rows = B.table(spark, sf_dir, "supplier").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))
    page = F.concat(F.lit("<table class='wikitable sortable'><tr><th>No</th></tr><tr><td>X</td></tr></table><table id=constituents><tr><th>Symbol</th></tr>"), F.array_join("rows.row", ""), F.lit("</table>"))
    return B.universe_from_html(rows.select(page.alias("html"))).select("pos", "ticker")


def fundamentals_lookup(spark, sf_dir):
    rows = B.universe(spark, sf_dir).withColumn("beta", F.length("name").cast("double"))
    return B.fundamentals(rows, B.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).cast("string").alias("ticker")))


def _gappy(spark, sf_dir):
    bars = B.bars_deep(spark, sf_dir)
    i = F.row_number().over(prepare.ordered())
    return bars.withColumn("i", i).withColumn("close", F.when(F.col("i") % 7 != 0, F.col("close")))


def impute_linear(spark, sf_dir):
    return prepare.impute(_gappy(spark, sf_dir), ["close"]).select(KEY, TIME, F.round(F.col("close") / F.col("high"), 8).alias("close_to_high"))


def impute_ffill(spark, sf_dir):
    return prepare.impute(_gappy(spark, sf_dir), ["close"], "forward_fill").select(KEY, TIME, "close")


def impute_mean(spark, sf_dir):
    return prepare.impute(_gappy(spark, sf_dir), ["close"], "mean").select(KEY, TIME, F.round(F.col("close") / F.col("high"), 8).alias("close_to_high"))


def impute_drop(spark, sf_dir):
    return prepare.impute(_gappy(spark, sf_dir), ["close"], "drop").select(KEY, TIME, "close")


def scale_minmax(spark, sf_dir):
    return prepare.scale(B.bars_deep(spark, sf_dir), ["close", "high"], "minmax").select(KEY, TIME, *_r("close", "high"))


def scale_fitted(spark, sf_dir):
    """Parameters of the training rows, applied to the test rows."""
    rows = prepare.split_chronological(B.bars_deep(spark, sf_dir))
    fitted = prepare.scale_parameters(rows.where("split = 'train'"), ["close"])
    return prepare.scale(rows.where("split = 'test'"), ["close"], fitted=fitted).select(KEY, TIME, *_r("close"))


def scale_standard(spark, sf_dir):
    return prepare.scale(B.bars_deep(spark, sf_dir), ["close", "high"]).select(KEY, TIME, *_r("close", "high"))


def scale_robust(spark, sf_dir):
    return prepare.scale(B.bars_deep(spark, sf_dir), ["volume"]).select(KEY, TIME, *_r("volume"))


def feature_stats(spark, sf_dir):
    return prepare.feature_stats(B.bars_deep(spark, sf_dir), ["high", "volume"]).select("feature", "n", "n_null", F.round(F.col("mean") / F.col("q50"), 8).alias("mean"), F.round(F.col("std") / F.col("q50"), 8).alias("std"), "min", "max", F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"))


def feature_importance(spark, sf_dir):
    rows = features.features(B.bars_deep(spark, sf_dir))
    return features.importance(rows, [c for c in rows.columns if c not in (KEY, TIME)]).select("feature", *_r("importance", digits=6), "category")


def split_chrono(spark, sf_dir):
    return prepare.split_chronological(B.bars_deep(spark, sf_dir)).select(KEY, TIME, "split")


def split_info(spark, sf_dir):
    return prepare.split_info(prepare.split_chronological(B.bars_deep(spark, sf_dir)))


def split_gap(spark, sf_dir):
    return prepare.split_gap(B.bars_deep(spark, sf_dir), 60, 5).select(KEY, TIME, "split")


def split_walk_forward(spark, sf_dir):
    return prepare.split_walk_forward(B.bars_deep(spark, sf_dir)).groupBy(KEY, "fold", "split").agg(F.count(F.lit(1)).alias("n"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"))


def split_stratified(spark, sf_dir):
    bars = B.bars_deep(spark, sf_dir).withColumn("label", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    return prepare.split_stratified(bars, "label").select(KEY, TIME, "label", "split")


def seq_windows(spark, sf_dir):
    rows = prepare.sequences(B.bars_deep(spark, sf_dir), ["close", "volume"])
    return rows.select(KEY, TIME, F.size("seq").alias("n"), F.element_at("seq", 1)[0].cast("double").alias("first_close"), F.element_at("seq", -1)[1].cast("double").alias("last_volume"), F.col("target").cast("double").alias("target"))


def _sums():
    """Sums over a sequence of each of its two columns."""
    column = lambda i: F.transform("seq", lambda x: x[i].cast("double"))
    return [F.round(F.aggregate(column(i), F.lit(0.0), lambda a, x: a + x), 2).alias(f"sum_{i}") for i in (0, 1)]


def seq_arrays(spark, sf_dir):
    rows = prepare.sequences(B.bars_deep(spark, sf_dir), ["close", "volume"])
    return rows.select(KEY, TIME, *_sums(), F.element_at("seq", 30)[0].cast("double").alias("middle_close"))


def seq_split(spark, sf_dir):
    return prepare.split_sequences(prepare.sequences(B.bars_deep(spark, sf_dir), ["close", "volume"])).select(KEY, TIME, "split")


def preprocess_sequences(spark, sf_dir):
    rows = prepare.preprocess(B.bars_deep(spark, sf_dir))[1]
    return rows.select(KEY, TIME, F.size("seq").alias("n"), F.size(F.element_at("seq", 1)).alias("width"), F.round(F.element_at("seq", 60)[3].cast("double"), 4).alias("last_close"), F.round(F.col("target").cast("double"), 4).alias("target"))


def preprocess_metadata(spark, sf_dir):
    return prepare.preprocess(B.bars_deep(spark, sf_dir), ("price", "cyclical"))[2]


def label_windows(spark, sf_dir):
    return labels.dataset(B.bars_deep(spark, sf_dir)).select(KEY, "date", "pattern_id", *_r("confidence", "future_return"))


def label_distribution(spark, sf_dir):
    return labels.distribution(labels.dataset(B.bars_deep(spark, sf_dir))).select("pattern_id", "n", *_r("share"))


def backtest_direction(spark, sf_dir):
    return labels.backtest(B.bars_deep(spark, sf_dir)).select(KEY, "pattern_id", *_r("confidence", "actual_return"), "correct")


def backtest_accuracy(spark, sf_dir):
    return labels.accuracy(labels.backtest(B.bars_broad(spark, sf_dir))).select("n", *_r("accuracy"))


def training_metadata(spark, sf_dir):
    rows = prepare.split_chronological(B.bars_deep(spark, sf_dir))
    made = model.training_metadata(rows, labels.backtest(B.bars_broad(spark, sf_dir)), 20, "2024-01-02 03:04:05")
    read = lambda name, kind: F.get_json_object("metadata", f"$.{name}").cast(kind).alias(name)
    return made.select(F.round(read("test_accuracy", "double"), 8).alias("test_accuracy"), *[read(x, "long") for x in ("training_samples", "validation_samples", "test_samples", "epochs")], read("training_date", "string"))


def label_records(spark, sf_dir):
    return labels.records(labels.dataset(B.bars_deep(spark, sf_dir))).select(KEY, "date", "pattern", "start_idx", "end_idx", "breakout_idx")


def chart_matrix(spark, sf_dir):
    rows = model.matrix(labels.dataset(B.bars_deep(spark, sf_dir)))
    total = lambda i: F.aggregate(F.transform("chart", lambda b: b[i]), F.lit(0.0), lambda a, x: a + x)
    return rows.select(KEY, "date", F.size("chart").alias("n"), *[F.round(total(i), 6).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))])


def collect_dataset(spark, sf_dir):
    return labels.collect(B.bars_trending(spark, sf_dir)).groupBy(KEY, "pattern_id").agg(F.count(F.lit(1)).alias("n"))


def collect_scaled(spark, sf_dir):
    return labels.collect(B.bars_trending(spark, sf_dir), "scaled").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))


def breakout_points(spark, sf_dir):
    return labels.breakout_point(B.bars_deep(spark, sf_dir))


def pattern_boxes(spark, sf_dir):
    return labels.pattern_box(B.bars_deep(spark, sf_dir))


def model_detect(spark, sf_dir):
    rows = labels.dataset(B.bars_deep(spark, sf_dir))
    return model.detect(model.train(rows), rows, least=0.5).select(KEY, "date", "pattern_id", "confidence")


def model_backtest(spark, sf_dir):
    trained = model.train(labels.dataset(B.bars_deep(spark, sf_dir)))
    return model.backtest(trained, B.bars_broad(spark, sf_dir)).select(KEY, "pattern_id", "confidence", "actual_return", "correct")


def augment(spark, sf_dir):
    rows = labels.dataset(B.bars_deep(spark, sf_dir)).select(KEY, "date", "pattern_id", "w_c")
    total = F.aggregate("w_c", F.lit(0.0), lambda a, x: a + x)
    return labels.augment(rows, "w_c").select(KEY, "date", "variant", F.size("w_c").alias("n"), F.round(F.element_at("w_c", 1), 8).alias("first"), F.round(F.element_at("w_c", 60), 8).alias("last"), F.round(total, 4).alias("total"))


NAMES = (
    "bars_daily bars_hourly universe_info sector_distribution latest_price returns_basic volatility_hist feat_price feat_candles feat_shadows feat_volume feat_money_flow feat_momentum feat_rs_efficiency feat_stats_moments "
    "feat_stats_quantiles feat_zscore feat_higher_high_runs feat_trend_slope feat_touches feat_breakout feat_sma_cross feat_ema feat_bollinger feat_cyclical ind_rsi ind_macd ind_stoch ind_obv_vwap ind_atr_adx "
    "ind_snapshot_score ind_signals screen_checks screen_rank impute_linear impute_ffill scale_standard scale_robust feature_stats feature_importance split_chrono split_info split_gap split_walk_forward "
    "split_stratified seq_windows label_windows label_distribution backtest_direction breakout_points model_detect augment "
    "bars_trending bars_weekly bars_scan bars_last_year universe_limit universe_detailed universe_html fundamentals_lookup ind_bands ind_vwap_intraday screen_metrics screen_scores screen_pass_rate screen_report impute_mean impute_drop "
    "scale_minmax scale_fitted seq_arrays seq_split preprocess_sequences preprocess_metadata backtest_accuracy training_metadata label_records chart_matrix collect_dataset collect_scaled pattern_boxes model_backtest"
).split()
QUERIES = {name: globals()[name] for name in NAMES}


def flagship(spark, sf_dir) -> DataFrame:
    """The tickers with the largest last return over their volatility."""
    rows = returns.volatility(B.bars_deep(spark, sf_dir))
    from candlework.functions.windows import last_rows

    return last_rows(rows).select(KEY, TIME, "close", "daily_return", "volatility").orderBy(F.desc_nulls_last(F.try_divide("daily_return", "volatility")), KEY).limit(20)
