"""Market operators on closed-form and random bars, against pandas and by invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from candlework.functions import windows
from candlework.operators import features, indicators, labels, model, prepare, screen
from candlework.plans import queries as plans
from candlework.plans.settings import DataSettings, ModelSettings, ScreenSettings, Settings
from candlework.sources import bars as B
from candlework.sources import cache


def walk(tickers: int = 3, n: int = 130) -> pd.DataFrame:
    rows = []
    for k in range(tickers):
        last = None
        for i in range(n):
            close = (40 + 10 * k) * math.exp(0.0008 * i + 0.03 * math.sin(i / 7 + k))
            open_ = last or close
            rows.append((f"T{k}", dt.date(2023, 1, 2) + dt.timedelta(i), open_, max(open_, close) * 1.01, min(open_, close) * 0.99, close, 1e6 * (1 + k % 7) + 5e4 * (i % 11)))
            last = close
    return pd.DataFrame(rows, columns=["ticker", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), "ticker string, ts date, open double, high double, low double, close double, volume double").cache()


def test_all_features_are_there(bars):
    whole = features.features(bars)
    assert len(whole.columns) == 7 + 205 and len(set(whole.columns)) == len(whole.columns)


def test_statistics_equal_pandas(bars):
    got = features.statistical(bars).where("ticker = 'T1'").orderBy("ts").toPandas()
    c = got["close"]
    for p in (5, 20, 60):
        r = c.rolling(p)
        for name, want in (("mean", r.mean()), ("std", r.std()), ("skew", r.skew()), ("kurt", r.kurt()), ("quantile_25", r.quantile(0.25))):
            np.testing.assert_allclose(got[f"{name}_{p}"].astype(float), want, rtol=1e-6, atol=1e-8, equal_nan=True)


def test_no_look_ahead(bars):
    cut = dt.date(2023, 3, 20)
    whole = features.features(bars).where(F.col("ts") < F.lit(cut)).orderBy("ticker", "ts").toPandas()
    short = features.features(bars.where(F.col("ts") < F.lit(cut))).orderBy("ticker", "ts").toPandas()
    pd.testing.assert_frame_equal(whole, short)


def test_indicators(bars):
    got = indicators.indicators(bars).where("ticker = 'T0'").orderBy("ts").toPandas()
    assert got.rsi.dropna().between(0, 100).all() and got.rsi.isna().sum() == 14
    assert (got.bb_lower.dropna() <= got.bb_upper.dropna()).all()
    np.testing.assert_allclose(got.macd_signal, (got.close.ewm(span=12, adjust=False).mean() - got.close.ewm(span=26, adjust=False).mean()).ewm(span=9, adjust=False).mean())
    short = indicators.score(indicators.analyze(bars)).toPandas()
    assert short.rsi.isna().all() and (short.n_bars == 130).all()


def test_screen(bars):
    rows = screen.screen(bars, screen.MODES["loose"]).toPandas()
    assert len(rows) == 3 and rows.quality_score.between(0, 100).all()
    c = walk().query("ticker == 'T0'").close.to_numpy()
    assert rows.set_index("ticker").weekly_change["T0"] == pytest.approx(c[-1] / c[-5] - 1)


def test_recursive_means_of_many_series_in_batches(spark, monkeypatch):
    monkeypatch.setattr(windows, "HELD", 40)
    lengths = [1, 2, 90, 3, 30, 7, 55, 1, 12]
    rows = [(f"T{k}", i, None if (i + k) % 5 == 0 else math.sin(i * k), i % 3 == 0, f"{k} {i}") for k, n in enumerate(lengths) for i in range(n)]
    frame = spark.createDataFrame(rows, "ticker string, ts int, x double, keep boolean, other string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        means = {"a": ("x", 0.3), "b": ("a", 0.1), "c": (lambda column: column("a") - column("x"), 0.5)}
        got = windows.recursive_means(frame, means).orderBy("ticker", "ts").toPandas()
        kept = windows.recursive_means(frame, means, "keep").orderBy("ticker", "ts").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.DataFrame(rows, columns=["ticker", "ts", "x", "keep", "other"])
    mean = lambda c, alpha: want.groupby("ticker")[c].transform(lambda g: g.ewm(alpha=alpha, adjust=False, ignore_na=True).mean())
    want["a"] = mean("x", 0.3)
    want = want.assign(b=mean("a", 0.1), _d=want.a - want.x)
    want["c"] = mean("_d", 0.5)
    want = want.drop(columns="_d")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-13)
    pd.testing.assert_frame_equal(kept, want[want.keep].reset_index(drop=True), check_dtype=False, rtol=1e-13)


def test_analysis_is_the_last_row_of_indicators_and_calls_python_once(spark):
    daily = walk(2, 450).query("ticker == 'T0' or ts < '2023-09-01'".replace("'2023-09-01'", "@dt.date(2023, 9, 1)"))
    rows = [(r.ticker, dt.datetime.combine(r.ts, dt.time()), *r[3:]) for r in daily.itertuples()]
    rows += [("M", dt.datetime(2024, 1, 1 + i // 300, 9) + dt.timedelta(minutes=i % 300), *r[3:]) for i, r in enumerate(walk(1, 590).itertuples())]
    bars = spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")
    last = indicators.analyze(bars)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
    got = last.orderBy("ticker").toPandas()
    whole = indicators.indicators(bars).toPandas().sort_values("ts").groupby("ticker").tail(1).sort_values("ticker").reset_index(drop=True)
    assert list(got.n_bars) == [590, 450, 242]
    assert got[list(whole.columns)].notna().all(axis=None)
    pd.testing.assert_frame_equal(got[list(whole.columns)], whole, rtol=1e-12)


def test_held_back_windows_are_those_of_all_windows_and_collected_once(spark):
    rows = walk(3, 130).query("ticker != 'T1' or ts < @dt.date(2023, 3, 23)")
    rows = pd.concat([rows, walk(1, 79).assign(ticker="short"), walk(1, 80).assign(ticker=None)])
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows.itertuples(index=False)]
    rows[60] = (*rows[60][:5], None, None)
    rows[400 - 61] = (*rows[400 - 61][:3], None, *rows[400 - 61][4:])
    bars = spark.createDataFrame(rows, "ticker string, ts date, open double, high double, low double, close double, volume double")
    frame = labels.windows(bars).withColumns({"_last": windows.lead("close", 59), "_then": windows.lead("close", 79)}).where("_i = _n - 80")
    frame = frame.withColumns({"actual_return": F.expr("(_then - _last) / _last"), "start_idx": F.col("_i").cast("long")})
    held = labels.held_back(bars)
    assert "collect_list" not in "".join(x for x in held._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x)
    got, want = ({r.ticker: r.asDict() for r in x.collect()} for x in (held, frame))
    assert got == want and len(got) == 4 and any(r["w_c"] is None for r in got.values())


def test_report_rounds_as_printf(spark):
    numbers = [(107.25, 0.056, 1.25, 65.0), (107.125, -0.0004, 0.35, 0.05), (1.005, 0.0125, 2.75, 62.25), (float("inf"), float("nan"), 9.95, -1.25), (1.0, None, 1.0, 1.0)]
    kinds = "ticker string, current_price double, weekly_change double, volume_ratio double, quality_score double, recommendation string"
    rows = [(f"T{i}", *x, "SKIP") for i, x in enumerate(numbers)]
    got = [r.line for r in screen.report(spark.createDataFrame(rows, kinds)).orderBy("ticker").collect()]
    want = [None if r[2] is None else "%s $%.2f week %+.1f%% volume %.1fx score %.1f %s" % (r[0], r[1], r[2] * 100, *r[3:]) + (" VOLUME SURGE" if r[3] >= 2 else "") for r in rows]
    assert got == want


def test_impute(spark):
    rows = [("A", dt.date(2023, 1, 1 + i), x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])]
    frame = spark.createDataFrame(rows, "ticker string, ts date, close double")
    get = lambda how: [r.close for r in prepare.impute(frame, ["close"], how).orderBy("ts").collect()]
    assert get("interpolate") == [1, 1, 2, 3, 4, 4]
    assert get("forward_fill") == [1, 1, 1, 1, 4, 4]
    assert get("mean") == [2.5, 1, 2.5, 2.5, 4, 2.5]
    assert get("drop") == [1, 4]
    with pytest.raises(ValueError):
        prepare.impute(frame, ["close"], "guess")


def test_scale_with_kept_parameters(bars):
    fitted = prepare.scale_parameters(bars, ["close", "volume"], "minmax")
    got = prepare.scale(bars, ["close", "volume"], fitted=fitted).toPandas()
    assert got.close.min() == 0 and got.close.max() == 1
    with pytest.raises(ValueError):
        prepare.scale_parameters(bars, ["close"], "other")


def test_splits(bars):
    n = prepare.split_chronological(bars).groupBy("ticker", "split").count().toPandas().pivot(index="ticker", columns="split", values="count")
    assert (n.train == 91).all() and (n.valid == 19).all() and (n.test == 20).all()
    folds = prepare.split_walk_forward(bars, 5, 30).groupBy("ticker", "fold", "split").count().toPandas()
    assert set(folds[folds.split == "test"]["count"]) == {30}
    assert prepare.split_walk_forward(bars.limit(0), 5, 30).isEmpty()


def test_labels_and_backtest(bars):
    rows = labels.dataset(bars, stride=1).toPandas()
    assert set(rows.pattern_id) <= {0, 1, 6, 8, 10}
    assert labels.backtest(bars).count() == 3
    variants = labels.augment(labels.dataset(bars, stride=25), "w_c")
    assert variants.where("variant = 'rolled' and pattern_id = 0").isEmpty()
    assert {r[0] for r in variants.select(F.size("w_c")).distinct().collect()} == {60}


def test_model_and_augment_queries_take_all_windows(spark, monkeypatch):
    folder, taken, train = "/root/testdata/sf0.001", {}, model.train
    monkeypatch.setattr(model, "train", lambda rows, **options: taken.update(options, n=rows.count()) or train(rows, **options))
    n = labels.dataset(B.bars_deep(spark, folder)).count()
    assert plans.model_detect(spark, folder).columns == ["ticker", "date", "pattern_id", "confidence"] and taken == {"n": n}
    assert plans.augment(spark, folder).where("variant = 'original'").count() == n > 0


def test_importance_query_ranks_all_features(spark, bars):
    found = plans.feature_importance(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(found.feature) == sorted(set(features.features(bars).columns) - {"ticker", "ts"})
    assert found.importance.dropna().between(0, 1).all() and found.importance.notna().sum() > 150


def test_importance_of_a_constant_is_null_over_several_tasks(spark):
    moves = [("T%d" % (i // 50), dt.date(2023, 1, 2) + dt.timedelta(i), 50 + math.sin(i), 1.0, float(i % 7)) for i in range(600)]
    frame = spark.createDataFrame(moves, "ticker string, ts date, close double, same double, other double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.feature: r.importance for r in features.importance(frame, ["same", "other"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["same"] is None and 0 < got["other"] < 1


def test_universe_from_html(spark):
    page = "<table class='wikitable sortable'><tr><th>S</th></tr><tr><td>X</td></tr></table><table id='constituents'><tr><th>Symbol</th></tr><tr><td><a>BRK.B</a>\n</td><td>b</td></tr><tr><td> MMM </td></tr></table>"
    got = B.universe_from_html(spark.createDataFrame([(page,)], "html string")).orderBy("pos").collect()
    assert [r.ticker for r in got] == ["BRK-B", "MMM"]


def test_cache_rules(tmp_path):
    assert cache.universe_is_fresh(7 * 24 - 1) and not cache.universe_is_fresh(7 * 24 + 1)
    assert cache.bars_are_fresh(23) and not cache.bars_are_fresh(2, "1h")
    assert cache.key("BRK-B", "1d") != cache.key("BRKB", "1d")
    cache.write_universe(tmp_path / "u.json", ["A"], [{"ticker": "A"}])
    cache.write_universe(tmp_path / "u.json", ["A", "B"])
    assert cache.read_universe(tmp_path / "u.json")["companies"] == [{"ticker": "A"}]
    assert cache.clear(tmp_path, 0.5) == 0 and cache.clear(tmp_path) == 1


def test_settings(tmp_path):
    assert not Settings().problems()
    bad = Settings(DataSettings(historical_days=5), ScreenSettings(min_price=9, max_price=1, volume_surge=0.5), ModelSettings(threshold=2, weights={"a": 0.5}))
    assert len(bad.problems()) == 6
    Settings().save(tmp_path / "s.json")
    assert Settings.load(tmp_path / "s.json") == Settings()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
