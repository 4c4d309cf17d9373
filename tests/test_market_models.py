"""Preprocessing, sequence splits, collection, detections, training, settings and sources against plain Python."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_market import walk

from candlework.operators import features, indicators, labels, model, prepare, screen
from candlework.plans import settings as S
from candlework.sources import bars as B
from candlework.sources import cache

KINDS = "ticker string, ts date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(4, 300), KINDS).cache()


@pytest.fixture(scope="module")
def rows(bars):
    return labels.dataset(bars).cache()


def test_preprocess(bars):
    scaled, seqs, meta = prepare.preprocess(bars, ("price",), length=30)
    got = scaled.where("ticker = 'T1'").orderBy("ts").toPandas()
    close = walk(4, 300).query("ticker == 'T1'").close.to_numpy()
    np.testing.assert_allclose(got.close, (close - close.mean()) / close.std(), atol=1e-9)
    assert got.notna().all().all()
    volume = walk(4, 300).query("ticker == 'T1'").volume
    np.testing.assert_allclose(got.volume, (volume - volume.median()) / (volume.quantile(0.75) - volume.quantile(0.25)), atol=1e-9)
    m = {r.ticker: r for r in meta.collect()}["T1"]
    columns = len(got.columns) - 2
    assert (m.num_features, m.num_samples, m.num_sequences) == (columns, 300, 270) and m.missing_values > 0
    one = seqs.where("ticker = 'T1'").orderBy("ts").first()
    assert len(one.seq) == 30 and len(one.seq[0]) == columns
    np.testing.assert_allclose([x[3] for x in one.seq], got.close[:30], rtol=1e-5, atol=1e-6)


def test_preprocess_of_one_ticker_is_that_of_many(bars):
    alone = prepare.preprocess(bars.where("ticker = 'T2'"))[0].orderBy("ts").toPandas()
    many = prepare.preprocess(bars)[0].where("ticker = 'T2'").orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(alone, many)


def test_split_sequences(bars):
    seqs = prepare.sequences(bars, ["close"], 60)
    got = prepare.split_sequences(seqs, 0.6, 0.2).orderBy("ticker", "ts").toPandas()
    for _, g in got.groupby("ticker"):
        n = len(g)
        assert list(g.split) == ["train"] * int(n * 0.6) + ["valid"] * (int(n * 0.8) - int(n * 0.6)) + ["test"] * (n - int(n * 0.8))


def test_stratified_rows_come_in_order_of_time(bars):
    got = prepare.split_stratified(bars.withColumn("label", F.dayofmonth("ts") % 3), "label").where("ticker = 'T0'").toPandas()
    assert got.ts.is_monotonic_increasing and set(got.split) == {"train", "valid", "test"}


def test_macd_above_zero_needs_a_bullish_crossover(spark):
    last = spark.createDataFrame([(1.0, 0.5), (0.5, 1.0), (-0.5, -1.0)], "macd double, macd_signal double")
    rest = {c: F.lit(None).cast("double") for c in ("rsi", "bb_percent", "adx", "volume_ratio", "stoch_k", "sma_20", "sma_50", "sma_200")}
    last = last.withColumns(rest).withColumns({"macd_crossover": indicators.macd_crossover(F.col("macd"), F.col("macd_signal")), "bb_signal": indicators.bb_signal(F.col("bb_percent"))})
    assert ["MACD_ABOVE_ZERO" in r.signals for r in indicators.signals(last).collect()] == [True, False, False]
    assert {r.bb_signal for r in last.collect()} == {"normal"}


def test_importance_is_sorted_and_equals_pandas(bars):
    made = features.features(bars, ("price",))
    columns = [c for c in made.columns if c not in ("ticker", "ts")]
    got = features.importance(made, columns).toPandas()
    assert list(got.importance.fillna(-1)) == sorted(got.importance.fillna(-1), reverse=True)
    data = made.orderBy("ticker", "ts").toPandas()
    nxt = data.groupby("ticker").close.shift(-1) / data.close - 1
    for c in ("close", "return_5d", "high_change_10d"):
        assert got.set_index("feature").importance[c] == pytest.approx(abs(data[c].corr(nxt)), rel=1e-6)


def test_collect(spark):
    data = walk(5, 300)
    frame = spark.createDataFrame(data, KINDS)
    good = {r.ticker for r in screen.screen(frame, screen.MODES["loose"]).where("passed").collect()}
    for how in ("raw", "scaled"):
        got = labels.collect(frame, how)
        assert {r.ticker for r in got.select("ticker").distinct().collect()} <= good
    with pytest.raises(ValueError):
        labels.collect(frame, "other")


def test_records_and_augmentation(rows):
    for r in labels.records(rows).collect():
        assert r.end_idx == r.start_idx + 59 and r.pattern == labels.PATTERNS[r.pattern_id]
        assert r.breakout_idx == (r.end_idx if r.w_c[59] > 0.99 * max(r.w_h[40:]) else None)
    out = labels.augment(rows, "w_c").select("ticker", "date", "pattern_id", "variant", "w_c")
    again = {tuple(r) for r in out.select("ticker", "date", "variant", F.element_at("w_c", 1)).collect()}
    assert again == {tuple(r) for r in labels.augment(rows.repartition(3), "w_c").select("ticker", "date", "variant", F.element_at("w_c", 1)).collect()}
    by = {}
    for r in out.collect():
        by.setdefault((r.ticker, r.date), {})[r.variant] = (r.pattern_id, np.array(r.w_c))
    noise, shifts = [], set()
    for kinds in by.values():
        label, x = kinds["original"]
        noise += list(kinds["noise"][1] - x)
        factor = kinds["scaled"][1] / x
        assert np.ptp(factor) < 1e-12 and 0.95 <= factor[0] <= 1.05
        if "rolled" in kinds:
            found = [k for k in (-2, -1, 1, 2) if np.array_equal(np.roll(x, k), kinds["rolled"][1])]
            assert label != 0 and len(found) == 1
            shifts |= set(found)
    assert abs(np.mean(noise)) < 0.001 and np.std(noise) == pytest.approx(0.01, rel=0.1) and abs(np.mean(np.abs(noise) < 0.01) - 0.683) < 0.05


def test_training_keeps_the_best_model_and_comes_back_from_a_file(spark, bars, rows, tmp_path):
    train, valid = rows.where("start_idx % 3 <> 0"), rows.where("start_idx % 3 = 0")
    best, history = model.train_best(train, valid, epochs=3, rounds=4)
    assert [h["epoch"] for h in history] == [0, 1, 2] and history[-1]["train_loss"] <= history[0]["train_loss"]
    assert all(0 <= h["val_acc"] <= 1 and h["val_loss"] > 0 for h in history)
    model.save(best, f"file://{tmp_path}/model")
    back = model.load(f"file://{tmp_path}/model")
    key = lambda m: sorted((r.ticker, str(r.date), r.pattern_id, round(r.confidence, 9), r.start_idx, r.end_idx, r.pattern) for r in model.detect(m, rows, least=0.1).collect())
    assert key(back) == key(best) and key(best)
    tested = model.backtest(best, bars, least=0.05)
    for r in tested.collect():
        want = r.actual_return > 0 if r.pattern_id in labels.BULLISH else r.actual_return < 0 if r.pattern_id in (2, 8) else abs(r.actual_return) < 0.03
        assert r.correct == want
    splits = spark.createDataFrame([("train",)] * 5 + [("valid",)] * 2 + [("test",)], "split string")
    made = json.loads(model.training_metadata(splits, tested.limit(1).withColumn("correct", F.lit(True)), 3, "2024-01-02 03:04:05").first().metadata)
    assert made | {"test_accuracy": 1.0} == {"test_accuracy": 1.0, "training_samples": 5, "validation_samples": 2, "test_samples": 1, "epochs": 3, "training_date": "2024-01-02 03:04:05"}


def test_scan_by_period_and_interval(spark, bars):
    last = dt.date(2023, 1, 2) + dt.timedelta(299)
    assert B.scan(bars, ["T0"], period="5d").count() == 6 and B.scan(bars, ["T0"], period="max").count() == 300
    assert B.scan(bars, ["T0"], period="ytd").agg(F.min("ts")).first()[0] == dt.date(last.year, 1, 2)
    weeks = B.scan(bars, ["T0"], interval="1wk").orderBy("ts").collect()
    data = walk(1, 300)
    assert weeks[0].open == data.open[0] and weeks[0].close == data.close[6] and weeks[0].volume == data.volume[:7].sum() and len(weeks) == 43
    for bad in ({"period": "9q"}, {"interval": "7x"}):
        with pytest.raises(ValueError):
            B.scan(bars, **bad)
    minutes = spark.createDataFrame([("A", dt.datetime(2023, 1, 2, 10, m), 1.0, 2.0 + m, 0.5, 1.5, 10.0) for m in range(30)], KINDS.replace("ts date", "ts timestamp"))
    assert [r.high for r in B.resample(minutes, "15m").orderBy("ts").collect()] == [16.0, 31.0]


def test_detailed_universe_and_limits(spark):
    rows = spark.createDataFrame([(" BRK.B ", "B Co", "2010")], ["Symbol ", " Security", "Founded"]).withColumn("Other", F.lit(1))
    out = B.detailed_universe(rows)
    assert out.columns == ["ticker", "name", "founded", "Other"] and out.first().ticker == "BRK-B"
    many = spark.createDataFrame([(str(i),) for i in range(9)], "ticker string")
    assert [r.ticker for r in B.first_tickers(many, 3).collect()] == ["0", "1", "2"]


def test_expired_files_are_served_if_fetching_fails():
    assert cache.usable(3) and not cache.usable(30) and cache.usable(30, failed=True) and not cache.usable(float("inf"), failed=True)


def test_settings_by_section(spark, tmp_path):
    s = S.Settings(services=S.ServiceSettings(news_key="short"), trading=S.TradingSettings(position_share=0.2, stop_loss=0.2, min_score=101), notices=S.NoticeSettings(mail=True, chat=True), system=S.SystemSettings(log_level="LOUD", workers=17), model=S.ModelSettings(lookback=300))
    found = s.by_section()
    assert {k: len(v) for k, v in found.items()} == {"services": 1, "trading": 3, "notices": 2, "system": 2, "across": 1}
    s.save(tmp_path / "s.json")
    assert S.Settings.load(tmp_path / "s.json") == s and not S.Settings().problems()
    row = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, None)], "pattern double, forecast double, technical double, sentiment double, volume double")
    assert row.select(S.ensemble_score(S.ModelSettings())).first()[0] == pytest.approx(0.9)


def test_chart_matrix(rows):
    for r in model.matrix(rows).limit(20).collect():
        x = np.array(r.chart)
        assert x.shape == (60, 5) and x.min() >= 0 and x.max() <= 1 and x[:, 1].max() == 1 and x[:, 2].min() == 0
        low, high = min(r.w_l), max(r.w_h)
        np.testing.assert_allclose(x[:, 3], (np.array(r.w_c) - low) / (high - low))
        np.testing.assert_allclose(x[:, 4], np.array(r.w_v) / max(r.w_v))
