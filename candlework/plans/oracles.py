"""DuckDB SQL for the queries in queries.py."""

from __future__ import annotations

DEEP = """SELECT ticker, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(l_quantity) AS volume
FROM (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem WHERE l_quantity > 0) GROUP BY ticker, ts"""
BROAD = DEEP.replace("l_returnflag || l_linestatus", "CAST(l_suppkey AS VARCHAR)")
HOURLY = """SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, ROW(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)"""
W = "PARTITION BY ticker ORDER BY ts"


def last(k: int) -> str:
    return f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def before(k: int) -> str:
    return f"({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def full(k: int, agg: str, x: str, args: str | None = None, frame: str | None = None) -> str:
    frame = frame or last(k)
    return f"CASE WHEN count({x}) OVER {frame} = {k} THEN {agg}({args or x}) OVER {frame} END"


def mean(x: str, k: int) -> str:
    return full(k, "avg", x)


def std(x: str, k: int) -> str:
    return full(k, "stddev_samp", x)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def change(x: str, k: int = 1) -> str:
    return f"({div(x, lag(x, k))} - 1)"


def r(**columns: str) -> str:
    return ", ".join(f"round({x}, 8) AS {n}" for n, x in columns.items())


def rel(**columns: str) -> str:
    return ", ".join(f"round(({x}) / close, 8) AS {n}" for n, x in columns.items())


def on(body: str, *stages: str, bars: str = DEEP) -> str:
    """A query over bars b0; each stage adds columns to the one before."""
    parts = [f"b0 AS ({bars})"] + [f"b{i + 1} AS (SELECT *, {s} FROM b{i})" for i, s in enumerate(stages)]
    return f"WITH {', '.join(parts)} SELECT {body} FROM b{len(stages)}"


def fold(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: {alpha!r} * v + (1 - {alpha!r}) * a)"


def flag(c: str) -> str:
    return f"coalesce(CAST(({c}) AS INT), 0)"


EPS = "1e-10"
PS = (5, 10, 20, 30, 60)
SP = (5, 10, 20, 50, 100, 200)
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
T = "ticker, ts, "
ORACLES: dict[str, str] = {
    "bars_daily": DEEP,
    "bars_hourly": HOURLY,
    "universe_info": "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, trim(s_name) AS name, trim(r_name) AS sector, trim(n_name) AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sector_distribution": "SELECT r_name AS sector, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "latest_price": f"SELECT ticker, arg_max(close, ts) AS price, arg_max(volume, ts) AS volume, max(ts) AS ts FROM ({BROAD}) GROUP BY ticker",
    "returns_basic": on(
        T + r(daily_return=change("close"), log_return=f"ln({div('close', lag('close'))})", cumulative_return=f"CASE WHEN {lag('close')} IS NOT NULL THEN close / first_value(close) OVER ({W}) - 1 END", ma5_return=change("ma5"), ma20_return=change("ma20")),
        f"{mean('close', 5)} AS ma5, {mean('close', 20)} AS ma20",
    ),
    "volatility_hist": on(
        T + r(volatility=f"{std('ret', 20)} * sqrt(252)", parkinson_vol=f"sqrt(({mean('hl2', 20)}) * 252 / (4 * ln(2)))") + ", " + rel(atr=mean("tr", 20)),
        f"{change('close')} AS ret, pow(ln(high / low), 2) AS hl2, {TR} AS tr",
    ),
    "feat_price": on(
        T + f"open - {lag('close')} AS gap, " + r(
            high_low_ratio=div("high", "low"), close_open_ratio=div("close", "open"), price_position=div("close - low", f"high - low + {EPS}"), gap_percentage=div(f"open - {lag('close')}", lag("close")),
            **{f"return_{p}d": change("close", p) for p in (1, 2, 3, 5, 10, 20, 30)}, **{f"log_return_{p}d": f"ln({div('close', lag('close', p))})" for p in (1, 2, 3, 5, 10, 20, 30)},
            **{f"{x}_change_{p}d": change(x, p) for x in ("high", "low") for p in (5, 10, 20)},
        )
    ),
    "feat_candles": on(
        T + f"body AS body_size, up AS upper_shadow, down AS lower_shadow, {flag(f'body / (high - low + {EPS}) < 0.1')} AS is_doji, {flag('down > 2 * body AND up < body')} AS is_hammer",
        "abs(close - open) AS body, high - greatest(close, open) AS up, least(close, open) - low AS down",
    ),
    "feat_volume": on(
        T + r(
            **{f"volume_change_{p}d": change("volume", p) for p in (1, 5, 10, 20)}, **{f"volume_ratio_{p}d": div("volume", mean("volume", p)) for p in (1, 5, 10, 20)},
            **{f"volume_ma_{p}": mean("volume", p) for p in (5, 10, 20, 50)}, **{f"volume_std_{p}": std("volume", p) for p in (5, 10, 20, 50)},
            volume_price_correlation=div(full(20, "covar_samp", "close", "close, volume"), f"({std('close', 20)}) * ({std('volume', 20)})"), volume_spike=div(f"volume - {mean('volume', 20)}", f"{std('volume', 20)} + {EPS}"),
        ) + ", " + rel(price_volume_trend=full(10, "sum", "pv")),
        f"{change('close')} * volume AS pv",
    ),
    "feat_money_flow": on(T + r(money_flow="mf", money_flow_ma=mean("mf", 14)), f"((close - low) - (high - close)) / (high - low + {EPS}) * volume AS mf"),
    "feat_momentum": on(
        T + f"momentum_5, close - {lag('close', 10)} AS momentum_10, close - {lag('close', 20)} AS momentum_20, " + r(**{f"roc_{p}": div(f"100 * (close - {lag('close', p)})", lag("close", p)) for p in (5, 10, 20, 30)}) + ", " + rel(price_acceleration=f"momentum_5 - {lag('momentum_5')}"),
        f"close - {lag('close', 5)} AS momentum_5",
    ),
    "feat_rs_efficiency": on(
        T + r(**{f"rs_{p}": div(mean("gain", p), f"{mean('loss', p)} + {EPS}") for p in (7, 14, 21)}, **{f"efficiency_{p}": div(f"close - {lag('close', p)}", f"{full(p, 'sum', 'move')} + {EPS}") for p in (10, 20)}),
        f"close - {lag('close')} AS diff", "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END AS gain, CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END AS loss, abs(diff) AS move",
    ),
    "feat_stats_moments": on(
        T + ", ".join(f"{full(p, 'min', 'close')} AS min_{p}, {full(p, 'max', 'close')} AS max_{p}, ({full(p, 'max', 'close')}) - ({full(p, 'min', 'close')}) AS range_{p}" for p in PS) + ", "
        + r(**{f"position_in_range_{p}": div(f"close - ({full(p, 'min', 'close')})", f"({full(p, 'max', 'close')}) - ({full(p, 'min', 'close')}) + {EPS}") for p in PS}, **{f"skew_{p}": full(p, "skewness", "close") for p in PS})
        + ", " + ", ".join(f"round({full(p, 'kurtosis', 'close')}, 6) AS kurt_{p}" for p in PS)
        + ", " + rel(**{f"mean_{p}": mean("close", p) for p in PS}, **{f"std_{p}": std("close", p) for p in PS})
    ),
    "feat_stats_quantiles": on(
        T + rel(**{f"quantile_{q}_{p}": full(p, "quantile_cont", "close", f"close, 0.{q}") for q in (25, 75) for p in PS}, **{f"iqr_{p}": f"({full(p, 'quantile_cont', 'close', 'close, 0.75')}) - ({full(p, 'quantile_cont', 'close', 'close, 0.25')})" for p in PS})
    ),
    "feat_zscore": on(T + r(**{f"zscore_{p}": div(f"close - ({mean('close', p)})", f"({std('close', p)}) + {EPS}") for p in (10, 20, 30)})),
    "feat_trend_slope": on(
        T + r(**{f"trend_strength_{p}": div(f"abs({full(p, 'regr_slope', 'close', 'close, rn')})", f"({std('close', p)}) + {EPS}") for p in (10, 20, 30)}) + ", " + rel(**{f"trend_slope_{p}": full(p, "regr_slope", "close", "close, rn") for p in (10, 20, 30)}),
        f"row_number() OVER ({W}) AS rn",
    ),
    "feat_touches": on(
        T + ", ".join(f"CASE WHEN rn >= {p} THEN CAST(sum({c}{p}) OVER {last(p)} AS BIGINT) END AS {n}_touches_{p}" for n, c in (("resistance", "t"), ("support", "s")) for p in (20, 50)),
        f"row_number() OVER ({W}) AS rn, " + ", ".join(f"{full(p, 'max', 'high')} AS hi{p}, {full(p, 'min', 'low')} AS lo{p}" for p in (20, 50)),
        ", ".join(f"{flag(f'abs(high - hi{p}) / hi{p} < 0.01')} AS t{p}, {flag(f'abs(low - lo{p}) / lo{p} < 0.01')} AS s{p}" for p in (20, 50)),
    ),
    "feat_breakout": on(T + ", ".join(f"{flag(f'close > ({full(p, "max", "high", frame=before(p))})')} AS breakout_up_{p}, {flag(f'close < ({full(p, "min", "low", frame=before(p))})')} AS breakout_down_{p}" for p in (20, 50))),
    "feat_sma_cross": on(
        T + ", ".join(f"{flag(f'sma_{a} > sma_{b}')} AS ma_cross_{a}_{b}" for a, b in ((5, 20), (20, 50), (50, 200))) + ", " + r(**{f"close_to_sma_{p}": div("close", f"sma_{p}") for p in SP}) + ", " + ", ".join(f"round(sma_{p} / close, 8) AS sma_{p}" for p in SP),
        ", ".join(f"{mean('close', p)} AS sma_{p}" for p in SP),
    ),
    "feat_ema": on(T + r(**{f"close_to_ema_{p}": f"close / e{p}" for p in SP}) + ", " + rel(**{f"ema_{p}": f"e{p}" for p in SP}), ", ".join(f"{fold('close', 2 / (p + 1))} AS e{p}" for p in SP)),
    "feat_bollinger": on(
        T + r(**{f"bb_position_{p}": div(f"close - (m{p} - 2 * s{p})", f"4 * s{p} + {EPS}") for p in (10, 20, 30)}, **{f"atr_ratio_{p}": f"({mean('tr', p)}) / close" for p in (7, 14, 21)}) + ", "
        + rel(**{f"bb_upper_{p}": f"m{p} + 2 * s{p}" for p in (10, 20, 30)}, **{f"bb_lower_{p}": f"m{p} - 2 * s{p}" for p in (10, 20, 30)}, **{f"bb_width_{p}": f"4 * s{p}" for p in (10, 20, 30)}, **{f"atr_{p}": mean("tr", p) for p in (7, 14, 21)}),
        f"{TR} AS tr, " + ", ".join(f"{mean('close', p)} AS m{p}, {std('close', p)} AS s{p}" for p in (10, 20, 30)),
    ),
    "feat_cyclical": on(
        T + "CAST(quarter(ts) AS INT) AS quarter, CAST(day(ts) = 1 AS INT) AS is_month_start, CAST(ts = last_day(ts) AS INT) AS is_month_end, CAST(day(ts) = 1 AND month(ts) % 3 = 1 AS INT) AS is_quarter_start, CAST(ts = last_day(ts) AND month(ts) % 3 = 0 AS INT) AS is_quarter_end, "
        + r(**{f"{n}_{f}": f"{f}(2 * pi() * ({x}) / {k})" for n, x, k in (("day", "isodow(ts) - 1", 7), ("month_day", "day(ts)", 30), ("month", "month(ts)", 12)) for f in ("sin", "cos")})
    ),
    "ind_rsi": on(
        T + "CASE WHEN count(gain) OVER " + last(100000) + " >= 14 THEN round(100 * g / nullif(g + l, 0), 8) END AS rsi",
        f"close - {lag('close')} AS diff", "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END AS gain, CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END AS loss", f"{fold('gain', 1 / 14)} AS g, {fold('loss', 1 / 14)} AS l",
    ),
    "ind_macd": on(T + rel(macd="m", macd_signal="s", macd_hist="m - s", ema_12="a", ema_26="b"), f"{fold('close', 2 / 13)} AS a, {fold('close', 2 / 27)} AS b", "a - b AS m", f"{fold('m', 0.2)} AS s"),
    "ind_stoch": on(
        T + r(stoch_k="k3", stoch_d=mean("k3", 3)), f"{full(14, 'min', 'low')} AS lo, {full(14, 'max', 'high')} AS hi", "100 * (close - lo) / nullif(hi - lo, 0) AS k", f"{mean('k', 3)} AS k3"
    ),
    "ind_obv_vwap": on(
        T + f"sum(coalesce(sign(close - prev) * volume, 0)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv, CASE WHEN vs > 0 THEN round(volume / vs, 8) END AS volume_ratio, " + rel(vwap="(high + low + close) / 3"),
        f"{lag('close')} AS prev, {mean('volume', 20)} AS vs",
    ),
    "ind_atr_adx": on(
        T + f"CASE WHEN count(tr) OVER {last(100000)} >= 28 THEN round({fold('dx', 1 / 14)}, 8) END AS adx, CASE WHEN count(tr) OVER {last(100000)} >= 14 THEN round(trw / close, 8) END AS atr",
        f"{TR} AS tr, high - {lag('high')} AS u, {lag('low')} - low AS d",
        "CASE WHEN u IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0 END END AS dmp, CASE WHEN d IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0 END END AS dmm",
        f"{fold('tr', 1 / 14)} AS trw, {fold('dmp', 1 / 14)} AS pw, {fold('dmm', 1 / 14)} AS mw", "100 * pw / nullif(trw, 0) AS pdi, 100 * mw / nullif(trw, 0) AS mdi", "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx",
    ),
    "impute_linear": on(
        T + "round(coalesce(x, ax + (bx - ax) / nullif(bi - ai, 0) * (i - ai), ax, bx) / high, 8) AS close_to_high", f"row_number() OVER ({W}) AS i", "CASE WHEN i % 7 != 0 THEN close END AS x, CASE WHEN i % 7 != 0 THEN i END AS xi",
        ", ".join(f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a{n}, first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b{n}" for c, n in (("x", "x"), ("xi", "i"))),
    ),
    "impute_ffill": on(
        T + f"coalesce(last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close", f"row_number() OVER ({W}) AS i", "CASE WHEN i % 7 != 0 THEN close END AS x"
    ),
    "scale_standard": on(T + r(**{c: f"({c} - avg({c}) OVER (PARTITION BY ticker)) / stddev_pop({c}) OVER (PARTITION BY ticker)" for c in ("close", "high")})),
    "scale_robust": on(T + r(volume="(volume - q2) / nullif(q3 - q1, 0)"), ", ".join(f"quantile_cont(volume, {q}) OVER (PARTITION BY ticker) AS q{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))),
    "feature_stats": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}) / median({c}), 8) AS mean, round(stddev_samp({c}) / median({c}), 8) AS std, min({c}) AS min, max({c}) AS max FROM ({DEEP})" for c in ("high", "volume")),
    "split_chrono": on(T + "CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split", f"row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n"),
    "split_gap": "SELECT * FROM (" + on(
        T + "CASE WHEN i < te THEN 'train' WHEN i >= vs AND i < least(v0, n) THEN 'valid' WHEN i >= least(v0 + 6, n) THEN 'test' END AS split", f"row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n",
        "CAST(trunc((n - 59) * 0.7::DOUBLE) AS BIGINT) + 59 AS te", "te + 6 AS vs", "vs + CAST(trunc((n - 59) * 0.15::DOUBLE) AS BIGINT) AS v0",
    ) + ") WHERE split IS NOT NULL",
    "split_walk_forward": "SELECT ticker, fold, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (" + on(
        "ticker, ts, CAST(fold AS INT) AS fold, CASE WHEN i < step * (fold + 1) THEN 'train' WHEN i < least(step * (fold + 1) + 30, n) THEN 'test' END AS split", f"row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n", "(n - 30) // 5 AS step, unnest(range(5)) AS fold",
    ) + ") WHERE split IS NOT NULL GROUP BY ticker, fold, split",
    "split_stratified": on(T + "label, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split", "CASE WHEN close > open THEN 'up' ELSE 'down' END AS label", "row_number() OVER (PARTITION BY ticker, label ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY ticker, label) AS n"),
    "seq_windows": "SELECT * FROM (" + on(T + f"CAST(count(*) OVER {before(60)} AS INT) AS n, CAST(CAST(first_value(close) OVER {before(60)} AS FLOAT) AS DOUBLE) AS first_close, CAST(CAST({lag('volume')} AS FLOAT) AS DOUBLE) AS last_volume, CAST(CAST(close AS FLOAT) AS DOUBLE) AS target") + ") WHERE n = 60",
    "breakout_points": "SELECT ticker, ts, breakout FROM (" + on(T + f"close > 0.99 * ({full(20, 'max', 'high')}) AS breakout, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back") + ") WHERE back = 1",
}


def _runs() -> str:
    """Gaps and islands for the six runs."""
    flags, islands, out = [], [], []
    for p in (5, 10, 20):
        for name, long, c in (("higher_high", "consecutive_higher_highs", full(p, "max", "high", frame=before(p))), ("lower_low", "consecutive_lower_lows", full(p, "min", "low", frame=before(p)))):
            x = f"{name}_{p}"
            flags.append(f"{flag(f'{"high >" if name == "higher_high" else "low <"} ({c})')} AS {x}")
            islands.append(f"sum(1 - {x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k_{x}")
            out.append(f"{x}, CAST(sum({x}) OVER (PARTITION BY ticker, k_{x} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {long}_{p}")
    return on(T + ", ".join(out), ", ".join(flags), ", ".join(islands))


ORACLES["feat_higher_high_runs"] = _runs()
ORACLES["split_info"] = f"SELECT split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) / sum(count(*)) OVER () AS share FROM ({ORACLES['split_chrono']}) GROUP BY split"


def _label_stages(ahead: int = 20) -> tuple[str, ...]:
    frame = f"({W} ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)"
    arrays = ", ".join(f"list({c}) OVER {frame} AS {a}" for a, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume")))
    return (
        f"{arrays}, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, lead(ts, 59) OVER ({W}) AS date, lead(close, 59) OVER ({W}) AS lst, lead(close, {59 + ahead}) OVER ({W}) AS thn",
        "(c[25] - c[1]) / c[1] AS up, list_stddev_samp(list_transform(range(26, 49), lambda j: c[j] / c[j - 1] - 1)) AS vol, list_max(h[25:48]) AS top, (list_max(h[25:48]) - list_min(l[25:48])) / c[25] AS spread, list_avg(c[22:41]) AS sma, "
        "list_max(c[1:15]) AS lh, list_min(c[16:45]) AS bot, list_max(c[46:55]) AS rh, list_min(c[56:60]) AS han, list_max(h[1:20]) AS h1, list_max(h[21:40]) AS h2, list_max(h[41:60]) AS h3, list_min(l[1:30]) AS l1, list_min(l[31:60]) AS l2",
        "list_position(h[1:20], h1) AS p1, list_position(h[21:40], h2) + 20 AS p2, list_position(h[41:60], h3) + 40 AS p3, list_position(l[1:30], l1) AS q1, list_position(l[31:60], l2) + 30 AS q2",
        "least(list_min(h[p1:p2 - 1]), list_min(h[p2:p3 - 1])) AS neck, list_max(h[q1:q2 - 1]) AS peak, 1 - abs(lh - rh) / lh AS rim, (lh - bot) / lh AS depth, (c[60] - sma) / sma AS trend",
        "least(1.0::DOUBLE, CASE WHEN up > 0.10 THEN 0.3::DOUBLE WHEN up > 0.05 THEN 0.15 ELSE 0 END + CASE WHEN trend > 0.10 THEN 0.2::DOUBLE WHEN trend > 0.05 THEN 0.1 ELSE 0 END + CASE WHEN vol < 0.02 AND spread < 0.05 THEN 0.25::DOUBLE WHEN vol < 0.03 AND spread < 0.08 THEN 0.1 ELSE 0 END + CASE WHEN c[60] > top THEN 0.25::DOUBLE ELSE 0 END) AS s1, "
        "CASE WHEN rim > 0.95 THEN 0.4::DOUBLE WHEN rim > 0.90 THEN 0.2 ELSE 0 END + CASE WHEN depth BETWEEN 0.10 AND 0.30 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN han > bot + 0.5 * (rh - bot) THEN 0.3::DOUBLE ELSE 0 END AS s6, "
        "CASE WHEN h2 > h1 AND h2 > h3 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN 1 - abs(h1 - h3) / h1 > 0.90 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c[60] < neck THEN 0.3::DOUBLE ELSE 0 END AS s8, "
        "CASE WHEN 1 - abs(l1 - l2) / l1 > 0.97 THEN 0.4::DOUBLE WHEN 1 - abs(l1 - l2) / l1 > 0.95 THEN 0.2 ELSE 0 END + CASE WHEN (peak - l1) / l1 > 0.05 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c[60] > peak THEN 0.3::DOUBLE ELSE 0 END AS s10",
        "greatest(s1, s6, s8, s10) AS best, (thn - lst) / lst AS fr",
        "CASE WHEN best < 0.4 THEN 0 WHEN s1 = best THEN 1 WHEN s6 = best THEN 6 WHEN s8 = best THEN 8 ELSE 10 END AS pid, CASE WHEN best < 0.4 THEN 1.0::DOUBLE ELSE best END AS conf",
        "CASE WHEN (pid IN (1, 6, 10) AND fr < -0.05) OR (pid = 8 AND fr > 0.05) THEN 0 ELSE pid END AS pid2",
    )


_WINDOWED = on("*", *_label_stages())
ORACLES["label_windows"] = f"SELECT ticker, date, CAST(pid2 AS INT) AS pattern_id, round(conf, 8) AS confidence, round(fr, 8) AS future_return FROM ({_WINDOWED}) WHERE n >= 110 AND i % 5 = 0 AND i < n - 80 AND (conf > 0.6 OR pid2 = 0)"
ORACLES["label_distribution"] = f"SELECT pattern_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM ({ORACLES['label_windows']}) GROUP BY pattern_id"
ORACLES["backtest_direction"] = f"SELECT ticker, CAST(pid AS INT) AS pattern_id, round(conf, 8) AS confidence, round(fr, 8) AS actual_return, CASE WHEN pid IN (1, 6, 10) THEN fr > 0 WHEN pid = 8 THEN fr < 0 ELSE abs(fr) < 0.03 END AS correct FROM ({_WINDOWED}) WHERE i = n - 80"

TREND = f"""SELECT ticker, ts, open / 500.0::DOUBLE + 100.0::DOUBLE + wave AS open, high / 500.0::DOUBLE + 100.0::DOUBLE + wave AS high, low / 500.0::DOUBLE + 100.0::DOUBLE + wave AS low, close / 500.0::DOUBLE + 100.0::DOUBLE + wave AS close, volume * 200000.0::DOUBLE AS volume
FROM (SELECT *, CAST(abs((row_number() OVER ({W}) + 7 * CAST(ticker AS INT)) % 40 - 20) AS DOUBLE) AS wave FROM ({BROAD}))"""
_SHADOW = f"abs(close - open) / ((high - greatest(close, open)) + (least(close, open) - low) + {EPS})"
ORACLES["feat_shadows"] = on(T + f"round(least({_SHADOW}, 1e4::DOUBLE), 8) AS body_to_shadow_ratio")
ORACLES["bars_trending"] = TREND
ORACLES["bars_weekly"] = f"SELECT ticker, CAST(date_trunc('week', ts) AS DATE) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({DEEP}) AS b GROUP BY ticker, date_trunc('week', b.ts)"
ORACLES["bars_scan"] = f"SELECT * FROM ({BROAD}) WHERE ticker IN ('1', '5', '7', 'none') AND ts >= DATE '1997-01-01' AND ts < DATE '1998-01-01'"
ORACLES["bars_last_year"] = f"WITH b AS ({BROAD}) SELECT * FROM b WHERE ts >= (SELECT max(ts) - INTERVAL 1 YEAR FROM b) AND ticker IN (SELECT ticker FROM ({ORACLES['universe_info']}) ORDER BY ticker LIMIT 5)"
ORACLES["universe_limit"] = "SELECT CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier ORDER BY ticker LIMIT 20"
ORACLES["universe_detailed"] = "SELECT 'S-' || s_suppkey AS ticker, s_name AS name, s_nationkey AS cik, s_acctbal AS Notes FROM supplier"
ORACLES["universe_html"] = "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS INT) AS pos, 'S-' || s_suppkey AS ticker FROM supplier"
ORACLES["fundamentals_lookup"] = f"""SELECT t.ticker, coalesce(name, 'N/A') AS name, coalesce(sector, 'N/A') AS sector, coalesce(industry, 'N/A') AS industry, CAST(0 AS BIGINT) AS market_cap, CAST(0 AS BIGINT) AS avg_volume, CAST(0 AS BIGINT) AS shares_outstanding,
  CAST(NULL AS DOUBLE) AS pe_ratio, CAST(NULL AS DOUBLE) AS forward_pe, CAST(NULL AS DOUBLE) AS dividend_yield, CAST(length(name) AS DOUBLE) AS beta, CAST(NULL AS DOUBLE) AS high_52w, CAST(NULL AS DOUBLE) AS low_52w, CASE WHEN name IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM (SELECT CAST(n_nationkey * 7 AS VARCHAR) AS ticker FROM nation) t LEFT JOIN ({ORACLES['universe_info']}) u ON u.ticker = t.ticker"""
ORACLES["ind_bands"] = on(T + r(bb_width="400 * sd / m") + ", " + rel(bb_upper="m + 2 * sd", bb_middle="m", bb_lower="m - 2 * sd", sma_20="m", sma_50=mean("close", 50), sma_200=mean("close", 200), volume_sma=mean("volume", 20)), f"{mean('close', 20)} AS m, {std('close', 20)} AS sd")
_DAY = "(PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLES["ind_vwap_intraday"] = on(T + rel(vwap=div(f"sum((high + low + close) / 3 * volume) OVER {_DAY}", f"sum(volume) OVER {_DAY}")), bars=HOURLY)

# What indicators() has, of bars with a row for each ticker at the end
_SEEN = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_SNAPSHOT = on(
    "*",
    f"{TR} AS tr, close - {lag('close')} AS diff, high - {lag('high')} AS u, {lag('low')} - low AS d, {full(14, 'min', 'low')} AS lo14, {full(14, 'max', 'high')} AS hi14, {mean('close', 20)} AS m20, {std('close', 20)} AS sd20, {mean('close', 50)} AS m50, {mean('close', 200)} AS m200, {mean('volume', 20)} AS vs, "
    "count(*) OVER (PARTITION BY ticker) AS n_bars, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back",
    "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END AS gain, CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END AS loss, CASE WHEN u IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0 END END AS dmp, CASE WHEN d IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0 END END AS dmm, 100 * (close - lo14) / nullif(hi14 - lo14, 0) AS k1",
    f"{fold('close', 2 / 13)} AS e12, {fold('close', 2 / 27)} AS e26, {fold('gain', 1 / 14)} AS g, {fold('loss', 1 / 14)} AS l, {fold('tr', 1 / 14)} AS trw, {fold('dmp', 1 / 14)} AS pw, {fold('dmm', 1 / 14)} AS mw, {mean('k1', 3)} AS stoch_k",
    "e12 - e26 AS macd, 100 * pw / nullif(trw, 0) AS pdi, 100 * mw / nullif(trw, 0) AS mdi", "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx", f"{fold('macd', 0.2)} AS sig, {fold('dx', 1 / 14)} AS adx",
    bars=TREND,
)
_LAST = f"""SELECT ticker, ts, n_bars, rsi, adx, macd, sig, stoch_k, volume_ratio, m20, m50, m200, bb_percent,
  CASE WHEN rsi <= 30 THEN 'oversold' WHEN rsi >= 70 THEN 'overbought' ELSE 'neutral' END AS rsi_signal, CASE WHEN macd > sig THEN 'bullish' WHEN macd < sig THEN 'bearish' ELSE 'neutral' END AS macd_crossover,
  CASE WHEN bb_percent < 0 THEN 'below_lower' WHEN bb_percent > 1 THEN 'above_upper' WHEN bb_percent < 0.2 THEN 'near_lower' WHEN bb_percent > 0.8 THEN 'near_upper' ELSE 'normal' END AS bb_signal
FROM (SELECT ticker, ts, n_bars, CASE WHEN ok THEN 100 * g / nullif(g + l, 0) END AS rsi, CASE WHEN ok THEN adx END AS adx, CASE WHEN ok THEN macd END AS macd, CASE WHEN ok THEN sig END AS sig, CASE WHEN ok THEN stoch_k END AS stoch_k, CASE WHEN ok AND vs > 0 THEN volume / vs END AS volume_ratio,
  CASE WHEN ok THEN m20 END AS m20, CASE WHEN ok THEN m50 END AS m50, CASE WHEN ok THEN m200 END AS m200, CASE WHEN ok THEN CASE WHEN 4 * sd20 > 0 THEN (close - (m20 - 2 * sd20)) / ((m20 + 2 * sd20) - (m20 - 2 * sd20)) ELSE 0.5 END END AS bb_percent
  FROM (SELECT *, n_bars >= 200 AS ok FROM ({_SNAPSHOT}) WHERE back = 1))"""
_SCORE = [
    "CASE WHEN rsi BETWEEN 50 AND 65 THEN 15 WHEN rsi > 65 AND rsi <= 75 THEN 5 WHEN rsi > 75 THEN -10 WHEN rsi < 40 THEN -10 ELSE 0 END", "CASE macd_crossover WHEN 'bullish' THEN 15 WHEN 'bearish' THEN -15 ELSE 0 END",
    "CASE WHEN bb_percent BETWEEN 0.6 AND 0.9 THEN 10 WHEN bb_percent > 0.9 THEN 5 WHEN bb_percent < 0.3 THEN -10 ELSE 0 END", "CASE WHEN bb_signal = 'above_upper' THEN 5 ELSE 0 END",
    "CASE WHEN adx > 30 THEN 15 WHEN adx >= 25 THEN 10 WHEN adx >= 20 THEN 5 WHEN adx < 20 THEN -5 ELSE 0 END", "CASE WHEN volume_ratio > 2 THEN 15 WHEN volume_ratio >= 1.5 THEN 10 WHEN volume_ratio >= 1.2 THEN 5 WHEN volume_ratio < 0.8 THEN -10 ELSE 0 END",
    "CASE WHEN m20 > m50 AND m50 > m200 THEN 15 WHEN m20 > m50 THEN 8 WHEN m20 < m50 AND m50 < m200 THEN -15 ELSE 0 END", "CASE WHEN stoch_k BETWEEN 40 AND 80 THEN 5 WHEN stoch_k > 80 THEN -5 WHEN stoch_k < 20 THEN -10 ELSE 0 END",
]
ORACLES["ind_snapshot_score"] = f"SELECT ticker, ts, n_bars, CAST(greatest(0, least(100, 50 + {' + '.join(_SCORE)})) AS INT) AS score, rsi_signal, macd_crossover, bb_signal, {r(bb_percent='bb_percent', volume_ratio='volume_ratio', rsi='rsi', adx='adx', stoch_k='stoch_k')} FROM ({_LAST})"
_TAGS = [
    "CASE WHEN rsi BETWEEN 50 AND 70 THEN 'RSI_MOMENTUM' WHEN rsi > 70 THEN 'RSI_STRONG_MOMENTUM' END", "CASE WHEN macd_crossover = 'bullish' THEN 'MACD_BULLISH_CROSS' END", "CASE WHEN bb_signal IN ('near_upper', 'above_upper') THEN 'BB_BREAKOUT' END",
    "CASE WHEN adx > 30 THEN 'VERY_STRONG_TREND' WHEN adx > 25 THEN 'STRONG_TREND' END", "CASE WHEN volume_ratio > 2 THEN 'MAJOR_VOLUME_SURGE' WHEN volume_ratio > 1.5 THEN 'VOLUME_SURGE' END", "CASE WHEN stoch_k BETWEEN 40 AND 80 THEN 'STOCH_MOMENTUM' END",
    "CASE WHEN m20 > m50 AND m50 > m200 THEN 'MA_PERFECT_ALIGNMENT' WHEN m20 > m50 THEN 'MA_BULLISH_ALIGNMENT' END", "CASE WHEN bb_percent > 0.8 THEN 'APPROACHING_BREAKOUT' END", "CASE WHEN macd_crossover = 'bullish' AND macd > 0 THEN 'MACD_ABOVE_ZERO' END",
]
ORACLES["ind_signals"] = f"SELECT ticker, concat_ws(',', {', '.join(_TAGS)}) AS signals FROM ({_LAST})"

# The screen: metrics of the last 20 bars, checks by mode, score
_METRICS = f"""SELECT ticker, max(ts) AS ts, arg_max(close, ts) AS current_price, CAST(trunc(avg(volume)) AS BIGINT) AS avg_volume, arg_max(close, ts) / arg_max(w, ts) - 1 AS weekly0, (arg_max(close, ts) - arg_max(w, ts)) / arg_max(w, ts) AS weekly_change, arg_max(ret, ts) AS daily_change,
  CASE WHEN avg(volume) > 0 THEN arg_max(volume, ts) / avg(volume) ELSE 0 END AS volume_ratio, CASE WHEN count(*) >= 20 THEN (avg(close) FILTER (WHERE back <= 5) - avg(close)) / avg(close) ELSE 0.0::DOUBLE END AS momentum,
  CASE WHEN count(*) >= 20 THEN stddev_samp(ret) * sqrt(252) ELSE 1.0::DOUBLE END AS volatility, CAST(coalesce(min(back) FILTER (WHERE NOT coalesce(up, false)) - 1, count(*)) AS INT) AS consecutive_up_days, CASE WHEN count(*) >= 20 THEN arg_max(close, ts) >= 0.98::DOUBLE * max(high) ELSE false END AS is_near_resistance
FROM (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret, close > lag(close) OVER ({W}) AS up, lag(close, 4) OVER ({W}) AS w FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM ({TREND})) WHERE back <= 20) GROUP BY ticker HAVING count(*) >= 5"""
ORACLES["screen_metrics"] = f"SELECT ticker, ts, avg_volume, consecutive_up_days, is_near_resistance, 0.0::DOUBLE AS relative_strength, 0.0::DOUBLE AS accumulation_score, {r(**{c: c for c in ('current_price', 'weekly_change', 'daily_change', 'volume_ratio', 'momentum', 'volatility')})} FROM ({_METRICS})"
_MODES = "(VALUES ('default', 50, 500, 5e6, 1.2, 0.03, 0.07, 0.02, 2, 0.15, true), ('ultra_strict', 50, 500, 5e6, 1.3, 0.04, 0.065, 0.03, 2, 0.12, true), ('normal', 30, 1000, 2e6, 1.1, 0.03, 0.08, 0.01, 1, 0.20, false), ('loose', 20, 2000, 1e6, 1.0, 0.02, 0.10, 0.0, 0, 0.30, false)) AS modes(mode, p0, p1, v, vr, c0, c1, mo, up, vol, near)"
_NAMES = ("price_range", "positive_change", "volume", "volume_surge", "momentum", "low_volatility", "uptrend", "near_breakout")
_TESTED = f"""SELECT *, current_price BETWEEN p0 AND p1 AS t0, coalesce(weekly_change BETWEEN c0::DOUBLE AND c1::DOUBLE, false) AS t1, avg_volume >= v AS t2, volume_ratio >= vr::DOUBLE AS t3, momentum >= mo::DOUBLE AS t4, coalesce(volatility <= vol::DOUBLE, false) AS t5, consecutive_up_days >= up AS t6, is_near_resistance OR NOT near AS t7 FROM ({_METRICS}), {_MODES}"""
_PASSED = ", ".join(f"CASE WHEN t{i} THEN '{n}' END" for i, n in enumerate(_NAMES))
_FAILED = ", ".join(f"CASE WHEN NOT t{i} THEN '{n}' END" for i, n in enumerate(_NAMES) if i not in (3, 6, 7))
_CHECKED = f"SELECT *, t0 AND t1 AND t2 AND t4 AS passed, concat_ws(',', {_PASSED}) AS passed_checks, concat_ws(',', {_FAILED}) AS failed_checks, {' + '.join(f't{i}::INT' for i in range(8))} AS ok, {' + '.join(f'(NOT t{i})::INT' for i in (0, 1, 2, 4, 5))} AS bad FROM ({_TESTED})"
_POINTS = "coalesce(40.0::DOUBLE * ok / nullif(ok + bad, 0), 0) + CASE WHEN weekly_change BETWEEN 0.04 AND 0.06 THEN 20 WHEN weekly_change BETWEEN 0.03 AND 0.07 THEN 15 WHEN weekly_change > 0 THEN 10 ELSE 0 END + CASE WHEN volume_ratio >= 2 THEN 20 WHEN volume_ratio >= 1.5 THEN 15 WHEN volume_ratio >= 1.2 THEN 10 WHEN volume_ratio >= 1 THEN 5 ELSE 0 END + CASE WHEN momentum >= 0.05 THEN 10 WHEN momentum >= 0.03 THEN 7 WHEN momentum >= 0.01 THEN 5 ELSE 0 END + CASE WHEN consecutive_up_days >= 3 THEN 5 ELSE 0 END + CASE WHEN is_near_resistance THEN 5 ELSE 0 END"
_SCORED = f"""SELECT *, CASE WHEN s >= 80 THEN 'A+' WHEN s >= 70 THEN 'A' WHEN s >= 60 THEN 'B+' WHEN s >= 50 THEN 'B' ELSE 'C' END AS setup_quality, CASE WHEN NOT passed THEN 'SKIP' WHEN s >= 75 AND volume_ratio > 1.5 THEN 'STRONG BUY' WHEN s >= 70 THEN 'BUY' WHEN s >= 60 THEN 'WATCH' ELSE 'MONITOR' END AS recommendation
FROM (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_POINTS})) AS s FROM ({_CHECKED}))"""
ORACLES["screen_checks"] = f"SELECT mode, ticker, passed, passed_checks, failed_checks FROM ({_CHECKED})"
ORACLES["screen_scores"] = f"SELECT mode, ticker, round(s, 8) AS quality_score, setup_quality, recommendation FROM ({_SCORED})"
ORACLES["screen_rank"] = f"SELECT ticker, round(s, 8) AS quality_score, setup_quality, recommendation, passed FROM ({_SCORED}) WHERE mode = 'loose' ORDER BY quality_score DESC, ticker LIMIT 50"
ORACLES["screen_pass_rate"] = f"SELECT mode, count(*) AS n, CAST(sum(passed::INT) AS BIGINT) AS n_passed, round(avg(passed::INT), 8) AS rate FROM ({_CHECKED}) GROUP BY mode"
ORACLES["screen_report"] = f"SELECT ticker, printf('%s $%.2f week %+.1f%% volume %.1fx score %.1f %s', ticker, current_price, weekly_change * 100, volume_ratio, s, recommendation) || CASE WHEN volume_ratio >= 2 THEN ' VOLUME SURGE' ELSE '' END AS line FROM ({_SCORED}) WHERE mode = 'loose'"

_GAPS = on("ticker, ts, high, CASE WHEN i % 7 != 0 THEN close END AS x", f"row_number() OVER ({W}) AS i")
ORACLES["impute_mean"] = f"SELECT ticker, ts, round(coalesce(x, avg(x) OVER (PARTITION BY ticker)) / high, 8) AS close_to_high FROM ({_GAPS})"
ORACLES["impute_drop"] = f"SELECT ticker, ts, x AS close FROM ({_GAPS}) WHERE x IS NOT NULL"
ORACLES["scale_minmax"] = on(T + r(**{c: f"({c} - min({c}) OVER (PARTITION BY ticker)) / (max({c}) OVER (PARTITION BY ticker) - min({c}) OVER (PARTITION BY ticker))" for c in ("close", "high")}))
ORACLES["scale_fitted"] = f"""WITH s AS (SELECT * FROM ({DEEP}) JOIN ({ORACLES['split_chrono']}) USING (ticker, ts)), p AS (SELECT ticker, avg(close) AS m, stddev_pop(close) AS d FROM s WHERE split = 'train' GROUP BY ticker)
SELECT ticker, ts, round((close - m) / d, 8) AS close FROM s JOIN p USING (ticker) WHERE split = 'test'"""
ORACLES["feature_stats"] = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}) / median({c}), 8) AS mean, round(stddev_samp({c}) / median({c}), 8) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.75), 6) AS q75 FROM ({DEEP})" for c in ("high", "volume"))
ORACLES["seq_arrays"] = "SELECT ticker, ts, sum_0, sum_1, middle_close FROM (" + on(
    T + f"count(*) OVER {before(60)} AS n, round(sum(CAST(CAST(close AS FLOAT) AS DOUBLE)) OVER {before(60)}, 2) AS sum_0, round(sum(CAST(CAST(volume AS FLOAT) AS DOUBLE)) OVER {before(60)}, 2) AS sum_1, CAST(CAST({lag('close', 31)} AS FLOAT) AS DOUBLE) AS middle_close"
) + ") WHERE n = 60"
ORACLES["seq_split"] = f"SELECT ticker, ts, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (SELECT ticker, ts, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM ({ORACLES['seq_windows']}))"
ORACLES["preprocess_sequences"] = "SELECT * FROM (" + on(
    T + f"CAST(count(*) OVER {before(60)} AS INT) AS n, 5 AS width, round(CAST(CAST({lag('z')} AS FLOAT) AS DOUBLE), 4) AS last_close, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 4) AS target", "(close - avg(close) OVER (PARTITION BY ticker)) / stddev_pop(close) OVER (PARTITION BY ticker) AS z"
) + ") WHERE n = 60"
_LAGGED = 2 + sum(2 * min_ for min_ in (1, 2, 3, 5, 10, 20, 30)) + sum(2 * min_ for min_ in (5, 10, 20))  # nulls of the price family in a series of 31 bars or more
ORACLES["preprocess_metadata"] = f"SELECT ticker, CAST(47 AS BIGINT) AS num_features, count(*) AS num_samples, CAST({_LAGGED} AS BIGINT) AS missing_values, greatest(0, count(*) - 60) AS num_sequences FROM ({DEEP}) GROUP BY ticker"
_BROAD_WINDOWS = on("*", *_label_stages(), bars=BROAD)
ORACLES["backtest_accuracy"] = f"SELECT count(*) AS n, round(avg(correct::INT), 8) AS accuracy FROM (SELECT CASE WHEN pid IN (1, 6, 10) THEN fr > 0 WHEN pid = 8 THEN fr < 0 ELSE abs(fr) < 0.03 END AS correct FROM ({_BROAD_WINDOWS}) WHERE i = n - 80)"
_N = lambda name: f"(SELECT count(*) FROM ({ORACLES['split_chrono']}) WHERE split = '{name}')"
ORACLES["training_metadata"] = f"SELECT accuracy AS test_accuracy, {_N('train')} AS training_samples, {_N('valid')} AS validation_samples, {_N('test')} AS test_samples, CAST(20 AS BIGINT) AS epochs, '2024-01-02 03:04:05' AS training_date FROM ({ORACLES['backtest_accuracy']})"
_KEPT = "n >= 110 AND i % 5 = 0 AND i < n - 80 AND (conf > 0.6 OR pid2 = 0)"
ORACLES["label_records"] = f"SELECT ticker, date, CASE pid2 WHEN 0 THEN 'no_pattern' WHEN 1 THEN 'bull_flag' WHEN 6 THEN 'cup_and_handle' WHEN 8 THEN 'head_shoulders' ELSE 'double_bottom' END AS pattern, i AS start_idx, i + 59 AS end_idx, CASE WHEN c[60] > 0.99::DOUBLE * list_max(h[41:60]) THEN i + 59 END AS breakout_idx FROM ({_WINDOWED}) WHERE {_KEPT}"
_SPAN = "(list_max(h[1:60]) - list_min(l[1:60]))"
_SUMS = ", ".join(f"round(CASE WHEN {_SPAN} > 0 THEN list_sum(list_transform({a}[1:60], lambda x: (x - list_min(l[1:60])) / {_SPAN})) ELSE 30 END, 6) AS {c}" for a, c in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")))
ORACLES["chart_matrix"] = f"SELECT ticker, date, 60 AS n, {_SUMS}, round(CASE WHEN list_max(v[1:60]) > 0 THEN list_sum(v[1:60]) / list_max(v[1:60]) ELSE 0 END, 6) AS volume FROM (SELECT ticker, date, o, h, l, c, v FROM ({_WINDOWED}) WHERE {_KEPT})"
_CHOSEN = f"SELECT ticker FROM ({_SCORED}) WHERE mode = 'loose' AND passed ORDER BY s DESC, ticker LIMIT 100"
_COLLECTED = on("*", *_label_stages(), bars=f"SELECT * FROM ({TREND}) WHERE ticker IN ({_CHOSEN})")
ORACLES["collect_dataset"] = f"SELECT ticker, CAST(pid2 AS INT) AS pattern_id, count(*) AS n FROM ({_COLLECTED}) WHERE n > 250 AND {_KEPT} GROUP BY ticker, pid2"
_Z = ", ".join(f"({c} - avg({c}) OVER (PARTITION BY ticker)) / stddev_pop({c}) OVER (PARTITION BY ticker) AS {c}" for c in ("open", "high", "low", "close", "volume"))
_SCALED = on("*", *_label_stages(), bars=f"SELECT ticker, ts, {_Z} FROM ({TREND}) WHERE ticker IN ({_CHOSEN})")
ORACLES["collect_scaled"] = f"SELECT ticker, count(*) AS n FROM ({_SCALED}) WHERE n > 250 AND {_KEPT} GROUP BY ticker"
ORACLES["pattern_boxes"] = f"""SELECT b.ticker, b.start, b."end", b.low, b.high, CASE WHEN p.breakout THEN p.ts END AS marked FROM (SELECT ticker, min(ts) AS start, max(ts) AS "end", min(low) AS low, max(high) AS high FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS back FROM ({DEEP})) WHERE back <= 60 GROUP BY ticker) b JOIN ({ORACLES['breakout_points']}) p ON p.ticker = b.ticker"""


def _unit(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


_KEY = ("'1'", "ticker", "CAST(date AS VARCHAR)")
ORACLES["augment"] = f"""WITH x AS (SELECT ticker, date, pid2, c, CAST(floor({_unit(*_KEY, "'roll'")} * 5) AS INT) - 2 AS shift FROM ({_WINDOWED}) WHERE {_KEPT}),
v AS (SELECT ticker, date, 'original' AS variant, c AS y FROM x
UNION ALL SELECT ticker, date, 'noise', list_transform(range(0, 60), lambda i: c[i + 1] + 0.01::DOUBLE * sqrt(-2 * ln(1 - {_unit(*_KEY, "'a'", "CAST(i AS VARCHAR)")})) * cos(2 * pi() * {_unit(*_KEY, "'b'", "CAST(i AS VARCHAR)")})) FROM x
UNION ALL SELECT ticker, date, 'scaled', list_transform(c, lambda a: a * (0.95::DOUBLE + 0.1::DOUBLE * {_unit(*_KEY, "'scale'")})) FROM x
UNION ALL SELECT ticker, date, 'rolled', list_transform(range(0, 60), lambda i: c[(i - shift + 60) % 60 + 1]) FROM x WHERE pid2 != 0 AND shift != 0)
SELECT ticker, date, variant, CAST(len(y) AS INT) AS n, round(y[1], 8) AS first, round(y[60], 8) AS last, round(list_sum(y), 4) AS total FROM v"""


def _importance() -> str:
    """Correlations over the columns that the other feature queries give; those over the close are brought back."""
    from candlework.plans.queries import QUERIES

    parts, columns = [f"({DEEP}) AS b"], {c: c for c in ("open", "high", "low", "close", "volume")} | {"body_to_shadow_ratio": _SHADOW}
    for name, query in QUERIES.items():
        if hasattr(query, "plain"):
            parts.append(f"({ORACLES[name]}) AS {name}")
            columns |= {c: c for c in query.plain} | {c: f"{c} * close" for c in query.relative}
    joined = parts[0] + "".join(f" JOIN {p} USING (ticker, ts)" for p in parts[1:])
    value = lambda c: f"abs(covar_samp(x_{c}, nxt) / nullif(stddev_samp(x_{c}) * stddev_samp(nxt) FILTER (WHERE x_{c} IS NOT NULL), 0)) AS {c}"
    rules = [("volume", ("volume",)), ("momentum", ("momentum", "roc")), ("moving_average", ("ma",)), ("bollinger", ("bb",)), ("pattern", ("pattern", "higher", "lower")), ("statistical", ("stat", "std", "mean")), ("cyclical", ("sin", "cos"))]
    case = " ".join(f"WHEN {' OR '.join(f'contains(feature, {p!r})' for p in has)} THEN '{label}'" for label, has in rules)
    return f"""WITH f AS (SELECT ticker, ts, lead(close) OVER ({W}) / close - 1 AS nxt, {', '.join(f'CAST({x} AS DOUBLE) AS x_{c}' for c, x in columns.items())} FROM {joined}),
g AS (SELECT * REPLACE ({', '.join(f'CASE WHEN nxt IS NOT NULL THEN x_{c} END AS x_{c}' for c in columns)}) FROM f), wide AS (SELECT {', '.join(map(value, columns))} FROM g)
SELECT feature, round(importance, 6) AS importance, CASE {case} ELSE 'price' END AS category FROM wide UNPIVOT INCLUDE NULLS (importance FOR feature IN (COLUMNS(*)))"""


ORACLES["feature_importance"] = _importance()
