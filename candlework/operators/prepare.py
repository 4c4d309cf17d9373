"""Missing values, scaling, splits and sequences, each ticker by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions.windows import KEY, TIME, div, ordered

_past = lambda: ordered().rowsBetween(Window.unboundedPreceding, 0)
# Rows to come, read backwards: a frame that grows is summed once, one that shrinks anew for each row.
_future = lambda: Window.partitionBy(KEY).orderBy(F.desc(TIME)).rowsBetween(Window.unboundedPreceding, 0)
_whole = lambda: Window.partitionBy(KEY)


def impute(frame: DataFrame, columns: list[str], method: str = "interpolate") -> DataFrame:
    """interpolate (by row position, ends take the nearest value), forward_fill (then backward), drop, or mean.

    But for drop, nulls stay only in columns of tickers that have no value at all.
    """
    if method == "drop":
        return frame.na.drop(subset=columns)
    filled = lambda c: F.coalesce(F.last(c, True).over(_past()), F.last(c, True).over(_future()))
    if method == "forward_fill":
        return frame.withColumns({c: filled(c) for c in columns})
    if method == "mean":
        frame = frame.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(_whole())) for c in columns})
        return frame.withColumns({c: filled(c) for c in columns})
    if method != "interpolate":
        raise ValueError(f"unknown method {method}")
    frame = frame.withColumn("_i", F.row_number().over(ordered()))
    out: dict[str, Column] = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("x")))
        a, b = F.last(at, True).over(_past()), F.last(at, True).over(_future())
        between = a["x"] + div(b["x"] - a["x"], b["i"] - a["i"]) * (F.col("_i") - a["i"])
        out[c] = F.coalesce(F.col(c), between, a["x"], b["x"])
    return frame.withColumns(out).drop("_i")


def scaler_of(column: str, method: str = "standard") -> str:
    return "robust" if "volume" in column else method


def scale_parameters(frame: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """(ticker, column, centre, spread): a table that later rows can be scaled by."""
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown method {method}")
    aggregates = []
    for c in columns:
        kind = scaler_of(c, method)
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        centre, spread = {"standard": (F.avg(c), F.stddev_pop(c)), "minmax": (F.min(c), F.max(c) - F.min(c)), "robust": (q[1], q[2] - q[0])}[kind]
        aggregates.append(F.struct(F.lit(c).alias("column"), centre.cast("double").alias("centre"), spread.cast("double").alias("spread")))
    return frame.groupBy(KEY).agg(F.array(*aggregates).alias("p")).select(KEY, F.explode("p").alias("p")).select(KEY, "p.*")


def scale(frame: DataFrame, columns: list[str], method: str = "standard", fitted: DataFrame | None = None) -> DataFrame:
    """Columns less their centre over their spread (1 where that is 0), by given parameters or by the frame's own."""
    fitted = scale_parameters(frame, columns, method) if fitted is None else fitted
    wide = fitted.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("centre", "spread")))).alias("_p"))  # as many entries as columns
    both = frame.join(wide, KEY)
    return both.withColumns({c: (F.col(c) - F.col("_p")[c]["centre"]) / F.when(F.col("_p")[c]["spread"] == 0, 1.0).otherwise(F.col("_p")[c]["spread"]) for c in columns}).drop("_p")


def feature_stats(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_null, mean, std, min, q25, q50, q75, max)."""
    parts = [
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.5).alias("q50"), F.percentile(c, 0.75).alias("q75"), F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return frame.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def sequences(frame: DataFrame, columns: list[str], length: int = 60, target: str = "close") -> DataFrame:
    """(ticker, ts, seq, target): the length rows before each row, as float arrays, and that row's target."""
    frame_of = ordered().rowsBetween(-length, -1)
    row = F.array(*[F.col(c).cast("float") for c in columns])
    out = frame.withColumns({"seq": F.collect_list(row).over(frame_of), "target": F.col(target).cast("float")})
    return out.where(F.size("seq") == length).select(KEY, TIME, "seq", "target")


def preprocess(bars: DataFrame, families: tuple[str, ...] = (), length: int = 60, method: str = "standard", fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All tickers' bars made ready for a model, each ticker by itself: scaled features, sequences, and metadata.

    Features are the bars' own columns and those of some families (features.FAMILIES), imputed by interpolation, then
    scaled by the ticker's parameters or by given ones (as from scale_parameters). Metadata is a row for each ticker: how
    many features, samples, nulls before imputation, and sequences.
    """
    from candlework.operators.features import features

    made = features(bars, families)
    columns = [c for c in made.columns if c not in (KEY, TIME)]
    numbers = {c: F.when(~F.isnan(x := F.col(c).cast("double")), x) for c in columns}
    made = made.withColumns(numbers)
    scaled = scale(impute(made, columns), columns, method, fitted)
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    counts = made.groupBy(KEY).agg(F.count(F.lit(1)).alias("num_samples"), missing.alias("missing_values"))
    metadata = counts.select(KEY, F.lit(len(columns)).cast("long").alias("num_features"), "num_samples", "missing_values", F.greatest(F.lit(0), F.col("num_samples") - length).alias("num_sequences"))
    return scaled, sequences(scaled, columns, length), metadata


def _cut(n: Column, share: float) -> Column:
    return F.floor(n.cast("double") * F.lit(share))


def split_chronological(frame: DataFrame, train: float = 0.7, valid: float = 0.15, test: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """Adds split by position in time; shares that don't sum to 1 are normalised."""
    total = train + valid + test
    if abs(total - 1) > 1e-6:
        train, valid = train / total, valid / total
    by = [KEY] if by is None else by
    i = F.row_number().over(Window.partitionBy(*by).orderBy(TIME)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return frame.withColumns({"_i": i, "_n": n}).withColumn("split", F.when(F.col("_i") < _cut(F.col("_n"), train), "train").when(F.col("_i") < _cut(F.col("_n"), train + valid), "valid").otherwise("test")).drop("_i", "_n")


def split_gap(frame: DataFrame, window: int, gap: int = 0, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Splits for windowed samples, with gaps between them; rows in a gap are dropped."""
    frame = frame.withColumns({"_i": F.row_number().over(ordered()) - 1, "_n": F.count(F.lit(1)).over(_whole())})
    whole = lambda x: x.cast("long")  # noqa: E731  toward zero
    i, n = F.col("_i"), F.col("_n")
    eff = n - window + 1
    te = whole(eff.cast("double") * F.lit(train)) + window - 1
    vs = te + gap + 1
    ve0 = vs + whole(eff.cast("double") * F.lit(valid))
    ts = F.least(ve0 + gap + 1, n)
    split = F.when(i < te, "train").when((i >= vs) & (i < F.least(ve0, n)), "valid").when(i >= ts, "test")
    return frame.withColumn("split", split).where("split is not null").drop("_i", "_n")


def split_walk_forward(frame: DataFrame, folds: int = 5, test_size: int = 30) -> DataFrame:
    """Adds fold and split: each fold trains on all rows before its test rows. Folds without test or training rows are left out."""
    frame = frame.withColumns({"_i": F.row_number().over(ordered()) - 1, "_n": F.count(F.lit(1)).over(_whole())})
    step = F.floor((F.col("_n") - test_size) / F.lit(folds))
    frame = frame.withColumn("_step", step).where("_step > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = F.col("_step") * (F.col("fold") + 1)
    split = F.when(F.col("_i") < end, "train").when(F.col("_i") < F.least(end + test_size, F.col("_n")), "test")
    return frame.withColumn("split", split).where("split is not null").drop("_i", "_n", "_step")


def split_sequences(rows: DataFrame, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds split to windowed rows of each ticker by their order; shares are taken as they are, the rest is for testing."""
    frame = rows.withColumns({"_i": F.row_number().over(ordered()) - 1, "_n": F.count(F.lit(1)).over(_whole())})
    return frame.withColumn("split", F.when(F.col("_i") < _cut(F.col("_n"), train), "train").when(F.col("_i") < _cut(F.col("_n"), train + valid), "valid").otherwise("test")).drop("_i", "_n")


def split_stratified(frame: DataFrame, label: str, **shares: float) -> DataFrame:
    """As chronological, each label by itself; without that column, the whole series. Rows come in order of time."""
    return split_chronological(frame, by=[KEY, label] if label in frame.columns else None, **shares).orderBy(KEY, TIME)


def split_info(frame: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    counts = frame.groupBy("split").agg(n.alias("n"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
