"""Building blocks of ordered per-ticker analytics: frames with a full-window guard, safe division, run lengths, recursive averages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, TIME = "ticker", "ts"


def ordered():
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(k: int):
    """The last k rows, the present one among them."""
    return ordered().rowsBetween(-(k - 1), 0)


def before(k: int):
    """The k rows before the present one."""
    return ordered().rowsBetween(-k, -1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(c, k).over(ordered())


def lead(c: Column | str, k: int = 1) -> Column:
    return F.lead(c, k).over(ordered())


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def full(k: int, aggregate: Column, c: Column | str, frame=None) -> Column:
    """An aggregate over the last k rows, null until k values of c are there."""
    frame = frame if frame is not None else trailing(k)
    return F.when(F.count(c).over(frame) == k, aggregate.over(frame))


def mean(c: Column | str, k: int) -> Column:
    return full(k, F.avg(c), c)


def std(c: Column | str, k: int) -> Column:
    return full(k, F.stddev_samp(c), c)


def change(c: Column | str, k: int = 1) -> Column:
    """Relative change over k rows."""
    return div(col(c), lag(c, k)) - 1


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def run_length(frame: DataFrame, c: str, out: str) -> DataFrame:
    """How many rows in a row c has been 1, counting this one."""
    island = F.sum(F.when(F.col(c) == 1, 0).otherwise(1)).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    frame = frame.withColumn("_island", island)
    runs = Window.partitionBy(KEY, "_island").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(out, F.sum(c).over(runs)).drop("_island")


#: Rows that recursive_means holds at once, and those of the series that is not complete.
HELD = 200_000


def recursive_means(frame: DataFrame, means: Mapping[str, tuple[str | Callable, float]], keep: str | None = None) -> DataFrame:
    """Columns y by (x, alpha): y = alpha * x + (1 - alpha) * y of the row before, begun with the first value of x.

    A recursion can't be a window aggregate, so a ticker's rows are read in order by one task, those of many short series
    at once; its memory follows the longest single series. x is a column, one of the means before it, or a function of
    both, given what makes an array (nulls as nan) of a name. With keep, rows where that column is not true are read, but not returned.
    """
    # Numbering the rows brings each series to one task, in order; the numbers show where one begins.
    frame = frame.withColumn("_row", F.row_number().over(ordered()))
    at, most = frame.columns.index("_row"), HELD

    # Functions within this one travel to the workers whole, which need not have this package.
    def made(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        row = table["_row"].to_numpy()
        if row[0] != 1 or ((row[1:] != 1) & (row[1:] != row[:-1] + 1)).any():
            raise RuntimeError("rows of a series are not together or not in order")
        series, values = np.cumsum(row == 1), {}
        column = lambda c: values[c] if c in values else table[c].cast(pa.float64()).to_numpy()
        for name, (x, alpha) in means.items():
            x = pd.Series(x(column) if callable(x) else column(x))
            values[name] = x.groupby(series).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
        table = table.drop_columns(["_row"])
        for name in means:
            table = table.append_column(name, pa.array(values[name], pa.float64(), from_pandas=True))
        yield from (table.filter(table[keep]) if keep else table).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(at).to_numpy() == 1)
            if n >= most and len(starts):
                yield from made([*held, batch.slice(0, starts[-1])])
                held, n, batch = [], 0, batch.slice(starts[-1])
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from made(held)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema if f.name != "_row"] + [T.StructField(n, T.DoubleType()) for n in means])
    return frame.mapInArrow(run, schema)


def span(n: int) -> float:
    """Weight of an exponential mean over n rows."""
    return 2.0 / (n + 1)


def last_rows(frame: DataFrame, n: int = 1) -> DataFrame:
    """The last n rows of each ticker."""
    back = Window.partitionBy(KEY).orderBy(F.desc(TIME))
    return frame.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n).drop("_back")
