"""Ordered series per key: frames over the last rows or the last values, and recursive indicators.

Recursive indicators run over a key's whole history. A key has one bar per day, so its history is bounded by its
days, whatever the number of trades; last values are one fold over it, whole series one pass per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickforge.functions.columns import ratio
from tickforge.sources.shared import drop_table, written


def by_day(key: str = "k", day: str = "d") -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def last_rows(n: int, key: str = "k", day: str = "d", current: bool = True) -> WindowSpec:
    """The last n rows, whatever they hold; without the current one if `current` is false."""
    return by_day(key, day).rowsBetween(1 - n if current else -n, 0 if current else -1)


def full_mean(x: Column | str, n: int, current: bool = True) -> Column:
    """Mean over the last n rows, null unless all n hold a value."""
    frame = last_rows(n, current=current)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def sma(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Mean of the last n values that are not null, also at rows that hold none; null while there are fewer."""
    number = F.count(column).over(by_day())
    df = df.withColumn("_nth", number)
    values = Window.partitionBy("k", F.col(column).isNotNull()).orderBy("d").rowsBetween(1 - n, 0)
    own = F.when(F.col(column).isNotNull() & (F.count(column).over(values) == n), F.avg(column).over(values))
    df = df.withColumn("_own", own)
    carried = F.last("_own", ignorenulls=True).over(by_day())
    return df.withColumn(name, F.when(F.col("_nth") >= n, carried)).drop("_nth", "_own")


def latest(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    newest = Window.partitionBy("k").orderBy(F.desc("d"))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def history(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, rows): an array of each key's rows, one a day, oldest first."""
    return df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("d", *columns))).alias("rows"))


def last_of(rows: str, n: int, current: bool = True) -> Column:
    """The last n of an array of rows, or all of a shorter one; without the very last if `current` is false."""
    end = F.size(rows) - (0 if current else 1)
    return F.slice(rows, F.greatest(end - n + 1, F.lit(1)), F.least(F.greatest(end, F.lit(0)), F.lit(n)))


def array_mean(rows: str, value: Callable[[Column], Column], n: int, current: bool = True) -> Column:
    """full_mean at the end of an array of rows."""
    found = F.array_compact(F.transform(last_of(rows, n, current), value))
    return F.when(F.size(found) == n, total(found) / n)


def recent(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(k, rows): an array of each key's last n rows, oldest first."""
    return history(latest(df, n), columns)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def ema_last(xs: Column, n: int) -> Column:
    """The last exponential mean of an array; the seed is the mean of its first n values."""
    alpha = 2.0 / (n + 1)
    tail = F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))
    return F.when(F.size(xs) >= n, F.aggregate(tail, total(F.slice(xs, 1, n)) / n, lambda a, x: x * alpha + a * (1 - alpha)))


def wilder_last(xs: Column, n: int) -> Column:
    """The last smoothed mean (prev * (n - 1) + x) / n of an array, seeded with the mean of its first n values."""
    tail = F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))
    return F.when(F.size(xs) >= n, F.aggregate(tail, total(F.slice(xs, 1, n)) / n, lambda a, x: (a * (n - 1) + x) / n))


def rsi_last(xs: Column, n: int) -> Column:
    """Relative strength of an array of closes, Wilder's smoothing seeded by the mean of the first n moves: 50 where nothing moved, 100 where nothing fell."""
    zero = F.struct(F.lit(0).alias("i"), *(F.lit(0.0).alias(x) for x in ("x", "gain", "loss")))

    def step(st: Column, x: Column) -> Column:
        i, move = st["i"], x - st["x"]

        def mean(old: Column, part: Column) -> Column:
            part = F.greatest(part, F.lit(0.0))
            return F.when(i == 0, F.lit(0.0)).when(i < n, old + part).when(i == n, (old + part) / n).otherwise((old * (n - 1) + part) / n)

        return F.struct((i + 1).alias("i"), x.alias("x"), mean(st["gain"], move).alias("gain"), mean(st["loss"], -move).alias("loss"))

    def done(st: Column) -> Column:
        flat = F.when(st["gain"] == 0, 50.0).otherwise(100.0)
        return F.when(st["i"] > n, F.when(st["loss"] == 0, flat).otherwise(100 - 100 / (1 + F.try_divide(st["gain"], st["loss"]))))

    return F.aggregate(xs, zero, step, done)


def rsi_values(closes: list[float], n: int) -> list[float | None]:
    """The relative strength at each of a list of closes, null for the first n."""
    out: list[float | None] = []
    gain = loss = 0.0
    for i, x in enumerate(closes):
        move = x - closes[i - 1] if i else 0.0
        up, down = max(move, 0.0), max(-move, 0.0)
        if i <= n:
            gain, loss = gain + up, loss + down
            if i == n:
                gain, loss = gain / n, loss / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        out.append(None if i < n else (50.0 if gain == 0 else 100.0) if loss == 0 else 100 - 100 / (1 + gain / loss))
    return out


def ema_values(xs: list[float], n: int) -> list[float | None]:
    """The exponential mean at each of a list, seeded by the mean of the first n, null before."""
    out: list[float | None] = []
    for i, x in enumerate(xs):
        seed = sum(xs[:n]) / n if i == n - 1 else None
        out.append(seed if i < n else x * (2 / (n + 1)) + out[-1] * (1 - 2 / (n + 1)))
    return out


def series_of(df: DataFrame, values: dict[str, tuple]) -> DataFrame:
    """(k, d, ...) of (k, d, c): for each name the values of function(closes, n), in one pass over each key's days."""

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("d", ignore_index=True)
        closes = days["c"].tolist()
        return days[["k", "d"]].assign(**{name: pd.array(f(closes, n), dtype="Float64") for name, (f, n) in values.items()})

    return df.select("k", "d", "c").groupBy("k").applyInPandas(run, "k long, d date, " + ", ".join(f"{x} double" for x in values))


def standings(df: DataFrame, values: dict[str, tuple], places: int = 4) -> DataFrame:
    """One row for each key of (k, d, c): its last day `d`, and for each name the last value of function(closes, n), its mid-rank among the key's own (`under_`: values under it and half of those equal to it) and how many there are (`bars_`).

    One pass over each key's days; values are compared as they are shown, to `places`.
    """

    def run(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("d", ignore_index=True)
        closes, row = days["c"].tolist(), {"k": days["k"].iloc[0], "d": days["d"].iloc[-1]}
        for name, (f, n) in values.items():
            found = f(closes, n)
            shown = np.floor(np.array([x for x in found if x is not None], float) * 10**places + 0.5001) / 10**places
            last = shown[-1] if found[-1] is not None else None
            row |= {name: last, f"under_{name}": None if last is None else float((shown < last).sum() + 0.5 * (shown == last).sum()), f"bars_{name}": len(shown)}
        return pd.DataFrame([row])

    schema = "k long, d date, " + ", ".join(f"{x} double, under_{x} double, bars_{x} long" for x in values)
    return df.select("k", "d", "c").groupBy("k").applyInPandas(run, schema)


def true_range(rows: Column) -> Column:
    """True ranges of an array of (h, l, c); the first is high - low."""

    def at(i: Column) -> Column:
        here, before = F.get(rows, i), F.get(rows, i - 1)
        span = here["h"] - here["l"]
        return F.when(i == 0, span).otherwise(F.greatest(span, F.abs(here["h"] - before["c"]), F.abs(here["l"] - before["c"])))

    return F.transform(F.sequence(F.lit(0), F.size(rows) - 1), at)


def macd_last(xs: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """(line, signal, histogram) at the last of an array of closes; null under slow + signal values."""
    a, b, c = (2.0 / (n + 1) for n in (fast, slow, signal))
    zero = F.struct(F.lit(0).alias("i"), *(F.lit(0.0).alias(n) for n in ("f", "s", "g")))

    def step(st: Column, x: Column) -> Column:
        i = st["i"] + 1
        # Running sums until a seed is complete, then the recursion.
        f = F.when(i < fast, st["f"] + x).when(i == fast, (st["f"] + x) / fast).otherwise(x * a + st["f"] * (1 - a))
        s = F.when(i < slow, st["s"] + x).when(i == slow, (st["s"] + x) / slow).otherwise(x * b + st["s"] * (1 - b))
        line, first = f - s, slow + signal - 1
        g = F.when(i < slow, F.lit(0.0)).when(i < first, st["g"] + line).when(i == first, (st["g"] + line) / signal).otherwise(line * c + st["g"] * (1 - c))
        return F.struct(i.alias("i"), f.alias("f"), s.alias("s"), g.alias("g"))

    done = F.aggregate(xs, zero, step)
    line = done["f"] - done["s"]
    return F.when(F.size(xs) >= slow + signal, F.struct(line.alias("line"), done["g"].alias("signal"), (line - done["g"]).alias("histogram")))


def numbered(df: DataFrame, *order: Column, name: str, observed: Sequence[Column] = ()) -> tuple[DataFrame, dict]:
    """df with each row's number from 1 in a total order, and the values of the aggregates in `observed`.

    Ranges are sorted apart and written once, each row with its place in its range; a range begins behind the rows of those
    before it. Counts and rows are read from the one table, so they cannot disagree about where a range begins. No task holds
    more than a range; what meets in one is a count per range. Rows that are equal in `order` are numbered in any order.
    """
    # Finding the ranges reads the rows once more, so what makes them is not run again for it.
    rows, seen = written(df, *observed)
    ranged, _ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    drop_table(df.sparkSession, seen["path"])
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own") + 1).drop("_at", "_range", "_own", "_before"), seen


def mean_change(now: Column, before: Column) -> Column:
    return (ratio(now, before) - 1) * 100
