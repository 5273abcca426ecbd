"""Which days are covered: ranges merged over gaps, windows contained in them, and sessions that daily bars prove free of splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_ranges(ranges: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, first, last) of day ranges, closed on both ends: ranges of a key that overlap, lie in each other or touch (the next day) become one.

    A range begins a new one if it begins more than a day behind the farthest end so far. Ranges with an end before their begin are none.
    """
    before = Window.partitionBy(key).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.select(key, first, last).where(F.col(first) <= F.col(last)).distinct()
    reach = F.max(last).over(before)
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col(first) > F.date_add(reach, 1)), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(Window.partitionBy(key).orderBy(first, last).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("_island")


def contained(windows: DataFrame, ranges: DataFrame, key: str, first: str, last: str, name: str) -> DataFrame:
    """windows (key, first, last, ...) with `name`: whether one merged range of the key holds the whole window."""
    merged = merged_ranges(ranges, key, first, last).select(key, F.col(first).alias("_from"), F.col(last).alias("_to"))
    hits = windows.select(key, first, last).distinct().join(merged, key).where((F.col("_from") <= F.col(first)) & (F.col(last) <= F.col("_to"))).select(key, first, last, F.lit(True).alias(name)).distinct()
    return windows.join(hits, [key, first, last], "left").withColumn(name, F.coalesce(name, F.lit(False)))


# Fixed value: the range that a proof must have asked for.
WHOLE_RANGE = "10y"


def zero_split_coverage(proofs: DataFrame, sessions: DataFrame, bars: DataFrame, splits: DataFrame, key: str = "k") -> DataFrame:
    """(key, reason) of proofs (key, first, last, asked, splits array<struct<d, ratio>>): null if the intraday sessions are surely on the daily bars' share basis.

    sessions (key, d), bars (key, d), splits (key, d, ratio). In this order: the proof's span is that of the bars (span-mismatch); each
    session is a bar's day (sessions-uncovered); the stored splits are the proof's, but for those before the bars that the proof doesn't
    have (splits-mismatch); no split from the first session to the last bar (in-window-split); all years were asked for (range-not-10y).
    """
    days = bars.select(key, "d").distinct()
    span = days.groupBy(key).agg(F.min("d").alias("bar_first"), F.max("d").alias("bar_last"))
    intra = sessions.select(key, "d").distinct()
    first = intra.groupBy(key).agg(F.min("d").alias("session_first"))
    uncovered = intra.join(days, [key, "d"], "left_anti").select(key, F.lit(True).alias("uncovered")).distinct()
    proven = proofs.select(key, F.explode("splits").alias("s")).select(key, "s.d", F.col("s.ratio").alias("proven"))
    stored = splits.select(key, "d", "ratio").join(span, key).join(first, key, "left")
    both = stored.join(proven, [key, "d"], "full_outer")
    relevant = F.col("proven").isNotNull() | (F.col("d") >= F.col("bar_first"))
    inside = F.coalesce((F.col("d") >= F.col("session_first")) & (F.col("d") <= F.col("bar_last")) & F.col("ratio").isNotNull(), F.lit(False))
    seen = both.groupBy(key).agg(F.max(F.coalesce(relevant & ~F.col("ratio").eqNullSafe(F.col("proven")), F.lit(False))).alias("differs"), F.max(inside).alias("inside"))
    rows = proofs.select(key, "first", "last", "asked").join(span, key, "left").join(uncovered, key, "left").join(seen, key, "left")
    same = F.coalesce((F.col("first") == F.col("bar_first")) & (F.col("last") == F.col("bar_last")), F.lit(False))
    reason = F.when(~same, "span-mismatch").when(F.col("uncovered"), "sessions-uncovered").when(F.col("differs"), "splits-mismatch").when(F.col("inside"), "in-window-split")
    return rows.select(key, reason.when(F.col("asked").eqNullSafe(F.lit(WHOLE_RANGE)), F.lit(None)).otherwise("range-not-10y").alias("reason"))
