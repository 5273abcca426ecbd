"""Filed facts: latest submission wins, windows over fiscal years, as-of and range joins, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import growth_rate, ratio
from tickforge.sources.versions import Versions


def latest_wins(df: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """Per key the row submitted last; among equal stamps the one with the least tie value.

    A partial aggregate on each side of the shuffle, so a key with very many submissions is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(stamp), -F.col(tie))
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def growth_window(df: DataFrame, years: int = 5) -> DataFrame:
    """(k, first_fy, last_fy, n_years, first, last, previous, cagr, yoy, gap) of (k, fy, amount), one row per year.

    The last `years` fiscal years that are there; growth a year uses the year before that is there; gap tells
    whether years are missing between the first and the last.
    """
    newest = Window.partitionBy("k").orderBy(F.desc("fy"))
    rows = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= years)
    at = lambda n: F.max(F.when(F.col("_n") == n, F.col("amount")))
    out = rows.groupBy("k").agg(F.min("fy").alias("first_fy"), F.max("fy").alias("last_fy"), F.count(F.lit(1)).alias("n_years"), F.min_by("amount", "fy").alias("first"), F.max_by("amount", "fy").alias("last"), at(2).alias("previous"))
    span = F.col("last_fy") - F.col("first_fy")
    yoy = F.when(F.col("previous") > 0, ratio("last", "previous") - 1)
    return out.withColumns({"cagr": growth_rate(F.col("first"), F.col("last"), span), "yoy": yoy, "gap": F.col("n_years") < span + 1})


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, when: str, value: list[str]) -> DataFrame:
    """left with the values of right's last row of the key whose `when` is not after left's `at`; null if there is none.

    Both sides in one ordered stream per key, the right side's values carried forward: linear, no range join.
    """
    columns = left.columns
    marks = right.select(key, F.col(when).alias("_at"), F.struct(F.col(when).alias(when), *value).alias("_row"), F.lit(0).alias("_side"))
    asks = left.select(key, F.col(at).alias("_at"), F.struct(*columns).alias("_left"), F.lit(1).alias("_side"))
    both = marks.unionByName(asks, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(order)).where("_side = 1")
    return found.select(*(F.col("_left")[c].alias(c) for c in columns), *(F.col("_row")[c].alias(c) for c in [when, *value]))


def revisions(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows at which the value of a key changes, numbered, with the order value (a time stamp) at which the next one starts.

    Changes are found day by day, each day with the value that the days before left; numbers and ends are carried over days. A key's raw rows
    never meet in one task, only its days do.
    """
    rows = df.withColumn("_day", F.to_date(order[0]))
    days, stream = Window.partitionBy(key).orderBy("_day"), Window.partitionBy(key, "_day").orderBy(*order)
    left = rows.groupBy(key, "_day").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_left"))
    rows = rows.join(left.select(key, "_day", F.lag("_left").over(days).alias("_carried")), [key, "_day"])
    rows = rows.withColumn("_before", F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(stream), "_carried"))
    changed = rows.where(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_before", "_carried")
    counts = changed.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"), F.min(order[0]).alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(key, "_day", earlier.alias("_earlier"), F.lead("_first").over(days).alias("_next"))
    found = changed.join(counts, [key, "_day"])
    found = found.withColumn("revision", (F.col("_earlier") + F.row_number().over(stream)).cast("int")).withColumn("valid_to", F.coalesce(F.lead(order[0]).over(stream), "_next"))
    return found.drop("_day", "_earlier", "_next")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, ...) rows that one side has more often than the other; empty if they are equal as bags."""
    return left.exceptAll(right).select(F.lit("left").alias("side"), "*").union(right.exceptAll(left).select(F.lit("right").alias("side"), "*"))


def one_scope(df: DataFrame, key: str, end: str, scope: str, order: list[str], as_of: Column) -> DataFrame:
    """df's rows in one scope per key: of the scopes at its last end the first in `order`. Rows that end after as_of are left out, scopes not in `order` too.

    The last end and its first scope are one greatest pair, a partial maximum; no raw rows are sorted.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(scope))
    rows = df.where(F.col(end) <= as_of).withColumn("_place", place).where("_place > 0")
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(end), (-F.col("_place")).alias("_place"))).alias("_m")).select(key, (-F.col("_m")["_place"]).alias("_place"))
    return rows.join(best, [key, "_place"]).drop("_place")


def checked_once(df: DataFrame, key: str) -> DataFrame:
    """df, which fails when it is read if a key is there twice."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} is there twice: "), F.col(key).cast("string")))).otherwise(F.col("_n"))
    return df.join(counted.select(key, once.cast("long").alias("_n")), key).where("_n = 1").drop("_n")


def overlay(store: Versions, name: str, events: DataFrame) -> int:
    """The master `name` (k, name, market, active, last_event) after events (k, new, kind, to), and the events in `name`_events, as one version.

    delist ends a listing, transfer moves it, listing adds what the master lacks; other events of unknown keys change nothing.
    """
    master = store.read(name)
    both = master.withColumn("_known", F.lit(True)).join(events, "k", "full").where("_known or kind = 'listing'")
    kind, known = F.col("kind"), F.coalesce("_known", F.lit(False))
    after = both.select(
        "k", F.coalesce("name", "new").alias("name"), F.when((kind == "transfer") | ~known, F.col("to")).otherwise(F.col("market")).alias("market"),
        F.when(~known, True).when(kind == "delist", False).otherwise(F.col("active")).alias("active"), F.coalesce("kind", "last_event").alias("last_event"),
    )
    log = f"{name}_events"
    logged = store.read(log).unionByName(events) if log in store.tables() else events
    return store.publish({name: after, log: logged})
