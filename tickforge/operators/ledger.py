"""State that grows run by run: quality gates against the last accepted row, holds, merges, sweeps, observations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tickforge.sources.objects import incoherent

#: Fixed value: a close may move by this factor from the last accepted one where there is no volume.
MOST_JUMP = 10.0


def judged(bars: DataFrame, jump: float = MOST_JUMP) -> DataFrame:
    """bars (k, d, h, l, c, v and any more) with `reason`: why a bar is refused, null where it is accepted.

    A bar is compared with the last accepted bar that has a close, so one broken bar does not drag the next one down; that is a
    recursion, one pass over each key's days in order. Only the last close is held. Bars without a close are accepted and compared with nothing.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), None
        for days in batches:
            reasons = []
            # Nulls come as NaN, which is unlike itself.
            for k, h, lo, c, v in zip(days.column("k").to_pylist(), *(days.column(x).to_numpy(zero_copy_only=False).astype("float64").tolist() for x in ("h", "l", "c", "v")), strict=True):
                if k != key:
                    key, last = k, None
                reason, there = None, c == c
                if there and c <= 0:
                    reason = "non_positive_close"
                elif h < lo:
                    reason = "high_low_inverted"
                elif there and last and (v != v or not v) and not 1 / jump <= c / last <= jump:
                    reason = "jump_without_volume"
                if reason is None and there:
                    last = c
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([*days.columns, pa.array(reasons, pa.string())], names=[*days.schema.names, "reason"])

    return bars.repartition("k").sortWithinPartitions("k", "d").mapInArrow(judge, StructType([*bars.schema.fields, StructField("reason", StringType())]))


def sanitised(bars: DataFrame, jump: float = MOST_JUMP) -> DataFrame:
    """(k, d, c, reason) of bars (k, d, h, l, c, v): why a bar is refused, null where it is accepted."""
    return judged(bars.select("k", "d", "h", "l", "c", "v"), jump).select("k", "d", "c", "reason")


def guarded(bars: DataFrame, quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """(k, verdict, refused, freshness) of histories (k, d, o, h, l, c, v, adj), quoted prices (k, price) and the day that is expected (one row).

    raw: any value that is there is impossible, whatever else its bar lacks. incoherent: of the bars that the sanitiser accepts, the newest with a used
    close (adjusted, else as traded) is far off the quoted price without volume, or the price is no price. freshness: the newest accepted
    bar is not the expected day's (stale_date) or has no used close (missing_fresh_close); null if it is there.
    """
    bad = F.lit(False)
    for x in ("o", "h", "l", "c", "adj"):
        bad = bad | F.coalesce(F.isnan(x) | (F.col(x) <= 0), F.lit(False))
    bad = bad | F.coalesce(F.isnan("v") | (F.col("v") < 0), F.lit(False)) | F.coalesce(F.col("o").isNotNull() & F.col("c").isNotNull() & (F.col("h") < F.col("l")), F.lit(False))
    used = F.coalesce("adj", "c")
    rows = judged(bars)
    taken = F.col("reason").isNull()
    latest = F.struct(used.alias("used"), F.col("v").alias("v"))
    g = rows.groupBy("k").agg(F.max(bad).alias("raw"), F.count_if(~taken).alias("refused"), F.max_by(latest, F.when(taken & used.isNotNull(), F.col("d"))).alias("last"), F.max(F.when(taken, F.col("d"))).alias("d"), F.max_by(used, F.when(taken, F.col("d"))).alias("newest"))
    g = g.join(quotes, "k", "left").crossJoin(F.broadcast(expected))
    verdict = F.when(F.col("raw"), "raw").when(incoherent(F.col("last.used"), F.col("last.v"), F.col("price")), "incoherent").otherwise("ok")
    freshness = F.when(~F.col("d").eqNullSafe(F.col("expected")), "stale_date").when(F.coalesce(F.col("newest") <= 0, F.lit(True)), "missing_fresh_close")
    return g.select("k", verdict.alias("verdict"), "refused", freshness.alias("freshness"))


def held(windows: DataFrame, events: DataFrame, key: str, first: str, last: str, at: str, name: str) -> DataFrame:
    """windows with `name`: whether an event of the key falls behind the window's first and not behind its last day.

    The key is the join's; the days are a residual, and the hits are put together before they come back.
    """
    hits = windows.select(key, first, last).distinct().join(events.select(key, F.col(at).alias("_at")), key).where((F.col("_at") > F.col(first)) & (F.col("_at") <= F.col(last))).select(key, first, last, F.lit(True).alias(name)).distinct()
    return windows.join(hits, [key, first, last], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def merged(old: DataFrame, new: DataFrame, keys: list[str], newer: Column, stricter: str) -> DataFrame:
    """Upsert: the new row wins where `newer` (over columns old and new) holds or there is no old one; of both licenses the stricter stays."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("old")), new.select(*keys, F.struct(*rest).alias("new"))
    both = a.join(b, keys, "full_outer")
    wins = F.col("old").isNull() | (F.col("new").isNotNull() & F.coalesce(newer, F.lit(False)))
    pick = {c: F.when(wins, F.col("new")[c]).otherwise(F.col("old")[c]) for c in rest}
    pick[stricter] = F.greatest(F.col("old")[stricter], F.col("new")[stricter])
    return both.select(*keys, *(x.alias(c) for c, x in pick.items()))


def observations(wide: DataFrame, keys: list[str], legs: dict[str, tuple[str, float]], period: str) -> DataFrame:
    """(keys, period, indicator, value, change): each leg's column times its factor as a row, with the change against the period before; nulls are no observation."""
    scaled = wide.select(*keys, period, *((F.col(c) * factor).alias(name) for name, (c, factor) in legs.items()))
    long = scaled.unpivot([*keys, period], list(legs), "indicator", "value").where("value is not null")
    before = F.lag("value").over(Window.partitionBy(*keys, "indicator").orderBy(period))
    return long.withColumn("change", F.col("value") - before)


def problems(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, comma-joined; a null rule does not."""
    return F.array_join(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))), ",")


def flat_columns(df: DataFrame) -> list[Column]:
    """All leaves of nested structs as text, named by their dotted path."""

    def leaves(path: list[str], kind) -> Iterator[Column]:
        for f in kind.fields:
            here = [*path, f.name]
            if hasattr(f.dataType, "fields"):
                yield from leaves(here, f.dataType)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).cast("string").alias(".".join(here))

    return list(leaves([], df.schema))


def regressions(old: DataFrame, new: DataFrame, key: str, arrays: list[str], writer: str) -> DataFrame:
    """(key, reason) of new documents (key, writer, first_date, arrays) against the stored ones: why one may not be written, null where it may.

    In this order: it is not this writer's (writer); the stored one is another's (other_writer); of the arrays one vanished, has fewer
    elements, or lacks one that it had (vanished, shrunk, lost); it begins later (first_date). A key that is not stored yet is new and free.
    """
    fields = ["writer", "first_date", *arrays]
    both = new.select(key, F.struct(*fields).alias("n")).join(old.select(key, F.struct(*fields).alias("o")), key, "left")
    any_of = lambda test: F.array_contains(F.array(*(F.coalesce(test(F.col(f"o.{a}"), F.col(f"n.{a}")), F.lit(False)) for a in arrays)), True)
    stored = F.col("o").isNotNull()
    reason = (
        F.when(~F.col("n.writer").eqNullSafe(F.lit(writer)), "writer").when(stored & F.col("o.writer").isNotNull() & (F.col("o.writer") != writer), "other_writer").when(stored & any_of(lambda o, n: o.isNotNull() & n.isNull()), "vanished")
        .when(stored & any_of(lambda o, n: F.size(n) < F.size(o)), "shrunk").when(stored & any_of(lambda o, n: F.size(F.array_except(o, n)) > 0), "lost").when(stored & F.coalesce(F.col("n.first_date") > F.col("o.first_date"), F.lit(False)), "first_date")
    )
    return both.select(key, reason.alias("reason"))


def same_body(old: Column, new: Column, schema: str, volatile: list[str]) -> Column:
    """Whether two JSON documents are the same but for their volatile top-level fields; a stored one that is missing or no such document is not.

    Objects are compared whatever the order of their fields, arrays in order. A field that one of them lacks is a difference: fields are compared by
    their names too.
    """
    names = lambda text: F.array_sort(F.filter(F.json_object_keys(text), lambda k: ~k.isin(volatile)))
    return F.coalesce(names(old).eqNullSafe(names(new)) & names(old).isNotNull() & F.from_json(old, schema).eqNullSafe(F.from_json(new, schema)), F.lit(False))
