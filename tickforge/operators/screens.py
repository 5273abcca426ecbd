"""Screens with parameters: conditions that are there only if asked for, a total before the limit, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import col

MOST = 500


def clamped(limit: int | None, default: int = 100, most: int = MOST) -> int:
    """A limit between 1 and `most`."""
    return default if limit is None else max(1, min(int(limit), most))


def checked(codes: list[str], most: int = 50) -> list[str]:
    """Distinct codes of a request in their order; too many, or one that is no word, are refused."""
    out = list(dict.fromkeys(str(c).strip() for c in codes))
    if not out or len(out) > most or not all(c.isalnum() for c in out):
        raise ValueError(f"one to {most} codes of letters and digits are asked for")
    return out


def all_of(conditions: list[Column | None]) -> Column:
    """The conditions that are there, all of them; a null is no."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & F.coalesce(c, F.lit(False))
    return out


def within(column: str, least: float | None = None, most: float | None = None, over: float | None = None) -> Column | None:
    """A range condition of the bounds that are given; None without any."""
    bounds = [F.col(column) >= least if least is not None else None, F.col(column) <= most if most is not None else None, F.col(column) > over if over is not None else None]
    return all_of(bounds) if any(b is not None for b in bounds) else None


def paged(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page of df and, on each row, `total`: how many rows there are before the limit (a partial count, one row, beside the page)."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(max(0, offset)).limit(clamped(limit)).crossJoin(F.broadcast(total))


def fresh(stamp: str, now: Column, days: int, than: str | None = None) -> Column:
    """Whether a row was computed within `days` before now, and not before what it stands beside (`than`)."""
    own = F.col(stamp) >= F.date_sub(now, days)
    return own if than is None else own & (F.col(stamp) >= F.col(than))


def found_by(q: str, code: str = "code", name: str = "name") -> Column:
    """A code that begins with q or a name that holds it, as plain text."""
    return F.startswith(F.col(code), F.lit(q)) | F.contains(F.col(name), F.lit(q))


def redacted(df: DataFrame, hidden: list[str]) -> DataFrame:
    """df with the hidden columns null, their types kept."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden if c in df.columns})


def date_page(df: DataFrame, date: str, cursor: Column | str | None, size: int) -> tuple[DataFrame, DataFrame]:
    """(the newest `size` dates up to the cursor with their rows, the next cursor: the date behind them, if any)."""
    days = df.select(date).distinct()
    if cursor is not None:
        days = days.where(F.col(date) <= col(cursor))
    newest = days.orderBy(F.desc(date)).limit(size + 1)  # bounded, so numbering it is too
    low = newest.agg(F.min(date).alias("low"), F.count(F.lit(1)).alias("n"))
    following = low.select(F.when(F.col("n") > size, F.col("low")).alias("next_cursor"))
    page = newest.crossJoin(low).where((F.col("n") <= size) | (F.col(date) > F.col("low"))).select(date)
    return df.join(F.broadcast(page), date, "left_semi"), following
