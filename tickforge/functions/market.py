"""Column builders for quotes and benefits: yields, estimates, record dates, kinds of instruments, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickforge.functions.japanese import CODE

# What the segment of a listed equity names, and what the other segments are.
DOMESTIC, MARKETS = "内国株式", ["プライム", "スタンダード", "グロース"]
SEGMENTS = {
    "プライム（外国株式）": "foreign", "スタンダード（外国株式）": "foreign", "グロース（外国株式）": "foreign", "PRO Market": "pro_market", "ETF・ETN": "etf_etn",
    "REIT・ベンチャーファンド・カントリーファンド・インフラファンド": "reit_fund", "出資証券": "investment_certificate",
}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def dividend_yield(percent: Column) -> Column:
    """A yield in per cent as a ratio; null for what is no finite number of 0 or more."""
    return F.when(_finite(percent) & (percent >= 0), percent / 100)


def estimated_dividend(price: Column, share: Column) -> Column:
    """Price times yield (a ratio); null without both, or where nothing is paid."""
    return F.when(_finite(price) & (share > 0), price * share)


def dividend_state(percent: Column) -> Column:
    """paying, non-dividend (a yield of 0), or unverified: missing and broken yields are not no dividend."""
    good = F.coalesce(_finite(percent) & (percent >= 0), F.lit(False))
    return F.when(~good, "unverified").when(percent > 0, "paying").otherwise("non-dividend")


def trusted(value: Column, source: Column) -> Column:
    """An estimate only if the company itself gave it."""
    return F.when(source == "company", value)


def record_day(text: Column) -> Column:
    """The day of a text YYYY-MM-DD; null for other forms, days that are none, and the year 0."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~text.startswith("0000"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def recurring(month: Column, day: Column) -> Column:
    """Whether a benefit comes back each year: in a month (1 to 12), not at any time (0), and without a single day (text).

    Null where the schedule is broken: no such month, a day that is none, or a single day beside "at any time".
    """
    broken = ~F.coalesce(month.between(0, 12), F.lit(False)) | (day.isNotNull() & record_day(day).isNull()) | ((month == 0) & day.isNotNull())
    return F.when(~broken, day.isNull() & (month != 0))


def instrument(code: Column, segment: Column) -> Column:
    """The kind of instrument of a code in a market segment (trimmed); null for a segment that is not in the list, which is not "no equity"."""
    own = F.trim(segment)
    market = F.contains(own, F.lit(MARKETS[0])) | F.contains(own, F.lit(MARKETS[1])) | F.contains(own, F.lit(MARKETS[2]))
    return F.when(code.rlike(CODE) & F.contains(own, F.lit(DOMESTIC)) & market, "equity").otherwise(F.try_element_at(F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair)), own))


def interim(kind: Column, end: Column) -> Column:
    """The kind of a report: a second quarter that ends from 2024-06-30 on is an interim report."""
    return F.when((kind == "2Q") & (end >= F.lit("2024-06-30").cast("date")), "中間").otherwise(kind)


def band(score: Column, yes: float, no: float) -> Column:
    """yes from one bound on, no up to the other, uncertain between."""
    return F.when(score >= yes, "yes").when(score <= no, "no").otherwise("uncertain")
