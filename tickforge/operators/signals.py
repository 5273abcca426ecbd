"""Flags and entry signals over one row per stock, scores and judgements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickforge.functions.columns import banded, col, ratio, rounded, weighted


def sure(flag: Column) -> Column:
    """A flag that is false where its inputs are null."""
    return F.coalesce(flag, F.lit(False))


def trend_flags(close: str, short: str, middle: str, long: str) -> dict[str, Column]:
    c, a, b, z = map(F.col, (close, short, middle, long))
    return {"trend_long": sure((a > b) & (c > a)), "trend_short": sure((a < b) & (c < a)), "perfect_long": sure((a > b) & (b > z)), "perfect_short": sure((a < b) & (b < z))}


def five_conditions(turnover: Column | str, volume_ratio: Column | str, atr_pct: Column | str, close: Column | str, short: Column | str, middle: Column | str, primary: float = 1e9, secondary: float = 5e8) -> dict[str, Column]:
    """Liquidity (a lower bound under a threefold volume), volatility and trend, and whether all hold for either side.

    Fixed values: 1e9 and 5e8 yen of mean turnover, 3 times the volume, 2 % of average true range.
    """
    t, v, a, c, s, m = map(col, (turnover, volume_ratio, atr_pct, close, short, middle))
    flags = {"liquid": sure((t >= primary) | ((v >= 3) & (t >= secondary))), "volatile": sure(a >= 2), "up": sure((s > m) & (c > s)), "down": sure((s < m) & (c < s))}
    return flags | {"passed_long": flags["liquid"] & flags["volatile"] & flags["up"], "passed_short": flags["liquid"] & flags["volatile"] & flags["down"]}


def _signal(when: Column, pattern: Column | str, side: Column | str, stop: Column, target: Column, strength: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(text(pattern).alias("pattern"), text(side).alias("side"), F.col("c").alias("entry"), stop.alias("stop"), target.alias("target"), strength.cast("double").alias("strength")))


def patterns() -> Column:
    """All signals (bounds and weights are fixed values) of a snapshot row (see plans.technical.snapshots) as an array without nulls."""
    c, o, hi, lo, vr, atr, rsi, pct, gap, width, f382, f618 = map(F.col, "c o hi lo vr atr rsi pct gap width f382 f618".split())
    rising = F.when(pct > 0, "long").otherwise("short")
    up, turn, jump = pct > 0, F.signum("pct"), F.signum("gap")
    flags = trend_flags("c", "sma5", "sma20", "sma60")
    inside = c.between(f618, f382)
    # The candle that turns: its shadow against the move is over one and a half bodies.
    hammer = sure((c > o) & (o - F.col("l") > (c - o) * 1.5))
    star = sure((c < o) & (F.col("h") - o > (o - c) * 1.5))
    gapped = (F.abs(gap) >= 1.5) & atr.isNotNull()
    outside = ((o > F.col("ph")) | (o < F.col("pl"))) & (vr >= 2)
    within = (o < F.col("ph")) & (o > F.col("pl")) & (vr < 1.3)
    return F.array_compact(
        F.array(
            _signal((c >= hi) & (vr >= 1.5) & (width > 0), "breakout_long", "long", hi - 0.5 * width, c + width, 20 * vr),
            _signal((c <= lo) & (vr >= 1.5) & (width > 0), "breakout_short", "short", lo + 0.5 * width, c - width, 20 * vr),
            _signal(flags["perfect_long"] & inside & rsi.isNotNull() & ((rsi < 40) | hammer), "pullback_long", "long", f618, hi, 40 + F.greatest(F.lit(0.0), 2 * (50 - rsi))),
            _signal(flags["perfect_short"] & inside & rsi.isNotNull() & ((rsi > 60) | star), "pullback_short", "short", f382, lo, 40 + F.greatest(F.lit(0.0), 2 * (rsi - 50))),
            _signal((vr >= 3) & (F.abs(pct) >= 3) & atr.isNotNull(), "volume_surge", rising, F.when(up, F.col("pl")).otherwise(F.col("ph")), c + turn * 2 * atr, 15 * vr + 2 * F.abs(pct)),
            F.coalesce(
                _signal(gapped & outside, "gap_follow", F.when(gap > 0, "long").otherwise("short"), F.when(gap > 0, hi).otherwise(lo), c + jump * 2 * atr, 50 + 10 * vr),
                _signal(gapped & within, "gap_fade", F.when(gap > 0, "short").otherwise("long"), c + jump * 1.5 * atr, F.col("pc"), F.lit(40.0)),
            ),
            _signal((vr >= 2.5) & (F.abs(pct) >= 5) & (ratio(atr, c) * 100 >= 3), "post_earnings", rising, c - turn * 1.5 * atr, c + turn * 3 * atr, 50 + 10 * vr),
        )
    )


def fundamental_score(per: Column, pbr: Column, dividend: Column, roe: Column, benefit: Column) -> Column:
    """Five banded scores by weight; those that are null drop out and the weights are scaled."""
    roe = F.when(F.abs(roe) > 1, roe).otherwise(roe * 100)
    return rounded(
        weighted(
            [
                (banded(F.when(per > 0, per), [("<", 10, 100), ("<", 15, 80), ("<", 20, 60), ("<", 30, 40)], 20), 0.25),
                (banded(F.when(pbr > 0, pbr), [("<", 0.5, 100), ("<", 1, 80), ("<", 1.5, 60), ("<", 2, 40)], 20), 0.20),
                (banded(dividend, [(">", 5, 100), (">=", 4, 80), (">=", 3, 60), (">=", 2, 40), (">=", 1, 20)], 10), 0.25),
                (banded(roe, [(">", 15, 100), (">=", 10, 80), (">=", 5, 60), (">=", 0, 40)], 20), 0.15),
                (banded(benefit, [(">", 5, 100), (">=", 3, 80), (">=", 2, 60), (">=", 1, 40)], 20), 0.15),
            ]
        ),
        2,
    )


def technical_score(deviation: Column, rsi: Column, macd: Column, signal: Column) -> Column:
    crossed = F.when(macd.isNull() | signal.isNull(), F.lit(None).cast("double")).when((macd > signal) & (macd < 0), 100.0).when(macd > signal, 60.0).otherwise(20.0)
    return rounded(
        weighted(
            [
                (banded(deviation, [("<", -10, 100), ("<", -5, 80), ("<", 0, 60), ("<", 5, 40)], 20), 0.45),
                (banded(rsi, [("<", 30, 100), ("<", 40, 80), ("<", 50, 60), ("<", 60, 40), ("<", 70, 20)], 10), 0.35),
                (crossed, 0.20),
            ]
        ),
        2,
    )


def macro_judgement(vi: Column, vix: Column, sp500: Column, turnover: Column, gap: Column) -> Column:
    """A to D or HOLD: nulls never judge, they hold."""
    calm = (turnover >= 1.2) & (F.abs(gap) <= 200)
    known = turnover.isNotNull() & gap.isNotNull()
    return (
        F.when(vi.isNull(), "HOLD")
        .when(vi > 35, "D")
        .when((vix > 20) & (sp500 <= -1), "D")
        .when(vi >= 30, "C")
        .when(vi > 25, "B")
        .when(vi < 20, "B")
        .when(calm, "A")
        .when(known, "B")
        .otherwise("HOLD")
    )
