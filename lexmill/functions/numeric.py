"""Closed-form functions: statistics, axis helpers and the small models behind figures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    # Fixed values of the approximation.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    ax = F.abs(x)
    t = 1 / (1 + p * ax)
    y = 1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-ax * ax)
    return F.when(x < 0, -y).otherwise(y)


def rank_test_p(u: Column, m: Column, n: Column) -> Column:
    """Two-sided p of a Mann-Whitney U: normal approximation, continuity 0.5, no tie correction."""
    spread = F.sqrt(m * n * (m + n + 1) / 12.0)
    z = F.greatest(F.lit(0.0), F.abs(u - m * n / 2.0) - 0.5) / spread
    return F.greatest(F.lit(0.0), 1 - erf(z / math.sqrt(2)))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def trimmed_number(x: Column, digits: int) -> Column:
    """A number with at most so many decimals, zeros trimmed, no negative zero; a dash where it is not finite."""
    fixed = F.regexp_replace(F.format_number(x, digits), ",", "")
    bare = F.when(F.lit(digits > 0), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("—")).when(bare.isin("-0", ""), F.lit("0")).otherwise(bare)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def tick_step(lo: Column, hi: Column, count: int) -> Column:
    """The step of 1, 2 or 5 times a power of ten that gives about count ticks."""
    raw = (hi - lo) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / power
    return F.when(unit <= 1, 1).when(unit <= 2, 2).when(unit <= 5, 5).otherwise(10) * power


def ticks(lo: Column, hi: Column, count: int = 5) -> Column:
    """Round values between lo and hi; lo alone where both are the same."""
    step = tick_step(lo, F.when(hi != lo, hi), count)
    first, last = F.ceil(lo / step), F.floor(hi / step + 1e-9)
    return F.when(lo == hi, F.array(lo.cast("double"))).otherwise(_between(first, last, step))


def _between(first: Column, last: Column, step: Column) -> Column:
    return F.transform(F.sequence(first, last), lambda i: F.round(i * step, 10))


# Fixed values of the models.
G_STAR, G_COL = 0.886, 0.049
A_MIN, T_CRIT, T_RETURN, DIP = 0.5992, 66.3, 22.0, 0.3
DESCENT = (73 - T_CRIT) / math.log((G_STAR - G_COL) / (0.1 - G_COL))
ESCAPE = 22.0


def runaway(x: Column, a: Column, hold: Column) -> Column:
    """Level at time x for a drive a held for hold: below a threshold none, past a dose collapse, else dip and return."""
    dose = hold / T_CRIT
    target = G_STAR - (a - A_MIN) / (1 - A_MIN) * (G_STAR - G_COL) * DIP * dose
    dipped = lambda t: G_STAR + (target - G_STAR) * (1 - F.exp(-t / T_RETURN))
    released = dipped(hold)
    fallen = F.when(x <= T_CRIT, G_STAR).otherwise(G_COL + (G_STAR - G_COL) * F.exp(-(x - T_CRIT) / DESCENT))
    return (
        F.when(a < A_MIN, F.lit(G_STAR))
        .when(dose >= 1, fallen)
        .when(x <= hold, dipped(x))
        .otherwise(released + (G_STAR - released) * (1 - F.exp(-(x - hold) / T_RETURN)))
    )


def damped(t: Column, zeta: Column, omega: float = 1.0) -> Column:
    """Impulse response; critically damped from zeta 1 on."""
    wd = omega * F.sqrt(F.greatest(F.lit(0.0), 1 - zeta * zeta))
    return F.when(wd <= 0.001, omega * t * F.exp(-omega * t)).otherwise(F.exp(-zeta * omega * t) * F.sin(wd * t))


def escape_ramp(t: Column) -> Column:
    tau = ESCAPE / 4
    return F.when(t >= ESCAPE, F.lit(1.0)).otherwise((1 - F.exp(-t / tau)) / (1 - math.exp(-ESCAPE / tau)))


def unit_ramp(u: Column, tau: float = 0.9) -> Column:
    return F.when(u >= 1, F.lit(1.0)).when(u <= 0, F.lit(0.0)).otherwise((1 - F.exp(-u / tau)) / (1 - math.exp(-1 / tau)))


def bisect_shape(share: float, cross: float, end: float, steps: int = 100) -> Column:
    """The tau for which (1 - e^(-cross/tau)) / (1 - e^(-end/tau)) equals share, by bisection."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = (1 - F.exp(-cross / mid)) / (1 - F.exp(-end / mid)) > share
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(1e-3).alias("lo"), F.lit(1e6).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def expression_level(t: Column) -> Column:
    return clamp((t - 0.35) / 0.55, 0.0, 1.0) * (0.6 + 0.4 * 0.62)


def evidence(n: Column) -> Column:
    return F.least(F.lit(1.0), n / 8.0)


def log_distance(x: Column) -> Column:
    return F.pow(F.lit(10.0), -x) * 800


def superscript(n: Column) -> Column:
    return F.translate(n.cast("string"), "-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹")


def distance_label(d: Column) -> Column:
    """m×10ᵉ with at most one decimal; 1 from one on, 0 for what is not above zero."""
    e = F.floor(F.ln(d) / math.log(10))
    m = d / F.pow(F.lit(10.0), e.cast("double"))
    whole = F.round(m)
    digits = F.when(F.abs(m - whole) < 1e-9, whole.cast("long").cast("string")).otherwise(trimmed_number(m, 1))
    return F.when(d.isNull() | F.isnan(d) | (d <= 0), "0").when(d >= 1, "1").otherwise(F.concat(digits, F.lit("×10"), superscript(e)))


def gauges(d: Column) -> Column:
    """Array of authority, scrutiny, cost of doubt and protection, each from 0 to 1."""
    return F.transform(F.array(d, 1 - d, d, 1 - d), lambda x: clamp(x, 0.0, 1.0))


def remaining_share(items: Column, core: int) -> Column:
    """Share of the work that is left: core tasks, and those of items (on boolean) that are not on."""
    left = F.size(F.filter(items, lambda x: ~F.coalesce(x["on"], F.lit(False))))
    return (left + core) / (F.size(items) + core)
