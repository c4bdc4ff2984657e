"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nitrapanel.functions.clean import ratio

# Coefficients of the Abramowitz-Stegun 7.1.26 error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def chance_above(level: Column, mean: Column, std: Column) -> Column:
    """P(N(mean, std) > level); a step at the mean when std is not positive."""
    z = ratio(level - mean, std * F.lit(2.0**0.5))
    return F.when(std <= 0, (mean > level).cast("double")).otherwise(F.lit(0.5) * (F.lit(1.0) - erf(z)))


def rmse(actual: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - pred, F.lit(2.0))))


def mae(actual: Column, pred: Column) -> Column:
    return F.avg(F.abs(actual - pred))


def direction_accuracy(actual: Column, pred: Column, before: Column) -> Column:
    """Share of moves called right, over rows that moved; 0.5 when none did."""
    moved = F.signum(actual - before)
    called = F.signum(pred - before)
    return F.coalesce(F.avg(F.when(moved != 0, (moved == called).cast("double"))), F.lit(0.5))


def hit_rate(label: Column, pred: Column) -> Column:
    return F.avg((label == pred).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over complete pairs; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size > 0.7, "Strong").when(size > 0.4, "Moderate").when(r.isNotNull(), "Weak")


def sorted_count_above(values: Column, above) -> Column:
    """Number of entries of an ascending array for which ``above`` holds, by bisection.

    ``above`` must be false up to some entry and true from there on.
    """
    n = F.size(values)

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        unsettled = acc["lo"] < acc["hi"]
        hit = F.coalesce(above(F.element_at(values, F.least(mid + 1, n))), F.lit(False))
        lo = F.when(unsettled & ~hit, mid + 1).otherwise(acc["lo"])
        hi = F.when(unsettled & hit, mid).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    # As many halvings as the size needs.
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))
    return n - F.aggregate(steps, start, halve, lambda acc: acc["hi"])


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin; the maximum falls in the last bin, a single value in bin 1."""
    return F.when(low == high, F.lit(1).cast("bigint")).otherwise(
        F.least(F.width_bucket(x, low, high, F.lit(bins)), F.lit(bins).cast("bigint"))
    )
