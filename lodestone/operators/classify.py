"""Breaks of a column's values, and classes by breaks. Breaks are few and plain numbers; only aggregates reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Distinct values that natural breaks are searched over exactly; beyond, values are first counted in so many equal bins.
JENKS_VALUES = 2048


def _one(df: DataFrame, *aggs: Column):
    return df.agg(*aggs).head()


def class_of(value: Column, breaks: Sequence[float]) -> Column:
    """How many breaks lie under the value (classify_values, classify_manual_breaks)."""
    out = F.lit(0).cast("long")
    for b in breaks:
        out = out + (value > F.lit(float(b))).cast("long")
    return out


def equal_interval(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    lo, hi = _one(df, F.min(column).cast("double"), F.max(column).cast("double"))
    return [lo + (hi - lo) / classes * i for i in range(1, classes)]


def defined_interval(df: DataFrame, column: str, interval: float) -> list[float]:
    lo, hi = _one(df, F.min(column).cast("double"), F.max(column).cast("double"))
    out, at = [], lo + interval
    while at < hi:
        out.append(at)
        at += interval
    return out


def standard_deviation(df: DataFrame, column: str, interval: float = 1.0) -> list[float]:
    mean, sd = _one(df, F.avg(column), F.stddev_pop(column))
    return [mean + k * interval * sd for k in (-2, -1, 0, 1, 2)]


def geometric_interval(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    c = F.col(column).cast("double")
    lo, hi = _one(df, F.coalesce(F.min(F.when(c > 0, c)), F.lit(1.0)), F.max(c))
    return [lo] * (classes - 1) if lo >= hi else [lo * (hi / lo) ** (i / classes) for i in range(1, classes)]


def at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at places from 0 of the sorted column, by counting distinct values and numbering those."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    upto = ordered.running(counts, "n", [F.col("v")], "sum", "upto")
    wanted = F.explode(F.filter(F.array(*[F.lit(r) for r in sorted(set(ranks))]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))
    found = {r["r"]: r["v"] for r in upto.select("v", wanted.alias("r")).collect()}
    return [found[r] for r in ranks]


def quantile(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    n = df.filter(F.col(column).isNotNull()).count()
    return at_ranks(df, column, [min(i * n // classes, n - 1) for i in range(1, classes)])


def percentile(df: DataFrame, column: str, shares: Sequence[float] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> list[float]:
    """Exact percentiles with linear interpolation."""
    return list(_one(df, F.percentile(F.col(column).cast("double"), F.array(*[F.lit(float(s)) for s in shares])))[0])


def box_plot(df: DataFrame, column: str) -> list[float]:
    """Lower fence, quartiles, upper fence."""
    q1, q2, q3 = percentile(df, column, (0.25, 0.5, 0.75))
    return [q1 - 1.5 * (q3 - q1), q1, q2, q3, q3 + 1.5 * (q3 - q1)]


def head_tail(df: DataFrame, column: str, most: int = 40) -> list[float]:
    """Means of the values above the mean before, while those are the smaller part."""
    rows, out = df.select(F.col(column).cast("double").alias("v")).filter("v is not null"), []
    while len(out) < most:
        n, mean = _one(rows, F.count("*"), F.avg("v"))
        if not n:
            break
        head = rows.filter(F.col("v") > mean)
        m = head.count()
        if not m or m == n:
            break
        out.append(mean)
        if m <= 1 or m / n > 0.4:
            break
        rows = head
    return out


def maximum_breaks(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    """The middles of the widest gaps between neighbouring values."""
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null").distinct()
    gaps = ordered.difference(rows, "v", [F.col("v")], 1, name="gap").filter("gap is not null").orderBy(F.desc("gap"), "v").limit(classes - 1)
    return sorted(r["v"] - r["gap"] / 2 for r in gaps.collect())


def pretty(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    """Multiples of 1, 2 or 5 times a power of ten."""
    lo, hi = _one(df, F.min(column).cast("double"), F.max(column).cast("double"))
    if lo == hi:
        return [lo]
    raw = (hi - lo) / classes
    size = 10 ** math.floor(math.log10(raw))
    step = next(m * size for m in (1, 2, 5, 10) if m * size >= raw)
    first = math.floor(lo / step) * step
    return [x for i in range(classes * 3) if lo < (x := round(first + step * i, 12)) < hi]


def natural_breaks(df: DataFrame, column: str, classes: int = 5) -> list[float]:
    """Jenks: the first values of the classes that have the least squared deviations in sum, by dynamic programming over distinct values.

    Up to JENKS_VALUES distinct values are exact; more are counted in that many equal bins, whose means stand for them.
    """
    import numpy as np

    rows = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    lo, hi, many = _one(rows, F.min("v"), F.max("v"), F.approx_count_distinct("v"))
    if lo is None or classes < 2:
        return []
    key = F.col("v") if many <= JENKS_VALUES * 0.9 else F.floor((F.col("v") - lo) / ((hi - lo) or 1.0) * (JENKS_VALUES - 1))
    got = rows.groupBy(key.alias("k")).agg(F.min("v").alias("first"), F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).orderBy("k").collect()
    m = len(got)
    if m < classes:
        return [r["first"] for r in got[1:]]
    n, s, q = (np.concatenate([[0.0], np.cumsum([float(r[c]) for r in got])]) for c in ("n", "s", "q"))
    cost = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / np.maximum(n[j] - n[i], 1e-300)
    best, back = np.array([cost(0, j) if j else 0.0 for j in range(m + 1)]), []
    for c in range(2, classes + 1):
        new, arg = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(c, m + 1):
            i = np.arange(c - 1, j)
            total = best[i] + cost(i, j)
            k = int(total.argmin())
            new[j], arg[j] = total[k], i[k]
        best = new
        back.append(arg)
    out, j = [], m
    for arg in reversed(back):
        j = int(arg[j])
        out.append(got[j]["first"])
    return sorted(out)


SCHEMES = {
    "natural_breaks": natural_breaks, "equal_interval": equal_interval, "quantile": quantile, "standard_deviation": standard_deviation, "geometric_interval": geometric_interval,
    "defined_interval": defined_interval, "head_tail": head_tail, "maximum_breaks": maximum_breaks, "pretty": pretty, "box_plot": box_plot, "percentile": percentile,
}


def classified(df: DataFrame, column: str, scheme: str, name: str = "class", **options) -> DataFrame:
    return df.withColumn(name, class_of(F.col(column).cast("double"), SCHEMES[scheme](df, column, **options)))
