"""Conformal calibration of intervals: symmetric, asymmetric, normalised, and by cells of a hierarchy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.metrics import order_statistic
from brindle.operators.order import quantiles


def rank(alpha: float) -> Callable[[Column], Column]:
    """ceil((n + 1) (1 - alpha) - 1e-9) by the number of scores."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return lambda n: F.ceil((n + 1) * (1 - alpha) - 1e-9)


def quantile(df: DataFrame, score: Column, alpha: float, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, q): the conformal quantile of the scores; infinite if there are too few."""
    return order_statistic(df, score, rank(alpha), groups)


def cqr_score(low: str, high: str, y: str) -> Column:
    return F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))


def widened(low: Column, high: Column, q_low: Column, q_high: Column) -> tuple[Column, Column]:
    """The interval moved out by q_low and q_high; if that turns it over, both ends are the middle."""
    lo, hi = low - q_low, high + q_high
    middle = (lo + hi) / 2
    return F.when(lo > hi, middle).otherwise(lo), F.when(lo > hi, middle).otherwise(hi)


def calibrated(calibration: DataFrame, apply_to: DataFrame, low: str, high: str, y: str, alpha: float = 0.2, symmetric: bool = True) -> DataFrame:
    """Adds lo_cal and hi_cal by the scores of the calibration rows."""
    if symmetric:
        q = quantile(calibration, cqr_score(low, high, y), alpha).select(F.col("q").alias("__ql"), F.col("q").alias("__qh"))
    else:
        ql = quantile(calibration, F.col(low) - F.col(y), alpha / 2).withColumnRenamed("q", "__ql")
        q = ql.crossJoin(quantile(calibration, F.col(y) - F.col(high), alpha / 2).withColumnRenamed("q", "__qh"))
    lo, hi = widened(F.col(low), F.col(high), F.col("__ql"), F.col("__qh"))
    return apply_to.crossJoin(F.broadcast(q)).withColumn("lo_cal", lo).withColumn("hi_cal", hi).drop("__ql", "__qh")  # one row


def normalized(calibration: DataFrame, apply_to: DataFrame, mu: str, sigma: str, y: str, alpha: float = 0.2) -> DataFrame:
    """Adds lo_cal and hi_cal = mu -/+ q * sigma, q by |y - mu| / sigma; a sigma that isn't positive is an error."""
    s = F.when(F.col(sigma) > 0, F.col(sigma)).otherwise(F.raise_error(F.lit("sigma must be positive")).cast("double"))
    q = quantile(calibration, F.abs(F.col(y) - F.col(mu)) / s, alpha).withColumnRenamed("q", "__q")
    return apply_to.crossJoin(F.broadcast(q)).withColumn("lo_cal", F.col(mu) - F.col("__q") * s).withColumn("hi_cal", F.col(mu) + F.col("__q") * s).drop("__q")


def band_cutpoints(df: DataFrame, value: str, bands: int = 4) -> DataFrame:
    """One row: cuts, the quantiles between bands."""
    return quantiles(df, F.col(value), [k / bands for k in range(1, bands)]).select(F.col("q").alias("cuts"))


def band(value: str | Column, cuts: str | Column = "cuts") -> Column:
    """B1, B2, ...: one more than the cuts at or under the value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("B"), (F.size(F.filter(cuts, lambda c: c <= v)) + 1).cast("string"))


def mondrian_cells(calibration: DataFrame, low: str, high: str, y: str, keys: Sequence[str], alpha: float = 0.2, least: int = 100) -> DataFrame:
    """(depth, keys, n, q) of the calibrated cells: by all keys, by all but the last, ..., by none.

    A cell needs `least` rows, that of all rows none. One pass makes each row's keys of all depths.
    """
    levels = [F.struct(F.lit(d).alias("depth"), *((F.col(k).cast("string") if i < d else F.lit(None).cast("string")).alias(k) for i, k in enumerate(keys))) for d in range(len(keys), -1, -1)]
    rows = calibration.select(cqr_score(low, high, y).alias("__score"), F.explode(F.array(*levels)).alias("c")).select("__score", "c.*")
    cell = F.concat_ws("\u0001", F.col("depth").cast("string"), *(F.coalesce(F.col(k), F.lit("\u0002")) for k in keys))
    rows = rows.withColumn("cell", cell)
    q = quantile(rows, F.col("__score"), alpha, ["cell"])
    sizes = rows.groupBy("cell", "depth", *keys).agg(F.count("__score").alias("n"))
    return sizes.join(q, "cell").where((F.col("n") >= least) | (F.col("depth") == 0)).select("depth", *keys, "n", "q")


def mondrian(calibration: DataFrame, apply_to: DataFrame, low: str, high: str, y: str, keys: Sequence[str], alpha: float = 0.2, least: int = 100) -> DataFrame:
    """Adds lo_cal, hi_cal and cell (`key=value|...` or `all`) by the finest calibrated cell of each row."""
    cells = mondrian_cells(calibration, low, high, y, keys, alpha, least)
    out, q, name = apply_to, [], []
    for d in range(len(keys), -1, -1):
        own = cells.where(F.col("depth") == d).select(*(F.col(k).alias(f"__{d}{k}") for k in keys[:d]), F.col("q").alias(f"__q{d}"))
        if d:
            on = [F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) == F.coalesce(F.col(f"__{d}{k}"), F.lit("\u0002")) for k in keys[:d]]
            out = out.join(own, on, "left")
        else:
            out = out.crossJoin(F.broadcast(own))
        label = F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys[:d])) if d else F.lit("all")
        q.append(F.col(f"__q{d}"))
        name.append(F.when(F.col(f"__q{d}").isNotNull(), label))
    best = F.coalesce(*q)
    lo, hi = widened(F.col(low), F.col(high), best, best)
    return out.select(*apply_to.columns, lo.alias("lo_cal"), hi.alias("hi_cal"), F.coalesce(*name).alias("cell"))
