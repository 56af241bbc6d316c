"""Regression, interval and quantile metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.order import order_statistics


def _errors(y: str, p: str) -> dict[str, Column]:
    e = F.col(p) - F.col(y)
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "medae": F.median(F.abs(e)),
        "mape": 100 * F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))),
    }


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, RMSE, median absolute error, MAPE (zeros left out) and R2 (null for a constant target), in one pass."""
    t, e = F.col(y), F.col(p) - F.col(y)
    r2 = F.when(F.max(t) > F.min(t), 1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t)))
    return df.agg(*(c.alias(n) for n, c in _errors(y, p).items()), r2.alias("r2"))


def segment_metrics(df: DataFrame, y: str, p: str, segment: str) -> DataFrame:
    """n, MAE, RMSE, MAPE and bias (prediction - target) by segment; null is a segment."""
    e = _errors(y, p)
    return df.groupBy(segment).agg(F.count("*").alias("n"), e["mae"].alias("mae"), e["rmse"].alias("rmse"), e["mape"].alias("mape"), F.avg(F.col(p) - F.col(y)).alias("bias"))


def coverage_report(df: DataFrame, y: str, low: str, high: str, group: str | None = None, overall: bool = True) -> DataFrame:
    """n, coverage (ends included), below, above, mean and median width by group, and for all as `all`; a group named so is an error."""
    label = F.col(group).cast("string") if group else F.lit(None).cast("string")
    checked = F.when(label == "all", F.raise_error(F.lit("a group is named all")).cast("string")).otherwise(label)
    keys = F.array(*([F.struct(checked.alias("g"))] if group else []), *([F.struct(F.lit("all").alias("g"))] if overall or not group else []))
    rows = df.select(F.col(y).alias("y"), F.col(low).alias("lo"), F.col(high).alias("hi"), F.explode(keys).alias("k"))
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(F.col("k.g").alias("segment")).agg(
        F.count("*").alias("n"), share((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).alias("coverage"), share(F.col("y") < F.col("lo")).alias("below"),
        share(F.col("y") > F.col("hi")).alias("above"), F.avg(F.col("hi") - F.col("lo")).alias("mean_width"), F.median(F.col("hi") - F.col("lo")).alias("median_width"),
    )


def interval_score(y: str, low: str, high: str, alpha: float) -> Column:
    """Mean Winkler score of 1 - alpha intervals (an aggregate)."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    t, lo, hi = F.col(y), F.col(low), F.col(high)
    return F.avg((hi - lo) + 2 / alpha * F.greatest(lo - t, F.lit(0.0)) + 2 / alpha * F.greatest(t - hi, F.lit(0.0)))


def order_statistic(df: DataFrame, value: Column, k: Callable[[Column], Column], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, q): the k-th smallest value of each group, k by the number of its values; +infinity beyond the last."""
    found = order_statistics(df, value, lambda n: [k(n) - 1], groups)
    return found.select(*groups, F.coalesce(F.col("at")[0], F.lit(float("inf"))).alias("q"))


def constant_band(df: DataFrame, y: str, p: str, coverage: float) -> DataFrame:
    """(q): the half width that covers the share: the k-th smallest error, k = max(ceil(n * coverage - 1e-9), 1)."""
    k = lambda n: F.greatest(F.ceil(n * coverage - 1e-9), F.lit(1))
    return order_statistic(df, F.abs(F.col(y) - F.col(p)), k)


def pinball(y: str | Column, q: str | Column, alpha: Column | float) -> Column:
    """Mean pinball loss (an aggregate)."""
    r = (F.col(y) if isinstance(y, str) else y) - (F.col(q) if isinstance(q, str) else q)
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.avg(F.greatest(a * r, (a - 1) * r))


def quantile_calibration(df: DataFrame, y: str, quantiles: str, levels: Sequence[float]) -> DataFrame:
    """(level, share, deviation, pinball, n) for an array of predicted quantiles."""
    at = F.posexplode(F.arrays_zip(F.col(quantiles).alias("q"), F.array(*map(F.lit, map(float, levels))).alias("level")))
    rows = df.select(F.col(y).alias("y"), at.alias("pos", "x")).select("y", F.col("x").getField("q").alias("q"), F.col("x").getField("level").alias("level"))
    share = F.avg((F.col("y") <= F.col("q")).cast("double"))
    return rows.groupBy("level").agg(share.alias("share"), (share - F.first("level")).alias("deviation"), pinball("y", "q", F.col("level")).alias("pinball"), F.count("*").alias("n"))


def crossing_rate(quantiles: str) -> Column:
    """Share of rows whose quantiles fall somewhere (an aggregate)."""
    q = F.col(quantiles)
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(q) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(q, i + 1) < F.element_at(q, i), F.lit(False)))
    return F.avg(falls.cast("double"))


def rearranged(quantiles: str | Column) -> Column:
    return F.array_sort(quantiles)


def market_percentile(quantiles: str | Column, levels: Sequence[float], value: str | Column, clamp: tuple[float, float] = (0.01, 0.99)) -> Column:
    """Where a value lies on the piecewise-linear distribution through sorted quantiles, extended at both ends, clamped.

    On a flat piece: 0 below all, 1 above all, else the piece's level. Null if anything is null.
    """
    q = F.array_sort(F.col(quantiles) if isinstance(quantiles, str) else quantiles)
    v = F.col(value) if isinstance(value, str) else value
    a = F.array(*map(F.lit, map(float, levels)))
    n = len(levels)
    below = F.size(F.filter(q, lambda x: x <= v))
    seg = F.least(F.greatest(below - 1, F.lit(0)), F.lit(n - 2)) + 1
    q0, q1, a0, a1 = F.element_at(q, seg), F.element_at(q, seg + 1), F.element_at(a, seg), F.element_at(a, seg + 1)
    flat = F.when(below == 0, 0.0).when(below == n, F.when(v > F.element_at(q, n), 1.0).otherwise(F.lit(float(levels[-1])))).otherwise(F.element_at(a, F.greatest(below, F.lit(1))))
    p = F.when(q1 > q0, a0 + (a1 - a0) * (v - q0) / F.nullif(q1 - q0, F.lit(0.0))).otherwise(flat)
    ok = v.isNotNull() & (F.size(F.filter(q, lambda x: x.isNotNull())) == n)
    return F.when(ok, F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), p)))


def holm(df: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds p_holm: step-down adjusted p-values, at most 1; null p-values don't count.

    Equal values have one result, so values are counted first. Runs of the order are cut by the
    values' size, so a window holds one run, and only a count and a maximum a run are brought together.
    """
    v, inf = F.col("__v"), F.lit(2.0**40)
    rows = df.withColumns({"__k": F.struct(*keys) if keys else F.lit(0), "__v": F.col(p).cast("double")})
    cut = lambda x: F.when(F.isnan(v), inf).otherwise(F.coalesce(F.floor(F.least(F.greatest(x, -inf), inf)).cast("double"), -inf))
    counts = rows.where(v.isNotNull()).groupBy("__k", "__v").agg(F.count("*").alias("__c")).withColumns({"__a": cut(16 * F.log2(v)), "__b": cut(1024 * v)})
    run = ["__k", "__a", "__b"]
    before = Window.partitionBy("__k").orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*run).orderBy("__v")
    left = counts.groupBy(*run).agg(F.sum("__c").alias("__n"))
    left = left.select(*run, (F.sum("__n").over(Window.partitionBy("__k")) - F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__left"))
    own = F.coalesce(F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.join(left, run).select(*run, "__v", ((F.col("__left") - own) * v).alias("__s"))
    highest = steps.groupBy(*run).agg(F.max("__s").alias("__top"))
    highest = highest.select(*run, F.max("__top").over(before).alias("__top"))
    raised = F.greatest("__top", F.max("__s").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    adjusted = steps.join(highest, run).select("__k", "__v", F.least(F.lit(1.0), raised).alias("p_holm"))
    return rows.join(adjusted, ["__k", "__v"], "left").drop("__k", "__v")


def ablation_table(runs: DataFrame, stages: Sequence[str], metric: str, pick: str = "last", lower_is_better: bool = True) -> DataFrame:
    """The last or best finished run of each stage, in the order of stages; runs: stage, seq, status and metrics."""
    order = F.desc("seq") if pick == "last" else (F.asc_nulls_last(metric) if lower_is_better else F.desc_nulls_last(metric))
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    rows = runs.where((F.col("status") == "FINISHED") & (place > 0)).withColumn("position", place)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("stage").orderBy(order, F.desc("seq")))).where("__k = 1").drop("__k").orderBy("position")


def extraction_scores(pred: DataFrame, gold: DataFrame, id_col: str, fields: Sequence[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """By field: support, tp, fp, fn, precision, recall, f1, accuracy. A wrong value is both a false positive and a false negative."""
    both = gold.alias("g").join(pred.alias("p"), id_col)
    rows = []
    for f in fields:
        g, p = F.col(f"g.{f}"), F.col(f"p.{f}")
        equal = F.abs(g - p) <= tolerance[f] if tolerance and f in tolerance else g == p
        rows.append(F.struct(F.lit(f).alias("field"), g.isNotNull().alias("gold"), p.isNotNull().alias("pred"), F.coalesce(equal, F.lit(False)).alias("hit")))
    flat = both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tp, fp, fn = F.count_if("hit"), F.count_if(F.col("pred") & ~F.col("hit")), F.count_if(F.col("gold") & ~F.col("hit"))
    none = F.count_if(~F.col("gold") & ~F.col("pred"))
    sums = flat.groupBy("field").agg(F.count_if("gold").alias("support"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), none.alias("__none"), F.count("*").alias("__n"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("field", "support", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(F.col("tp") + F.col("__none"), F.col("__n")).alias("accuracy"))
