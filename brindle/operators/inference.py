"""Resampling and tests. Draws come from numpy generators on replicates, so seeds fix results; they are not those of other libraries."""

from __future__ import annotations

from collections.abc import Sequence
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.order import even_quantiles, positions
from brindle.operators.spatial import knn_join


def _replicates(clusters: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, s, n): sums over clusters with Poisson(1) multiplicities; each task sums its clusters for all draws.

    clusters: (s, n). Poisson counts stand in for multinomial ones, so clusters need not be gathered.
    """

    def run(batches):
        for pdf in batches:
            # a cluster's counts depend on its hash alone, not on where it is
            total = np.zeros((draws, 2))
            for h, s, n in zip(pdf["h"], pdf["s"], pdf["n"]):
                k = np.random.default_rng([seed, h & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, draws)
                total[:, 0] += k * s
                total[:, 1] += k * n
            yield pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), "s": total[:, 0], "n": total[:, 1]})

    parts = clusters.select(F.xxhash64("g").alias("h"), "s", F.col("n").cast("double").alias("n")).mapInPandas(run, "draw int, s double, n double")
    return parts.groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _clusters(df: DataFrame, value, group: str) -> DataFrame:
    return df.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def bootstrap_ci(df: DataFrame, value, group: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(estimate, low, high) of the mean of an expression, whole clusters resampled."""
    clusters = _clusters(df, value, group)
    reps = _replicates(clusters, draws, seed).select(F.try_divide("s", "n").alias("m"))
    ends = reps.agg(F.percentile("m", [(1 - level) / 2, (1 + level) / 2]).alias("q"))
    est = clusters.agg((F.sum("s") / F.sum("n")).alias("estimate"))
    return est.crossJoin(F.broadcast(ends)).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap(df: DataFrame, y: str, a: str, b: str, group: str, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(diff, low, high, p): mean absolute error of a less that of b; p by centred replicates, (1 + hits) / (draws + 1)."""
    d = F.abs(F.col(a) - F.col(y)) - F.abs(F.col(b) - F.col(y))
    clusters = _clusters(df, d, group)
    est = clusters.agg((F.sum("s") / F.sum("n")).alias("diff"))
    reps = _replicates(clusters, draws, seed).select(F.try_divide("s", "n").alias("m")).crossJoin(F.broadcast(est))
    out = reps.agg(F.first("diff").alias("diff"), F.percentile("m", [(1 - level) / 2, (1 + level) / 2]).alias("q"), F.count_if(F.abs(F.col("m") - F.col("diff")) >= F.abs("diff") - 1e-12).alias("hits"))
    return out.select("diff", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((1 + F.col("hits")) / (draws + 1)).alias("p"))


def wilcoxon(df: DataFrame, y: str, a: str, b: str, group: str, digits: int | None = None) -> DataFrame:
    """(n, w_plus, w_minus, z, p) of the signed ranks of clusters' mean differences of absolute errors, a's less b's.

    Zeros are left out and ties share their mean rank. p is two-sided: exact up to 50 differences
    without ties, else by the normal with the ties' correction; 1 if all differences are zero.
    `digits` rounds the differences first, so that equal ones tie whatever the order of summing.
    """
    d = F.avg(F.abs(F.col(a) - F.col(y)) - F.abs(F.col(b) - F.col(y)))
    each = df.groupBy(F.col(group).cast("string").alias("g")).agg((F.round(d, digits) if digits is not None else d).alias("d")).where("d <> 0")
    at = positions(each, F.abs("d"))
    ups = each.groupBy(F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("up"))
    rank, t = F.col("__before") + (F.col("__w") + 1) / 2, F.col("__w").cast("double")
    sums = at.join(ups, F.col("__v") == F.col("m")).agg(
        F.coalesce(F.sum("__w"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(rank * (t - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(t**3 - t), F.lit(0.0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24))

    def run(batches):  # one row
        for pdf in batches:
            pdf["p"] = [_signed_rank_p(int(r.n), min(r.w_plus, r.w_minus), r.ties > 0, r.z) for r in pdf.itertuples()]
            yield pdf.drop(columns="ties")

    return sums.withColumn("z", z).mapInPandas(run, "n long, w_plus double, w_minus double, z double, p double")


def _signed_rank_p(n: int, w: float, ties: bool, z: float) -> float:
    if not n:
        return 1.0
    if n > 50 or ties:
        return min(1.0, 1 + erf(-abs(z) / sqrt(2)))
    ways = np.zeros(n * (n + 1) // 2 + 1)  # of the signs, by the sum of positive ranks
    ways[0] = 1.0
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k]
    return min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)


def power_grid(errors: DataFrame, column: str, sizes: Sequence[int], effects: Sequence[float], sims: int = 500, alpha: float = 0.05, correlation: float = 0.87, seed: int = 42) -> DataFrame:
    """(n, effect, power): share of simulated paired comparisons that detect a relative effect; a cell of the grid a row of work.

    The error distribution goes in as its 1001 quantiles, of fixed size whatever the table; power is null without errors.
    """
    q = even_quantiles(errors, F.abs(column), 1000).select("q")
    grid = errors.sparkSession.createDataFrame([(int(n), float(e)) for n in sizes for e in effects], "n int, effect double")
    z_crit = _normal_quantile(1 - alpha / 2)

    def run(batches):
        for pdf in batches:
            power = []
            for n, effect, levels in zip(pdf["n"], pdf["effect"], pdf["q"]):
                if levels is None:
                    power.append(None)
                    continue
                rng = np.random.default_rng([seed, int(n), int(effect * 1e6)])
                hits = 0
                for _ in range(sims):
                    own, other = (np.interp(rng.random(n), np.linspace(0, 1, 1001), levels) for _ in range(2))
                    diff = own - (1 - effect) * (correlation * own + (1 - correlation) * other)
                    hits += diff.mean() > 0 and diff.mean() / (diff.std(ddof=1) / np.sqrt(n) + 1e-300) > z_crit
                power.append(hits / sims)
            yield pd.DataFrame({"n": pdf["n"], "effect": pdf["effect"], "power": power})

    return grid.crossJoin(F.broadcast(q)).repartition("n", "effect").mapInPandas(run, "n int, effect double, power double")


def detectable(power: DataFrame, target: float = 0.8) -> DataFrame:
    """(n, effect): the smallest effect whose power reaches the target."""
    return power.groupBy("n").agg(F.min(F.when(F.col("power") >= target, F.col("effect"))).alias("effect"))


def _normal_quantile(p: float) -> float:
    lo, hi = -10.0, 10.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + erf(mid / sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def knn_weights(points: DataFrame, id_col: str, k: int = 8, cell: float = 1000.0) -> DataFrame:
    """(i, j, w): each point's k nearest others with weight 1 / k."""
    near = knn_join(points.select(id_col, "east", "north"), points.select(id_col, "east", "north"), k, id_col, id_col, cell, exclude_self=True)
    return near.select(F.col(id_col).alias("i"), F.col(f"r_{id_col}").alias("j"), F.lit(1.0 / k).alias("w"))


def morans_i(points: DataFrame, id_col: str, value: str, k: int = 8, cell: float = 1000.0, permutations: int = 0, seed: int = 42) -> DataFrame:
    """(n, moran_i, expected) and, with permutations, p: two-sided, (1 + more extreme) / (1 + permutations)."""
    rows = points.where(F.col(value).isNotNull() & F.col("east").isNotNull() & F.col("north").isNotNull()).select(F.col(id_col).alias("id"), "east", "north", F.col(value).alias("v"))
    mean = rows.agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("var"))
    edges = knn_weights(rows, "id", k, cell)
    z = rows.crossJoin(F.broadcast(mean)).select("id", (F.col("v") - F.col("m")).alias("z"))

    def cross(zs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        left, right = zs.withColumnRenamed("id", "i").withColumnRenamed("z", "zi"), zs.withColumnRenamed("id", "j").withColumnRenamed("z", "zj")
        return edges.join(left, "i").join(right, ["j", *keys]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("c"), F.sum("w").alias("s0"))

    scale = lambda d: d.crossJoin(F.broadcast(mean)).withColumn("i_value", F.try_divide(F.col("c") * F.col("n"), F.col("s0") * F.col("var") * F.col("n")))
    own = scale(cross(z)).select("n", F.col("i_value").alias("moran_i"), (-1 / (F.col("n") - 1)).alias("expected"))
    if not permutations:
        return own
    # a permutation pairs the ids' random order with the values' own: replicates are rows, none is gathered
    from pyspark.sql.window import Window

    reps = z.crossJoin(F.broadcast(z.sparkSession.range(permutations).toDF("rep")))
    ids = reps.select("rep", "id", F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", "id"), "id")).alias("k"))
    values = reps.select("rep", "z", F.row_number().over(Window.partitionBy("rep").orderBy("id")).alias("k"))
    shuffled = ids.join(values, ["rep", "k"]).select("rep", "id", "z")
    each = scale(cross(shuffled, ["rep"])).select(F.col("i_value").alias("r")).crossJoin(F.broadcast(own))
    extreme = F.count_if(F.abs(F.col("r") - F.col("expected")) >= F.abs(F.col("moran_i") - F.col("expected")) - 1e-12)
    return each.groupBy("n", "moran_i", "expected").agg(((1 + extreme) / (1 + permutations)).alias("p"))


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval, by bisection on the binomial tail."""
    from math import exp, lgamma, log

    def tail(p: float, least: int) -> float:  # P(X >= least)
        if p <= 0 or p >= 1:
            return float(p >= 1 or least <= 0)
        return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(least, n + 1))

    def solve(f, goal: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < goal else (lo, mid)
        return (lo + hi) / 2

    a = (1 - level) / 2
    return (0.0 if hits == 0 else solve(lambda p: tail(p, hits), a)), (1.0 if hits == n else solve(lambda p: tail(p, hits + 1), 1 - a))
