"""Composite indices: normalisation, aggregation, robustness, rank statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators.order import positions, quantiles, settled
from brindle.operators.robust import winsor_bounds

POINTS = 1 << 21  # that a task ranks at a time
GROUPS = 32  # of draws, if there are no more points than that
BINS = 4096  # steps of an index's range that runs are made of
SENT = 1 << 31  # bytes of points dealt out at a time, eight groups of draws at least


@dataclass(frozen=True)
class Indicator:
    """A column of an index: its dimension, direction, and whether it goes in as ln(1 + x)."""

    column: str
    dimension: str
    higher_is_better: bool = True
    log: bool = False

    def value(self) -> Column:
        return F.log1p(F.col(self.column)) if self.log else F.col(self.column).cast("double")


def minmax(df: DataFrame, indicators: Sequence[Indicator], winsor: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Columns of indicators as scores 0 to 100 between winsor bounds, turned if lower is better; 50 without spread; null stays."""
    values = df.select(*(i.value().alias(i.column) for i in indicators))
    bounds = winsor_bounds(values, [i.column for i in indicators], winsor)
    row = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("__b"))  # a row for each indicator
    out = df.crossJoin(F.broadcast(row))
    for i in indicators:
        lo, hi, v = F.col("__b")[i.column]["low"], F.col("__b")[i.column]["high"], i.value()
        score = F.when(hi > lo, 100 * (F.greatest(lo, F.least(hi, v)) - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(50.0)
        out = out.withColumn(i.column, F.when(v.isNotNull(), score if i.higher_is_better else 100 - score))
    return out.drop("__b")


def dimension_mean(columns: Sequence[str]) -> Column:
    """Mean of the non-null columns."""
    present = F.filter(F.array(*map(F.col, columns)), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))


def aggregate_index(df: DataFrame, indicators: Sequence[Indicator], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Adds dim_<dimension> and index, their weighted sum; null if a dimension of positive weight is."""
    dims: dict[str, list[str]] = {}
    for i in indicators:
        dims.setdefault(i.dimension, []).append(i.column)
    weights = weights or {d: 1 / len(dims) for d in dims}
    out = df
    for d, columns in dims.items():
        out = out.withColumn(f"dim_{d}", dimension_mean(columns))
    total = F.lit(0.0)
    for d in dims:
        if weights.get(d, 0) > 0:
            total = total + weights[d] * F.col(f"dim_{d}")
    return out.withColumn("index", total)


def geometric(columns: Sequence[str], weights: Sequence[float] | None = None, floor: float = 1.0) -> Column:
    """Weighted geometric mean of scores, each at least the floor; null if one is null."""
    w = weights or [1 / len(columns)] * len(columns)
    total = F.lit(0.0)
    for c, x in zip(columns, w):
        total = total + x * F.when(F.col(c).isNotNull(), F.ln(F.greatest(F.col(c), F.lit(floor))))
    return F.exp(total)


def leave_one_out(columns: Sequence[str], weights: Sequence[float] | None = None) -> dict[str, Column]:
    """For each column the linear index of the others, with their weights rescaled."""
    w = weights or [1 / len(columns)] * len(columns)
    out = {}
    for k, c in enumerate(columns):
        rest = 1 - w[k]
        total = F.lit(0.0)
        for j, o in enumerate(columns):
            if j != k:
                total = total + w[j] / rest * F.col(o)
        out[c] = total
    return out


def _ranked(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds __rank, the column's rank with ties at their mean, and __n, the number ranked; null for null."""
    at = positions(df, F.col(column), keys=keys).select("__k", "__v", (F.col("__before") + (F.col("__w") + 1) / 2).alias("__rank"), "__n")
    same = F.col(column).cast("double") == F.col("__v")
    if keys:
        same = same & (F.struct(*keys) == F.col("__k"))
    return df.join(at, same, "left").drop("__k", "__v")


def average_rank(df: DataFrame, column: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the rank of the column (as double) with ties at their mean, null for null; a null key is a key."""
    return _ranked(df, column, keys).withColumnRenamed("__rank", out).drop("__n")


def percentile_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds (average rank - 1) / max(n - 1, 1) * 100."""
    return _ranked(df, column).withColumn(out, (F.col("__rank") - 1) / F.greatest(F.col("__n") - 1, F.lit(1)) * 100).drop("__rank", "__n")


def value_score(df: DataFrame, quality: str, price: str, quality_weight: float = 0.5) -> DataFrame:
    """Adds value_score: quality's percentile rank and price's turned round, weighted; rows with both count."""
    rows = df.where(F.col(quality).isNotNull() & F.col(price).isNotNull())
    rows = percentile_rank(percentile_rank(rows, quality, "__q"), price, "__p")
    return rows.withColumn("value_score", quality_weight * F.col("__q") + (1 - quality_weight) * (100 - F.col("__p"))).drop("__q", "__p")


def reference_percentile(df: DataFrame, reference: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the mid-rank percentile of the column in the reference's distribution."""
    weighed = lambda d, w: d.select(F.col(column).cast("double").alias("v"), F.lit(w).cast("long").alias("w"))
    at = positions(weighed(reference, 1).unionByName(weighed(df, 0)), F.col("v"), F.col("w"))
    share = (F.col("__before") + 0.5 * F.col("__w")) / F.nullif(F.col("__n"), F.lit(0)) * 100
    return df.join(at.select("__v", share.alias(out)), F.col(column).cast("double") == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) over rows that have both."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ranked = average_rank(average_rank(rows, "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def convergent_validity(df: DataFrame, a: str, b: str, z: float = 1.959963984540054) -> DataFrame:
    """(n, rho, low, high): Spearman's rho with a Fisher interval, variance (1 + rho^2 / 2) / (n - 3); null under 4 rows."""
    s = spearman(df, a, b)
    rho, n = F.col("rho"), F.col("n")
    half = z * F.sqrt((1 + rho * rho / 2) / F.nullif(n - 3, F.lit(0)))
    ok = (n >= 4) & rho.isNotNull() & (F.abs(rho) < 1)
    return s.select("n", F.when(n >= 4, rho).alias("rho"), F.when(ok, F.tanh(F.atanh(rho) - half)).alias("low"), F.when(ok, F.tanh(F.atanh(rho) + half)).alias("high"))


def rank_comparison(df: DataFrame, base: str, other: str, id_col: str) -> DataFrame:
    """(n, spearman, mean_shift, p90_shift, top_decile): rank shifts in percentile points, share of the top tenth that stays."""
    rows = df.where(F.col(base).isNotNull() & F.col(other).isNotNull()).select(id_col, F.col(base).alias("a"), F.col(other).alias("b"))
    ranked = _ranked(average_rank(rows, "a", "ra"), "b").withColumnsRenamed({"__rank": "rb", "__n": "n"})
    shift = F.abs(F.col("ra") - F.col("rb")) / F.greatest(F.col("n") - 1, F.lit(1)) * 100
    sums = ranked.agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), F.corr("ra", "rb").alias("spearman"), F.avg(shift).alias("mean_shift"))
    p90 = quantiles(ranked.select(shift.alias("s")), F.col("s"), [0.9]).select(F.col("q")[0].alias("p90_shift"))
    k = F.greatest(F.lit(1), F.ceil(0.1 * F.col("__n")))
    above = F.col("__n") - F.col("__before") - F.col("__w")

    def top(c: str) -> DataFrame:
        at = positions(rows, F.col(c)).where(above < k).select("__v", k.alias("k"), (k - above).alias("room"), "__w")
        near = rows.join(at, F.col(c).cast("double") == F.col("__v"))
        # of the value that the cut splits, the first ids
        cut = near.where("room < __w").withColumn("r", F.row_number().over(Window.orderBy(id_col))).where("r <= room")
        return near.where("room >= __w").select(id_col, "k").unionByName(cut.select(id_col, "k"))

    both = top("a").join(top("b").drop("k"), id_col).agg((F.count("*") / F.first("k")).alias("share"))
    out = sums.crossJoin(F.broadcast(p90)).crossJoin(F.broadcast(both))  # one row each
    return out.select("n", "spearman", "mean_shift", "p90_shift", F.when(F.col("n") > 0, F.coalesce("share", F.lit(0.0))).alias("top_decile"))


def weight_sensitivity(df: DataFrame, dims: Sequence[str], id_col: str, draws: int = 500, concentration: float = 10.0, seed: int = 42, base: Sequence[float] | None = None) -> DataFrame:
    """(draw, spearman, mean_shift) of indices with Dirichlet weights against the base weights; spearman is null without spread.

    Rows of equal dimensions are one point. A task sorts all points, up to POINTS, for a group of
    draws; of more points, those of one run of a draw's index.
    """
    w0 = np.array(base or [1 / len(dims)] * len(dims))
    table = np.random.default_rng(seed).dirichlet(concentration * w0 * len(dims), draws)
    names = [f"__d{j}" for j in range(len(dims))]
    rows = df.dropna(subset=list(dims)).select(*(F.col(d).cast("double").alias(c) for d, c in zip(dims, names)))
    # rows of equal dimensions have equal indices in all draws
    points = rows.groupBy(*names).agg(F.count("*").alias("__c")).withColumn("__a", sum((F.col(c) * float(w) for c, w in zip(names, w0)), F.lit(0.0)))
    points = settled(points)
    at = positions(points, F.col("__a"), F.col("__c")).select("__v", (F.col("__before") + (F.col("__w") + 1) / 2).alias("__ra"))
    points = settled(points.join(at, F.col("__a") == F.col("__v")).select(*names, F.col("__c").cast("double").alias("__c"), "__ra"))
    size = points.agg(F.count("*").alias("n"), F.sum("__c").alias("rows")).first()
    if size["n"] <= POINTS:
        per, cuts, before = -(-draws // GROUPS), np.empty((draws, 0)), np.zeros((draws, 1))
    else:
        per = 1
        cuts, before = _cuts(points, names, table, size["n"])
    groups, middle = -(-draws // per), ((size["rows"] or 0) + 1) / 2
    at_once = max(8, SENT // max(1, size["n"] * 8 * (len(dims) + 2)))
    parts = [_rank_sums(points, names, table, cuts, before, middle, per, range(g, min(g + at_once, groups))) for g in range(0, groups, at_once)]
    if len(parts) > 1:
        parts = [settled(x) for x in parts]
    sums = reduce(DataFrame.union, parts).groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb", "shift")))
    rho = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.nullif(F.col("aa") * F.col("bb"), F.lit(0.0))))
    return sums.select("draw", rho.alias("spearman"), (F.col("shift") / F.col("n") / F.greatest(F.col("n") - 1, F.lit(1.0)) * 100).alias("mean_shift"))


def _index(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for row, v in zip(x, w):
        out = out + row * v
    return out


def _columns(batch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _cuts(points: DataFrame, names: Sequence[str], table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By draw: the index values that part runs of about POINTS points, and the rows before each run. Values packed into one of BINS steps stay together."""
    ends = points.agg(*(f(c).alias(f"{k}{c}") for k, f in (("l", F.min), ("h", F.max)) for c in names)).first()
    low, high = (np.array([_index(np.array([[ends[f"{k}{c}"]] for c in names]), w)[0] for w in table]) for k in "lh")
    edges = low[:, None] + (high - low)[:, None] * np.arange(1, BINS) / BINS

    def run(batches):
        counts = np.zeros((2, len(table), BINS))
        for batch in batches:
            x = _columns(batch)
            for d, w in enumerate(table):
                bin_ = np.searchsorted(edges[d], _index(x[: len(names)], w), "right")
                counts[0, d] += np.bincount(bin_, minlength=BINS)
                counts[1, d] += np.bincount(bin_, x[len(names)], BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), pa.array([counts[:, d].tobytes() for d in range(len(table))], pa.binary())], names=["draw", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("counts").to_pylist())
        return pa.table({"draw": rows.column("draw")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    runs = -(-n // POINTS)
    cuts, before = np.zeros((len(table), runs - 1)), np.zeros((len(table), runs))
    for r in points.mapInArrow(run, "draw int, counts binary").groupBy("draw").applyInArrow(added, "draw int, counts binary").toLocalIterator():
        number, weight = np.frombuffer(r["counts"]).reshape(2, BINS).cumsum(1)
        at = np.minimum(np.searchsorted(number, n * np.arange(1, runs) / runs), BINS - 2)
        cuts[r["draw"]], before[r["draw"], 1:] = edges[r["draw"]][at], weight[at]
    return cuts, before


def _rank_sums(points: DataFrame, names: Sequence[str], table: np.ndarray, cuts: np.ndarray, before: np.ndarray, middle: float, per: int, groups: range) -> DataFrame:
    """(draw, n, ab, aa, bb, shift): sums over the rows of each run of a draw, ranks taken from their middle.

    Points go, packed, to each group of `per` draws whole, or if there are cuts to the runs of their one draw.
    """
    k = len(names)

    def send(batches):
        for batch in batches:
            x = _columns(batch)
            keys, packed = [], []
            for g in groups:
                run = np.searchsorted(cuts[g], _index(x[:k], table[g]), "right") if cuts.shape[1] else np.zeros(x.shape[1], np.int64)
                for r in np.unique(run):
                    keys.append((g, int(r)))
                    packed.append(np.ascontiguousarray(x[:, run == r] if cuts.shape[1] else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), pa.array(packed, pa.binary())], names=["g", "r", "packed"])

    def sums(part: pa.Table) -> pa.Table:
        g, r = part.column("g")[0].as_py(), part.column("r")[0].as_py()
        x = np.concatenate([np.frombuffer(b).reshape(k + 2, -1) for b in part.column("packed").to_pylist()], axis=1)
        out = []
        for d in range(g * per, min((g + 1) * per, len(table))):
            b = _index(x[:k], table[d])
            order = np.argsort(b)
            b, c, ra = b[order], x[k][order], x[k + 1][order] - middle
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            same = np.add.reduceat(c, first)
            rb = np.repeat(before[d, r] + np.cumsum(same) - same + (same + 1) / 2 - middle, np.diff(np.append(first, len(b))))
            out.append((d, c.sum(), (c * ra * rb).sum(), (c * ra * ra).sum(), (c * rb * rb).sum(), (c * np.abs(ra - rb)).sum()))
        return pa.table([pa.array(v) for v in zip(*out)], names=["draw", "n", "ab", "aa", "bb", "shift"]).cast(pa.schema([("draw", pa.int32()), *((c, pa.float64()) for c in ("n", "ab", "aa", "bb", "shift"))]))

    return points.mapInArrow(send, "g int, r int, packed binary").groupBy("g", "r").applyInArrow(sums, "draw int, n double, ab double, aa double, bb double, shift double")


def cronbach(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(n, alpha): k / (k - 1) * (1 - sum of variances / variance of the sum) over complete rows; null under 3 rows."""
    k = len(columns)
    rows = df.dropna(subset=list(columns))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    parts = sum((F.var_samp(c) for c in columns[1:]), F.var_samp(columns[0]))
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, k / (k - 1) * (1 - F.try_divide(parts, F.var_samp(total)))).alias("alpha"))


def dimension_consistency(df: DataFrame, indicators: Sequence[Indicator]) -> DataFrame:
    """(dimension, n_indicators, cronbach_alpha, mean_spearman) of scored indicators.

    The mean is over the dimension's pairs, each over rows that have both; null for a single indicator
    or if a pair has no correlation. A dimension is a row of a few plans, their number fixed by the indicators.
    """
    dims: dict[str, list[str]] = {}
    for i in indicators:
        dims.setdefault(i.dimension, []).append(i.column)
    parts = []
    for d, columns in dims.items():
        if len(columns) < 2:
            none = F.lit(None).cast("double")
            parts.append(df.sparkSession.range(1).select(F.lit(d).alias("dimension"), F.lit(len(columns)).cast("long").alias("n_indicators"), none.alias("cronbach_alpha"), none.alias("mean_spearman")))
            continue
        pairs = [spearman(df, a, b).select("rho") for n, a in enumerate(columns) for b in columns[n + 1 :]]
        whole = F.count("rho") == F.count("*")
        mean = reduce(DataFrame.union, pairs).agg(F.when(whole, F.avg("rho")).alias("mean_spearman"))
        out = cronbach(df, columns).crossJoin(F.broadcast(mean))  # one row each
        parts.append(out.select(F.lit(d).alias("dimension"), F.lit(len(columns)).cast("long").alias("n_indicators"), F.col("alpha").alias("cronbach_alpha"), "mean_spearman"))
    return reduce(DataFrame.union, parts)


def quiet_noise(df: DataFrame, periods: Sequence[str] = ("day", "night")) -> DataFrame:
    """noise_<period>_db is 100 where noise_quiet_<period> holds; periods without both columns and null flags change nothing."""
    for p in periods:
        score, flag = f"noise_{p}_db", f"noise_quiet_{p}"
        if score in df.columns and flag in df.columns:
            df = df.withColumn(score, F.when(F.col(flag), 100.0).otherwise(F.col(score)))
    return df


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q): linear interpolation of the value at (cumulative weight - weight / 2) / total, ends held."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    at = positions(rows, F.col(value), F.col(weight), keys).select("__k", F.col("__v").alias("v"), ((F.col("__before") + F.col("__w") / 2) / F.col("__n")).alias("cdf"))
    low, high = F.when(F.col("cdf") < q, F.struct("v", "cdf")), F.when(F.col("cdf") >= q, F.struct("v", "cdf"))
    ends = (at.groupBy("__k") if keys else at).agg(F.max(low).alias("a"), F.min(high).alias("b"))
    a, b = F.col("a"), F.col("b")
    inside = a["v"] + (b["v"] - a["v"]) * (q - a["cdf"]) / F.nullif(b["cdf"] - a["cdf"], F.lit(0.0))
    return ends.select(*(["__k.*"] if keys else []), F.coalesce(inside, b["v"], a["v"]).alias("q"))
