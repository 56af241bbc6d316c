"""Joins by distance: bands, radius, nearest neighbours, polygons and raster cells.

All plan as equi-joins on grid cells with the exact distance as a filter; none compares all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import fixed
from brindle.functions import scalars as S


def band_pairs(df: DataFrame, id_col: str, block: str, value: str, tolerance: float) -> DataFrame:
    """(left_id, right_id), left < right: rows of one block whose values differ by the tolerance at most.

    A row goes to its own bucket of the tolerance's width and, as a left partner, to the two beside.
    """
    rows = df.where(F.col(block).isNotNull() & F.col(value).isNotNull()).select(F.col(id_col).alias("id"), F.col(block).alias("b"), F.col(value).alias("v"), F.floor(F.col(value) / tolerance).alias("c"))
    left = rows.select(F.col("id").alias("left_id"), "b", F.col("v").alias("lv"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    right = rows.select(F.col("id").alias("right_id"), "b", F.col("v").alias("rv"), "c")
    return left.join(right, ["b", "c"]).where((F.col("left_id") < F.col("right_id")) & (F.abs(F.col("lv") - F.col("rv")) <= tolerance + 1e-9)).select("left_id", "right_id")


def _cells(x: str, y: str, size: float) -> tuple[Column, Column]:
    return F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")


def radius_join(left: DataFrame, right: DataFrame, radius: float, x: str = "east", y: str = "north") -> DataFrame:
    """left's columns, right's with the prefix r_, and distance <= radius. Null coordinates meet nothing."""
    l = left.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("*", *_cells(x, y, radius))
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    l = l.withColumn("cx", F.explode(F.transform(shift, lambda d: F.col("cx") + d))).withColumn("cy", F.explode(F.transform(shift, lambda d: F.col("cy") + d)))
    r = right.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *_cells(x, y, radius))
    d = F.sqrt((F.col(x) - F.col(f"r_{x}")) ** 2 + (F.col(y) - F.col(f"r_{y}")) ** 2)
    return l.join(r, ["cx", "cy"]).drop("cx", "cy").withColumn("distance", d).where(F.col("distance") <= radius)


def radius_pairs(df: DataFrame, id_col: str, radius: float, x: str = "east", y: str = "north") -> DataFrame:
    """(left_id, right_id), left < right, of rows within the radius."""
    rows = df.select(F.col(id_col).alias("id"), x, y)
    return radius_join(rows, rows, radius, x, y).where("id < r_id").select(F.col("id").alias("left_id"), F.col("r_id").alias("right_id"))


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, cell: float, x: str = "east", y: str = "north", exclude_self: bool = False, condition: Column | None = None, within: float | None = None) -> DataFrame:
    """left_id, right's columns with the prefix r_, distance and rank 1..k; ties by right_id.

    Each round joins the open rows with the right rows within a radius, closes those that found k,
    and triples the radius for the rest, until it spans all rows. A right row within the radius can't
    be missed, so k found are the k nearest. The first radius holds some 2 k rows at the mean density
    of the area, or of the line if the rows lie on one; rows with fewer than k partners in all, or
    in the distance `within`, keep what there is.
    """
    open_, done = left.where(F.col(x).isNotNull() & F.col(y).isNotNull()), []
    total = right.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = (F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))
    r, l = total.agg(*ends).first(), open_.agg(*ends).first()
    if not r["n"] or not l["n"]:
        radius = reach = float(cell)
    else:
        width, height = r["x1"] - r["x0"], r["y1"] - r["y0"]
        area = (2.0 * (k + 1) * width * height / (3.14159 * r["n"])) ** 0.5
        line = (k + 1) * max(width, height) / r["n"]
        radius = max(area, line) or float(cell)
        # no two rows are farther apart
        reach = (max(r["x1"], l["x1"]) - min(r["x0"], l["x0"])) + (max(r["y1"], l["y1"]) - min(r["y0"], l["y0"])) + radius
        if r["n"] <= k + exclude_self:
            radius = reach  # all are needed
    if within is not None:
        radius, reach = min(radius, within), min(reach, within)
    keep = Window.partitionBy(left_id).orderBy("distance", f"r_{right_id}")
    while True:
        found = radius_join(open_, total, radius, x, y)
        if exclude_self:
            found = found.where(F.col(left_id) != F.col(f"r_{right_id}"))
        if condition is not None:
            found = found.where(condition)
        found = found.withColumn("rank", F.row_number().over(keep)).where(F.col("rank") <= k)
        if radius >= reach:
            done.append(found)
            break
        found = found.persist()
        full = found.groupBy(left_id).agg(F.count("*").alias("__n")).where(F.col("__n") >= k).select(left_id)
        done.append(found.join(full, left_id, "left_semi"))
        open_ = open_.join(full, left_id, "left_anti").persist()
        if open_.isEmpty():
            break
        radius = radius * 3 if within is None else min(radius * 3, within)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def knn_features(train: DataFrame, apply_to: DataFrame, k: int, target: str, id_col: str, cell: float, mode: str = "apply", fold: str | None = None, x: str = "east", y: str = "north", prefix: str = "knn") -> DataFrame:
    """Adds <prefix>_mean and <prefix>_median of the k nearest training targets; null without coordinates or neighbours.

    mode 'loo' leaves a row itself out, 'oof' its whole fold. Distances are in standardised
    coordinates of the training rows, which carry a target.
    """
    pool = train.where(F.col(target).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    m = pool.agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy")).first()
    scale = lambda df: df.withColumn("zx", (F.col(x) - F.lit(m["mx"])) / F.lit(m["sx"] or 1.0)).withColumn("zy", (F.col(y) - F.lit(m["my"])) / F.lit(m["sy"] or 1.0))
    right = scale(pool).select(F.col(id_col).alias("id"), "zx", "zy", F.col(target).alias("t"), *([F.col(fold).alias("f")] if fold else []))
    left = scale(apply_to).select(id_col, "zx", "zy", *([fold] if fold else []))
    other = F.col(fold) != F.col("r_f") if mode == "oof" else None
    near = knn_join(left, right, k, id_col, "id", cell, "zx", "zy", exclude_self=mode == "loo", condition=other)
    stats = near.groupBy(id_col).agg(F.avg("r_t").alias(f"{prefix}_mean"), F.median("r_t").alias(f"{prefix}_median"))
    return apply_to.join(stats, id_col, "left")


def _inside(px: np.ndarray, py: np.ndarray, rings) -> np.ndarray:
    """Even-odd rule over all rings, so holes are out."""
    out = np.zeros(len(px), bool)
    for ring in rings:
        xs, ys = np.array([p["x"] for p in ring], float), np.array([p["y"] for p in ring], float)
        for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
            if y1 != y2:
                cross = (y1 > py) != (y2 > py)
                out ^= cross & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return out


def _edge_distance(px: np.ndarray, py: np.ndarray, rings) -> np.ndarray:
    best = np.full(len(px), np.inf)
    for ring in rings:
        pts = np.array([(p["x"], p["y"]) for p in ring], float)
        for a, b in zip(pts, np.roll(pts, -1, 0)):
            d = b - a
            n = float(d @ d)
            t = np.clip(((px - a[0]) * d[0] + (py - a[1]) * d[1]) / n, 0, 1) if n else np.zeros(len(px))
            best = np.minimum(best, np.hypot(px - a[0] - t * d[0], py - a[1] - t * d[1]))
    return best


def locate(points: DataFrame, polygons: DataFrame, point_id: str, unit_id: str, max_snap: float = 2000.0, cell: float = 2000.0, x: str = "east", y: str = "north", exclude: DataFrame | None = None) -> DataFrame:
    """(point_id, unit_id, match, distance): the polygon that holds each point, else the nearest within max_snap, else null.

    polygons: unit_id and rings (array of arrays of struct x, y). match is within, nearest or none.
    Ties go to the smaller distance, then the smaller id. Points inside an `exclude` polygon aren't
    snapped. A polygon is listed in the cells of its bounding box grown by max_snap, and meets the
    points of those; the exact test runs in Arrow batches.
    """
    reach = F.flatten("rings")
    pad = lambda c: F.floor(c / cell).cast("long")

    def spread(polys: DataFrame, grow: float) -> DataFrame:
        box = polys.select(unit_id, "rings", *(f(F.transform(reach, lambda p: p[c])).alias(n) for n, f, c in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))))
        box = box.withColumn("cx", F.explode(F.sequence(pad(F.col("x0") - grow), pad(F.col("x1") + grow))))
        return box.withColumn("cy", F.explode(F.sequence(pad(F.col("y0") - grow), pad(F.col("y1") + grow)))).select(F.col(unit_id).alias("u"), "rings", "cx", "cy")

    where = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(point_id).alias("p"), F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy"))
    kinds = dict(where.dtypes)["p"], dict(polygons.dtypes)[unit_id]

    def test(batches):
        for pdf in batches:
            for _, g in pdf.groupby("u", sort=False):
                rings = g["rings"].iloc[0]
                px, py = g["px"].to_numpy(), g["py"].to_numpy()
                inside = _inside(px, py, rings)
                yield pd.DataFrame({"p": g["p"], "u": g["u"], "inside": inside, "d": np.where(inside, 0.0, _edge_distance(px, py, rings))})

    def tested(polys: DataFrame, grow: float) -> DataFrame:
        return where.join(spread(polys, grow), ["cx", "cy"]).select("p", "px", "py", "u", "rings").mapInPandas(test, f"p {kinds[0]}, u {kinds[1]}, inside boolean, d double")

    hits = tested(polygons, max_snap).where(F.col("inside") | (F.col("d") <= max_snap))
    if exclude is not None:
        masked = tested(exclude, 0.0).where("inside").select("p").distinct()
        hits = hits.join(masked.withColumn("m", F.lit(True)), "p", "left").where(F.col("inside") | F.col("m").isNull()).drop("m")
    best = hits.groupBy("p").agg(F.min(F.struct((~F.col("inside")).alias("o"), "d", "u")).alias("b"))
    out = points.select(F.col(point_id).alias("p")).join(best, "p", "left")
    match = F.when(F.col("b").isNull(), "none").when(F.col("b.o"), "nearest").otherwise("within")
    return out.select(F.col("p").alias(point_id), F.col("b.u").alias(unit_id), match.alias("match"), F.col("b.d").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, x: str = "east", y: str = "north") -> DataFrame:
    """(left_id, right_id, distance) of the nearest right row within the radius; null if none; ties by id."""
    near = radius_join(left.select(left_id, x, y), right.select(right_id, x, y), radius, x, y)
    best = near.groupBy(left_id).agg(F.min(F.struct("distance", F.col(f"r_{right_id}").alias("r"))).alias("b"))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.col("b.r").alias(right_id), F.col("b.distance").alias("distance"))


def accessibility(points: DataFrame, amenities: DataFrame, point_id: str, weights: Mapping[str, Sequence[float]], full_until: float = 400.0, zero_at: float = 2400.0) -> DataFrame:
    """acc_<category> and acc_total, 0 to 100: the n nearest amenities of a category count by weight and decay.

    A category's score is over the sum of its weights; the total weighs categories by these sums.
    Points without any amenity in reach score 0. Scores go by place: points of one place are scored
    once, amenities of one place and category count as far as there are weights, and of the others
    only the nearest places are joined.
    """
    at = lambda rows, c: rows.where(F.col("east").isNotNull() & F.col("north").isNotNull()).withColumn(c, F.struct("east", "north"))
    places = at(points, "place").select("place", "east", "north").distinct().persist()
    parts = []
    for c, w in weights.items():
        if not len(w):
            continue
        there = at(amenities.where(F.col("category") == c), "at").groupBy("at", "east", "north").agg(F.least(F.count("*"), F.lit(len(w))).cast("int").alias("n")).persist()
        near = knn_join(places, there, len(w), "place", "at", zero_at, within=zero_at).select("place", "distance", F.explode(F.sequence(F.lit(1), F.col("r_n"))).alias("k"), "r_at")
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("distance", "r_at", "k")))
        s = F.try_element_at(F.array(*map(F.lit, map(float, w))), F.col("rank")) * S.distance_decay("distance", full_until, zero_at)
        parts.append(near.where(F.col("rank") <= len(w)).select("place", F.lit(c).alias("category"), s.alias("s")))
    raw = reduce(DataFrame.unionByName, parts).groupBy("place").pivot("category", list(weights)).agg(F.sum("s"))
    out = points.select(point_id, F.when(F.col("east").isNotNull() & F.col("north").isNotNull(), F.struct("east", "north")).alias("place")).join(raw, "place", "left")
    total = sum(sum(w) for w in weights.values())
    scores = [(100 * F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) / sum(w)).alias(f"acc_{c}") for c, w in weights.items()]
    every = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in weights), F.lit(0.0))
    return out.select(point_id, *scores, (100 * every / total).alias("acc_total"))


def transit_indicators(points: DataFrame, classes: DataFrame, stops: DataFrame, point_id: str, stop_id: str, cell: float = 2000.0) -> DataFrame:
    """(point_id, transit_class, stop_distance): the best class whose polygon holds the point (0 outside all), the nearest stop of category 1 to 5.

    classes: class (A to D) and rings; stops: stop_id, category, east, north. Both are null without
    coordinates, the distance also without stops.
    """
    table = F.create_map(*(x for c, v in fixed.TRANSIT_SCORE.items() for x in (F.lit(c), F.lit(v))))
    # the smallest name wins a tie, so names start with what the best class lacks
    best = max(fixed.TRANSIT_SCORE.values())
    scored = classes.withColumn("__s", F.try_element_at(table, F.col("class"))).where("__s is not null")
    named = scored.select(F.concat(F.lpad((best - F.col("__s")).cast("string"), 3, "0"), F.lit("|"), F.sha2(F.to_json("rings"), 256)).alias("__u"), "rings").distinct()
    at = locate(points, named, point_id, "__u", max_snap=0.0, cell=cell).select(point_id, (best - F.substring("__u", 1, 3).cast("int")).alias("__in"))
    used = stops.where(F.col("category").between(1, 5)).select(stop_id, "east", "north")
    near = knn_join(points.select(point_id, "east", "north"), used, 1, point_id, stop_id, cell).select(point_id, F.col("distance").alias("stop_distance"))
    there = F.col("east").isNotNull() & F.col("north").isNotNull()
    out = points.select(point_id, there.alias("__t")).join(at, point_id, "left").join(near, point_id, "left")
    return out.select(point_id, F.when(F.col("__t"), F.coalesce("__in", F.lit(0))).alias("transit_class"), "stop_distance")


def green_share(points: DataFrame, landuse: DataFrame, point_id: str, radius: float = 300.0, classes: Sequence[int] = (5, 10, 11, 12)) -> DataFrame:
    """Share of green cells among land-use cells within the radius; null if there is none."""
    near = radius_join(points.select(point_id, "east", "north"), landuse.select("class", "east", "north"), radius)
    share = near.groupBy(point_id).agg((F.count_if(F.col("r_class").isin(*classes)) / F.count("*")).alias("green_share"))
    return points.select(point_id).join(share, point_id, "left")


def focal_max(points: DataFrame, raster: DataFrame, point_id: str, half_widths: Sequence[float], cell: float = 10.0, west: float = 0.0, north_edge: float = 0.0) -> DataFrame:
    """(point_id, half_width, level): the largest raster value in a square around each point; half width 0 is the point's own cell.

    raster: row, col, value, without empty cells. A point goes to the cells its square touches.
    """
    at = lambda v: F.floor(v / cell).cast("long")
    e, n = F.col("east") - west, north_edge - F.col("north")
    asked = points.select(point_id, "east", "north", F.explode(F.array(*map(F.lit, map(float, half_widths)))).alias("half_width"))
    h = F.col("half_width")
    asked = asked.withColumn("col", F.explode(F.sequence(at(e - h), at(e + h)))).withColumn("row", F.explode(F.sequence(at(n - h), at(n + h))))
    found = asked.join(raster, ["row", "col"]).groupBy(point_id, "half_width").agg(F.max("value").alias("level"))
    return points.select(point_id).crossJoin(F.broadcast(asked.sparkSession.createDataFrame([(float(x),) for x in half_widths], "half_width double"))).join(found, [point_id, "half_width"], "left")


def noise_levels(points: DataFrame, raster: DataFrame, point_id: str, rings: Sequence[float] = (0.0, 10.0, 20.0, 50.0, 100.0), facade: float = 20.0, inside: Column | None = None, **grid) -> DataFrame:
    """(point_id, level, source): the level of the smallest ring with data: point, facade, fallback; else quiet, or outside."""
    levels = focal_max(points, raster, point_id, rings, **grid).where("level is not null")
    first = levels.groupBy(point_id).agg(F.min(F.struct("half_width", "level")).alias("b"))
    w = F.col("b.half_width")
    source = F.when(w == 0, "point").when(w <= facade, "facade").when(w.isNotNull(), "fallback")
    out = points.join(first, point_id, "left")
    none = F.when(inside, "quiet").otherwise("outside") if inside is not None else F.lit("quiet")
    return out.select(point_id, F.col("b.level").alias("level"), F.coalesce(source, none).alias("source"))


def remap_mean(values: DataFrame, correspondence: DataFrame, value: str) -> DataFrame:
    """(terminal_id, mean): values by initial_id carried over to successor ids."""
    return values.join(correspondence, "initial_id").groupBy("terminal_id").agg(F.avg(value).alias(value))
