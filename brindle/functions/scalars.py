"""Column functions: conversions, geometry, acoustics and keys. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import fixed


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often `use` names it: projections are inlined, lambda variables aren't."""
    return F.transform(F.array(value), use)[0]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """Without Unicode white space at both ends; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.when(s != "", s)


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def coerce_numeric(c: str | Column) -> Column:
    """Number from text in Swiss notation: halves, currency, `.-`, thousands separators, decimal comma; else null."""
    s = F.trim(col(c).cast("string"))
    for pattern, new in (
        ("½", ".5"),
        (r"(?i)(chf|fr\.?)", ""),
        (r"[.,]\s*[-–—]+\s*$", ""),
        ("[\\s'’`  ]", ""),
        (r"(?<=\d),(?=\d{3}(?:\D|$))", ""),
        (",", "."),
    ):
        s = F.regexp_replace(s, pattern, new)
    return nan_to_null(s.try_cast("double"))


def parse_date(c: str | Column) -> Column:
    """Timestamp from ISO-8601 (an offset is applied) or dd.mm.yyyy; else null."""
    return F.coalesce(F.try_to_timestamp(col(c)), F.try_to_timestamp(col(c), F.lit("dd.MM.yyyy")))


def first_present(*columns: str | Column) -> Column:
    return F.coalesce(*map(col, columns))


def complete(columns: Sequence[str]) -> Column:
    """True if none of the columns is null."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def rotated(east: str | Column, north: str | Column, degrees: float, origin: tuple[float, float] = (2_600_000.0, 1_200_000.0)) -> tuple[Column, Column]:
    """Coordinates turned counter-clockwise around the origin."""
    x, y = col(east) - origin[0], col(north) - origin[1]
    c, s = F.cos(F.radians(F.lit(float(degrees)))), F.sin(F.radians(F.lit(float(degrees))))
    return x * c + y * s, y * c - x * s


def nested_keys(*levels: str) -> list[Column]:
    """Path keys `a`, `a/b`, `a/b/c`; null from the first null level on."""
    return [F.concat(*(p for k in range(n) for p in ((F.lit("/"),) if k else ()) + (F.col(levels[k]).cast("string"),))) for n in range(1, len(levels) + 1)]


def count_bucket(c: str | Column, low: int = 5, high: int = 20) -> Column:
    """`<low`, `low-high` or `>high`; a null counts as 0, a negative count is an error."""
    n = F.coalesce(col(c), F.lit(0))
    return F.when(n < 0, F.raise_error(F.lit("negative count"))).when(n < low, f"<{low}").when(n <= high, f"{low}-{high}").otherwise(f">{high}")


def energetic_sum(*levels: str | Column) -> Column:
    """10 log10 of the summed powers of levels in dB; nulls are skipped, null if all are."""
    powers = [F.pow(F.lit(10.0), col(c) / 10) for c in levels]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in powers])
    return F.when(F.coalesce(*map(col, levels)).isNotNull(), 10 * F.log10(total))


def lden(day: str | Column, night: str | Column) -> Column:
    """Day-evening-night level from a day level (12 h, and 4 h of evening at +5) and a night level (8 h at +10)."""
    d, n = col(day), col(night)
    return 10 * F.log10((12 * F.pow(F.lit(10.0), d / 10) + 4 * F.pow(F.lit(10.0), (d + 5) / 10) + 8 * F.pow(F.lit(10.0), (n + 10) / 10)) / 24)


def distance_decay(d: str | Column, full_until: float = 400.0, zero_at: float = 2400.0) -> Column:
    """1 up to full_until, then a half cosine down to 0 at zero_at; null stays, a negative distance is an error."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(d) - full_until) / (zero_at - full_until)))
    return F.when(col(d) < 0, F.raise_error(F.lit("negative distance")).cast("double")).when(col(d).isNotNull(), 0.5 * (1 + F.cos(F.pi() * x)))


def exceedance(day: str | Column, night: str | Column, limits: tuple[float, float] = (60.0, 50.0)) -> dict[str, Column]:
    """Excess over the day and night limits (0 if none) and whether a limit is exceeded, null if that can't be known."""
    d, n = col(day), col(night)
    excess = lambda c, limit: F.when(c.isNotNull(), F.greatest(c - limit, F.lit(0.0)))
    return {"day_excess": excess(d, limits[0]), "night_excess": excess(n, limits[1]), "day_over": d > limits[0], "night_over": n > limits[1], "any_over": (d > limits[0]) | (n > limits[1])}


def verdict(asking: str | Column, low: str | Column, high: str | Column) -> Column:
    """below, within (ends included) or above the interval; a null or NaN is an error."""
    a, lo, hi = col(asking), col(low), col(high)
    bad = reduce(lambda x, y: x | y, [c.isNull() | F.isnan(c.cast("double")) for c in (a, lo, hi)])
    return F.when(bad, F.raise_error(F.lit("verdict needs numbers"))).when(a < lo, "below").when(a > hi, "above").otherwise("within")


def sdmx_code(c: str | Column) -> Column:
    """What stands before the first colon."""
    return F.trim(F.substring_index(col(c), ":", 1))


def unit_key(level: str | Column, unit: str | Column) -> Column:
    return F.concat(col(level), F.lit(":"), col(unit).cast("string"))


def parse_key(key: str | Column) -> tuple[Column, Column]:
    return F.substring_index(col(key), ":", 1), F.try_element_at(F.split(col(key), ":"), F.lit(2)).try_cast("long")


def plot_xy(east: str | Column, north: str | Column, origin: tuple[float, float] = (2_600_000.0, 1_200_000.0), scale: float = 1e-5) -> tuple[Column, Column]:
    """Metres to small plot degrees."""
    return (col(east) - origin[0]) * scale, (col(north) - origin[1]) * scale


def chf(c: str | Column, decimals: int = 0) -> Column:
    """1'850 notation; an en dash for null."""
    return F.coalesce(F.translate(F.format_number(col(c), decimals), ",", "'"), F.lit("–"))


def language_region(canton: str | Column, district: str | Column, municipality: str | Column | None = None) -> Column:
    """The municipality's language if it has one of its own, else the district's, else the canton's.

    Null for a null canton; a canton that isn't known is an error.
    """

    def look(table: dict[str, str], key: Column) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)

    def named(c: str | Column) -> Column:
        return F.lower(F.concat(col(canton), F.lit("|"), F.trim(col(c))))

    found = [look(fixed.MUNICIPALITY_LANGUAGE, named(municipality))] if municipality is not None else []
    found += [look(fixed.DISTRICT_LANGUAGE, named(district)), look(fixed.CANTON_LANGUAGE, col(canton))]
    return F.when(col(canton).isNotNull(), F.coalesce(*found, F.raise_error(F.lit("unknown canton")).cast("string")))
