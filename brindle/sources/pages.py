"""Listing and detail pages: fields from HTML by regular expressions, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_text(html: str | Column, tag: str) -> Column:
    """Text of the first element of a name, tags out, white space to one space; null if there is none."""
    h = F.col(html) if isinstance(html, str) else html
    inner = F.regexp_extract(h, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, "(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def attribute(html: str | Column, tag: str, name: str) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.regexp_extract(h, rf'(?is)<{tag}\s[^>]*?\b{name}="([^"]*)"', 1), F.lit(""))


def links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, href) of all links, in page order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*?\bhref="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("pos", "href"))


def json_ld(html: str | Column, kind: str, field: str) -> Column:
    """A field of the first JSON-LD script whose @type is `kind`."""
    h = F.col(html) if isinstance(html, str) else html
    blocks = F.regexp_extract_all(h, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    hits = F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']") == kind)
    return F.get_json_object(F.try_element_at(hits, F.lit(1)), f"$.{field}")


def label_values(html: str | Column, row: str = "dt", value: str = "dd") -> Column:
    """Map label -> value of the page's description rows; `-` is null."""
    h = F.col(html) if isinstance(html, str) else html
    rows = F.regexp_extract_all(h, F.lit(rf"(?is)<{row}[^>]*>.*?</{row}>\s*<{value}[^>]*>.*?</{value}>"), F.lit(0))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(tag_text(r, row), F.nullif(tag_text(r, value), F.lit("-")))))


def cards(pages: DataFrame, id_col: str, html: str, card: str = "article") -> DataFrame:
    """(id, pos, slug, rooms, area, price) of listing cards; numbers that can't be read are 0."""
    from brindle.functions.scalars import coerce_numeric

    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{card}[^>]*>.*?</{card}>"), F.lit(0))
    c = F.col("card")
    number = lambda pattern: F.coalesce(coerce_numeric(F.regexp_extract(c, pattern, 1)), F.lit(0.0))
    return pages.select(id_col, F.posexplode(found).alias("pos", "card")).select(
        id_col, "pos", attribute(c, "a", "href").alias("slug"), number(r"(?i)([\d.,½]+)\s*(?:zimmer|rooms?|pi[èe]ces)").alias("rooms"),
        number(r"(?i)([\d.,']+)\s*m(?:²|2)").alias("area"), number(r"(?i)CHF\s*([\d.,'’]+)").alias("price"),
    )
