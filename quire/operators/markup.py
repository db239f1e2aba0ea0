"""Parts of pages: links, titles, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame, html: str = "html", starts: str = "") -> DataFrame:
    """pages' page_id with the distinct link targets that begin with `starts`, in order of their text."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a[ \t\n\f\r][^>]*?href=["']([^"']*)["']"""), 1)
    kept = F.filter(found, lambda x: F.startswith(x, F.lit(starts)))
    return pages.select("page_id", F.explode(F.array_sort(F.array_distinct(kept))).alias("href"))


def inner(html: Column, tag: str) -> Column:
    """The markup within the first element of that name."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:[ \t\n\f\r][^>]*)?>(.*?)</{tag}>", 1)
