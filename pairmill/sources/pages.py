"""Raw page parsing (S17, S18) with built-in regex functions: no per-row
Python, one pass over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = r'<a\s[^>]*href="([^"]*)"'


def page_fields(pages: DataFrame) -> DataFrame:
    """Host, title, first h1, link count and visible-text size per page."""
    html = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1).alias("host"),
        F.trim(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.trim(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"),
        F.size(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("n_links"),
        F.length(F.regexp_replace(html, r"<[^>]+>", "")).alias("text_chars"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every distinct link with the first page it appears on."""
    e = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))
    return e.groupBy("href").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
