"""Download links in HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.functions.clean import pad_code

# comments and scripts hold text that looks like links but is none
NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script>"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']"""

# Name of an archive of the topographic database, with its area (three digits, or two and a
# letter for the two halves of Corsica) and its release date.
ARCHIVE = r"BDTOPO_[0-9]-[0-9]_TOUSTHEMES_GPKG_LAMB93_D([0-9]{2}[0-9AB])_([0-9]{4}-[0-9]{2}-[0-9]{2})\.7z$"


def absolute(href: Column, base: Column) -> Column:
    """Resolve a link against the address of its page."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    plain = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(plain == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))
    return (
        F.when(href.startswith("http"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def page_links(pages: DataFrame, pattern: str = "", base: Column | None = None) -> DataFrame:
    """Distinct absolute links `url` in order, whose `href` matches the pattern."""
    markup = F.regexp_replace(F.col("html"), NOT_MARKUP, " ")
    found = pages.select(
        F.explode(F.regexp_extract_all(markup, F.lit(ANCHOR), F.lit(1))).alias("raw"), (base if base is not None else F.col("url")).alias("base")
    ).withColumn("href", F.replace(F.trim("raw"), F.lit("&amp;"), F.lit("&")))
    return found.filter(F.col("href").rlike(pattern)).select(absolute(F.col("href"), F.col("base")).alias("url")).distinct().orderBy("url")


def archive_links(pages: DataFrame, date: str) -> DataFrame:
    """`(url, tag)` of the archives of one release; `date` may be a year or a month only."""
    named = page_links(pages, ARCHIVE).withColumn("tag", F.regexp_extract("url", ARCHIVE, 1))
    return named.filter(F.regexp_extract("url", ARCHIVE, 2).startswith(date))


def pick_by_area(links: DataFrame, areas: DataFrame, area: str = "dep") -> DataFrame:
    """`(dep, url)`: the first link per area, by the area tag of the archives."""
    first = links.groupBy(F.col("tag").alias("_tag")).agg(F.min("url").alias("url"))
    return areas.select(area, pad_code(F.col(area), 3).alias("_tag")).distinct().join(first, "_tag").select(area, "url")
