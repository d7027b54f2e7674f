"""Pages: filters, metadata and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import blank

#: Titles of pages that a new wiki space brings along.
BOILERPLATE = ["Getting started in Confluence", "Overview", "Welcome to Confluence", "Confluence 101"]
MIN_LENGTH = 50
ENRICH_CHARS = 2000
#: Marks in enriched and cut texts.
CUT_MARK = "\n... [truncated for enrichment]"
ENRICHMENT_MARK = "--- SEMANTIC ENRICHMENT ---"


def drop_boilerplate(pages: DataFrame, titles: list[str] = BOILERPLATE) -> DataFrame:
    """Without pages of the given exact titles; a null title stays."""
    return pages.where(F.coalesce(~F.col("title").isin(titles), F.lit(True)))


def page_url(base_url: str, webui: Column) -> Column:
    return F.concat(F.lit(base_url + "/wiki"), F.coalesce(webui, F.lit("")))


def page_metadata(pages: DataFrame, base_url: str, space_key: str) -> DataFrame:
    """Adds url, space_key and breadcrumb (titles of the ancestors, null without any)."""
    titles = F.transform("ancestors", lambda a: a["title"])
    return pages.withColumns({"url": page_url(base_url, F.col("webui")), "space_key": F.lit(space_key), "breadcrumb": F.when(F.size("ancestors") > 0, F.array_join(titles, " > "))})


def drop_empty(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Documents with at least ``min_length`` characters."""
    return docs.where(~blank(F.col("content")) & (F.length("content") >= min_length))


def enrichment_requests(docs: DataFrame, most: int = ENRICH_CHARS) -> DataFrame:
    """(page_id, title, excerpt) for a batch of a language model."""
    content = F.col("content")
    return docs.select("page_id", "title", F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, most), F.lit(CUT_MARK))).alias("excerpt"))


def apply_enrichment(docs: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Appends a page's enrichment to its content; pages without one stay as they are."""
    joined = docs.join(enrichments.select("page_id", "enrichment"), "page_id", "left")
    return joined.withColumn("content", F.when(F.col("enrichment").isNull(), F.col("content")).otherwise(F.concat("content", F.lit(f"\n\n{ENRICHMENT_MARK}\n"), "enrichment"))).drop("enrichment")
