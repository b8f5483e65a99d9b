"""Pages as they arrive: parse in a stream, with running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.markup import node_counts, spread
from ..operators.pages import PageFilter, content


def parsed_pages(pages: DataFrame, by: PageFilter = PageFilter()) -> DataFrame:
    """(page_id, title, n_links, n_templates) of a batch or streaming DataFrame of pages; no state is kept. Only the
    counts leave the parse."""
    kept = spread(pages.where(by.condition()).select("page_id", "title", content().alias("text")))
    return kept.select("page_id", "title", node_counts("text", "Link", "Template").alias("n")).select("page_id", "title", F.col("n.Link").alias("n_links"), F.col("n.Template").alias("n_templates"))


def totals(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("links"), F.coalesce(F.sum("n_templates"), F.lit(0)).alias("templates"))
