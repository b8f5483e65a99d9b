"""Page filters, look-ups and counts on a DataFrame of pages: (page_id, ns, title, redirect_target, revisions, ...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageFilter:
    """Empty fields don't restrict; max_pages 0 is no limit."""

    namespaces: tuple[int, ...] = ()
    include_redirects: bool = True
    title_prefix: str = ""
    title_contains: str = ""
    only_latest_revision: bool = False
    max_pages: int = 0

    def condition(self) -> Column:
        c = F.lit(True)
        if self.namespaces:
            c &= F.col("ns").isin(*self.namespaces)
        if not self.include_redirects:
            c &= F.col("redirect_target").isNull()
        if self.title_prefix:
            c &= F.startswith(F.col("title"), F.lit(self.title_prefix))
        if self.title_contains:
            c &= F.contains(F.col("title"), F.lit(self.title_contains))
        return c


def filter_pages(pages: DataFrame, by: PageFilter) -> DataFrame:
    out = pages.where(by.condition())
    if by.only_latest_revision:
        out = out.withColumn("revisions", F.slice("revisions", -1, 1))
    return out.limit(by.max_pages) if by.max_pages else out


def latest_revision(revisions="revisions") -> Column:
    return F.get(F.col(revisions), F.size(revisions) - 1)


def content(revisions="revisions") -> Column:
    """The latest revision's text; '' without one."""
    return F.coalesce(latest_revision(revisions)["content"], F.lit(""))


def is_main() -> Column:
    return F.col("ns") == 0


def is_template() -> Column:
    return F.col("ns") == 10


def is_module() -> Column:
    return F.col("ns") == 828


def is_redirect() -> Column:
    return F.col("redirect_target").isNotNull()


def is_wikitext(model="model") -> Column:
    return F.coalesce(F.col(model), F.lit("")).isin("", "wikitext")


def count_pages(pages: DataFrame, by: PageFilter = PageFilter()) -> DataFrame:
    return filter_pages(pages, by).agg(F.count("*").alias("n"))


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """Some n pages, reading no more than is needed: what a scan that stops early sees."""
    return pages.limit(n)


def find_page(pages: DataFrame, title: str) -> DataFrame:
    return pages.where(F.col("title") == title).limit(1)


def template_pages(pages: DataFrame) -> DataFrame:
    return pages.where(is_template())


def page_stats(pages: DataFrame, by: PageFilter) -> DataFrame:
    """(pages_read, pages_processed, pages_skipped, redirects, characters) in one pass."""
    m = by.condition()
    return pages.agg(
        F.count("*").alias("pages_read"),
        F.count_if(m).alias("pages_processed"),
        F.count_if(~m).alias("pages_skipped"),
        F.count_if(is_redirect()).alias("redirects"),
        F.coalesce(F.sum(F.length(content())), F.lit(0)).alias("characters"),
    )
