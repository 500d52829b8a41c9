"""Result pages to typed article records, and walks from page to page.

A walk follows next-links from a start page until there is none, or until it meets a page
that it has been to. All walks advance together, by doubling: the pages 1, 2, 4, .. hops
ahead are known from the table before, so a walk of n pages takes log2(n) written tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from litsieve.functions.markup import (
    ANCHOR,
    HREF,
    Element,
    content,
    decode_entities,
    element,
    first_match,
    links,
    next_page_link,
    absolute_url,
    text_of,
    usable_href,
    without_scripts,
)
from litsieve.operators.search import accumulate_pages
from litsieve.session import durable

YEAR = r"\b(?:19|20)\d{2}\b"


@dataclass(frozen=True)
class Rules:
    """Elements or patterns of one page layout. ``None`` fields stay null."""

    block: str = r"(?i)<div\s(?:[^>]*\s)?class=[\x22'](?:[^\x22'>]*\s)?gs_r(?=[\s\x22'])"
    title: str | Element = element("h3", "gs_rt")
    byline: str | Element | None = Element("div", "gs_a")
    abstract: str | Element | None = Element("div", "gs_rs")
    footers: tuple[str | Element, ...] = (Element("div", "gs_flb"), Element("div", "gs_fl"))
    cites: str = r"/scholar\?cites=\d+"
    separator: str = " - "
    venue: str = "last"
    glue: bool = False
    every_entity: bool = False


RESULT_PAGE = Rules()
ARTICLE_PAGE = Rules(
    block=r"(?i)<article\b",
    title=element("h1"),
    byline=None,
    abstract=r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|<p\b|</article>)",
    footers=(),
)


def first_author(byline: Column, separator: str = " - ") -> Column:
    """Text before the separator, then before the first comma; null if empty."""
    author = F.trim(F.split(F.split(byline, separator)[0], ",")[0])
    return F.nullif(author, F.lit(""))


def year_of(text: Column) -> Column:
    return first_match(text, YEAR, 0).cast("int")


def venue_last(byline: Column, separator: str = " - ") -> Column:
    parts = F.split(byline, separator)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def venue_second(byline: Column, separator: str = " - ") -> Column:
    return F.trim(F.split(F.get(F.split(byline, separator), F.lit(1)), ",")[0])


def citation_count(footer: Column, cites: str = RESULT_PAGE.cites) -> Column:
    """First number in the text of the first link to a citing list; 0 if none."""
    anchors = F.regexp_extract_all(footer, F.lit(ANCHOR), F.lit(0))
    wanted = F.filter(anchors, lambda a: F.regexp_extract(a, HREF, 1).rlike(cites))
    number = F.regexp_extract(text_of(F.get(wanted, F.lit(0))), r"\d+", 0)
    return F.coalesce(number.try_cast("int"), F.lit(0))


def record_blocks(pages: DataFrame, rules: Rules = RESULT_PAGE) -> DataFrame:
    """One row per record: page_id, url, pos (from 1), block."""
    parts = F.split(without_scripts(F.col("html")), rules.block)
    return pages.select(
        "page_id", F.col("url").alias("page_url"), F.posexplode(parts).alias("pos", "block")
    ).filter(F.col("pos") > 0)


def extract_records(
    pages: DataFrame, rules: Rules = RESULT_PAGE, keep_rejected: bool = False
) -> DataFrame:
    """Records in page order. Blocks without a title are left out, or kept with
    ``error`` set when ``keep_rejected``; no block can fail the job."""
    block = F.col("block")

    def text(wanted: str | Element | None) -> Column:
        if wanted is None:
            return F.lit(None).cast("string")
        return text_of(content(block, wanted), rules.glue, rules.every_entity)

    footer = F.coalesce(*[content(block, f) for f in rules.footers], F.lit(None).cast("string"))
    byline = F.col("byline")
    venue = venue_last if rules.venue == "last" else venue_second
    parsed = (
        record_blocks(pages, rules)
        .withColumn("title_markup", content(block, rules.title))
        .withColumn("byline", text(rules.byline))
        .select(
            "page_id",
            "page_url",
            "pos",
            text_of(F.col("title_markup"), rules.glue, rules.every_entity).alias("title"),
            first_author(byline, rules.separator).alias("authors"),
            year_of(byline).alias("year"),
            venue(byline, rules.separator).alias("journal"),
            citation_count(footer, rules.cites).alias("citations"),
            text(rules.abstract).alias("abstract"),
            decode_entities(first_match(F.col("title_markup"), HREF)).alias("url"),
        )
    )
    if keep_rejected:
        return parsed.withColumn("error", F.when(F.col("title").isNull(), F.lit("no title")))
    return parsed.filter(F.col("title").isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """All links of all pages: page_id, page_url, pos (from 0), href, text."""
    return pages.select(
        "page_id",
        F.col("url").alias("page_url"),
        F.posexplode(links(without_scripts(F.col("html")))).alias("pos", "link"),
    ).select("page_id", "page_url", "pos", "link.href", "link.text")


def follow_next(pages: DataFrame, host: str, step: int = 10) -> DataFrame:
    """Each page with the following page: page_id, next_url, next_page_id.

    The hop is an equi-join of the pages with themselves on the URL; of pages that
    were captured under one URL the first is followed. Pages without a next link,
    which would all meet in one task, go around the join.
    """
    href = next_page_link(links(without_scripts(F.col("html"))), F.col("url"), step)
    hops = (
        pages.select("page_id", "url", href.alias("href"))
        .withColumn(
            "next_url",
            F.when(usable_href(F.col("href"), host), absolute_url(F.col("href"), F.col("url"))),
        )
        .select("page_id", "next_url")
    )
    targets = pages.groupBy(F.col("url").alias("next_url")).agg(F.min("page_id").alias("next_page_id"))
    linked = hops.filter(F.col("next_url").isNotNull()).join(targets, "next_url", "left")
    last = hops.filter(F.col("next_url").isNull()).withColumn("next_page_id", F.lit(None).cast("long"))
    return linked.select("page_id", "next_url", "next_page_id").unionByName(last)


def walk_pages(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """Pages that a walk from each start comes to, in order: start, place (from 0), page.

    ``hops``: page_id, next_page_id as ``follow_next`` gives them (rows without a next page
    end a walk; of several next pages the least is taken). ``starts``: start, which need
    not stand in ``hops``; repeated and null ones count once and not at all.
    """
    jump = hops.filter("next_page_id IS NOT NULL AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("at"))
    jump = durable(jump.agg(F.min("next_page_id").alias("to")), "jump")
    open_ = durable(
        starts.filter("start IS NOT NULL").select("start", F.lit(0).cast("long").alias("place"), F.col("start").alias("page")).distinct(),
        "walk",
    )
    ended, known = [], 1
    while True:
        # The first ``known`` places of the open walks, no page twice, are there.
        ahead = open_.join(jump, open_["page"] == jump["at"]).select("start", (F.col("place") + known).alias("place"), F.col("to").alias("page"))
        # One next page each: after the first page met again, only such pages follow.
        longer = durable(
            open_.unionByName(ahead).groupBy("start", "page").agg(F.min("place").alias("place")).select("start", "place", "page"), "walk"
        )
        known *= 2
        on = durable(longer.groupBy("start").agg(F.count("*").alias("n")), "lengths")
        going, done = on.filter(F.col("n") == known), on.filter(F.col("n") < known)
        # The pages of a walk are parted from the others only where some walks end and some go on.
        if going.isEmpty():
            return reduce(DataFrame.unionByName, [*ended, longer])
        if done.isEmpty():
            open_ = longer
        else:
            ended.append(longer.join(done, "start", "left_semi"))
            open_ = durable(longer.join(going, "start", "left_semi"), "walk")
        second = jump.select(F.col("at").alias("to"), F.col("to").alias("far"))
        jump = durable(jump.join(second, "to").select("at", F.col("far").alias("to")), "jump")


def walk_records(walks: DataFrame, records: DataFrame, max_results: int) -> DataFrame:
    """Records along each walk, up to its first page without any and to ``max_results``:
    start, page, pos, place (from 1). ``records``: page_id, pos."""
    pages = walks.select("start", F.col("place").alias("step"), "page")
    found = pages.join(records.select(F.col("page_id").alias("page"), "pos"), "page")
    return accumulate_pages(pages, found, "start", "step", "pos", max_results).select("start", "page", "pos", "place")
