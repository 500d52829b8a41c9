"""Search over article records: terms, author, years, order, pages; one or many at once.

One search scans the articles. For many, ``term_index`` writes one line per word and
article once, and ``search_many`` answers a whole table of requests by joining their terms
to it: an article is found when as many of its words match as the request has terms. Only an
article that holds a request's rarest term is compared with the request.
"""

from __future__ import annotations

from functools import reduce

import regex as re
from pyspark.sql import Column, DataFrame, Window, functions as F

from litsieve.functions.text import normalise_title
from litsieve.session import durable

PAGE_SIZE = 10


def query_terms(query: str) -> list[str]:
    """Distinct words of the query, normalised as the searched text is."""
    return list(dict.fromkeys(re.sub(r"[^\p{L}\p{N}_]+", " ", query.lower()).split()))


def search_text(columns: tuple[str, ...] = ("title", "abstract")) -> Column:
    """Normalised words of all columns, blank at both ends."""
    return F.concat(F.lit(" "), normalise_title(F.concat_ws(" ", *columns)), F.lit(" "))


def term_hits(text: Column, term: str) -> Column:
    """How often the whole word stands in the text."""
    return F.size(F.filter(F.split(text, " "), lambda w: w == term))


def match_articles(
    articles: DataFrame,
    query: str,
    author: str | None = None,
    year_start: int | None = None,
    year_end: int | None = None,
    columns: tuple[str, ...] = ("title", "abstract"),
) -> DataFrame:
    """Articles that hold every term and pass the filters; adds ``hits``."""
    out = articles
    if author:
        out = out.filter(F.lower("authors").contains(author.lower()))
    if year_start:
        out = out.filter(F.col("year") >= year_start)
    if year_end:
        out = out.filter(F.col("year") <= year_end)
    terms = query_terms(query)
    found = F.transform(
        F.array(search_text(columns)),
        lambda text: F.struct(
            *[term_hits(text, t).alias(f"n{i}") for i, t in enumerate(terms)],
            reduce(lambda a, b: a + b, [term_hits(text, t) for t in terms] or [F.lit(0)]).alias("hits"),
        ),
    )
    # A filter on a column of explode stays above it, so each text is normalised once
    # and after the rows were spread.
    out = out.withColumn("_found", F.explode(found))
    for i in range(len(terms)):
        out = out.filter(F.col(f"_found.n{i}") > 0)
    return out.withColumn("hits", F.col("_found.hits")).drop("_found")


def result_order(sort_by: str = "relevance") -> list[Column]:
    if sort_by == "date":
        return [F.desc_nulls_last("year"), F.asc("ord")]
    return [F.desc("hits"), F.desc_nulls_last("citations"), F.asc("ord")]


def search(
    articles: DataFrame,
    query: str,
    author: str | None = None,
    year_start: int | None = None,
    year_end: int | None = None,
    sort_by: str = "relevance",
    max_results: int = 100,
    page: int | None = None,
    columns: tuple[str, ...] = ("title", "abstract"),
) -> DataFrame:
    """The first ``max_results`` articles, or one page of ten of them."""
    found = match_articles(articles, query, author, year_start, year_end, columns)
    top = found.orderBy(*result_order(sort_by))
    if page is None:
        return top.limit(max_results)
    return top.offset(PAGE_SIZE * page).limit(PAGE_SIZE)


def term_index(articles: DataFrame, columns: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Written lines (term, ord, hits): how often an article holds a word.

    Dealt out by ranges of (term, ord) and sorted, so a frequent word lies in several
    files, and a filter on ``term`` skips the others by their ranges.
    """
    words = articles.select("ord", F.explode(F.split(F.trim(search_text(columns)), " ")).alias("term"))
    lines = words.filter("term <> ''").groupBy("term", "ord").agg(F.count("*").alias("hits"))
    return durable(lines.repartitionByRange("term", "ord").sortWithinPartitions("term", "ord"), "terms")


REQUEST = "request long, query string, author string, year_start int, year_end int, sort_by string, max_results int"


def search_many(index: DataFrame, articles: DataFrame, requests: DataFrame) -> DataFrame:
    """request, place (from 1), ord, hits for every row of ``requests`` (``REQUEST``), each
    as ``search`` answers it; ``articles`` has ord, authors, year, citations.

    A request without terms finds all articles that pass its filters, as ``search`` does;
    nulls in author, years, sort_by and max_results stand for no filter, relevance and 100.
    """
    requests = requests.select(
        F.col("request").alias("_request"),
        F.array_distinct(F.filter(F.split(normalise_title(F.col("query")), " "), lambda t: t != "")).alias("_terms"),
        F.nullif(F.lower("author"), F.lit("")).alias("_author"),
        F.nullif("year_start", F.lit(0)).alias("_from"), F.nullif("year_end", F.lit(0)).alias("_to"),
        (F.coalesce("sort_by", F.lit("")) == "date").alias("_by_date"), F.coalesce("max_results", F.lit(100)).alias("_most"),
    )
    # Written, so that joins know how small it is.
    asked = durable(requests, "asked")
    details = articles.select("ord", "authors", "year", "citations")
    found = _holding(index, asked, details)
    # Requests without terms meet every article once; they are told apart before the join.
    bare = asked.filter("size(_terms) = 0").withColumn("_all", F.lit(1))
    every = details.withColumn("_all", F.lit(1)).join(F.broadcast(bare), "_all").select(
        "_request", "ord", F.lit(0).cast("long").alias("hits")
    ).join(details, "ord") if not bare.isEmpty() else None
    hits = found if every is None else found.unionByName(every)
    passing = (
        hits.join(asked.drop("_terms"), "_request")
        .filter(F.col("_author").isNull() | F.contains(F.lower("authors"), F.col("_author")))
        .filter(F.col("_from").isNull() | (F.col("year") >= F.col("_from")))
        .filter(F.col("_to").isNull() | (F.col("year") <= F.col("_to")))
    )
    by = [
        F.when(F.col("_by_date"), F.col("year")).desc_nulls_last(), F.when(~F.col("_by_date"), F.col("hits")).desc_nulls_last(),
        F.when(~F.col("_by_date"), F.col("citations")).desc_nulls_last(), F.col("ord").asc(),
    ]
    # One number; a literal limit lets each task keep no more rows of a request.
    most = asked.agg(F.max("_most")).first()[0] or 0
    ranked = passing.withColumn("place", F.row_number().over(Window.partitionBy("_request").orderBy(*by)))
    return ranked.filter(F.col("place") <= most).filter(F.col("place") <= F.col("_most")).select(
        F.col("_request").alias("request"), "place", "ord", "hits"
    )


def _holding(index: DataFrame, asked: DataFrame, details: DataFrame) -> DataFrame:
    """(_request, hits, and the details) of the articles that hold all terms of a request.

    Each article's asked terms come together once, next to its details. A request looks at
    the articles of its rarest term alone, never at all lines of a word that most hold.
    """
    terms = asked.filter("_request IS NOT NULL").select("_request", F.size("_terms").alias("_n"), F.explode("_terms").alias("term"))
    lines = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_lines"))
    by_lines = F.array_sort(F.collect_list(F.struct(F.coalesce("_lines", F.lit(0)).alias("n"), "term")))
    # Of all but ``_n - 1`` of a request's terms, an article with ``_n`` of them holds one.
    wanted = durable(
        terms.join(lines, "term", "left").groupBy("_request").agg(F.first("_n").alias("_n"), by_lines["term"].alias("_all"))
        .withColumn("_rare", F.array_distinct(F.slice("_all", F.lit(1), F.size("_all") - F.col("_n") + 1))),
        "wanted",
    )
    rare = wanted.select(F.explode("_rare").alias("term")).distinct().withColumn("rare", F.lit(True))
    known = durable(terms.select("term").distinct().join(rare, "term", "left"), "asked-terms")
    held = index.join(known, "term").groupBy("ord").agg(F.collect_list(F.struct("term", "hits", "rare")).alias("_has"))
    meet = (
        held.join(details, "ord")
        .withColumn("_at", F.explode(F.expr("filter(_has, x -> x.rare).term")))
        .join(wanted.withColumn("_at", F.explode("_rare")), "_at")
        # A request's first rare term that the article holds, so that they meet once.
        .filter("element_at(filter(_rare, t -> exists(_has, x -> x.term = t)), 1) = _at")
        .withColumn("_found", F.expr("flatten(transform(_all, t -> filter(_has, x -> x.term = t)))"))
        .filter("size(_found) = _n")
    )
    hits = F.expr("aggregate(_found, 0L, (n, x) -> n + x.hits)")
    return meet.select("_request", "ord", hits.alias("hits"), *[c for c in details.columns if c != "ord"])


def accumulate_pages(
    pages: DataFrame, records: DataFrame, run: str, page: str, pos: str, max_results: int
) -> DataFrame:
    """Per run, records of the pages before its first empty page, in page order,
    up to ``max_results``. ``pages`` holds (run, page), ``records`` also pos."""
    filled = records.select(run, page).distinct().withColumn("_filled", F.lit(True))
    empty = (
        pages.select(run, page)
        .join(filled, [run, page], "left")
        .filter(F.col("_filled").isNull())
        .groupBy(run)
        .agg(F.min(page).alias("_end"))
    )
    upto = Window.partitionBy(run).orderBy(page, pos)
    return (
        records.join(empty, run, "left")
        .filter(F.col("_end").isNull() | (F.col(page) < F.col("_end")))
        .withColumn("place", F.row_number().over(upto))
        .filter(F.col("place") <= max_results)
        .drop("_end")
    )
