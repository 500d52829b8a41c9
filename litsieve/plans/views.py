"""Article-shaped views over other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from litsieve.operators.extract import ARTICLE_PAGE, extract_records
from litsieve.session import dealt, spread


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A table; ``heavy`` when much work per row follows (text, markup)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy else df


def document_articles(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Documents as articles: headline line = title, the rest = abstract."""
    d = table(spark, folder, "documents", heavy)
    title = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("source_file"),
        F.col("lang"),
        title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"),
    )


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    return document_articles(spark, folder).select("ord", "source_file", "title")


def order_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as articles: customer = author, order year = year,
    line items = citations, market segment and priority = words of the title."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("citations"))
    )
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("ord"),
            F.concat_ws(" ", F.lit("order"), "c_mktsegment", "o_orderpriority").alias("title"),
            F.col("c_name").alias("authors"),
            F.year("o_orderdate").alias("year"),
            F.col("c_mktsegment").alias("journal"),
            F.coalesce("citations", F.lit(0)).alias("citations"),
            F.concat_ws(" ", F.lit("status"), "o_orderstatus").alias("abstract"),
        )
    )


def part_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citation links between parts: each order line cites the line before it."""
    l = table(spark, folder, "lineitem")
    cites = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    cited = l.select(
        "l_orderkey",
        (F.col("l_linenumber") + 1).alias("l_linenumber"),
        F.col("l_partkey").alias("dst"),
    )
    return cites.join(cited, ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def part_articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), "p_brand", "p_retailprice"
    )


def page_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as articles, read from their markup."""
    pages = table(spark, folder, "pages", heavy=True)
    return extract_records(pages, ARTICLE_PAGE)


SHELF = 1 << 40


def shelf_titles(spark: SparkSession, folder: str) -> list[DataFrame]:
    """Titles of documents, then of pages; ``ord`` ranks rows across both."""
    docs = document_titles(spark, folder)
    pages = page_articles(spark, folder).select(
        (F.col("page_id") + SHELF).alias("ord"), "title", F.col("page_url").alias("url")
    )
    return [docs, pages]


SITE = "https://lib.example"


def order_result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One result page per order: a full record block, a block without a title,
    and a link to the page of the next order."""
    o = table(spark, folder, "orders", heavy=True)
    c = table(spark, folder, "customer")
    key, text = F.col("o_orderkey"), F.lit
    start = F.lit(f"{SITE}/scholar?q=order&start=")
    markup = F.concat(
        text('<html><body><div class="gs_r gs_or"><h3 class="gs_rt"><span>[B]</span> <a href="/order/'),
        key.cast("string"),
        text('?v=1&amp;seg='),
        F.col("c_mktsegment"),
        text('">Order <b>'),
        F.col("o_orderpriority"),
        text("</b> for "),
        F.col("c_mktsegment"),
        text('</a></h3><div class="gs_a">'),
        F.col("c_name"),
        text(", B Author - Journal of "),
        F.col("c_mktsegment"),
        text(", "),
        F.year("o_orderdate").cast("string"),
        text(' - lib.example</div><div class="gs_rs">Status '),
        F.col("o_orderstatus"),
        text(' &amp; more</div><div class="gs_fl"><a href="/save">Save</a> <a href="/scholar?cites='),
        key.cast("string"),
        text('&amp;hl=en">Cited by '),
        F.col("o_custkey").cast("string"),
        text('</a></div></div><div class="gs_r"><div class="gs_a">No title - 1999</div></div>'),
        text('<a href="javascript:void(0)">x</a> <a href="/scholar?q=order&amp;start='),
        ((key + 1) * 10).cast("string"),
        text('">Next</a></body></html>'),
    )
    return dealt(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey").select(
        key.alias("page_id"),
        F.concat(start, (key * 10).cast("string")).alias("url"),
        markup.alias("html"),
    )


def segment_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One search request per market segment and order priority that occur together."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    pairs = o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderpriority").distinct()
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return pairs.select(
        (F.ascii("c_mktsegment").cast("long") * 10 + rank).alias("request"),
        F.concat_ws(" ", F.lit("Order"), "c_mktsegment", F.when(rank < 4, F.col("o_orderpriority"))).alias("query"),
        F.when(rank == 2, "customer#00000000").alias("author"),
        F.when(rank > 2, 1995).alias("year_start"),
        F.when(rank == 5, 1997).alias("year_end"),
        F.when(rank % 2 == 0, "date").otherwise("relevance").alias("sort_by"),
        (rank * 25).alias("max_results"),
    )


def nested_result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One result page per order whose byline, abstract and footer hold divs of their
    own, some of them never closed, empty, or inside a comment."""
    o = table(spark, folder, "orders", heavy=True)
    c = table(spark, folder, "customer")
    key, text = F.col("o_orderkey"), F.lit
    year = F.year("o_orderdate").cast("string")
    deeper = F.col("o_orderpriority") < "3"
    markup = F.concat(
        text('<div class="gs_r"><h3 class="gs_rt"><a href="/order/'), key.cast("string"), text('">Order '), F.col("o_orderpriority"),
        text('</a></h3><div class="gs_a"><DIV class="who">'), F.col("c_name"), text('</DIV>, B Author - <div><div>Journal of '),
        F.col("c_mktsegment"), text("</div>, "), year, text('</div> - <div/>lib.example</div><div class="gs_rs">Status <div>'),
        F.when(deeper, F.concat(text("<div>"), F.col("o_orderstatus"), text("</div>"))).otherwise(F.col("o_orderstatus")),
        text(' &amp; <!-- </div> -->more</div>, end</div><div class="gs_fl"><div><a href="/save">Save 7</a></div> <div class="x">'),
        text('<a href="/scholar?cites='), key.cast("string"), text('">Cited by '), F.col("o_custkey").cast("string"),
        text('</a></div></div></div><div class="gs_r"><h3 class="gs_rt">Open</h3><div class="gs_a">'), F.col("c_name"),
        text('<div> - left open - 1999</div> <div class="gs_rs">gone'),
    )
    return dealt(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey").select(
        key.alias("page_id"), F.lit(SITE).alias("url"), markup.alias("html")
    )


def customer_result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Result pages of each customer's orders, one order a page. A page names the next
    page's number; the last one of a customer in the building segment names the first
    page again, the last one of any other none. Pages of pending orders show no record."""
    o = table(spark, folder, "orders", heavy=True)
    c = table(spark, folder, "customer")
    # A customer's own orders.
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    at = F.row_number().over(mine) - 1
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "c_mktsegment", at.alias("at"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n")
    )

    def url(place: Column) -> Column:
        return F.concat(F.lit("/scholar?q="), F.col("o_custkey").cast("string"), F.lit("&start="), (place * 10).cast("string"))

    more = F.when(F.col("at") + 1 < F.col("n"), url(F.col("at") + 1)).when(F.col("c_mktsegment") == "BUILDING", url(F.lit(0)))
    link = F.concat(F.lit('<a href="'), F.replace(more, F.lit("&"), F.lit("&amp;")), F.lit('">'), (F.col("at") + 2).cast("string"), F.lit("</a>"))
    record = F.concat(F.lit('<div class="gs_r"><h3 class="gs_rt">Order '), F.col("o_orderkey").cast("string"), F.lit("</h3></div>"))
    return rows.select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit(SITE), url(F.col("at"))).alias("url"),
        F.concat(F.when(F.col("o_orderstatus") != "P", record).otherwise("no results"), F.coalesce(link, F.lit(""))).alias("html"),
    )


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each market segment."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.min("o_orderkey").alias("start")).select("start")


def customer_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The dearest order of each customer."""
    o = table(spark, folder, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("start")).select("start")


def bylines(spark: SparkSession, folder: str) -> DataFrame:
    """Author lines of several shapes, by order priority."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    year = F.year("o_orderdate").cast("string")
    name, venue = F.col("c_name"), F.concat(F.lit("J "), F.col("c_mktsegment"))
    line = (
        F.when(
            F.col("o_orderpriority").startswith("1"),
            F.concat(name, F.lit(", W Chen - "), venue, F.lit(", "), year, F.lit(" - Wiley")),
        )
        .when(F.col("o_orderpriority").startswith("2"), F.concat(name, F.lit("- "), year, F.lit(" - a.example")))
        .when(F.col("o_orderpriority").startswith("3"), name)
        .when(F.col("o_orderpriority").startswith("4"), F.concat(F.lit(" - "), venue))
        .otherwise(F.concat(name, F.lit(" - "), venue, F.lit(", no year")))
    )
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("ord"), line.alias("byline"))


def part_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon from part names: first word adjective, last word plural-ready noun."""
    names = table(spark, folder, "part").select(F.split("p_name", " ").alias("w"))
    first = names.select(F.element_at("w", 1).alias("token"), F.lit("JJ").alias("tag"))
    last = names.select(F.element_at("w", -1).alias("token"), F.lit("NN").alias("tag"))
    types = table(spark, folder, "part").select(
        F.lower("p_type").alias("token"), F.lit("VB").alias("tag")
    )
    return first.union(last).union(types).groupBy("token").agg(F.min("tag").alias("tag")).withColumn(
        "lemma", F.col("token")
    )


def seed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """One seed title per brand: its dearest part."""
    return (
        part_articles(spark, folder)
        .groupBy("p_brand")
        .agg(F.min_by("title", F.struct(-F.col("p_retailprice"), "ord")).alias("title"))
        .select("title")
        .distinct()
    )
