import random

from litsieve.operators import search as Q
from litsieve.operators import snowball as G

ARTICLES = [
    (1, "Design by analogy", "Ann Lee", 2001, 5, "analogy works"),
    (2, "Analogy in design", "Bob Ray", 2010, 5, None),
    (3, "Other design", "Ann Lee", 2015, 9, "no match"),
    (4, "Design analogy analogy", "Lee Ann", None, 0, "analogous"),
]


def frame(spark):
    schema = "ord long, title string, authors string, year int, citations int, abstract string"
    return spark.createDataFrame(ARTICLES, schema)


def found(spark, *args, **kw):
    return [r.ord for r in Q.search(frame(spark), *args, **kw).collect()]


def test_terms_order_and_limit(spark):
    assert found(spark, "design Analogy") == [1, 4, 2]
    assert found(spark, "design-analogy!") == [1, 4, 2]
    assert found(spark, "design", sort_by="date") == [3, 2, 1, 4]
    assert found(spark, "design", max_results=2, sort_by="date") == [3, 2]


def test_filters(spark):
    assert found(spark, "design", author="ann lee") == [3, 1]
    assert found(spark, "design", year_start=2010) == [3, 2]
    assert found(spark, "design", year_start=2001, year_end=2010) == [1, 2]
    assert len(found(spark, "design", year_start=0)) == 4
    assert found(spark, "design", page=1) == []


def test_accumulate_stops_at_the_first_empty_page(spark):
    pages = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)], "run string, page int")
    records = spark.createDataFrame(
        [("a", 0, 1), ("a", 0, 0), ("a", 1, 0), ("a", 3, 0), ("b", 0, 0)], "run string, page int, pos int"
    )
    got = Q.accumulate_pages(pages, records, "run", "page", "pos", 2).collect()
    assert sorted((r.run, r.page, r.pos) for r in got) == [("a", 0, 0), ("a", 0, 1), ("b", 0, 0)]
    got = Q.accumulate_pages(pages, records, "run", "page", "pos", 9).collect()
    assert sorted((r.run, r.page) for r in got) == [("a", 0), ("a", 0), ("a", 1), ("b", 0)]


EDGES = [(2, 1), (3, 1), (4, 1), (1, 9), (2, 9), (3, 9), (3, 8), (1, 8), (1, 1), (7, 6)]


def test_directions_and_cap(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    seeds = spark.createDataFrame([(1,), (5,), (99,)], "seed long")
    assert sorted(r.found for r in G.cited_by(seeds, edges).collect()) == [2, 3, 4]
    assert sorted(r.found for r in G.references(seeds, edges).collect()) == [8, 9]
    assert {r.found: r.score for r in G.related(seeds, edges).collect()} == {2: 2, 3: 3, 4: 1}
    got = G.snowball(edges, seeds, cap=2).collect()
    assert sorted((r.direction, r["rank"], r.found) for r in got) == [
        ("cited_by", 1, 2), ("cited_by", 2, 3), ("references", 1, 8), ("references", 2, 9),
        ("related", 1, 3), ("related", 2, 2),
    ]
    both = {r.found: r.directions for r in G.merged(G.snowball(edges, seeds, cap=2)).collect()}
    assert both == {2: "cited_by,related", 3: "cited_by,related", 8: "references", 9: "references"}


def test_resolve_seeds(spark):
    seeds = spark.createDataFrame([("DESIGN: by analogy",), ("unknown",), (None,)], "title string")
    got = G.resolve_seeds(seeds, frame(spark)).collect()
    assert [(r.seed_title, r.seed) for r in got] == [("DESIGN: by analogy", 1)]


def test_seeds_by_best_score(spark):
    articles = spark.createDataFrame(
        [(3, "Facilitating design by analogy"), (5, "facilitating design-by-analogy"), (7, "Facilitating design by analogie"), (9, "Else")],
        "ord long, title string",
    )
    seeds = spark.createDataFrame([("Facilitating DESIGN by analogy",), ("Facilitating design by analogies",), ("Unlike all",), (None,)], "title string")
    got = {r.seed_title: (r.seed, round(r.similarity, 2)) for r in G.resolve_seeds_by_score(seeds, articles).collect()}
    assert got == {"Facilitating DESIGN by analogy": (3, 1.0), "Facilitating design by analogies": (7, 0.98)}


def test_many_searches_are_the_single_ones(spark):
    rng = random.Random(3)
    names = ["red", "blue", "Green", "été", "x_1", "data-driven"]
    rows = [
        (i, " ".join(rng.choices(names, k=4)), rng.choice([None, " ".join(rng.choices(names, k=3))]), rng.choice(["A Lee", "b lee", None]),
         rng.choice([None, 1990, 2000, 2010]), rng.choice([None, 0, 5, 9]))
        for i in range(200)
    ]
    articles = spark.createDataFrame(rows, "ord long, title string, abstract string, authors string, year int, citations int")
    asked = [
        (1, "red blue", None, None, None, None, None), (2, "RED, red!", "LEE", 1995, None, "date", 7), (3, "été", "", 0, 2005, "relevance", 500),
        (4, "nothing", None, None, None, None, 5), (5, "", "a", 2000, 2010, "date", 9), (6, "data driven", None, None, None, "date", 0),
        (7, None, None, None, None, None, 3),
    ]
    got = {}
    index = Q.term_index(articles)
    for r in Q.search_many(index, articles, spark.createDataFrame(asked, Q.REQUEST)).orderBy("request", "place").collect():
        got.setdefault(r.request, []).append((r.ord, r.hits))
    for request, query, author, start, end, by, most in asked:
        one = Q.search(articles, query or "", author, start, end, by or "relevance", 100 if most is None else most).collect()
        assert got.get(request, []) == [(r.ord, r.hits) for r in one], request
    assert Q.search_many(index, articles, spark.createDataFrame([], Q.REQUEST)).collect() == []
