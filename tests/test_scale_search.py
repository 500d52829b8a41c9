import random

from litsieve.operators import search as Q

REQUESTS = Q.REQUEST
ARTICLE = "ord long, title string, authors string, year int, citations int, abstract string"


def test_common_words_meet_no_request_by_themselves(spark, monkeypatch):
    articles = spark.createDataFrame(
        [(i, f"order number {i}", "A", 2000, i, "status" if i % 2 else "rare" if i == 40 else None) for i in range(60)], ARTICLE
    )
    requests = spark.createDataFrame(
        [(1, "Order number", None, None, None, None, 5), (2, "order rare", None, None, None, None, 5), (3, "order absent", None, None, None, None, 5)],
        REQUESTS,
    )
    written = []
    monkeypatch.setattr(Q, "durable", lambda df, name, f=Q.durable: written.append((name, out := f(df, name))) or out)
    got = Q.search_many(Q.term_index(articles), articles, requests).collect()
    assert [r.ord for r in sorted(got, key=lambda r: r.place) if r.request == 1] == [59, 58, 57, 56, 55]
    assert [(r.request, r.ord) for r in got if r.request > 1] == [(2, 40)]
    rare = {r["_request"]: r["_rare"] for r in dict(written)["wanted"].collect()}
    assert rare[2] == ["rare"] and rare[3] == ["absent"] and len(rare[1]) == 1


def test_many_searches_as_one_by_one(spark):
    rng = random.Random(5)
    words = ["the"] * 9 + "of design analogy case rare method a b c".split()
    rows = [
        (i, " ".join(rng.choices(words, k=rng.randrange(6))), rng.choice(["Ann Lee", "Bob", None]), rng.choice([1999, 2005, None]), rng.randrange(4),
         " ".join(rng.choices(words, k=3))) for i in range(150)
    ]
    articles = spark.createDataFrame(rows, ARTICLE).repartition(4)
    asked = [
        (i, " ".join(rng.sample(sorted(set(words)) + ["missing"], rng.randrange(4))), rng.choice([None, "lee", ""]), rng.choice([None, 2000]), None,
         rng.choice(["date", "relevance", None]), rng.choice([3, 40, None])) for i in range(12)
    ]
    got = {}
    for r in Q.search_many(Q.term_index(articles), articles, spark.createDataFrame([*asked, (None, "the", None, None, None, None, 3)], REQUESTS)).collect():
        got.setdefault(r.request, []).append((r.place, r.ord, r.hits))
    for request, query, author, start, end, by, most in asked:
        want = Q.search(articles, query, author, start, end, by or "relevance", 100 if most is None else most).select("ord", "hits").collect()
        assert sorted(got.get(request, [])) == [(i, r.ord, r.hits) for i, r in enumerate(want, 1)], query
