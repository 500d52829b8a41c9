from litsieve.operators import extract as P


def test_walks_that_go_on_together_are_written_once_a_round(spark, monkeypatch):
    hops = spark.createDataFrame([(i, i + 1) for i in range(40)], "page_id long, next_page_id long")
    starts = spark.createDataFrame([(0,), (1,)], "start long")
    written = []
    monkeypatch.setattr(P, "durable", lambda df, name, f=P.durable: written.append(name) or f(df, name))
    walks = P.walk_pages(hops, starts)
    assert written.count("walk") == 7  # the starts and 2, 4, .. 64 places
    assert "Join" not in walks._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.start, r.place): r.page for r in walks.collect()}
    assert got == {(s, n): s + n for s in (0, 1) for n in range(41 - s)}
