import random

import pytest
from pyspark.sql import functions as F

from litsieve.functions.similarity import EPS, MEASURES, edits_udf, lacks_more
from litsieve.operators import fuzzy as Z
from litsieve.session import durable
from test_fuzzy import score


def near_titles(n):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh ", k=rng.choice([30, 90, 150]))).strip() for _ in range(n)]
    edited = ["".join(c for c in t if rng.random() > 0.1) for t in base]
    return [(i, t) for i, t in enumerate(base + edited)]


def test_candidates_are_decided_where_they_meet(spark):
    rows = spark.createDataFrame(near_titles(30), "ord long, title string")
    for metric in ("levenshtein", "ratcliff"):
        measure = MEASURES[metric](0.85)
        reps = durable(Z.representatives(rows, "title", "ord", measure, 20), "titles")
        assert "grams" not in reps.columns
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = Z.edges_within(reps, 60, 0.85, 20, measure, route="blocks")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count("SortMergeJoin") == 1


def test_long_titles_have_no_parts(spark):
    rows = spark.createDataFrame([(1, "abcdefgh " * 500), (2, "abcdefghij " * 6), (3, "abcdefgh " * 12 + "abc")], "ord long, title string")
    measure = MEASURES["levenshtein"](0.95)
    reps = durable(Z.representatives(rows, "title", "ord", measure, 20), "titles")
    got = {r.ord: (r.poor, r.n) for r in Z._share_rows(reps, 20, measure).select("ord", "poor", F.size("keys").alias("n")).collect()}
    assert got[1] == (True, 0)
    assert got[2][0] is False or got[2][1] > 0
    assert got[3][0] and got[3][1] > 0  # a shorter one may be similar to it


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_close_loses_no_pair(spark, threshold):
    rng, pairs = random.Random(8), []
    for _ in range(300):
        a = "".join(rng.choices("abcdef ", k=rng.randrange(1, 120))).strip() or "a"
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        pairs.append((a, "".join(b) or "b"))
    table = spark.createDataFrame(pairs, "a string, b string")
    kept = {(r.a, r.b) for r in table.filter(edits_udf(threshold)("a", "b")).collect()}
    for a, b in pairs:
        if score("levenshtein", a, b) >= threshold - EPS:
            assert (a, b) in kept


def test_lacks_more():
    assert lacks_more("abcdefgh", "zzzzzzzz", 4, 4, 4)
    assert not lacks_more("abcdefgh", "abcdefgx", 4, 4, 4)
