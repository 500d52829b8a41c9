from pyspark.sql import functions as F

from litsieve.operators import dedup as D

ROWS = [(3, "f1", "a"), (1, "f2", "a"), (7, "f1", "a"), (2, "f1", None), (5, "f2", None), (6, "f1", "b")]
SCHEMA = "ord long, source_file string, title string"


def frame(spark, parts=1):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(parts)


def test_keeps_first_whatever_the_partitioning(spark):
    for parts in (1, 3, 7):
        kept = D.drop_duplicates(frame(spark, parts)).collect()
        assert sorted(r.ord for r in kept) == [1, 2, 6]


def test_marks_and_report_also_with_salted_hot_keys(spark):
    for hot in (1_000_000, 1):
        marked = D.mark_duplicates(frame(spark), hot_rows=hot).collect()
        assert {r.ord: (r.kept_ord, r.is_duplicate) for r in marked} == {
            1: (1, False), 3: (1, True), 7: (1, True), 2: (2, False), 5: (2, True), 6: (6, False),
        }
        report = D.duplicate_report(frame(spark), hot_rows=hot).collect()
        assert sorted((r.ord, r.kept_ord) for r in report) == [(3, 1), (5, 2), (7, 1)]


def test_stats(spark):
    assert D.dedup_stats(frame(spark)).first().asDict() == {"total": 6, "removed": 3, "kept": 3}
    empty = frame(spark).filter("false")
    assert D.dedup_stats(empty).first().asDict() == {"total": 0, "removed": 0, "kept": 0}
    per = {r.source_file: (r.total, r.kept) for r in D.dedup_stats(frame(spark), by="source_file").collect()}
    assert per == {"f1": (4, 3), "f2": (2, 2)}


def test_union_by_name_earlier_frame_wins(spark):
    a = spark.createDataFrame([(9, "x", 2001), (4, "y", 2002), (5, "y", 2003)], "ord long, title string, year int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "title string, ord long")
    got = D.union_dedup([a, b]).collect()
    assert {(r.title, r.ord, r.year) for r in got} == {("x", 9, 2001), ("y", 4, 2002), ("z", 2, None)}


def test_equals_per_frame_then_across(spark):
    frames = [frame(spark).filter(F.col("source_file") == f) for f in ("f2", "f1")]
    two_steps = D.drop_duplicates(
        D.union_by_name([D.drop_duplicates(f) for f in frames]), "title", ["file_rank", "ord"]
    )
    assert set(two_steps.collect()) == set(D.union_dedup(frames).collect())


def test_rank_filter_runs_before_the_shuffle(spark):
    plan = D.drop_duplicates(frame(spark, 3))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
