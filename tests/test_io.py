import csv
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from litsieve.operators import fuzzy
from litsieve.plans import screening
from litsieve.schema import COLUMN_ORDER, require_columns
from litsieve import session
from litsieve.sources import io

HEAD = ["title", "authors", "year", "journal", "citations", "abstract", "url"]


def write(path, header, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


@pytest.fixture
def files(tmp_path):
    a = write(tmp_path / "z.csv", HEAD, [
        ['Say "x", he ‐ said', "A", "", "2011", "3", "two\nlines", "u1"],
        ["Same", "B", "1999", "j", "n/a", "", ""],
        ["Same", "C", "2000", "j", "1", "", ""],
    ])
    b = write(tmp_path / "a.csv", ["title", "url", "authors"], [["Only", "u", "D"], ["Same", "v", "E"]])
    c = write(tmp_path / "bad.csv", ["Rank", "Author", "Title"], [["1", "x", "Same"]])
    return [a, b, c]


def test_read_in_list_order_by_name(spark, files):
    rows, bad = io.read_articles(spark, files)
    got = rows.orderBy("ord").collect()
    assert [r.title for r in got] == ['Say "x", he ‐ said', "Same", "Same", "Only", "Same"]
    assert [r.year for r in got] == [None, 1999, 2000, None, None]
    assert [r.citations for r in got][:3] == [3, None, 1] and got[0].abstract == "two\nlines"
    assert got[3].url == "u" and got[3].journal is None
    (r,) = bad.collect()
    assert r.file == files[2] and "Title" in r.reason


def test_merge_keeps_the_first_of_the_first_file(spark, files):
    kept, _ = io.merge_files(spark, files)
    assert {(r.title, r.authors) for r in kept.collect()} == {('Say "x", he ‐ said', "A"), ("Same", "B"), ("Only", "D")}
    kept, _ = io.merge_files(spark, [files[1], files[0]])
    assert ("Same", "E") in {(r.title, r.authors) for r in kept.collect()}


def test_errors(spark, files, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_articles(spark, [str(tmp_path / "none.csv")])
    with pytest.raises(ValueError):
        io.read_articles(spark, files[2:])
    with pytest.raises(FileNotFoundError):
        io.list_files(spark, str(tmp_path), "*.tsv")
    assert [f.rsplit("/", 1)[1] for f in io.list_files(spark, str(tmp_path))] == ["a.csv", "bad.csv", "z.csv"]
    with pytest.raises(ValueError):
        require_columns(spark.createDataFrame([("x",)], "Title string"), "title")


def test_round_trips(spark, files, tmp_path):
    rows, _ = io.read_articles(spark, files[:1])
    want = sorted(map(tuple, rows.select(COLUMN_ORDER).collect()), key=str)
    assert io.write_articles(rows, str(tmp_path / "c"), "CSV")
    back, _ = io.read_articles(spark, io.list_files(spark, str(tmp_path / "c")))
    blank = lambda r: tuple(None if v == "" else v for v in r)
    assert sorted(map(blank, back.select(COLUMN_ORDER).collect()), key=str) == sorted(map(blank, want), key=str)
    assert io.write_articles(rows, str(tmp_path / "j"), "json")
    line = spark.read.text(str(tmp_path / "j")).first().value
    assert "‐" in line and '"year":null' in line
    assert io.write_articles(rows, str(tmp_path / "p"), "parquet", partition_by="source_file")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert not io.write_articles(rows.filter("false"), str(tmp_path / "e"))
    assert not (tmp_path / "e").exists()
    with pytest.raises(ValueError):
        io.write_articles(rows, files[0], inputs=files)


@pytest.mark.parametrize("name", ["b file.csv", "50%25 a#b.csv", "é [1] {x}*.csv", "plain.csv"])
def test_files_by_the_path_a_user_types(spark, tmp_path, name):
    path = write(tmp_path / name, HEAD, [["T", "A", "", "", "", "", ""]])
    relative = os.path.relpath(path)
    for typed in (path, relative, f"./{relative}"):
        rows, bad = io.read_articles(spark, [typed])
        assert [(r.title, r.source_file) for r in rows.collect()] == [("T", typed)] and bad.count() == 0
    if "%" not in name and "#" not in name:
        assert io.read_articles(spark, [f"file:{path}"])[0].count() == 1


def test_order_without_multi_line(spark, tmp_path):
    a = write(tmp_path / "a.csv", ["title"], [[f"t{i}"] for i in range(3000)])
    b = write(tmp_path / "b.csv", ["title"], [["last"]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, _ = io.read_articles(spark, [a, b], multi_line=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.title for r in rows.orderBy("ord").collect()] == [*(f"t{i}" for i in range(3000)), "last"]


def test_write_keeps_all_columns(spark, files, tmp_path):
    rows, _ = io.read_articles(spark, files[:1])
    more = rows.withColumn("is_duplicate", F.lit(False))
    io.write_articles(more, str(tmp_path / "all"), "parquet")
    assert spark.read.parquet(str(tmp_path / "all")).columns == [*COLUMN_ORDER, "source_file", "file_rank", "ord", "is_duplicate"]
    io.write_articles(more, str(tmp_path / "few"), "parquet", article_columns_only=True)
    assert spark.read.parquet(str(tmp_path / "few")).columns == COLUMN_ORDER


def test_writes_count_in_one_pass(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.range(10, numPartitions=2).selectExpr("concat('t', id) AS title").mapInArrow(seen, "title string")
    path = str(tmp_path / "out")
    for fmt in ("csv", "json", "parquet"):
        runs.value = 0
        assert io.counted_write(df, path, fmt) == 10 and runs.value == 10
    assert spark.read.parquet(path).count() == 10
    assert io.counted_write(df.filter("title = 'x'"), path) == 0  # what is there stays
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["out"]
    more = df.limit(3).withColumn("n", F.length("title"))
    assert io.counted_write(more, path, "parquet", partition_by="n") == 3
    assert spark.read.parquet(path).count() == 3


def test_write_never_touches_an_input(spark, files, tmp_path):
    rows, _ = io.read_articles(spark, files[:2])
    for target in (files[0], str(tmp_path), f"{files[1]}/x", f"file:{tmp_path}/"):
        with pytest.raises(ValueError, match="overlaps"):
            io.write_articles(rows, target)  # known without a list of inputs
    with pytest.raises(ValueError, match="overlaps"):
        io.write_articles(spark.range(1).withColumn("title", F.lit("x")), str(tmp_path), inputs=[files[0]])
    assert (tmp_path / "z.csv").exists()


def test_scratch_is_removed(spark):
    with session.scratch(spark) as folder:
        made = session.durable(spark.range(5), "x")
        assert made.count() == 5 and Path(folder).exists()
    assert not Path(folder).exists()


def test_names_and_pages(spark, tmp_path):
    assert io.result_name("x", "exact") == "x_cleaned" and io.result_name("x", "fuzzy") == "x_intelligent_cleaned"
    df = spark.createDataFrame([("Data-driven design by analogy",)], "t string")
    assert df.select(io.seed_name(F.col("t"))).first()[0] == "Data-driven_design_b"
    (tmp_path / "p1.html").write_text("<p>a\nb</p>")
    assert io.read_pages(spark, str(tmp_path)).first().html == "<p>a\nb</p>"


def test_frames_that_number_their_rows_alike(spark):
    one = spark.createDataFrame([(1, "Case based reasoning"), (2, "Unlike")], "ord long, title string")
    two = spark.createDataFrame([(1, "Something else"), (2, "[B]Case-based reasoning")], "ord long, title string")
    got = screening.screen([one, two], threshold=0.85).collect()
    assert sorted((r.file_rank, r.ord) for r in got) == [(0, 1), (0, 2), (1, 1)]
    with pytest.raises(ValueError, match="more than one row"):
        fuzzy.fuzzy_matches(one.union(two))


def test_screen(spark):
    one = spark.createDataFrame([(1, "Case based reasoning"), (2, "Unlike")], "ord long, title string")
    two = spark.createDataFrame([(3, "Unlike"), (4, "[B]Case-based reasoning")], "ord long, title string")
    got = screening.screen([one, two], threshold=0.85).collect()
    assert sorted(r.ord for r in got) == [1, 2]
    report = screening.fuzzy_report(one.union(two), threshold=0.85).first().asDict()
    assert report == {"total": 4, "comparisons": 4, "removed": 2, "kept": 2, "leaders": 2, "skipped": 4}
