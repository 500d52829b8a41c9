"""Article files: CSV in, CSV / JSON lines / Parquet out."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from litsieve.operators.dedup import drop_duplicates
from litsieve.schema import ARTICLE_SCHEMA, in_column_order
from litsieve.session import durable, plain_path, sources_of

REJECTED_SCHEMA = "file string, reason string"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """Files of a folder by name; a missing or empty folder is an error."""
    try:
        rows = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(folder)
            .select("path")
            .collect()
        )
    except AnalysisException as e:
        raise FileNotFoundError(folder) from e
    if not rows:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return sorted(r["path"] for r in rows)


def _literal(file: str) -> str:
    """The path with the characters escaped that a file pattern would read."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def _header_line(spark: SparkSession, file: str) -> tuple[str, str | None]:
    """First line of a file, and the name that Spark gives to the file: one small
    job that stops at the first row it meets. An empty file has neither."""
    try:
        lines = spark.read.text(_literal(file)).filter(F.col("_metadata.file_block_start") == 0)
        first = lines.select("value", "_metadata.file_path").head(1)
    except AnalysisException as e:
        raise FileNotFoundError(f"cannot read {file}") from e
    return (first[0]["value"].lstrip("\ufeff"), first[0]["file_path"]) if first else ("", None)


def _typed(df: DataFrame) -> DataFrame:
    """Article columns in their types; numbers that do not parse become null."""
    casts: dict[str, Column] = {}
    for field in ARTICLE_SCHEMA:
        if field.name not in df.columns:
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.IntegerType):
            c = c.try_cast("double").try_cast("int")
        casts[field.name] = c
    return df.withColumns(casts)


def read_articles(
    spark: SparkSession,
    files: Sequence[str],
    required: Sequence[str] = ("title",),
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Read CSV files in the listed order: (articles, rejected files).

    A file whose header lacks a required column (case matters) is rejected with
    a reason and the others go on. Files are read once per distinct header and
    united by column name. ``source_file`` (as given in ``files``), ``file_rank`` and
    ``ord`` say where a row stood; ``ord`` follows list order, then row order, and is
    written out once so that it never changes. With ``multi_line`` a field may hold
    line feeds and a file is one task; without, large files are split.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    rejected, names = [], []
    for rank, f in enumerate(files):
        line, name = _header_line(spark, f)
        names.append((name, f, rank))
        columns = tuple(next(csv.reader([line]), []))
        missing = [c for c in required if c not in columns]
        if missing:
            rejected.append((f, f"missing column(s) {missing}; available: {list(columns)}"))
        else:
            by_header.setdefault(columns, []).append(f)
    bad = spark.createDataFrame(rejected, REJECTED_SCHEMA)
    if not by_header:
        raise ValueError(f"no usable file: {rejected}")
    # One line per file, made of the caller's list.
    ranks = spark.createDataFrame(names, "_name string, source_file string, file_rank int")
    frames = []
    for columns, paths in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        frames.append(
            spark.read.schema(schema)
            .csv([_literal(p) for p in dict.fromkeys(paths)], header=True, escape='"', multiLine=multi_line, enforceSchema=True)
            .withColumns(
                {
                    "_name": F.col("_metadata.file_path"),
                    # Rows of a block are fewer than its bytes, so the sum rises within a file.
                    "_row": F.col("_metadata.file_block_start")
                    + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
                }
            )
        )
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    # Columns of those names in the files give way.
    placed = rows.drop("source_file", "file_rank", "ord").join(F.broadcast(ranks), "_name")
    numbered = placed.withColumn(
        "ord", F.shiftleft(F.col("file_rank").cast("long"), 43) + F.col("_row")
    ).drop("_name", "_row")
    return durable(_typed(numbered), "articles"), bad


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved result pages, one per file: page_id, url, html."""
    return spark.read.text(folder, wholetext=True).select(
        F.xxhash64("_metadata.file_path").alias("page_id"),
        # The key where there are so many pages that two ids could be equal.
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )


def write_articles(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    inputs: Sequence[str] = (),
    partition_by: str | None = None,
    article_columns_only: bool = False,
) -> bool:
    """Write a folder of parts; False and nothing left when there are no rows.

    The article columns come first, in their order, then all others;
    ``article_columns_only`` drops those. A target that is, holds, or lies inside a
    file that ``df`` is made from, or one of ``inputs``, is refused. An existing folder
    is replaced, but not by a frame without rows: the rows are written next to it and
    counted on the way, so the plan runs once.
    """
    return counted_write(df, path, fmt, inputs, partition_by, article_columns_only) > 0


def counted_write(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    inputs: Sequence[str] = (),
    partition_by: str | None = None,
    article_columns_only: bool = False,
) -> int:
    """``write_articles``, giving the number of rows written."""
    target = plain_path(path).rstrip("/")
    for source in sources_of(df) | {plain_path(p).rstrip("/") for p in inputs}:
        if f"{source}/".startswith(f"{target}/") or f"{target}/".startswith(f"{source}/"):
            raise ValueError(f"{path} overlaps the input {source}; write to another path")
    first = in_column_order(df).columns
    others = [c for c in df.columns if c not in first]
    if article_columns_only:
        others = [c for c in others if c == partition_by]
    seen = Observation()
    writer = df.select(*first, *others).observe(seen, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    kind = fmt.lower()
    if kind == "csv":
        writer.csv(aside, header=True, escape='"')
    elif kind == "parquet":
        writer.parquet(aside)
    else:
        writer.json(aside, ignoreNullFields=False)
    rows = seen.get["rows"]
    spark = df.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
    files = new.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not rows:
        files.delete(new, True)
        return 0
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{aside} could not be moved to {path}")
    return rows


def result_name(stem: str, stage: str) -> str:
    """``<stem>_cleaned`` for the exact stage, ``<stem>_intelligent_cleaned``."""
    return f"{stem}_{ {'exact': 'cleaned', 'fuzzy': 'intelligent_cleaned'}[stage]}"


def seed_name(title: Column) -> Column:
    """First 20 characters of a seed title, blanks as underscores."""
    return F.replace(F.substring(title, 1, 20), F.lit(" "), F.lit("_"))


def merge_files(
    spark: SparkSession, files: Sequence[str], key: str = "title"
) -> tuple[DataFrame, DataFrame]:
    """Exact screening of a list of files: (kept articles, rejected files)."""
    articles, bad = read_articles(spark, files, (key,))
    return drop_duplicates(articles, key, "ord"), bad
