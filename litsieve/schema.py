"""The article record."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("journal", T.StringType()),
        T.StructField("citations", T.IntegerType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

COLUMN_ORDER = ARTICLE_SCHEMA.fieldNames()


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail when a column is absent. Case matters, unlike Spark's own lookup."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available: {df.columns}")
    return df


def in_column_order(df: DataFrame) -> DataFrame:
    """Keep the article columns that exist, in their fixed order."""
    return df.select([c for c in COLUMN_ORDER if c in df.columns])
