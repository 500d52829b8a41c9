"""Key lookup that stays balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000


def lookup_by_key(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join ``rows`` to ``lookup``, whose lines say in ``n_rows`` how many
    rows have their key.

    A key with more than ``hot_rows`` rows is spread by the hash of ``spread``, over as
    many tasks as it has times that many rows; its lookup line is repeated once per
    task. Keys compare null-safe. Adds the lookup's other columns, without ``n_rows``.
    """
    key_hash = F.xxhash64(*keys)
    # At most total_rows / hot_rows lines of 16 bytes: small enough to broadcast.
    hot = (
        lookup.filter(F.col("n_rows") > hot_rows)
        .groupBy(key_hash.alias("_hash"))
        .agg(F.ceil(F.sum("n_rows") / hot_rows).alias("_hot"))
    )
    salted_rows = (
        rows.withColumn("_hash", key_hash)
        .join(F.broadcast(hot), "_hash", "left")
        .withColumn(
            "_salt",
            F.pmod(F.xxhash64(spread), F.coalesce("_hot", F.lit(1))),
        )
        .drop("_hot")
        .alias("r")
    )
    hot_lookup = (
        lookup.withColumn("_hash", key_hash)
        .join(F.broadcast(hot), "_hash", "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1)),
        )
        .alias("l")
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys],
        (F.col("r._hash") == F.col("l._hash")) & (F.col("r._salt") == F.col("l._salt")),
    )
    added = [c for c in lookup.columns if c not in (*keys, "n_rows")]
    return salted_rows.join(hot_lookup, same).select(
        *[F.col(f"r.{c}") for c in rows.columns], *[F.col(f"l.{c}") for c in added]
    )
