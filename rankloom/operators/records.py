"""Current records of upsert logs, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_records(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[Column | str]) -> DataFrame:
    """One row per ``key``: the row greatest by ``order``, with the columns ``keep``.

    One aggregation with a map-side part, so a key that holds most rows
    reaches its reducer as one row per task. Only ``key``, ``order`` and
    ``keep`` are shuffled: compute small columns before, not after. Rows equal
    in ``order`` are decided by ``keep``, left to right. A null in ``order``
    sorts first, so it never beats a value. Rows with a null key are left out:
    they name no record. An empty table gives an empty table.
    """
    kept = [F.col(c) if isinstance(c, str) else c for c in keep]
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*kept).alias("_kept"))
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key))
        .agg(F.max(row).alias("_row"))
        .select(key, "_row._kept.*")
    )


def skew_safe_left_join(left: DataFrame, right: DataFrame, key: str, share: int = 256) -> DataFrame:
    """Left join to a ``right`` that is unique in ``key``, whatever the skew of ``left``.

    Keys that hold at least 1/``share`` of ``left`` are hot. There are at most
    ``share`` of them and ``right`` has one row for each, so that part is
    broadcast with a proven bound; all other keys join by shuffle, and none of
    them is large. Null keys are kept, unmatched, and are not shuffled to one
    task. Columns of ``right`` other than ``key`` must not occur in ``left``.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.agg(F.count(F.lit(1)).alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share >= F.col("_all")).select(key)
    hot_right = right.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    flagged = left.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), key, "left")
    warm = flagged.filter("_is_hot").drop("_is_hot").join(F.broadcast(hot_right), key, "left").drop("_hot")
    rest = flagged.filter(F.col("_is_hot").isNull() & F.col(key).isNotNull()).drop("_is_hot").join(right, key, "left")
    none = left.filter(F.col(key).isNull())
    for c in right.columns:
        if c != key:
            none = none.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    return warm.unionByName(rest).unionByName(none)
