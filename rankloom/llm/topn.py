"""Problem 1: the N best items of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.sources.tables import table


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``group``, ``item``, ``score`` and ``rank`` (1 to ``n``) of each group's best items.

    An item counts once per group with its highest score; equal scores go by
    ``item`` ascending. Null and NaN scores and null items do not count; a null
    group is a group like any other; a group with fewer items gives all it
    has. Other columns are ignored, whatever their names.

    Plan: the maximum per (group, item) is keyed on both, so a group with a
    third of all rows is spread over all tasks. The row_number filter becomes a
    WindowGroupLimit on both sides of the second shuffle, so each task sends at
    most ``n`` rows of a group.
    """
    s = F.col("s")
    best = (
        df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
        .filter(s.isNotNull() & ~F.isnan(s) & F.col("i").isNotNull())
        .groupBy("g", "i")
        .agg(F.max(s + F.lit(0.0)).alias("s"))
    )
    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    return (
        best.withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= n)
        .select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every query in es_hits."""
    return top_n_per_group(table(spark, sf_dir, "es_hits"), "query_id", "doc_id", "score", 10).select("query_id", "doc_id", "rank")


def p1_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with scores, by shard: the three best documents of every shard."""
    return top_n_per_group(table(spark, sf_dir, "es_hits"), "shard", "doc_id", "score", 3)


QUERIES = {"p1_found": p1_found, "p1_scored": p1_scored}

SQL = {
    "p1_found": """
        SELECT query_id, doc_id, CAST(r AS INTEGER) AS rank FROM (
          SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r
          FROM (SELECT query_id, doc_id, max(score + 0.0) AS s FROM es_hits
                WHERE score IS NOT NULL AND NOT isnan(score) AND doc_id IS NOT NULL GROUP BY ALL))
        WHERE r <= 10""",
    "p1_scored": """
        SELECT shard, doc_id, s AS score, CAST(r AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY shard ORDER BY s DESC, doc_id) AS r
          FROM (SELECT shard, doc_id, max(score + 0.0) AS s FROM es_hits
                WHERE score IS NOT NULL AND NOT isnan(score) AND doc_id IS NOT NULL GROUP BY ALL))
        WHERE r <= 3""",
}
