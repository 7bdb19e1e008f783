"""Problem 5: one ranking from several differently scaled scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.sources.tables import table


def long_hits(df: DataFrame, group: str, lists: Sequence[str], item: str = "doc_id", score: str = "score") -> DataFrame:
    """``g``, ``l`` (position of the list), ``i``, ``s`` of nested hit lists, one row per list and item.

    An item counts once per list with its highest score, over all rows of its
    group; hits without a score (null, NaN) or item don't count. Null and empty
    lists give nothing. Repeated rows vanish in the map-side aggregation.
    """
    def as_list(k: int):
        return lambda h: F.struct(F.lit(k).alias("l"), h[item].alias("i"), h[score].cast("double").alias("s"))

    parts = [F.transform(F.coalesce(F.col(name), F.array()), as_list(k)) for k, name in enumerate(lists)]
    hits = df.select(F.col(group).alias("g"), F.explode(F.concat(*parts)).alias("h")).select("g", "h.*")
    return hits.filter(F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")).groupBy("g", "l", "i").agg(F.max(F.col("s") + F.lit(0.0)).alias("s"))


def with_lists(df: DataFrame, group: str, lists: Sequence[str], least: int, item: str = "doc_id", score: str = "score") -> DataFrame:
    """``g`` of the groups in which at least ``least`` lists have a hit that counts; no list is unfolded."""
    counts = lambda h: h[item].isNotNull() & h[score].isNotNull() & ~F.isnan(h[score].cast("double"))
    has = [F.max(F.coalesce(F.exists(F.col(c), counts), F.lit(False)).cast("int")).alias(f"_l{k}") for k, c in enumerate(lists)]
    return df.groupBy(F.col(group).alias("g")).agg(*has).filter(sum((F.col(f"_l{k}") for k in range(len(lists))), F.lit(0)) >= least).select("g")


def leximin_ranking(hits: DataFrame, n_lists: int, groups: DataFrame | None = None) -> DataFrame:
    """``g``, ``i``, ``shares`` (ascending), ``rank`` of each group's items in leximin order.

    ``hits`` has ``g``, ``l``, ``i``, ``s``, unique in the first three. A score
    becomes the share of its list's items that it reaches or beats, so only the
    order within a list counts, ties count alike, and no range dominates. An
    item's shares, 0 for a list without it, are sorted ascending and compared
    from the weakest on, greater first: a strong score never hides a weak one.
    Equal vectors go by item. Only the ``groups`` (a table of ``g``), where
    given, are ranked. A list of one group is ranked in one task.
    """
    per_list = Window.partitionBy("g", "l").orderBy("s")
    shared = hits.withColumn("p", F.cume_dist().over(per_list))
    vectors = shared.groupBy("g", "i").agg(F.collect_list("p").alias("v"))
    group = Window.partitionBy("g")
    order = group.orderBy(F.col("shares").desc(), F.col("i").asc())
    padded = F.sort_array(F.concat(F.col("v"), F.array_repeat(F.lit(0.0), F.lit(n_lists) - F.size("v"))))
    if groups is not None:
        vectors = vectors.join(groups, "g", "left_semi")
    ranked = vectors.withColumn("shares", padded).withColumn("rank", F.row_number().over(order))
    return ranked.select("g", "i", "shares", "rank")


LISTS = ("es_hybrid", "faiss_dense", "hnsw_sparse")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of every query: ``query_id``, ``doc_id``, ``weakest``, ``rank``."""
    ranked = leximin_ranking(long_hits(table(spark, sf_dir, "query_results"), "query_id", LISTS), len(LISTS))
    return ranked.select(F.col("g").alias("query_id"), F.col("i").alias("doc_id"), F.round(F.get("shares", F.lit(0)), 6).alias("weakest"), "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading documents of each query with at least two non-empty lists."""
    results = table(spark, sf_dir, "query_results")
    ranked = leximin_ranking(long_hits(results, "query_id", LISTS), len(LISTS), with_lists(results, "query_id", LISTS, 2))
    return ranked.filter("rank <= 3").select(F.col("g").alias("query_id"), F.col("i").alias("doc_id"))


QUERIES = {"p5_found": p5_found, "p5_ranking": p5_ranking}

_P5 = """
  WITH h AS (
    SELECT query_id, l, u.doc_id AS doc_id, max(u.score + 0.0) AS s FROM (
      SELECT query_id, 0 AS l, unnest(es_hybrid) AS u FROM query_results UNION ALL
      SELECT query_id, 1, unnest(faiss_dense) FROM query_results UNION ALL
      SELECT query_id, 2, unnest(hnsw_sparse) FROM query_results)
    WHERE u.doc_id IS NOT NULL AND u.score IS NOT NULL AND NOT isnan(u.score) GROUP BY ALL),
  p AS (SELECT *, cume_dist() OVER (PARTITION BY query_id, l ORDER BY s) AS p FROM h),
  v AS (SELECT query_id, doc_id, list_sort(list_concat(list(p), list_resize(CAST([] AS DOUBLE[]), 3 - count(*), 0.0))) AS shares
        FROM p GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shares DESC, doc_id) AS r FROM v)
"""
SQL = {
    "p5_found": _P5 + "SELECT query_id, doc_id FROM r WHERE r <= 3 AND query_id IN (SELECT query_id FROM h GROUP BY 1 HAVING count(DISTINCT l) >= 2)",
    "p5_ranking": _P5 + "SELECT query_id, doc_id, round(shares[1], 6) AS weakest, CAST(r AS INTEGER) AS rank FROM r",
}
