"""Fusion of ranked lists. Lists are rows: query_id, list (position of the list), pos (from 1), doc_id, score, content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.records import current_records
from rankloom.sources.tables import table

#: What the worst document of a list still gets; a missing one gets nothing.
FLOOR = 0.1
#: Fused scores are rounded to so many digits before they are ranked.
DIGITS = 9
STRATEGIES = ("linear", "rrf")


def nested_lists(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of nested hit lists, in stored order. Hits without an id or a score (null, NaN) are left out before positions are given."""
    parts = []
    for i, name in enumerate(names):
        live = F.filter(F.coalesce(F.col(name), F.array()), lambda h: h["doc_id"].isNotNull() & h["score"].isNotNull() & ~F.isnan(h["score"]))
        parts.append(df.select("query_id", F.lit(i).alias("list"), F.posexplode(live).alias("p", "h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", "list", (F.col("p") + 1).alias("pos"), "h.doc_id", "h.score", F.coalesce("h.content", F.lit("")).alias("content"))


def normalize(lists: DataFrame) -> DataFrame:
    """query_id, list, doc_id, pos (first), norm: scores from FLOOR to 1 within each list.

    All 1 where a list has one score only. The range is that of all hits; of a
    document that is there twice the last hit counts.
    """
    each = Window.partitionBy("query_id", "list")
    low, high = F.min("score").over(each), F.max("score").over(each)
    norm = F.when(high == low, F.lit(1.0)).otherwise(FLOOR + (1 - FLOOR) * ((F.col("score") - low) / F.nullif(high - low, F.lit(0.0))))
    return lists.withColumn("norm", norm).groupBy("query_id", "list", "doc_id").agg(F.min("pos").alias("pos"), F.max_by("norm", "pos").alias("norm"))


def _weights(spark: SparkSession, weights: Mapping[int, float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "list int, w double"))


def _ranked(parts: DataFrame, keys: Sequence[str], k: int | None) -> DataFrame:
    """Sum of ``part``; ties by first appearance: list, then position."""
    fused = parts.groupBy(*keys, "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.min(F.struct("list", "pos")).alias("_first"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("_first"), F.col("doc_id"))
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return (ranked.filter(F.col("rank") <= k) if k else ranked).select(*keys, "doc_id", "score", "rank")


def fuse(lists: DataFrame, strategy: str, weights: Mapping[int, float], k: int | None = None, rrf_k: int = 60) -> DataFrame:
    """query_id, doc_id, score, rank of the fused ranking.

    linear: the weighted sum of normalised scores. rrf: the sum of
    weight / (rrf_k + position), and a document that is in a list twice gets
    both. A list of weight 0 still brings its documents, at 0. Lists without a
    weight are left out. Equal scores stay in order of first appearance.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown fusion strategy: {strategy}")
    w = _weights(lists.sparkSession, weights)
    if strategy == "linear":
        parts = normalize(lists).join(w, "list").withColumn("part", F.col("w") * F.col("norm"))
    else:
        parts = lists.join(w, "list").withColumn("part", F.col("w") / (rrf_k + F.col("pos")))
    return _ranked(parts, ["query_id"], k)


def contents(lists: DataFrame) -> DataFrame:
    """query_id, doc_id, content: that of the last list (and hit) which has one; empty where none has."""
    last = F.max_by("content", F.when(F.col("content") != "", F.struct("list", "pos")))
    return lists.groupBy("query_id", "doc_id").agg(F.coalesce(F.when(F.max("content") != "", last), F.lit("")).alias("content"))


def fusion_sweep(lists: DataFrame, alphas: Sequence[float], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """strategy, alpha, query_id, doc_id, score, rank: lists 0 and 1 at alpha and 1 - alpha, for every setting in one plan."""
    params = F.broadcast(lists.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double"))
    two = lists.filter(F.col("list") < 2)
    w = F.when(F.col("list") == 0, F.col("alpha")).otherwise(1 - F.col("alpha"))
    linear = normalize(two).crossJoin(params).select(F.lit("linear").alias("strategy"), "alpha", "query_id", "doc_id", "list", "pos", (w * F.col("norm")).alias("part"))
    rrf = two.crossJoin(params).select(F.lit("rrf").alias("strategy"), "alpha", "query_id", "doc_id", "list", "pos", (w / (rrf_k + F.col("pos"))).alias("part"))
    return _ranked(linear.unionByName(rrf), ["strategy", "alpha", "query_id"], k)


def sparse_source(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with ``sparse``: per row the first of the named lists that isn't null or empty, else an empty list."""
    out = F.array().cast(df.schema[names[-1]].dataType)
    for name in reversed(names):
        out = F.when(F.size(F.coalesce(F.col(name), F.array())) > 0, F.col(name)).otherwise(out)
    return df.withColumn("sparse", out)


LISTS = ("es_hybrid", "faiss_dense", "hnsw_sparse")
WEIGHTS = {0: 0.4, 1: 0.4, 2: 0.2}
ALPHAS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0)


def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of query_results, repeated rows once."""
    return nested_lists(current_records(table(spark, sf_dir, "query_results"), "query_id", [], LISTS), LISTS)


def norm_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(query_lists(spark, sf_dir)).select("query_id", "list", "doc_id", F.round("norm", DIGITS).alias("norm"))


def fuse_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(query_lists(spark, sf_dir), "linear", WEIGHTS, 10)


def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(query_lists(spark, sf_dir), "rrf", WEIGHTS, 10)


def fuse_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(query_lists(spark, sf_dir))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion_sweep(query_lists(spark, sf_dir), ALPHAS, 5)


def legacy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_source(current_records(table(spark, sf_dir, "query_results"), "query_id", [], LISTS), ("es_hybrid", "hnsw_sparse"))
    return fuse(nested_lists(rows, ("sparse", "faiss_dense")), "rrf", {0: 0.4, 1: 0.4}, 10)


QUERIES = {"norm_floor": norm_floor, "fuse_linear": fuse_linear, "fuse_rrf": fuse_rrf, "fuse_content": fuse_content, "fusion_sweep": sweep, "fuse_legacy": legacy_fusion}

_HIT = "list_filter({c}, lambda h: h.doc_id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score))"
_LIST = "SELECT query_id, {i} AS list, pos, x[pos].doc_id AS doc_id, x[pos].score AS score, coalesce(x[pos].content, '') AS content FROM (SELECT query_id, x, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT query_id, {hit} AS x FROM {t}))"


def lists_sql(names: Sequence[str], t: str = "rows") -> str:
    """CTE hits of the named list columns."""
    return "hits AS (" + " UNION ALL ".join(_LIST.format(i=i, hit=_HIT.format(c=n), t=t) for i, n in enumerate(names)) + ")"


_ROWS = "WITH rows AS (SELECT DISTINCT * FROM query_results), "
_NORM = """norms AS (SELECT query_id, list, doc_id, min(pos) AS pos, arg_max(norm, pos) AS norm FROM (
  SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE
    ELSE 0.1::DOUBLE + 0.9::DOUBLE * ((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)) END AS norm
  FROM hits WINDOW w AS (PARTITION BY query_id, list)) GROUP BY 1, 2, 3)"""
HITS_CTE = _ROWS + lists_sql(LISTS)


def fused_sql(parts: str, keys: str, k: int) -> str:
    return f"""SELECT {keys}, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, list, pos, doc_id) AS INTEGER) AS rank FROM (
      SELECT {keys}, doc_id, round(sum(part), 9) AS score, min((list, pos))[1] AS list, min((list, pos))[2] AS pos FROM ({parts}) GROUP BY {keys}, doc_id)) WHERE rank <= {k}"""


_W = "(CASE list WHEN 2 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END)"
_A = "(CASE list WHEN 0 THEN alpha ELSE 1 - alpha END)"
_P = f"(SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS alpha)"
SQL = {
    "norm_floor": HITS_CTE + ", " + _NORM + " SELECT query_id, list, doc_id, round(norm, 9) AS norm FROM norms",
    "fuse_linear": HITS_CTE + ", " + _NORM + " " + fused_sql(f"SELECT *, {_W} * norm AS part FROM norms", "query_id", 10),
    "fuse_rrf": HITS_CTE + " " + fused_sql(f"SELECT *, {_W} / (60 + pos) AS part FROM hits", "query_id", 10),
    "fuse_content": HITS_CTE + " SELECT query_id, doc_id, coalesce(arg_max(content, (list, pos)) FILTER (content <> ''), '') AS content FROM hits GROUP BY 1, 2",
    "fusion_sweep": HITS_CTE + ", two AS (SELECT * FROM hits WHERE list < 2), " + _NORM + " "
    + fused_sql(f"SELECT 'linear' AS strategy, alpha, query_id, doc_id, list, pos, {_A} * norm AS part FROM norms CROSS JOIN {_P} WHERE list < 2 UNION ALL SELECT 'rrf', alpha, query_id, doc_id, list, pos, {_A} / (60 + pos) FROM two CROSS JOIN {_P}", "strategy, alpha, query_id", 5),
    "fuse_legacy": _ROWS + "src AS (SELECT query_id, CASE WHEN len(es_hybrid) > 0 THEN es_hybrid WHEN len(hnsw_sparse) > 0 THEN hnsw_sparse ELSE [] END AS sparse, faiss_dense FROM rows), "
    + lists_sql(("sparse", "faiss_dense"), "src") + " " + fused_sql("SELECT *, 0.4::DOUBLE / (60 + pos) AS part FROM hits", "query_id", 10),
}
