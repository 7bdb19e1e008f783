"""Reranking of a bounded head of each ranking, blended by rank with the first stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.operators import sparse
from rankloom.plans import datasets as D
from rankloom.session import written

DIGITS = 9
#: Candidates that are reranked.
DEPTH = 100


def coverage_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, rerank_score: the share of the query's distinct tokens that the document has.

    A deterministic scorer that stands in for a neural cross-encoder; content
    is joined to the shortlist only.
    """
    words = lambda c: F.array_distinct(tokens(F.coalesce(c, F.lit(""))))  # noqa: E731 - found once for a text, not for each pair
    asked, known = queries.select("query_id", words("text").alias("q")), docs.select("doc_id", words("content").alias("d"))
    pairs = hits.select("query_id", "doc_id").join(asked, "query_id").join(known, "doc_id", "left")
    both = F.size(F.array_intersect("q", F.coalesce("d", F.array().cast("array<string>"))))
    return pairs.select("query_id", "doc_id", F.coalesce(both / F.nullif(F.size("q"), F.lit(0)), F.lit(0.0)).alias("rerank_score"))


def model_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame, score_pairs) -> DataFrame:
    """The same by ``score_pairs(queries, contents) -> scores`` on Arrow batches (pandas series).

    Of two-column results, the second column is the score. Only the shortlist
    reaches the function.
    """

    def run(batches):
        for pdf in batches:
            out = score_pairs(pdf["text"], pdf["content"])
            if getattr(out, "ndim", 1) == 2:
                out = out[:, -1]
            yield pdf[["query_id", "doc_id"]].assign(rerank_score=out)

    pairs = hits.select("query_id", "doc_id").join(queries, "query_id").join(docs.select("doc_id", "content"), "doc_id", "left")
    return pairs.select("query_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, "query_id string, doc_id string, rerank_score double")


def rerank_blend(hits: DataFrame, scores: DataFrame, weight: float = 0.3, blend_k: int = 60, top_n: int | None = None, top_k: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank, rerank_score, retrieval_score.

    ``hits`` has rank from 1 and score. The first ``top_n`` (None: all) are
    ordered by rerank score, equals in first-stage order, and scored
    weight / (blend_k + rerank rank) + (1 - weight) / (blend_k + first-stage
    rank). The rest keep their order below the lowest of these, and have no
    rerank score. ``top_k`` 0 or None returns all. Hits without a score count
    as lowest.
    """
    each = Window.partitionBy("query_id")
    head = F.lit(True) if top_n is None else F.col("rank") <= top_n
    marked = hits.select("query_id", "doc_id", "rank", F.col("score").alias("retrieval_score")).join(scores, ["query_id", "doc_id"], "left").withColumn("head", head)
    by_score = Window.partitionBy("query_id", "head").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    blended = F.when(F.col("head"), weight / (blend_k + F.row_number().over(by_score)) + (1 - weight) / (blend_k + F.col("rank")))
    scored = marked.withColumn("_b", blended)
    floor, n_head = F.coalesce(F.min("_b").over(each), F.lit(0.0)), F.sum(F.col("head").cast("int")).over(each)
    n_tail = F.count(F.lit(1)).over(each) - n_head
    tail = floor - (F.col("rank") - n_head) / (blend_k + n_tail + 1)
    final = scored.withColumn("score", F.round(F.when(F.col("head"), F.col("_b")).otherwise(tail), DIGITS))
    order = each.orderBy(F.col("head").desc(), F.col("score").desc(), F.col("rank"))
    out = final.withColumn("_r", F.row_number().over(order))
    out = out.filter(F.col("_r") <= top_k) if top_k else out
    return out.select("query_id", "doc_id", "score", F.col("_r").alias("rank"), F.when(F.col("head"), F.col("rerank_score")).alias("rerank_score"), "retrieval_score")


def blend_sweep(hits: DataFrame, scores: DataFrame, weights: Sequence[float], blend_k: int = 60) -> DataFrame:
    """weight, query_id, doc_id, score, rank for every blend weight, scored once."""
    each = Window.partitionBy("query_id")
    by_score = each.orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    both = hits.join(scores, ["query_id", "doc_id"], "left").withColumn("rr", F.row_number().over(by_score))
    params = F.broadcast(hits.sparkSession.createDataFrame([(float(w),) for w in weights], "weight double"))
    blended = F.round(F.col("weight") / (blend_k + F.col("rr")) + (1 - F.col("weight")) / (blend_k + F.col("rank")), DIGITS)
    order = Window.partitionBy("weight", "query_id").orderBy(F.col("score").desc(), F.col("first"))
    return both.crossJoin(params).select("weight", "query_id", "doc_id", blended.alias("score"), F.col("rank").alias("first")).withColumn("rank", F.row_number().over(order)).drop("first")


BLEND_WEIGHTS = (0.0, 0.2, 0.3, 0.5, 0.7, 0.85, 1.0)


def first_stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BM25 hits of the judged queries, and coverage scores of them."""
    docs, queries = D.corpus(spark, sf_dir), D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir))
    hits = written(sparse.bm25_topk_of(docs, D.query_tokens(queries), DEPTH), "hits")
    return hits, coverage_scores(hits, queries, docs)


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_blend(*first_stage(spark, sf_dir))


def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank_blend(*first_stage(spark, sf_dir), top_n=4, top_k=8)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend_sweep(*first_stage(spark, sf_dir), BLEND_WEIGHTS).filter("rank <= 5")


QUERIES = {"rerank_blend": blended, "rerank_tail": tail, "blend_sweep": sweep}

_TOK = D._tokens
STAGE = (
    D.with_("docs", "graded", "all_q", "gq", "gqt", "tf", "bm")
    + ", hits AS (" + sparse.ranked_sql(sparse._DOT.format(p="bm", q="gqt"), DEPTH) + ")"
    + f""", cov AS (SELECT query_id, doc_id, h.score AS retrieval_score, h.rank, len(list_intersect(list_distinct({_TOK("coalesce(text, '')")}), {_TOK("content")})) / len(list_distinct({_TOK("text")}))::DOUBLE AS rerank_score
      FROM hits h JOIN gq USING (query_id) JOIN docs USING (doc_id))"""
)


def _blend_sql(n: int) -> str:
    return f""", b AS (SELECT *, rank <= {n} AS head, CASE WHEN rank <= {n} THEN 0.3::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id, rank <= {n} ORDER BY rerank_score DESC, rank)) + 0.7::DOUBLE / (60 + rank) END AS bl FROM cov),
    c AS (SELECT *, min(bl) OVER w AS floor, sum(head::INT) OVER w AS nh, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY query_id)),
    d AS (SELECT *, round(CASE WHEN head THEN bl ELSE floor - (rank - nh) / (60 + (n - nh) + 1)::DOUBLE END, 9) AS score FROM c),
    e AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY head DESC, score DESC, rank) AS INTEGER) AS r FROM d)
    SELECT query_id, doc_id, score, r AS rank, CASE WHEN head THEN rerank_score END AS rerank_score, retrieval_score FROM e"""


_BW = f"(SELECT unnest([{', '.join(map(str, BLEND_WEIGHTS))}])::DOUBLE AS weight)"
SQL = {
    "rerank_blend": STAGE + _blend_sql(1000),
    "rerank_tail": STAGE + _blend_sql(4) + " WHERE r <= 8",
    "blend_sweep": STAGE
    + f""", b AS (SELECT weight, query_id, doc_id, rank AS first, round(weight / (60 + rr) + (1 - weight) / (60 + rank), 9) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rr FROM cov) CROSS JOIN {_BW})
    SELECT weight, query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM b) WHERE rank <= 5""",
}
