"""Queries over whole plans: corpus cap, upsert, hybrid stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normal_id
from rankloom.operators.rerank import coverage_scores
from rankloom.plans import datasets as D
from rankloom.plans.pipeline import HashedEncoder, HybridRetriever, LexicalEncoder, Settings
from rankloom.sources.files import cap_corpus
from rankloom.sources.sinks import merged
from rankloom.sources.tables import table

CAP = 200


def corpus_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 lines of beir_corpus and every judged document."""
    lines = table(spark, sf_dir, "beir_corpus").select(normal_id("_id").alias("doc_id"), "line_no").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    return cap_corpus(lines, "line_no", CAP, D.graded(spark, sf_dir))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pg_documents up to mid 2024, then the later rows upserted."""
    rows = table(spark, sf_dir, "pg_documents").select("doc_id", "updated_at", "content")
    early, late = rows.filter("updated_at < timestamp_ntz'2024-07-01 00:00:00'"), rows.filter("updated_at >= timestamp_ntz'2024-07-01 00:00:00'")
    first = merged(rows.limit(0), early, "doc_id", "updated_at")
    return merged(first, late, "doc_id", "updated_at").select("doc_id", "updated_at", F.length("content").alias("n_chars"))


def hybrid_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages for the judged queries, 100 candidates each: dense, sparse, hybrid, hybrid+rerank."""
    found = HybridRetriever(LexicalEncoder(), HashedEncoder(), coverage_scores, Settings()).index(D.corpus(spark, sf_dir))
    return found.search(D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir)), all_stages=True)


QUERIES = {"corpus_cap": corpus_cap, "upsert_merge": upsert_merge, "hybrid_stages": hybrid_stages}
SQL = {
    "corpus_cap": D.with_("graded") + f", l AS (SELECT {D._norm('_id')} AS doc_id, min(line_no) AS line_no FROM beir_corpus GROUP BY 1) SELECT doc_id, line_no FROM (SELECT *, row_number() OVER (ORDER BY line_no) AS r FROM l WHERE doc_id IS NOT NULL) WHERE r <= {CAP} OR doc_id IN (SELECT doc_id FROM graded)",
    "upsert_merge": "SELECT doc_id, updated_at, CAST(length(content) AS INTEGER) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) AS r FROM pg_documents) WHERE r = 1",
}
