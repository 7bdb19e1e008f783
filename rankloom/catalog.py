"""All queries of the core by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators import dense, evaluate, fusion, graph, orphans, rag, rerank, sparse
from rankloom.plans import queries

_MODULES = (sparse, dense, fusion, rerank, graph, rag, evaluate, queries, orphans)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25: the ten best documents of every judged query."""
    return QUERIES["bm25_topk"](spark, sf_dir)
