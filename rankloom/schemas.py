"""Fixed schemas of files and tables; nothing is inferred."""

from __future__ import annotations

DOCUMENTS = "doc_id string, content string"
QUERIES = "query_id string, text string"
BINARY_QRELS = "query_id string, relevant_doc_ids array<string>"
SPARSE = "doc_id string, splade_terms map<string,double>, content string"
HIT = "struct<doc_id:string, score:double, content:string>"
RAG = f"struct<question:string, retrieved_docs:array<{HIT}>, context:string, answer:string>"
SYSTEMS = ("es_hybrid", "es_bm25", "hnsw_sparse", "faiss_dense", "pg_sparse", "graph", "hybrid_fused")
RESULTS = "query_id string, text string, " + ", ".join(f"{s} array<{HIT}>" for s in SYSTEMS) + ", rag " + RAG
BEIR_CORPUS = "_id string, title string, text string"
BEIR_QUERIES = "_id string, text string"
HITS = "stage string, query_id string, doc_id string, rank int, score double, content string, rerank_score double, retrieval_score double"
METRICS = "stage string, metric string, k int, value double"
EXPERIMENT = (
    "experiment string, system string, variant string, recall_at_5 double, recall_at_10 double, recall_at_20 double, ndcg_at_10 double, mrr double, "
    "query_latency_ms double, index_size_mb double, memory_usage_mb double, indexing_time_s double, docs_per_sec double, timestamp timestamp, notes string"
)
