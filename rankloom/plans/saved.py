"""An index that is built once, kept in a folder, and searched by all systems without its documents being encoded again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.operators import blocks, dense, fusion, graph, rag, sparse
from rankloom.plans.pipeline import DenseEncoder, SparseEncoder, attach_contents
from rankloom.session import path_exists, written
from rankloom.sources import sinks
from rankloom.utils import stopwatch

#: Weights of the fused ranking: text and sparse, dense, graph.
FUSED = {0: 0.4, 1: 0.4, 2: 0.2}


def build(docs: DataFrame, out: str, sparse_encoder: SparseEncoder | None, dense_encoder: DenseEncoder | None, max_neighbours: int = 50) -> dict[str, float]:
    """Writes the tables of an index of doc_id, content below ``out``; gives the seconds of each.

    documents; bm25 (token counts in blocks); with a sparse encoder postings,
    their greatest weight, cosine, overlap and hybrid blocks, and the graph's
    edges and links; with a dense encoder vectors. A vector of another length
    than the encoder's raises.
    """
    spark, took = docs.sparkSession, {}
    with stopwatch(took, "documents"):
        sinks.create_table(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("content").alias("content")), f"{out}/documents")
        docs = spark.read.parquet(f"{out}/documents")
    with stopwatch(took, "bm25"):
        blocks.store_blocks(blocks.text_blocks(docs), f"{out}/bm25")
    meta = {"n_docs": docs.count()}
    if sparse_encoder:
        with stopwatch(took, "postings"):
            sinks.save_index(sparse_encoder.documents(docs), f"{out}/postings")
            postings = spark.read.parquet(f"{out}/postings")
            meta["global_max"] = getattr(sparse_encoder, "global_max", None) or sparse.global_max(postings).first().global_max
        with stopwatch(took, "sparse file"):
            entries = F.map_from_entries(F.collect_list(F.struct("term", "weight")))
            sinks.write_sparse(postings.groupBy("doc_id").agg(entries.alias("splade_terms")), f"{out}/sparse")
        with stopwatch(took, "sparse blocks"):
            blocks.store_blocks(blocks.posting_blocks(sparse.unit_length(postings, "doc_id")), f"{out}/cosine")
            blocks.store_blocks(blocks.posting_blocks(postings), f"{out}/overlap")
            hybrid = sparse.hybrid_postings(sparse.bm25_weights(docs), sparse.dismax_postings(sparse.saturation(postings)))
            blocks.store_blocks(blocks.posting_blocks(hybrid), f"{out}/hybrid")
        with stopwatch(took, "graph"):
            sinks.save_index(graph.edges(postings), f"{out}/graph")
            sinks.save_index(graph.doc_edges(spark.read.parquet(f"{out}/graph"), max_neighbours), f"{out}/links")
    if dense_encoder:
        with stopwatch(took, "vectors"):
            dense.store_vectors(dense_encoder.documents(docs), f"{out}/vectors", "doc_id", "embedding", dense_encoder.dim)
            meta["dim"] = dense_encoder.dim
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/meta")
    return took


class SavedIndex:
    """The tables below a folder. Only queries are encoded; systems whose tables are missing are left out."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.meta = json.loads(spark.read.text(f"{folder}/meta").first().value)
        self.docs = self.table("documents")

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def _blocks(self, name: str, terms: DataFrame, k: int, bm25: blocks.Bm25 | None = None) -> DataFrame:
        return sparse.rank_hits(blocks.top_k_blocks(self.table(name), terms, k, sparse.DIGITS, bm25), k)

    def search(self, queries: DataFrame, sparse_encoder: SparseEncoder | None, dense_encoder: DenseEncoder | None, k: int = 10, strategy: str = "rrf", weights: dict[int, float] | None = None, rrf_k: int = 60) -> DataFrame:
        """system, query_id, doc_id, rank, score, content of every system that the index can serve, and of their fusion."""
        found = {"es_bm25": self._blocks("bm25", sparse.token_terms(queries), k, blocks.Bm25())}
        if sparse_encoder and self.table("postings") is not None:
            if hasattr(sparse_encoder, "global_max"):  # queries are quantised as the documents were
                sparse_encoder.global_max = self.meta["global_max"]
            terms = written(sparse_encoder.queries(queries), "terms")
            bare = sparse.match_all(self.docs, queries, terms, k, 0.6)  # the sparse branch's weight
            found["es_hybrid"] = self._blocks("hybrid", terms, k).unionByName(bare)
            found["hnsw_sparse"] = self._blocks("cosine", sparse.unit_length(terms, "query_id"), k)
            found["pg_sparse"] = self._blocks("overlap", terms, k)
            found["graph"] = graph.hop_scores(self.table("graph"), self.table("links"), terms, k=k)
        if dense_encoder and self.table("vectors") is not None:
            if dense_encoder.dim != self.meta["dim"]:
                raise ValueError(f"the index has vectors of {self.meta['dim']}, the encoder makes {dense_encoder.dim}")
            found["faiss_dense"] = dense.exact_topk(self.table("vectors"), dense_encoder.queries(queries), k, "doc_id", "query_id", "embedding", dense_encoder.dim)
        columns = ["query_id", "doc_id", "score", "rank"]
        found = {n: written(h.select(*columns), n) for n, h in found.items()}
        first = found.get("es_hybrid", found["es_bm25"])
        lists = None
        for i, hits in enumerate((first, found.get("faiss_dense"), found.get("graph"))):
            if hits is not None:
                rows = hits.select("query_id", F.lit(i).alias("list"), F.col("rank").alias("pos"), "doc_id", "score", F.lit("").alias("content"))
                lists = rows if lists is None else lists.unionByName(rows)
        found["hybrid_fused"] = fusion.fuse(lists, strategy, weights or FUSED, k, rrf_k).select(*columns)
        out = None
        for name in schemas.SYSTEMS:
            if name in found:
                rows = found[name].select(F.lit(name).alias("system"), *columns)
                out = rows if out is None else out.unionByName(rows)
        return attach_contents(out, self.docs).select("system", *columns, "content")


def rag_answers(hits: DataFrame, queries: DataFrame, generate: Callable | None = None, top_k: int = 5, max_tokens: int = 2048) -> DataFrame:
    """query_id, rag (question, retrieved_docs, context, answer) from the leading hits of the fused ranking; texts in it are excerpts."""
    first = hits.filter((F.col("system") == "hybrid_fused") & (F.col("rank") <= top_k))
    context = written(rag.build_context(first, max_tokens), "context")
    answer = rag.answers(rag.prompts(context, queries), generate)
    hit = F.struct("rank", "doc_id", F.substring("content", 1, 200).alias("content"), "score")
    found = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: F.struct(h["doc_id"].alias("doc_id"), h["content"].alias("content"), h["score"].alias("score"))).alias("retrieved_docs"))
    rows = answer.join(found, "query_id").join(context.select("query_id", rag.excerpt("context").alias("context")), "query_id").join(queries.select("query_id", "text"), "query_id")
    return rows.select("query_id", F.struct(F.col("text").alias("question"), "retrieved_docs", "context", "answer").alias("rag"))
