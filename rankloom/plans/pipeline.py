"""Stage planner: sparse, dense, fused and reranked hits of all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import render_document, tokens
from rankloom.operators import blocks, dense, fusion, rerank, sparse
from rankloom.operators.records import skew_safe_left_join
from rankloom.operators.sparse import hashed_dimension
from rankloom.plans import datasets as D
from rankloom.session import scratch_path, written

#: What is put before queries, by a part of the model's name.
QUERY_PREFIXES = {"bge": "Represent this sentence for searching relevant passages: ", "e5": "query: ", "gte": "", "all-minilm": ""}


def query_prefix(model: str) -> str:
    """The prefix of the first known part of the model's name, else none."""
    return next((p for part, p in QUERY_PREFIXES.items() if part in model.lower()), "")


class SparseEncoder(Protocol):
    """Weights of documents (doc_id, content) as doc_id, term, weight, and of queries (query_id, text) as query_id, term, weight."""

    def documents(self, docs: DataFrame) -> DataFrame: ...

    def queries(self, queries: DataFrame) -> DataFrame: ...


class DenseEncoder(Protocol):
    """Vectors of documents and queries: the id and ``embedding`` (array<float>) of length ``dim``."""

    dim: int

    def documents(self, docs: DataFrame) -> DataFrame: ...

    def queries(self, queries: DataFrame) -> DataFrame: ...


class LexicalEncoder:
    """Built in: the greatest log-tf idf weights of documents, term counts of queries. Not a learned model."""

    def __init__(self, top_terms: int = 100):
        self.top_terms = top_terms

    def documents(self, docs: DataFrame) -> DataFrame:
        return sparse.lexical_weights(docs, self.top_terms)

    def queries(self, queries: DataFrame) -> DataFrame:
        return D.query_tokens(queries)


class HashedEncoder:
    """Built in: counts of hashed tokens at length 1, with a prefix on queries. Not a learned model."""

    def __init__(self, dim: int = 64, prefix: str = ""):
        self.dim, self.prefix = dim, prefix

    def _vectors(self, df: DataFrame, key: str, text) -> DataFrame:
        counts = df.select(key, F.explode(tokens(text)).alias("t")).groupBy(key, hashed_dimension("t", self.dim).alias("i")).agg(F.count(F.lit(1)).alias("n"))
        pairs = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
        return pairs.select(key, F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: (F.coalesce(F.col("m")[i], F.lit(0)) / F.col("len")).cast("float")).alias("embedding"))

    def documents(self, docs: DataFrame) -> DataFrame:
        return self._vectors(docs, "doc_id", F.col("content"))

    def queries(self, queries: DataFrame) -> DataFrame:
        return self._vectors(queries, "query_id", F.concat(F.lit(self.prefix), F.coalesce("text", F.lit(""))))


def encode_with(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], dim: int, prefix: str = "", batch: int = 64, normalize: bool = True) -> DataFrame:
    """``key``, ``embedding`` by a model: ``encode(texts) -> matrix``, called once per ``batch`` texts in Arrow batches. Another width than ``dim`` raises."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                x = np.asarray(encode([prefix + (t or "") for t in part.column(1).to_pylist()]), np.float32)
                if x.shape != (part.num_rows, dim):
                    raise ValueError(f"the model gave {x.shape}, not {(part.num_rows, dim)}")
                if normalize:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                ends = np.arange(0, x.size + 1, dim, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


class ModelDenseEncoder:
    """A dense model ``encode(texts) -> matrix`` of width ``dim``; ``prefix`` is put before queries."""

    def __init__(self, encode: Callable[[list[str]], np.ndarray], dim: int, prefix: str = "", batch: int = 64, normalize: bool = True):
        self.encode, self.dim, self.prefix, self.batch, self.normalize = encode, dim, prefix, batch, normalize

    def documents(self, docs: DataFrame) -> DataFrame:
        return encode_with(docs, "doc_id", "content", self.encode, self.dim, "", self.batch, self.normalize)

    def queries(self, queries: DataFrame) -> DataFrame:
        return encode_with(queries, "query_id", "text", self.encode, self.dim, self.prefix, self.batch, self.normalize)


def encode_sparse_with(df: DataFrame, key: str, text: str, forward: Callable, vocabulary: Sequence[str], special: Sequence[int] = (), top_terms: int = 100, batch: int = 32) -> DataFrame:
    """``key``, ``term``, ``weight`` by a model: ``forward(texts) -> (logits [n, positions, terms], mask [n, positions])``.

    A term's weight is the maximum over unmasked positions of log1p(relu(logit));
    special ids never count. The ``top_terms`` greatest stay, of equal ones the
    smaller ids. Called once per ``batch`` texts.
    """
    kind, names, never = df.schema[key].dataType.simpleString(), np.array(list(vocabulary), object), list(special)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                logits, mask = (np.asarray(x, np.float64) for x in forward([t or "" for t in part.column(1).to_pylist()]))
                weights = np.log1p(np.maximum(logits, 0) * (mask[:, :, None] > 0)).max(axis=1, initial=0)
                weights[:, never] = 0
                order = np.argsort(-weights, axis=1, kind="stable")[:, :top_terms]
                best = np.take_along_axis(weights, order, axis=1)
                row, column = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(names[order[row, column]].tolist(), pa.string()), pa.array(best[row, column])], [key, "term", "weight"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, term string, weight double")


class ModelSparseEncoder:
    """A sparse model, see :func:`encode_sparse_with`. With ``quantize`` weights are whole numbers of 255ths of the documents' greatest weight.

    That weight, ``global_max``, is set by :meth:`documents` and kept with a
    saved index; queries before it is known stay unquantised.
    """

    def __init__(self, forward: Callable, vocabulary: Sequence[str], special: Sequence[int] = (), top_terms: int = 100, batch: int = 32, quantize: bool = False):
        self.how = {"forward": forward, "vocabulary": vocabulary, "special": special, "top_terms": top_terms, "batch": batch}
        self.quantize, self.global_max = quantize, None

    def _scaled(self, rows: DataFrame) -> DataFrame:
        if not self.quantize or self.global_max is None:
            return rows
        return rows.withColumn("weight", F.floor(F.col("weight") / F.lit(self.global_max) * 255).cast("double")).filter("weight > 0")

    def documents(self, docs: DataFrame) -> DataFrame:
        rows = written(encode_sparse_with(docs, "doc_id", "content", **self.how), "encoded")
        self.global_max = sparse.global_max(rows).first().global_max
        return self._scaled(rows)

    def queries(self, queries: DataFrame) -> DataFrame:
        return self._scaled(encode_sparse_with(queries, "query_id", "text", **self.how))


def attach_contents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with the content of their documents (unique ids), empty where there is none; a document in most results is looked up by a broadcast."""
    contents = docs.select("doc_id", "content")
    return skew_safe_left_join(hits, contents, "doc_id").withColumn("content", F.coalesce("content", F.lit("")))


@dataclass
class Settings:
    """What the stages do. ``top_k`` cuts each branch and the fusion; ``rerank_n`` bounds the scored head (None: all)."""

    top_k: int = 100
    strategy: str = "linear"
    alpha: float = 0.4
    beta: float = 0.6
    rrf_k: int = 60
    blend_weight: float = 0.3
    blend_k: int = 60
    rerank_n: int | None = None


class HybridRetriever:
    """Index once, then answer batches of queries. Branches without an encoder are left out; a reranker is optional.

    ``reranker(hits, queries, docs)`` gives query_id, doc_id, rerank_score.
    """

    def __init__(self, sparse_encoder: SparseEncoder | None = None, dense_encoder: DenseEncoder | None = None, reranker: Callable | None = None, settings: Settings | None = None):
        if sparse_encoder is None and dense_encoder is None:
            raise ValueError("at least one branch is needed")
        self.sparse_encoder, self.dense_encoder, self.reranker, self.settings = sparse_encoder, dense_encoder, reranker, settings or Settings()

    def index(self, docs: DataFrame) -> HybridRetriever:
        """Writes the branches' tables of documents (doc_id, and content or title and text) to the shared folder."""
        if "content" not in docs.columns:
            docs = docs.select("doc_id", render_document("title", "text").alias("content"))
        self.docs = docs
        if self.sparse_encoder:
            self.postings = blocks.store_blocks(blocks.posting_blocks(self.sparse_encoder.documents(docs)))
        if self.dense_encoder:
            path = scratch_path(docs.sparkSession, "vectors")
            dense.store_vectors(self.dense_encoder.documents(docs), path, "doc_id", "embedding", self.dense_encoder.dim)
            self.vectors = docs.sparkSession.read.parquet(path)
        return self

    def search(self, queries: DataFrame, all_stages: bool = False) -> DataFrame:
        """stage, query_id, doc_id, rank, score, content, rerank_score, retrieval_score of the last stage, or of all. No queries, no rows."""
        s, stages = self.settings, {}
        if self.dense_encoder:
            asked = self.dense_encoder.queries(queries)
            stages["dense"] = dense.exact_topk(self.vectors, asked, s.top_k, "doc_id", "query_id", "embedding", self.dense_encoder.dim)
        if self.sparse_encoder:
            stages["sparse"] = sparse.rank_hits(blocks.top_k_blocks(self.postings, self.sparse_encoder.queries(queries), s.top_k, sparse.DIGITS), s.top_k)
        last = next(reversed(stages))
        if len(stages) == 2:
            stages = {n: written(h, n) for n, h in stages.items()}
            lists = [stages[n].select("query_id", F.lit(i).alias("list"), F.col("rank").alias("pos"), "doc_id", "score", F.lit("").alias("content")) for i, n in enumerate(("sparse", "dense"))]
            stages["hybrid"] = fusion.fuse(lists[0].unionByName(lists[1]), s.strategy, {0: s.alpha, 1: s.beta}, s.top_k, s.rrf_k)
            last = "hybrid"
        if self.reranker:
            first = written(stages[last], last)
            head = first if s.rerank_n is None else first.filter(F.col("rank") <= s.rerank_n)
            stages[f"{last}+rerank"] = rerank.rerank_blend(first, self.reranker(head, queries, self.docs), s.blend_weight, s.blend_k, s.rerank_n)
            last = f"{last}+rerank"
        out = None
        for name, hits in (stages if all_stages else {last: stages[last]}).items():
            for c in ("rerank_score", "retrieval_score"):
                if c not in hits.columns:
                    hits = hits.withColumn(c, F.lit(None).cast("double"))
            rows = hits.select(F.lit(name).alias("stage"), "query_id", "doc_id", "rank", "score", "rerank_score", "retrieval_score")
            out = rows if out is None else out.unionByName(rows)
        columns = ("stage", "query_id", "doc_id", "rank", "score", "content", "rerank_score", "retrieval_score")
        return attach_contents(out, self.docs).select(*columns)
