"""Dense retrieval: exact search in blocks, inverted cells, product quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.blocks import HITS, Floors, chosen, hit_rows, per_batch
from rankloom.operators.sparse import rank_hits
from rankloom.session import written
from rankloom.sources.tables import table

DIGITS = 5
#: Vectors in a block of documents, and of queries.
DOC_BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Vectors that cells and codebooks are fitted on, at most.
FIT_SAMPLE = 20_000


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors (finite, ``dim`` elements) and their matrix."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    dim = dim or int(sizes.max(initial=1))
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1)
    return at[ok], x[ok].astype(np.float32)


def exact_topk(docs: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str, dim: int, normalize: bool = False, size: int | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: the ``k`` greatest inner products of every query, exactly; all documents if there are fewer.

    Batches of queries, of a bounded number, are broadcast and compared with
    the documents where they are: no vector is shuffled, and only rows that can
    still be among the ``k`` best (of equal rounded scores those with the
    smallest ids) leave a task. ``normalize`` makes it the cosine. Repeated
    documents should be removed before. Null, broken and (normalised) zero
    vectors are in no row.
    """

    def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, x = matrix(column, dim)
        x = x.astype(float)
        if normalize:
            length = np.linalg.norm(x, axis=1)
            at, x = at[length > 0], x[length > 0] / length[length > 0, None]
        return at, x

    spark = docs.sparkSession
    asked = queries.filter(F.col(query_key).isNotNull()).select(F.col(query_key).cast("string").alias("query_id"), F.col(vector).cast("array<float>").alias("x"))
    rows = docs.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string"), vector)

    def hits(part: pa.Table) -> DataFrame:
        at, x = usable(part["x"].combine_chunks()) if part.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
        shared = spark.sparkContext.broadcast((part["query_id"].take(pa.array(at)).to_pylist(), x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            floors = Floors(len(ids), k, -np.inf)
            for whole in batches:
                for lo in range(0, whole.num_rows if ids else 0, DOC_BLOCK):
                    batch = whole.slice(lo, DOC_BLOCK)
                    at, y = usable(batch.column(1))
                    names = np.array(batch.column(0).take(pa.array(at)).to_pylist(), object)
                    order = np.argsort(names, kind="stable")
                    names, y = names[order], y[order].T
                    for first in range(0, len(q) if len(names) else 0, 256):
                        s = rounded(q[first : first + 256] @ y)
                        able = s >= floors.floor[first : first + 256, None]
                        found = []
                        for i in np.flatnonzero(able.any(axis=1)).tolist():
                            columns = np.flatnonzero(able[i])
                            columns = columns[chosen(s[i, columns], k)]
                            floors.add(first + i, s[i, columns])
                            found.append((first + i, names[columns], s[i, columns]))
                        if found:
                            yield hit_rows(found, ids)

        return rows.mapInArrow(run, HITS)

    return rank_hits(per_batch(written(asked, "asked"), hits, size=size), k, DIGITS)


def store_vectors(vectors: DataFrame, path: str, key: str, vector: str, dim: int) -> None:
    """Vectors as a Parquet table; raises if one that isn't null has another length than ``dim``."""
    vectors.write.mode("overwrite").parquet(path)
    other = vectors.sparkSession.read.parquet(path).filter(F.size(vector) != dim).select(key, F.size(vector).alias("n")).limit(1).collect()
    if other:
        raise ValueError(f"vector {other[0][0]!r} has {other[0].n} elements, not {dim}")


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Centroids of a sample; empty clusters take the worst-served points."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (centers**2).sum(1) - 2 * x @ centers.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centers[n == 0] = x[np.argsort(-d.min(1))[: (n == 0).sum()]]
    return centers


def fit_sample(df: DataFrame, vector: str, dim: int, size: int = FIT_SAMPLE, seed: int = 5) -> np.ndarray:
    """A bounded sample of usable vectors, for fitting only; every vector is indexed."""
    n = df.count()
    rows = df.select(vector).filter(F.col(vector).isNotNull()).sample(min(1.0, size / max(1, n)), seed=seed).limit(size).toArrow()[vector].combine_chunks()
    return matrix(rows, dim)[1] if len(rows) else np.zeros((0, dim), np.float32)


def rounded(s: np.ndarray) -> np.ndarray:
    """Scores to ``DIGITS`` digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(s) * 10**DIGITS + 0.5), s) / 10**DIGITS


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest of every row of ``s``; of equal ones the first columns."""
    if s.shape[1] <= k:
        return np.divmod(np.arange(s.size), max(1, s.shape[1]))
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, tied = s > kth, s == kth
    return np.nonzero(above | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))


class CellIndex:
    """Inverted cells: centroids (at most ``n_cells``), each document with its cell, and each cell's radius.

    By the radius r of a cell with centroid c no document in it has an inner
    product with q above q c + |q| r. Cells are probed in the order of that
    bound, and a search goes on to every cell whose bound reaches the k-th score
    found, so that large vectors in far cells are met, and nothing is missed.
    """

    def __init__(self, docs: DataFrame, key: str, vector: str, dim: int, n_cells: int = 100):
        sample = fit_sample(docs, vector, dim)
        self.dim, self.centers = dim, kmeans(sample, n_cells) if len(sample) else np.zeros((1, dim), np.float32)
        self.cells = written(self._gathered(docs, key, vector), "cells")
        self.radius = np.full(len(self.centers), -np.inf)  # of an empty cell
        for cell, r in self.cells.groupBy("cell").agg(F.max("r")).collect():  # a row for each cell
            self.radius[cell] = r

    def _gathered(self, docs: DataFrame, key: str, vector: str) -> DataFrame:
        """cell, r, ids array<string>, x binary: usable vectors by nearest centroid, in blocks, and the greatest distance from it; no shuffle."""
        centers, dim = self.centers.astype(float), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half, held, n = (centers**2).sum(1) / 2, [], 0

            def out() -> Iterator[pa.RecordBatch]:
                ids, cell, x = (np.concatenate(c) for c in zip(*held, strict=True))
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    for lo in range(0, len(at), DOC_BLOCK):
                        part = at[lo : lo + DOC_BLOCK]
                        r = np.linalg.norm(x[part] - centers[c], axis=1).max()
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([r]), pa.array([ids[part].tolist()], pa.list_(pa.string())), pa.array([x[part].tobytes()])], ["cell", "r", "ids", "x"])

            for batch in batches:
                at, x = matrix(batch.column(1), dim)
                held.append((np.array(batch.column(0).take(pa.array(at)).to_pylist(), object), (half - x.astype(float) @ centers.T).argmin(1), x))
                n += len(at)
                if n >= 8 * DOC_BLOCK:
                    yield from out()
                    held, n = [], 0
            if n:
                yield from out()

        return docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("string"), F.col(vector)).mapInArrow(run, "cell int, r double, ids array<string>, x binary")

    def _probed(self, queries: DataFrame, probes: int, first: bool) -> DataFrame:
        """cell, q, qx, floor: blocks of query_id, v, floor for the ``probes`` cells of the greatest bounds, or for the other cells whose bound reaches ``floor``."""
        centers, radius, dim = self.centers.astype(float), self.radius, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, QUERY_BLOCK):
                    part = batch.slice(lo, QUERY_BLOCK)
                    ids, floor = np.array(part.column(0).to_pylist(), object), part.column(2).to_numpy()
                    x = part.column(1).flatten().to_numpy().reshape(-1, dim)
                    length = np.linalg.norm(x.astype(float), axis=1)[:, None]
                    bound = x.astype(float) @ centers.T + length * np.where(np.isfinite(radius), radius, 0)
                    bound[:, ~np.isfinite(radius)] = -np.inf
                    head = np.zeros(bound.shape, bool)
                    np.put_along_axis(head, np.argsort(-bound, axis=1, kind="stable")[:, :probes], True, axis=1)
                    meets = (head if first else ~head & (bound >= floor[:, None] - slack(length))) & np.isfinite(radius)
                    for c in np.flatnonzero(meets.any(0)):
                        at = np.flatnonzero(meets[:, c])
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([ids[at].tolist()], pa.list_(pa.string())), pa.array([x[at].tobytes()]), pa.array([floor[at].tobytes()])], ["cell", "q", "qx", "floor"])

        largest = float(np.max(np.linalg.norm(self.centers, axis=1) + np.where(np.isfinite(radius), radius, 0)))

        def slack(length: np.ndarray) -> np.ndarray:
            return 1.01 * 10.0**-DIGITS + 1e-9 * length * largest  # scores that are equal once rounded

        return queries.mapInArrow(run, "cell int, q array<string>, qx binary, floor binary")

    def _asked(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        """query_id, v, floor of usable queries, without a floor yet."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.array(matrix(batch.column(1), dim)[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows).cast(pa.list_(pa.float32())), pa.array(np.full(len(rows), -np.inf))], ["query_id", "v", "floor"])

        asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("string"), F.col(vector)).mapInArrow(run, "query_id string, v array<float>, floor double")
        asked = written(asked, "asked")
        return asked.repartition(-(-asked.count() // QUERY_BLOCK) or 1)  # full blocks: documents travel once for each

    def _met(self, probed: DataFrame, cells: DataFrame) -> DataFrame:
        """Blocks of documents and queries of one cell; not dealt out again, as each block of documents would travel with each of queries."""
        return cells.join(probed, "cell")

    @staticmethod
    def _raised(asked: DataFrame, floors: DataFrame, k: int) -> DataFrame:
        """query_id, v, floor: ``floor`` is the ``k``-th score, minus infinity where there are fewer."""
        kth = floors.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        return asked.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("kth", "floor").alias("floor"))

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank by inner product: ``probes`` cells, then all others that may hold one of the ``k`` best."""
        dim = self.dim

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, dx, q, qx in zip(*(batch.column(n) for n in ("ids", "x", "q", "qx")), strict=True):
                    yield block_hits(d, dx, q, qx, dim, k)

        def hits(asked: DataFrame, first: bool) -> DataFrame:
            met = self._met(self._probed(asked, probes, first), self.cells.select("cell", "ids", "x")).select("ids", "x", "q", "qx")
            return met.mapInArrow(score, "query_id string, doc_id string, score double")

        asked = self._asked(queries, key, vector)
        near = written(rank_hits(hits(asked, True), k, DIGITS), "near")
        far = hits(self._raised(asked, near, k).coalesce(asked.rdd.getNumPartitions()), False)
        return rank_hits(near.select("query_id", "doc_id", "score").unionByName(far), k, DIGITS)


class ProductIndex(CellIndex):
    """Cells, and per document its length and the code of each sub-vector of its direction.

    Codes bound each inner product from both sides: the error of a coded
    document is |q| times its distance from its code. Documents whose upper
    bound reaches the k-th lower bound are scored by their vectors.
    """

    def __init__(self, docs: DataFrame, key: str, vector: str, dim: int, n_cells: int = 100, parts: int = 48, codes: int = 256):
        super().__init__(docs, key, vector, dim, n_cells)
        parts = max(p for p in range(1, min(parts, dim) + 1) if dim % p == 0)
        sample = fit_sample(docs, vector, dim)
        sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
        self.books = [kmeans(s, codes, 8) if len(s) else np.zeros((1, dim // parts), np.float32) for s in np.split(sample, parts, axis=1)]
        books, width = self.books, dim // parts

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, ids, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                    x = np.frombuffer(x.as_py(), np.float32).reshape(-1, dim).astype(float)
                    length = np.linalg.norm(x, axis=1)
                    u = x / np.maximum(length, 1e-30)[:, None]
                    code = np.stack([((b**2).sum(1) - 2 * u[:, i * width : (i + 1) * width] @ b.T).argmin(1) for i, b in enumerate(books)], axis=1).astype(np.uint8)
                    off = np.linalg.norm(x - length[:, None] * decoded(code, books), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], pa.int32()), pa.array([ids.as_py()], pa.list_(pa.string())), *(pa.array([a.tobytes()]) for a in (code, length, off, x.astype(np.float32)))], ["cell", "ids", "code", "length", "off", "x"])

        self.coded = self.cells.select("cell", "ids", "x").mapInArrow(encode, "cell int, ids array<string>, code binary, length binary, off binary, x binary")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int = 10) -> DataFrame:
        """As with cells; codes choose the documents that are scored."""
        books, dim = self.books, self.dim

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, code, length, off, q, qx in zip(*(batch.column(n) for n in ("ids", "code", "length", "off", "q", "qx")), strict=True):
                    names, asked = np.array(d.as_py(), object), np.array(q.as_py(), object)
                    for lo, s, error, _ in estimates(code, length, off, qx, books, dim):
                        rows, columns = best_columns(s - error, k)
                        yield pa.RecordBatch.from_arrays([pa.array(asked[lo + rows].tolist(), pa.string()), pa.array(names[columns].tolist(), pa.string()), pa.array((s - error)[rows, columns])], ["query_id", "doc_id", "score"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, code, length, off, dx, q, qx, floor in zip(*(batch.column(n) for n in ("ids", "code", "length", "off", "x", "q", "qx", "floor")), strict=True):
                    names, asked, floor = np.array(d.as_py(), object), np.array(q.as_py(), object), np.frombuffer(floor.as_py())
                    order = np.argsort(names, kind="stable")
                    names, y = names[order], np.frombuffer(dx.as_py(), np.float32).reshape(-1, dim)[order].astype(float)
                    for lo, s, error, part in estimates(code, length, off, qx, books, dim):
                        rows, columns = np.nonzero((s + error)[:, order] >= floor[lo : lo + len(s), None] - 1.01 * 10.0**-DIGITS)
                        exact = np.full(s.shape, -np.inf)
                        for i in range(0, len(rows), 65_536):
                            r, c = rows[i : i + 65_536], columns[i : i + 65_536]
                            exact[r, c] = rounded(np.einsum("ij,ij->i", part[r], y[c]))
                        rows, columns = best_columns(exact, k)
                        live = np.isfinite(exact[rows, columns])
                        rows, columns = rows[live], columns[live]
                        yield pa.RecordBatch.from_arrays([pa.array(asked[lo + rows].tolist(), pa.string()), pa.array(names[columns].tolist(), pa.string()), pa.array(exact[rows, columns])], ["query_id", "doc_id", "score"])

        asked = self._asked(queries, key, vector)
        met = self._met(self._probed(asked, probes, True), self.coded.drop("x")).drop("cell", "floor")
        near = rank_hits(met.mapInArrow(lower, "query_id string, doc_id string, score double"), k, DIGITS + 4)
        raised = self._raised(asked, near, k)
        raised = written(raised, "raised").coalesce(asked.rdd.getNumPartitions())
        probed = self._probed(raised, probes, True).unionByName(self._probed(raised, probes, False))
        return rank_hits(self._met(probed, self.coded).drop("cell").mapInArrow(score, "query_id string, doc_id string, score double"), k, DIGITS)


def estimates(code: pa.Scalar, length: pa.Scalar, off: pa.Scalar, qx: pa.Scalar, books: list[np.ndarray], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First query, inner products by codes, their largest errors and the queries, for parts of a block of queries."""
    code = np.frombuffer(code.as_py(), np.uint8).reshape(-1, len(books))
    y = np.frombuffer(length.as_py())[:, None] * decoded(code, books)
    x, off = np.frombuffer(qx.as_py(), np.float32).reshape(-1, dim).astype(float), np.frombuffer(off.as_py())
    off = off * (1 + 1e-9) + 1e-9 * np.abs(y).max(initial=0)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        yield lo, part @ y.T, np.linalg.norm(part, axis=1)[:, None] * off, part


def decoded(code: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that rows of codes stand for."""
    return np.concatenate([b[code[:, i]] for i, b in enumerate(books)], axis=1).astype(float)


def block_hits(d: pa.Scalar, dx: pa.Scalar, q: pa.Scalar, qx: pa.Scalar, dim: int, k: int) -> pa.RecordBatch:
    """query_id, doc_id, score: of a block of documents the ``k`` best of every query of a block, equal rounded scores by id."""
    names, asked = np.array(d.as_py(), object), np.array(q.as_py(), object)
    order = np.argsort(names, kind="stable")
    names, y = names[order], np.frombuffer(dx.as_py(), np.float32).reshape(-1, dim)[order].astype(float).T
    x, out = np.frombuffer(qx.as_py(), np.float32).reshape(-1, dim).astype(float), []
    for lo in range(0, len(x), 256):
        s = rounded(x[lo : lo + 256] @ y)
        rows, columns = best_columns(s, k)
        out.append((asked[lo + rows], names[columns], s[rows, columns]))
    who, which, score = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(who.tolist(), pa.string()), pa.array(which.tolist(), pa.string()), pa.array(score)], ["query_id", "doc_id", "score"])


INDEX_TYPES = ("Flat", "IVFFlat", "IVFPQ")


def build_index(index_type: str, docs: DataFrame, key: str, vector: str, dim: int, n_cells: int = 100):
    """A cell or product index by type name; Flat needs none."""
    if index_type not in INDEX_TYPES:
        raise ValueError(f"Unknown index type: {index_type}")
    if index_type == "Flat":
        return None
    return (CellIndex if index_type == "IVFFlat" else ProductIndex)(docs, key, vector, dim, n_cells)


DIM = 64


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding of dense_vectors, repeated rows once; the map-side part drops most repeats."""
    return table(spark, sf_dir, "dense_vectors").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def asking(vectors: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 100."""
    return vectors.filter(F.col("vec_id") % 100 == 0)


def dense_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, asking(vectors), 10, "vec_id", "vec_id", "embedding", DIM)


def flat_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(passages(spark, sf_dir), "passages")
    return exact_topk(vectors, asking(vectors), 10, "vec_id", "vec_id", "embedding", DIM, normalize=True)


def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(passages(spark, sf_dir), "passages")
    return CellIndex(vectors, "vec_id", "embedding", DIM).search(asking(vectors), "vec_id", "embedding", 10)


def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(passages(spark, sf_dir), "passages")
    return ProductIndex(vectors, "vec_id", "embedding", DIM).search(asking(vectors), "vec_id", "embedding", 10)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_type, n_queries, enough: whether each index finds at least 0.9 of what the exact search finds."""
    vectors, out = written(passages(spark, sf_dir), "passages"), None
    exact = written(exact_topk(vectors, asking(vectors), 10, "vec_id", "vec_id", "embedding", DIM), "exact").select("query_id", "doc_id")
    for kind in INDEX_TYPES[1:]:
        found = build_index(kind, vectors, "vec_id", "embedding", DIM).search(asking(vectors), "vec_id", "embedding", 10).select("query_id", "doc_id", F.lit(1).alias("hit"))
        row = exact.join(found, ["query_id", "doc_id"], "left").agg(F.count_distinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))
        row = row.select(F.lit(kind).alias("index_type"), "n_queries", "enough")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {"ann_recall": ann_recall, "dense_exact_topk": dense_exact_topk, "flat_cosine_topk": flat_cosine_topk, "ivf_topk": ivf_topk, "pq_topk": pq_topk}

_PAIR = "SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(d.vec_id AS VARCHAR) AS doc_id, {f}(q.e, d.e) AS score FROM v d JOIN v q ON q.vec_id % 100 = 0"
_LIVE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
SQL = {
    "ann_recall": f"SELECT unnest(['IVFFlat', 'IVFPQ']) AS index_type, (SELECT count(DISTINCT vec_id) FROM dense_vectors WHERE vec_id % 100 = 0 AND {_LIVE}) AS n_queries, true AS enough",
    "dense_exact_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (" + _PAIR.format(f="list_dot_product") + f") SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(score, {DIGITS}) AS score FROM r)) WHERE rank <= 10",
    "flat_cosine_topk": "WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM dense_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0), r AS ("
    + _PAIR.format(f="list_cosine_similarity") + f") SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(score, {DIGITS}) AS score FROM r)) WHERE rank <= 10",
}
