"""Sparse and dense search over documents in blocks: exact top-k without a row per query and document.

Documents are stored in blocks with their postings by term. Batches of queries,
of a bounded number, are broadcast; a task goes through its blocks and keeps
for every query the score that its k-th best document has so far, so that only
documents which can still be chosen leave it. No posting is shuffled to search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.session import scratch_path, written

#: Documents in a block, and postings from which a block is closed.
BLOCK, BLOCK_POSTINGS = 8_192, 1 << 21
#: Queries in a batch: what is broadcast at once is that many queries' terms or vectors.
QUERY_BATCH = 32_768
#: Parquet settings under which a reader holds few blocks at a time.
BLOCK_FILES = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "1"}

BLOCK_SCHEMA = "ids array<string>, t binary, n binary, d binary, w binary, p binary, len binary"
HITS = "query_id string, doc_id string, score double"


def store_blocks(blocks: DataFrame, path: str | None = None) -> DataFrame:
    """Blocks written to ``path`` (by default to the shared folder) and read back."""
    path = path or scratch_path(blocks.sparkSession, "blocks")
    blocks.write.mode("overwrite").options(**BLOCK_FILES).parquet(path)
    return blocks.sparkSession.read.parquet(path)


def _block(ids: list[str], doc: np.ndarray, t: np.ndarray, w: np.ndarray, p: np.ndarray | None = None, length: np.ndarray | None = None) -> pa.RecordBatch:
    """One row: terms in order, how many postings each has, their documents and weights."""
    order = np.lexsort((doc, t))
    t, doc = t[order], doc[order]
    first = np.flatnonzero(np.diff(t, prepend=t[:1] - 1)) if len(t) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(t)))
    parts = (t[first].astype(np.int64), n.astype(np.int32), doc.astype(np.int32), w[order].astype(float), None if p is None else p[order].astype(float), length)
    cells = [pa.array([b"" if x is None else x.tobytes()], pa.binary()) for x in parts]
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.string())), *cells], ["ids", "t", "n", "d", "w", "p", "len"])


def posting_blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings doc_id, term, weight and perhaps ``peak``, unique in the first two; null ids, terms and weights are left out.

    The one shuffle of an index: by doc_id, of which each is in one block. Terms
    are kept as 64-bit hashes.
    """
    peak = "peak" in postings.columns
    kept = postings.filter("doc_id IS NOT NULL AND term IS NOT NULL AND weight IS NOT NULL")
    columns = [F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w")]
    rows = kept.select(*columns, *([F.col("peak").cast("double").alias("p")] if peak else [])).repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            runs = pc.run_end_encode(table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"])
            ids, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            starts = np.append(0, ends[:-1])
            t, w = table["t"].to_numpy(), table["w"].to_numpy()
            p = table["p"].to_numpy() if peak else None
            whole = len(ids) if last else len(ids) - 1  # the last document may go on
            lo = 0
            while lo < whole:
                hi = min(whole, lo + BLOCK, max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_POSTINGS, "right"))))
                at = slice(int(starts[lo]), int(ends[hi - 1]))
                doc = np.repeat(np.arange(hi - lo), (ends - starts)[lo:hi])
                yield _block(ids[lo:hi], doc, t[at], w[at], None if p is None else p[at])
                lo = hi
            rest = table.slice(int(ends[whole - 1]) if whole else 0)
            held, n = rest.to_batches(), rest.num_rows

        limit = BLOCK_POSTINGS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= limit:
                    yield from cut(False)
                    limit = max(BLOCK_POSTINGS, 2 * n)
        if held:
            yield from cut(True)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of doc_id, content with token counts as weights and lengths; no shuffle. Ids are unique; null ids are left out.

    Documents without a token are there too, with length 0: they count in BM25.
    """
    hashes = F.coalesce(F.transform(tokens("content"), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), hashes.alias("t"))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        names = table["doc_id"].to_pylist()
        sizes = pc.list_value_length(table["t"]).to_numpy()
        place = np.argsort(np.argsort(np.array(names, object), kind="stable"), kind="stable")
        doc, t = np.repeat(place, sizes), pc.list_flatten(table["t"]).to_numpy()
        order = np.lexsort((doc, t))
        doc, t = doc[order], t[order]
        first = np.flatnonzero((np.diff(t, prepend=t[:1] - 1) != 0) | (np.diff(doc, prepend=-1) != 0)) if len(t) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(t)))
        length = np.zeros(len(names))
        length[place] = sizes
        return _block(sorted(names), doc[first], t[first], tf, None, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, postings = [], 0, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                held.append(batch)
                n, postings = n + batch.num_rows, postings + (pc.sum(pc.list_value_length(batch.column(1))).as_py() or 0)
                if n >= BLOCK or postings >= BLOCK_POSTINGS:
                    yield block(held)
                    held, n, postings = [], 0, 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


@dataclass
class Batch:
    """A bounded number of queries: ids, and by query its terms' places in ``vocabulary`` and weights."""

    ids: list[str]
    ends: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: np.ndarray

    @staticmethod
    def read(rows: pa.Table) -> Batch:
        t = pc.list_flatten(rows["t"]).to_numpy()
        vocabulary, term = np.unique(t, return_inverse=True)
        ends = np.append(0, np.cumsum(pc.list_value_length(rows["t"]).to_numpy()))
        return Batch(rows["query_id"].to_pylist(), ends, term, pc.list_flatten(rows["w"]).to_numpy(), vocabulary)


def bounded_batches(asked: DataFrame, key: str = "query_id", size: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """``asked`` (a table in the shared folder, a row per query) in parts of about ``size`` rows by a hash, and whether it is the only part."""
    n = max(1, -(-asked.count() // (size or QUERY_BATCH)))
    for i in range(n):
        yield (asked if n == 1 else asked.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)).toArrow(), n == 1


def per_batch(asked: DataFrame, hits: Callable[[pa.Table], DataFrame], key: str = "query_id", size: int | None = None) -> DataFrame:
    """The hits of all parts of ``asked``. With several parts each is written before the next begins, so one is held at a time."""
    out = None
    for rows, only in bounded_batches(asked, key, size):
        found = hits(rows)
        if not only:
            found = written(found, "hits")
        out = found if out is None else out.unionByName(found)
    return out


class Floors:
    """The ``k``-th best rounded score of every query so far, in one task."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.best, self.floor = k, np.full((n, k), -np.inf), np.full(n, least)

    def add(self, q: int, scores: np.ndarray) -> None:
        both = np.concatenate([self.best[q], scores])
        self.best[q] = np.partition(both, len(both) - self.k)[-self.k :]
        self.floor[q] = max(self.floor[q], self.best[q].min())


def rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    return np.copysign(np.floor(np.abs(s) * 10**digits + 0.5), s) / 10**digits


def chosen(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > kth)
    return np.sort(np.append(above, np.flatnonzero(scores == kth)[: k - len(above)]))


def hit_rows(found: list[tuple[int, list[str], np.ndarray]], ids: list[str]) -> pa.RecordBatch:
    """A row per query and document of (place of the query, documents, scores)."""
    who = [ids[q] for q, names, _ in found for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array([d for _, names, _ in found for d in names], pa.string()), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "doc_id", "score"])


class Bm25:
    """Weights of stored token counts: idf tf / (tf + k1 (1 - b + b length / average)). The statistics are those of all documents."""

    def __init__(self, k1: float = 1.2, b: float = 0.75):
        self.k1, self.b = k1, b

    def measure(self, blocks: DataFrame, vocabulary: np.ndarray) -> None:
        """Documents, average length of those with a token, and idf of the terms asked for: one pass, a row per task and term."""
        shared = blocks.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            df, total, live, docs = np.zeros(len(asked), np.int64), 0.0, 0, 0
            for batch in batches:
                for t, n, length in zip(*batch.columns, strict=True):
                    t, n, length = np.frombuffer(t.as_py(), np.int64), np.frombuffer(n.as_py(), np.int32), np.frombuffer(length.as_py())
                    at = np.searchsorted(asked, t)
                    known = np.flatnonzero(at < len(asked))
                    known = known[asked[at[known]] == t[known]]
                    df[at[known]] += n[known]
                    total, live, docs = total + length.sum(), live + int((length > 0).sum()), docs + len(length)
            at = np.flatnonzero(df)
            what = np.concatenate([[-1, -2, -3], at])
            yield pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(np.concatenate([[total, live, docs], df[at]]).astype(float))], ["what", "n"])

        rows = blocks.select("t", "n", "len").mapInArrow(run, "what int, n double").groupBy("what").agg(F.sum("n").alias("n")).toArrow()
        known = dict(zip(rows["what"].to_pylist(), rows["n"].to_pylist(), strict=True))
        self.n, live = known.get(-3, 0.0), known.get(-2, 0.0)
        self.average = known.get(-1, 0.0) / live if live else 1.0
        df = np.zeros(len(vocabulary))
        for what, n in known.items():
            if what >= 0:
                df[what] = n
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        shared.unpersist()

    def __call__(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf / (tf + self.k1 * ((1 - self.b) + self.b * length / self.average))


def top_k_blocks(blocks: DataFrame, terms: DataFrame, k: int, digits: int, bm25: Bm25 | None = None, least: bool = False, size: int | None = None) -> DataFrame:
    """query_id, doc_id, score: hits of ``terms`` (query_id, term, weight above 0), among them the ``k`` best of each query, exactly.

    The score of a document is the sum of weight products over common terms
    (with ``least`` of the smaller weights), plus the greatest product with
    ``p`` where the blocks have it. With
    ``bm25`` the stored counts become weights by it. Rounded scores decide, of
    equal ones the smaller ids. Documents without a common term are in no row.
    """
    live = terms.filter("weight > 0 AND term IS NOT NULL AND query_id IS NOT NULL").select("query_id", F.struct(F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w")).alias("x"))
    asked = live.groupBy("query_id").agg(F.collect_list("x").alias("x")).select(F.col("query_id").cast("string").alias("query_id"), F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    spark = blocks.sparkSession

    def hits(rows: pa.Table) -> DataFrame:
        batch = Batch.read(rows)
        if bm25:
            bm25.measure(blocks, batch.vocabulary)
        shared = spark.sparkContext.broadcast((batch, bm25, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, weigh, smaller = shared.value
            floors = Floors(len(asked.ids), k, 0.0)
            for rows in batches:
                for row in zip(*rows.columns, strict=True):
                    found = list(_search(row, asked, weigh, smaller, floors, k, digits))
                    if found:
                        yield hit_rows(found, asked.ids)

        return blocks.mapInArrow(run, HITS)

    return per_batch(written(asked, "asked"), hits, size=size)


def _search(row: tuple, asked: Batch, weigh: Bm25 | None, smaller: bool, floors: Floors, k: int, digits: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """query, ids, scores of one block's documents that may be among the ``k`` best of a query."""
    t, n, d = np.frombuffer(row[1].as_py(), np.int64), np.frombuffer(row[2].as_py(), np.int32), np.frombuffer(row[3].as_py(), np.int32)
    w, p, length = (np.frombuffer(c.as_py()) for c in row[4:7])
    if not len(t) or not len(asked.vocabulary):
        return
    ends = np.append(0, np.cumsum(n, dtype=np.int64))
    at = np.minimum(np.searchsorted(t, asked.vocabulary), len(t) - 1)
    here = t[at] == asked.vocabulary
    lo, hi = np.where(here, ends[at], 0), np.where(here, ends[at + 1], 0)
    if weigh:  # only the postings of terms that are asked for
        mine = np.flatnonzero(here)
        size = hi[mine] - lo[mine]
        places = np.repeat(lo[mine] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        d, w = d[places], weigh(np.repeat(mine, size), w[places], length[d[places]])
        hi[mine] = np.cumsum(size)
        lo[mine] = hi[mine] - size
    # no document can score above the sum of its terms' greatest weights: most queries need no look at most blocks
    size = hi - lo
    live = np.flatnonzero(size)
    bound, peak = np.zeros(len(size)), np.zeros(len(size))
    bound[live] = [w[a:b].max() for a, b in zip(lo[live].tolist(), hi[live].tolist(), strict=True)]
    if len(p):
        peak[live] = [p[a:b].max() for a, b in zip(lo[live].tolist(), hi[live].tolist(), strict=True)]
    part = np.minimum(bound[asked.term], asked.weight) if smaller else bound[asked.term] * asked.weight
    most = np.append(0.0, np.cumsum(part))
    most = most[asked.ends[1:]] - most[asked.ends[:-1]]
    if len(p) and len(asked.term):
        grouped = np.maximum.reduceat(np.append(peak[asked.term] * asked.weight, 0.0), asked.ends[:-1])
        most += np.where(np.diff(asked.ends) > 0, grouped, 0)
    ids = row[0].values
    n_docs = len(ids)
    dense = {}
    for x in np.flatnonzero(4 * size > n_docs).tolist():
        dense[x] = np.zeros(n_docs)
        dense[x][d[lo[x] : hi[x]]] = w[lo[x] : hi[x]]
    lo, hi, term, weight, starts = lo.tolist(), hi.tolist(), asked.term.tolist(), asked.weight.tolist(), asked.ends.tolist()
    score, top = np.zeros(n_docs), np.zeros(n_docs) if len(p) else None
    for q in np.flatnonzero((most > 0) & (most * (1 + 1e-9) >= floors.floor - 10.0**-digits)).tolist():
        score[:] = 0
        if top is not None:
            top[:] = 0
        for i in range(starts[q], starts[q + 1]):
            x = term[i]
            a, b = lo[x], hi[x]
            if a < b:
                if x in dense:
                    score += np.minimum(dense[x], weight[i]) if smaller else dense[x] * weight[i]
                else:
                    score[d[a:b]] += np.minimum(w[a:b], weight[i]) if smaller else w[a:b] * weight[i]
                if top is not None:
                    docs = d[a:b]
                    top[docs] = np.maximum(top[docs], p[a:b] * weight[i])
        full = score if top is None else score + top
        floor = floors.floor[q]
        able = np.flatnonzero(full >= floor - 10.0**-digits if floor > 0 else full)
        if not len(able):
            continue
        near = rounded(full[able], digits)
        keep = np.flatnonzero(near >= floor)
        keep = keep[chosen(near[keep], k)]
        if len(keep):
            floors.add(q, near[keep])
            yield q, ids.take(pa.array(able[keep])).to_pylist(), full[able[keep]]
