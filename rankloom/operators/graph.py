"""Document-term graph: edges, neighbours by shared terms, two-hop scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.blocks import HITS, QUERY_BATCH, Batch, Floors, _search, hit_rows, per_batch, posting_blocks, store_blocks, top_k_blocks
from rankloom.operators.sparse import _DOT, DIGITS, rank_hits, ranked_sql, top_k_dot
from rankloom.plans import datasets as D
from rankloom.session import written

#: Digits of two-hop scores: products of two weights and the decay stay clear of rounding limits.
GRAPH_DIGITS = 8
#: Documents in a block, and sources of a block that are compared at once.
GRAPH_BLOCK, GRAPH_ROWS = 4_096, 512
#: Terms of linked documents that a task holds before it adds them up.
REACH_ROWS = 1 << 20
#: Blocks whose terms a block of links meets in one row, and links that are followed at once.
REACH_BLOCKS, REACH_LINKS = 64, 1 << 14
#: Links of a block: place in it, number of the other document, weight in units of the last digit.
LISTS, LISTS_NAMES = "r long, ids array<string>, place binary, num binary, units binary", ["r", "ids", "place", "num", "units"]


def edges(postings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, term, weight of postings with at least the threshold. Documents without an edge stay in their own table."""
    return postings.filter(F.col("weight") >= threshold)


def neighbours(graph: DataFrame, n: int = 50, asked: Column | None = None) -> DataFrame:
    """src, dst, weight: the ``n`` documents that share most with each source, by the sum of the smaller weights; ties by dst.

    ``asked`` selects the sources (a stated query set); all documents are
    compared with them, in blocks and where they are: no row is made of a pair
    that can't be chosen, and a term in most documents costs no shuffle.
    """
    sources = (graph if asked is None else graph.filter(asked)).select(F.col("doc_id").alias("query_id"), "term", "weight")
    hits = top_k_blocks(store_blocks(posting_blocks(graph)), sources, n + 1, DIGITS, least=True)  # itself among them
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst"))
    shared = hits.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), F.round("score", DIGITS).alias("weight")).filter("src <> dst")
    return shared.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def _packed(x: np.ndarray) -> bytes:
    """Compressed, after its length: rows that meet many others stay small where they are joined."""
    return x.nbytes.to_bytes(8, "little") + (pa.compress(x.tobytes(), codec="zstd", asbytes=True) if x.nbytes else b"")


def _unpacked(cell: pa.Scalar, kind: type) -> np.ndarray:
    data = cell.as_buffer()
    size = int.from_bytes(data[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), kind) if size else np.zeros(0, kind)


def _doc_blocks(graph: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """b long, ids array<string>, n, t, w binary: documents in blocks, by id over all of them: number of terms, terms as 64-bit hashes, weights.

    Also the ``b`` of all blocks in order. A document's number is the place of
    its block in there, times ``GRAPH_BLOCK``, plus its place in the block, so
    numbers go as ids do.
    """
    kept = graph.filter("doc_id IS NOT NULL AND term IS NOT NULL AND weight IS NOT NULL").select("doc_id", F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w"))
    rows = kept.repartitionByRange("doc_id").groupBy("doc_id").agg(F.collect_list("t").alias("t"), F.collect_list("w").alias("w")).sortWithinPartitions("doc_id")
    size = GRAPH_BLOCK

    def block(part: pa.Table) -> pa.RecordBatch:
        t, w = (part[c].combine_chunks() for c in ("t", "w"))
        n = t.value_lengths().to_numpy().astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([part["doc_id"].to_pylist()], pa.list_(pa.string())), *(pa.array([_packed(x)], pa.binary()) for x in (n, t.flatten().to_numpy(), w.flatten().to_numpy()))], ["ids", "n", "t", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size).combine_chunks())
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks())

    found = written(rows.mapInArrow(run, "ids array<string>, n binary, t binary, w binary").withColumn("b", F.monotonically_increasing_id()), "blocks")
    return found, np.sort(found.select("b").toArrow()["b"].to_numpy())


def shared_weight(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of the smaller weights of common terms. ``a``: row, term, weight; ``b``: column, term, weight by term."""
    out = np.zeros(shape)
    order = np.argsort(a[1], kind="stable")
    row, term, weight = (x[order] for x in a)
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
    stop = np.r_[start[1:], len(term)]
    lo, hi = np.searchsorted(b[1], term[start]), np.searchsorted(b[1], term[start], "right")
    pairs = (stop - start) * (hi - lo)
    few = np.repeat(pairs <= 64, stop - start)
    width = np.repeat(hi - lo, stop - start)[few]
    at = np.repeat(np.repeat(lo, stop - start)[few], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    np.add.at(out.reshape(-1), np.repeat(row[few], width) * shape[1] + b[0][at], np.minimum(np.repeat(weight[few], width), b[2][at]))
    flat, dense = out.reshape(-1), 4 * pairs > out.size
    for i in np.flatnonzero((pairs > 64) & ~dense):
        here, there = slice(start[i], stop[i]), slice(lo[i], hi[i])
        flat[row[here, None] * shape[1] + b[0][there]] += np.minimum(weight[here, None], b[2][there])
    dense = np.flatnonzero((pairs > 64) & dense)  # in most documents: without look-ups, some rows at a time so that they stay in the cache
    full_a, full_b = np.zeros((len(dense), shape[0])), np.zeros((len(dense), shape[1]))
    for x, i in enumerate(dense):
        full_a[x, row[start[i] : stop[i]]], full_b[x, b[0][lo[i] : hi[i]]] = weight[start[i] : stop[i]], b[2][lo[i] : hi[i]]
    for top in range(0, shape[0] if len(dense) else 0, 16):
        part = out[top : top + 16]
        least = np.empty_like(part)
        for x in range(len(dense)):
            part += np.minimum(full_a[x, top : top + 16, None], full_b[x], out=least)
    return out


class Nearest:
    """The ``n`` greatest shared weights so far of every document of a block, in units of the last digit, and the numbers of the others; of equal ones the smaller."""

    def __init__(self, rows: int, n: int):
        self.n, self.units, self.num = n, np.full((rows, n), -1), np.full((rows, n), np.iinfo(np.int64).max)

    def add(self, lo: int, s: np.ndarray, first: int) -> None:
        """``s``: shared weights of the documents from place ``lo`` on with those from number ``first`` on."""
        n, over = self.n, s.shape[1] - self.n
        least = (self.units[lo : lo + len(s), -1:] - 0.6) / 10**DIGITS
        if over > 0 and least.min() < 0:
            kth = np.array([np.partition(x, over)[over] for x in s])
            least = np.maximum(least, kth[:, None] - 1.01 / 10**DIGITS)
        i, j = np.nonzero(s >= np.maximum(least, np.finfo(float).tiny))
        if not len(i):
            return
        mine = np.unique(i)
        row = np.append(np.repeat(mine, n), i)
        units = np.append(self.units[lo + mine], np.floor(s[i, j] * 10**DIGITS + 0.5).astype(np.int64))
        num = np.append(self.num[lo + mine], first + j)
        order = np.lexsort((num, -units, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < n]
        self.units[lo + mine], self.num[lo + mine] = units[order].reshape(-1, n), num[order].reshape(-1, n)

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """place, number of the other, units: by place."""
        place, at = np.nonzero(self.units >= 0)
        return place.astype(np.int32), self.num[place, at], self.units[place, at]


def _meet(batches: Iterator[pa.RecordBatch], known: np.ndarray, size: int, step: int, n: int) -> Iterator[tuple[int, pa.Scalar, Nearest, dict[int, pa.Scalar]]]:
    """Place of the block, ids, nearest, ids of the blocks met: one for each block of sources, whose rows follow each other."""

    def read(row: tuple[pa.Scalar, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = _unpacked(row[2], np.int32)
        return np.repeat(np.arange(len(n)), n), _unpacked(row[3], np.int64), _unpacked(row[4], float)

    block, done, ids, names, waiting = None, set(), None, {}, []
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            own = int(np.searchsorted(known, row[0].as_py()))
            if own != block:
                if block is not None:
                    yield block, ids, best, names
                if own in done:
                    raise RuntimeError("the rows of a block don't follow each other")
                block, ids = own, None
                done.add(own)
            waiting.append(row[5:])
            if ids is None and (row[1].is_valid or row[0] == row[5]):
                first = row[:5] if row[1].is_valid else row[5:]
                ids, a = first[1], read(first)
                best = Nearest(len(ids), n)
            if ids is None:
                continue
            for met in waiting:
                other = int(np.searchsorted(known, met[0].as_py()))
                names[other] = met[1]
                b = read(met)
                order = np.argsort(b[1], kind="stable")
                b = tuple(x[order] for x in b)
                for lo in range(0, len(ids), step):
                    at = slice(*np.searchsorted(a[0], [lo, lo + step]))
                    s = shared_weight((a[0][at] - lo, a[1][at], a[2][at]), b, (min(step, len(ids) - lo), len(met[1])))
                    if own == other:
                        s[np.arange(len(s)), lo + np.arange(len(s))] = 0
                    best.add(lo, s, other * size)
            waiting = []
    if block is not None:
        yield block, ids, best, names


def _pairs_of_blocks(found: DataFrame, n_blocks: int) -> DataFrame:
    """A block of sources with up to some 64 others, one after the other in one task. Where it is among them, it isn't sent a second time."""
    columns, whole = ("b", "ids", "n", "t", "w"), n_blocks < 64
    left = found.select(*((F.lit(None).cast(found.schema[c].dataType) if whole and c != "b" else F.col(c)).alias("a" + c) for c in columns)).repartition(max(1, n_blocks))
    return left.hint("shuffle_replicate_nl").crossJoin(found.select(*columns).coalesce(1 + n_blocks // 64))  # pairs are met where they are made


def all_neighbours(graph: DataFrame, n: int = 50) -> DataFrame:
    """src, dst, weight as ``neighbours`` of all documents: blocks of documents meet, and no row is made of a pair that can't be chosen.

    ``graph`` has a document's term once, with a weight above 0. A block of
    sources meets up to some 64 others in one task, which keeps the ``n`` greatest weights
    so far of each source.
    """
    found, known = _doc_blocks(graph)
    size, step = GRAPH_BLOCK, GRAPH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, best, names in _meet(batches, known, size, step, n):
            place, num, units = best.lists()
            dst = np.empty(len(num), object)
            for r in np.unique(num // size):
                at = num // size == r
                dst[at] = np.array(names[r].as_py(), object)[num[at] % size]
            yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(place)), pa.array(dst.tolist(), pa.string()), pa.array(units / 10**DIGITS)], ["src", "dst", "weight"])

    rows = _pairs_of_blocks(found, len(known)).mapInArrow(run, "src string, dst string, weight double")
    order = Window.partitionBy("src").orderBy(F.col("weight").desc(), F.col("dst"))
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def _lists_row(r: int, ids: pa.Scalar | None, *parts: np.ndarray) -> list[pa.Array]:
    return [pa.array([r]), pa.array([ids], pa.list_(pa.string())), *(pa.array([_packed(x)], pa.binary()) for x in parts)]


def _read_lists(row: tuple[pa.Scalar, ...]) -> list[np.ndarray]:
    return [_unpacked(c, kind) for c, kind in zip(row, (np.int32, np.int64, np.int64), strict=True)]


def _gathered(lists: DataFrame, tasks: int, cut: Callable[..., np.ndarray]) -> DataFrame:
    """One row for each block, with what ``cut`` (place, num, units) chooses of all its lists; blocks are dealt out in turn."""
    dealt = lists.repartitionById(tasks, (F.col("r") % tasks).cast("int")).sortWithinPartitions("r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held = None, None, []

        def out() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            at = cut(*parts)
            return pa.RecordBatch.from_arrays(_lists_row(block, ids, *(x[at] for x in parts)), LISTS_NAMES)

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if row[0].as_py() != block:
                    if held:
                        yield out()
                    block, ids, held = row[0].as_py(), None, []
                ids = row[1].as_py() if ids is None else ids
                held.append(_read_lists(row[2:]))
        if held:
            yield out()

    return dealt.mapInArrow(run, LISTS)


def _links(found: DataFrame, known: np.ndarray, n: int, tasks: int) -> DataFrame:
    """r, ids, place, num, units: for each block of documents the links to them (place in the block, number of the other, weight), by the other's number.

    As ``doc_edges``: a link stands if either end chose it. Links are numbers
    of some bytes here, packed by pairs of blocks, and each is shuffled once
    for each end that chose it.
    """
    size, step = GRAPH_BLOCK, GRAPH_ROWS

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids, best, _ in _meet(batches, known, size, step, n):
            yield pa.RecordBatch.from_arrays(_lists_row(r, ids.as_py(), *best.lists()), LISTS_NAMES)

    def best(place: np.ndarray, num: np.ndarray, units: np.ndarray) -> np.ndarray:
        order = np.lexsort((num, -units, place))
        return order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < n]

    def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], kind) for x, kind in zip(row, batch.schema.types, strict=True)], LISTS_NAMES)
                r, (place, num, units) = row[0].as_py(), _read_lists(row[2:])
                order = np.argsort(num // size, kind="stable")
                place, num, units = place[order], num[order], units[order]
                for at in np.split(np.arange(len(num)), np.flatnonzero(np.diff(num // size)) + 1):
                    if len(at):
                        yield pa.RecordBatch.from_arrays(_lists_row(int(num[at[0]] // size), None, (num[at] % size).astype(np.int32), r * size + place[at].astype(np.int64), units[at]), LISTS_NAMES)

    def once(place: np.ndarray, num: np.ndarray, units: np.ndarray) -> np.ndarray:
        order = np.lexsort((units, place, num))
        return order[np.append(True, (np.diff(num[order]) != 0) | (np.diff(place[order]) != 0))[: len(order)]]

    lists = _pairs_of_blocks(found, len(known)).mapInArrow(nearest, LISTS)
    if len(known) >= 64:
        lists = _gathered(lists, len(known), best)
    return _gathered(lists.mapInArrow(both_ways, LISTS), tasks, once)


def doc_edges(graph: DataFrame, n: int = 50, asked: Column | None = None) -> DataFrame:
    """src, dst, weight in both directions: an edge stands if either end chose it, so a degree may exceed ``n``."""
    chosen = written(all_neighbours(graph, n) if asked is None else neighbours(graph, n, asked), "chosen")
    return chosen.unionByName(chosen.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()


def hop_scores(graph: DataFrame, links: DataFrame, terms: DataFrame, decay: float = 0.5, allowed: DataFrame | None = None, k: int | None = 50) -> DataFrame:
    """query_id, doc_id, score, rank: hop 1 by query terms (of any sign), hop 2 from hop 1 to neighbours, times ``decay``.

    Hop 2 starts from the scores of hop 1 as they are, so it doesn't feed on
    itself. ``allowed`` (query_id, doc_id or doc_id alone) restricts the result.
    """
    first = graph.join(terms.select("query_id", "term", F.col("weight").alias("qw")), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    second = first.withColumnRenamed("doc_id", "src").join(links, "src").select("query_id", F.col("dst").alias("doc_id"), (decay * F.col("score") * F.col("weight")).alias("score"))
    scored = first.unionByName(second).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    if allowed is not None:
        scored = scored.join(allowed, [c for c in ("query_id", "doc_id") if c in allowed.columns], "left_semi")
    return rank_hits(scored, k, GRAPH_DIGITS)


class Reach:
    """What each term adds to the score of each document of a block: by its own weights, and by those of the documents linked to it."""

    def __init__(self, size: int, terms: int):
        self.size, self.kind, self.new, self.pending = size, np.int32 if terms * size < 1 << 31 else np.int64, [], 0
        self.summed = [(np.zeros(0, self.kind), np.zeros(0))]

    def add(self, place: np.ndarray, num: np.ndarray, factor: np.ndarray, docs: np.ndarray, n: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        """``factor`` times the terms of ``num``, for the document at ``place``. ``docs``: numbers in order, with ``n`` terms ``t`` each, of weight ``w``."""
        if not len(docs):
            return
        at = np.minimum(np.searchsorted(docs, num), len(docs) - 1)
        met = np.flatnonzero(docs[at] == num)
        starts = np.cumsum(n, dtype=np.int64) - n
        for lo in range(0, len(met), REACH_LINKS):
            mine = met[lo : lo + REACH_LINKS]
            long = n[at[mine]].astype(np.int64)
            i = np.repeat(starts[at[mine]] - np.cumsum(long) + long, long) + np.arange(long.sum())
            self.new.append((t[i].astype(self.kind) * self.kind(self.size) + np.repeat(place[mine].astype(self.kind), long), w[i] * np.repeat(factor[mine], long)))
            self.pending += len(i)
            if self.pending > REACH_ROWS:
                self.summed.append(self._sum(self.new))
                self.new, self.pending = [], 0

    @staticmethod
    def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.add.reduceat(value, first) if len(first) else value

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """term * size + place in order, sum."""
        parts, self.summed, self.new = self.summed + self.new, [], []
        return self._sum(parts)


def two_hop(graph: DataFrame, terms: DataFrame, n: int = 50, decay: float = 0.5, k: int | None = 50, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank as ``hop_scores`` over the links of all documents, without a row for each query, document and neighbour.

    A score is a sum over the query's terms, whatever the way from the term to
    the document, so what a term adds by both hops is summed once for each
    document of a block and then asked by all queries. Weights of ``terms`` are
    above 0. Give ``k`` or ``allowed`` (query_id, doc_id: a bounded number of
    documents for each query, which are sent out with a batch of queries).
    """
    if (k is None) == (allowed is None):
        raise ValueError("either k or allowed")
    spark = graph.sparkSession
    live = terms.filter("weight > 0 AND term IS NOT NULL AND query_id IS NOT NULL").select("query_id", F.struct(F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w")).alias("x"))
    asked = live.groupBy("query_id").agg(F.collect_list("x").alias("x")).select(F.col("query_id").cast("string").alias("query_id"), F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    if allowed is not None:
        asked = asked.join(allowed.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.collect_set("doc_id").alias("docs")), "query_id")
    asked = written(asked, "asked")
    found, known = _doc_blocks(graph)
    links = _links(found, known, n, max(1, min(len(known), spark.sparkContext.defaultParallelism)))
    if asked.count() > QUERY_BATCH:
        links = written(links, "links")
    size = GRAPH_BLOCK

    def hits(rows: pa.Table) -> DataFrame:
        batch = Batch.read(rows)
        only = None if allowed is None else (pc.list_flatten(rows["docs"]).combine_chunks(), np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["docs"]).to_numpy()))
        shared = spark.sparkContext.broadcast((batch, only))

        def asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, held = shared.value[0].vocabulary, []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([_packed(np.concatenate(x))], pa.binary()) for x in zip(*held, strict=True)], ["docs", "n", "t", "w"])

            for b in batches:
                for row in zip(*b.columns, strict=True):
                    n, t, w = (_unpacked(c, kind) for c, kind in zip(row[1:], (np.int32, np.int64, float), strict=True))
                    at = np.minimum(np.searchsorted(vocabulary, t), max(0, len(vocabulary) - 1))
                    mine = np.flatnonzero(vocabulary[at] == t) if len(vocabulary) else np.zeros(0, int)
                    number = np.searchsorted(known, row[0].as_py()) * size + np.arange(len(n))
                    n = np.bincount(np.repeat(np.arange(len(n)), n)[mine], minlength=len(n)).astype(np.int32)
                    if held and (len(held) == REACH_BLOCKS or number[0] < held[-1][0][0]):
                        yield out()
                        held = []
                    held.append((number, n, at[mine].astype(np.int32), w[mine]))
            if held:
                yield out()

        def top(ids: pa.Scalar, key: np.ndarray, value: np.ndarray, asked: Batch, floors: Floors) -> Iterator[pa.RecordBatch]:
            t = key // size
            first = np.flatnonzero(np.diff(t, prepend=-1))
            parts = (asked.vocabulary[t[first]], np.diff(np.append(first, len(t))).astype(np.int32), (key % size).astype(np.int32), value, np.zeros(0), np.zeros(0))
            near = _search((ids, *(pa.scalar(x.tobytes()) for x in parts)), asked, None, False, floors, k, GRAPH_DIGITS)
            while some := list(islice(near, 4_096)):
                yield hit_rows(some, asked.ids)

        def these(ids: pa.Scalar, key: np.ndarray, value: np.ndarray, asked: Batch, place: np.ndarray, docs: pa.Array, query: np.ndarray) -> Iterator[pa.RecordBatch]:
            mine = np.flatnonzero(place >= 0)
            long = (asked.ends[1:] - asked.ends[:-1])[query[mine]]
            i = np.repeat(asked.ends[query[mine]] - np.cumsum(long) + long, long) + np.arange(long.sum())
            wanted = (asked.term[i] * np.int64(size) + np.repeat(place[mine], long)).astype(key.dtype)
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            met = np.flatnonzero(key[at] == wanted)
            pair = np.repeat(np.arange(len(mine)), long)[met]
            score = np.bincount(pair, value[at[met]] * asked.weight[i[met]], len(mine))
            near = np.unique(pair)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids, pa.string()).take(pa.array(query[mine[near]])), docs.take(pa.array(mine[near])), pa.array(score[near])], ["query_id", "doc_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, only = shared.value
            floors = None if only else Floors(len(asked.ids), k, 0.0)
            block, done = None, set()

            def end() -> Iterator[pa.RecordBatch]:
                key, value = reach.sums()
                if len(key):
                    yield from top(ids, key, value, asked, floors) if only is None else these(ids, key, value, asked, here, *only)

            for b in batches:
                for row in zip(*b.columns, strict=True):
                    if row[0].as_py() != block:
                        if block is not None:
                            yield from end()
                        block, ids, reach = row[0].as_py(), row[1], Reach(size, len(asked.vocabulary))
                        if block in done:
                            raise RuntimeError("the rows of a block don't follow each other")
                        done.add(block)
                        place, num, units = _read_lists(row[2:5])
                        own = np.arange(len(ids))
                        place, num, factor = np.append(place, own), np.append(num, block * size + own), np.append(decay * (units / 10**DIGITS), np.ones(len(own)))
                        if only is not None:
                            here = pc.fill_null(pc.index_in(only[0], value_set=ids.values), -1).to_numpy()
                            kept = np.isin(place, here)
                            place, num, factor = place[kept], num[kept], factor[kept]
                    reach.add(place, num, factor, *(_unpacked(c, kind) for c, kind in zip(row[5:], (np.int64, np.int32, np.int32, float), strict=True)))
            if block is not None:
                yield from end()

        narrow = written(found.select("b", "n", "t", "w").mapInArrow(asked_terms, "docs binary, n binary, t binary, w binary"), "narrow")
        return links.hint("shuffle_replicate_nl").crossJoin(narrow.coalesce(1)).mapInArrow(run, HITS)

    return rank_hits(per_batch(asked, hits), k, GRAPH_DIGITS)


def stats(docs: DataFrame, graph: DataFrame, links: DataFrame) -> DataFrame:
    """bipartite_nodes, bipartite_edges, doc_nodes, doc_edges (undirected)."""
    nodes = docs.agg(F.count_distinct("doc_id").alias("n_docs"))
    terms = graph.agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("bipartite_edges"))
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count(F.lit(1)).alias("doc_edges"))
    return nodes.crossJoin(terms).crossJoin(pairs).select((F.col("n_docs") + F.col("n_terms")).alias("bipartite_nodes"), "bipartite_edges", F.col("n_docs").alias("doc_nodes"), "doc_edges")


def _asked() -> Column:
    """The stated set of sources: documents whose number is divisible by 100."""
    return F.regexp_extract("doc_id", r"(\d+)$", 1).try_cast("bigint") % 100 == 0


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(edges(D.sparse_postings(spark, sf_dir)), "graph")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(D.sparse_postings(spark, sf_dir))


def doc_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_graph(spark, sf_dir), 20, _asked())


def graph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop scores over the whole graph: 50 neighbours of every document."""
    graph = _graph(spark, sf_dir)
    terms = D.query_tokens(D.judged_queries(spark, sf_dir, D.binary(spark, sf_dir)))
    return two_hop(graph, terms, k=20)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the whole graph: 50 neighbours of every document."""
    postings = written(D.sparse_postings(spark, sf_dir), "postings")
    graph = written(edges(postings), "graph")
    return stats(postings, graph, doc_edges(graph))


def graph_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hop scores of the documents that another search found: the ten best of each query by sparse dot product."""
    postings, terms = written(D.sparse_postings(spark, sf_dir), "postings"), D.query_tokens(D.judged_queries(spark, sf_dir, D.binary(spark, sf_dir)))
    return two_hop(edges(postings), terms, k=None, allowed=top_k_dot(postings, terms, 10).select("query_id", "doc_id"))


QUERIES = {"graph_edges": graph_edges, "doc_similarity": doc_similarity, "graph_score": graph_score, "graph_stats": graph_stats, "graph_allowed": graph_allowed}

_E = D.with_("post") + ", ed AS (SELECT * FROM post WHERE weight >= 0.5)"
_N = """, nb AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM (
  SELECT a.doc_id AS src, b.doc_id AS dst, round(sum(least(a.weight, b.weight)), 6) AS weight FROM ed a JOIN ed b ON a.term = b.term AND a.doc_id <> b.doc_id
  WHERE {w} GROUP BY 1, 2)) WHERE r <= {n}),
  ln AS (SELECT DISTINCT * FROM (SELECT * FROM nb UNION ALL SELECT dst, src, weight FROM nb))"""
_ASKED, _ALL = "TRY_CAST(regexp_extract(a.doc_id, '(\\d+)$', 1) AS BIGINT) % 100 = 0", "true"
_H = """, h1 AS (SELECT query_id, doc_id, sum(q.weight * e.weight) AS score FROM ed e JOIN bqt q USING (term) GROUP BY 1, 2),
  hh AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT query_id, dst, 0.5::DOUBLE * score * weight FROM h1 JOIN ln ON src = doc_id) GROUP BY 1, 2) """
SQL = {
    "graph_edges": _E + " SELECT * FROM ed",
    "doc_similarity": _E + _N.format(n=20, w=_ASKED) + " SELECT * FROM nb",
    "graph_score": D.with_("judged_binary", "all_q", "bq", "bqt", "post") + ", ed AS (SELECT * FROM post WHERE weight >= 0.5)" + _N.format(n=50, w=_ALL) + _H + ranked_sql("SELECT * FROM hh", 20, GRAPH_DIGITS),
    "graph_allowed": D.with_("judged_binary", "all_q", "bq", "bqt", "post") + ", ed AS (SELECT * FROM post WHERE weight >= 0.5)" + _N.format(n=50, w=_ALL) + _H
    + f", al AS ({ranked_sql(_DOT.format(p='post', q='bqt'), 10)}) " + ranked_sql("SELECT hh.* FROM hh JOIN al USING (query_id, doc_id)", 10, GRAPH_DIGITS),
    "graph_stats": _E + _N.format(n=50, w=_ALL) + """ SELECT (SELECT count(DISTINCT doc_id) FROM post) + (SELECT count(DISTINCT term) FROM ed) AS bipartite_nodes, (SELECT count(*) FROM ed) AS bipartite_edges,
      (SELECT count(DISTINCT doc_id) FROM post) AS doc_nodes, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM ln)) AS doc_edges""",
}
