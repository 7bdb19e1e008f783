"""Problem 6: the most similar vectors of every vector, by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.blocks import Floors, chosen, per_batch
from rankloom.session import written
from rankloom.sources.tables import table

#: Rows of the sample that the curves are fitted on (scale, range limits, distances along a curve), at most.
SAMPLE = 16_384
#: Rows of the sample whose true neighbours are found first, to choose curves and reach.
PROBES = 1_024
#: Curves that are tried, and the share of true neighbours that they are to find.
CURVES, RECALL = 16, 0.98
#: Vectors in one range of a curve, at least, and points of the sample in it.
RANGE_ROWS, RANGE_POINTS = 16_384, 16
#: Rows of a block, and the shortest and longest way that it looks along the curve to either side.
BLOCK, REACH, LONGEST = 1_024, 512, 32_768
#: Asking vectors that are compared with all others at once, where no curves find their neighbours.
ASKING = 16_384
#: What carrying a vector to one more curve costs, in comparisons.
CARRY = 4_000
#: Dimensions of the projections and bits of each; together at most 32.
DIMS, BITS = 8, 4


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with integer coordinates below 2 ** bits; one row per point.

    Skilling's published transform ("Programming the Hilbert curve", 2004), on
    arrays. Walks from the coarsest bit to the finest and keeps, for every point, the
    reflection and the exchange of axes under which its sub-cube is traversed.
    """
    x = cells.T.astype(np.int64)
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            reflect = (x[i] >> level) & 1 == 1
            swap = np.where(reflect, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(reflect, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where((x[-1] >> level) & 1 == 1, fix ^ ((1 << level) - 1), fix)
    x ^= fix
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


class Curves:
    """Several Hilbert orderings: each has its own projection and shift, and knows the sample's keys in order."""

    def __init__(self, sample: np.ndarray, n_curves: int, seed: int):
        rng, dims = np.random.default_rng(seed), min(DIMS, sample.shape[1])
        self.fits, self.sorted = [], []
        for _ in range(n_curves):
            axes = np.linalg.qr(rng.normal(size=(sample.shape[1], dims)))[0].astype(np.float32)
            spread = (sample @ axes).std(axis=0) + 1e-9
            self.fits.append((axes / spread, rng.uniform(-0.5, 0.5, dims).astype(np.float32)))
        ids = rng.integers(0, 1 << 62, len(sample))
        self.sorted = [np.sort(self.keys(sample, ids, c)) for c in range(n_curves)]

    def keys(self, x: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """Curve positions, made distinct by 31 bits of the id, so that equal vectors can be divided."""
        axes, shift = self.fits[curve]
        even = 1 / (1 + np.exp(-1.7 * np.clip(x @ axes + shift, -9, 9)))  # about uniform on 0 to 1
        cells = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return hilbert_key(cells, BITS) << 31 | salt.astype(np.int64)

    def use(self, n_curves: int, n: int, reach: int) -> None:
        """Keeps so many curves and divides each into ranges of ``n`` rows in all, with rims of about ``reach`` rows."""
        points = len(self.sorted[0])
        rows = max(RANGE_ROWS, 4 * reach, -(-RANGE_POINTS * n // points))
        self.n_ranges, self.reach = max(1, -(-n // rows)), reach
        self.fits = self.fits[:n_curves]
        at = np.arange(1, self.n_ranges) * points // self.n_ranges
        rim = min(-(-reach * points // max(1, n)) + 1, points // (2 * self.n_ranges) + 1)
        own = self.sorted[:n_curves]
        self.limits = [s[at] for s in own]
        self.rims = [(s[np.maximum(at - rim, 0)], s[np.minimum(at + rim, points - 1)]) for s in own]
        self.sorted = []

    def ranges(self, keys: np.ndarray, curve: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, range, and whether the row belongs there: rows near a limit are guests of the range beyond it."""
        home, (low, high) = np.searchsorted(self.limits[curve], keys, side="right"), self.rims[curve]
        up = np.flatnonzero(np.searchsorted(low, keys, side="right") > home)
        down = np.flatnonzero(np.searchsorted(high, keys, side="right") < home)
        row = np.concatenate([np.arange(len(keys)), up, down])
        return row, np.concatenate([home, home[up] + 1, home[down] - 1]), np.arange(len(row)) < len(keys)


def plan(distance: np.ndarray, target: float, asking: float) -> tuple[int, int] | None:
    """The number of curves and the reach of the least work that bring the target share of pairs together; None if none up to LONGEST do.

    ``distance``: rows between the two vectors of each pair on each curve. A
    vector costs CARRY for every curve, and an asking one what it is compared
    with.
    """
    best, reach = (np.inf, None), REACH
    while reach <= LONGEST:
        met = np.cumsum(distance <= reach, axis=1) > 0  # the curves in their order: choosing the luckiest would promise too much
        enough = np.flatnonzero(met.mean(axis=0) >= target)
        if len(enough):
            n_curves = int(enough[0]) + 1
            best = min(best, (n_curves * (CARRY + asking * (BLOCK + 2 * reach)), (n_curves, reach)), key=lambda b: b[0])
        reach *= 2
    return best[1]


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that aren't broken, and those vectors at length 1.

    Broken: null, of another number of elements than ``dim``, with a null, NaN
    or infinite element, or all zeros.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim)
    length = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return at[good], (x[good] / length[good, None]).astype(np.float32)


def best_in_windows(x: np.ndarray, ids: np.ndarray, k: int, least: float, wanted: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cosine) of the k best within reach of each wanted row; rows are in curve order.

    Columns are taken in groups. The k-th best of the group maxima bounds the
    k-th best column from below, so only the k best groups are looked into.
    """
    n, group, out = len(x), 32, []
    some = max(32, (1 << 23) // (BLOCK + 2 * reach))  # rows at once
    blocks = [lo + np.flatnonzero(wanted[lo : lo + BLOCK]) for lo in range(0, n, BLOCK)]
    for rows in (each[i : i + some] for each in blocks for i in range(0, len(each), some)):
        lo = rows[0] // BLOCK * BLOCK
        a, b = max(0, lo - reach), min(n, lo + BLOCK + reach)
        s = x[rows] @ x[a:b].T
        s[np.arange(len(rows)), rows - a] = -2
        width = -(-s.shape[1] // group)
        if width * group > s.shape[1]:
            s = np.concatenate([s, np.full((len(s), width * group - s.shape[1]), -2, np.float32)], axis=1)
        cells = s.reshape(len(s), width, group)
        top = cells.max(axis=2)
        take = min(k, width)
        groups = np.argpartition(-top, take - 1, axis=1)[:, :take]
        if least > -1:
            live = np.flatnonzero(top.max(axis=1) >= least)
            rows, groups, cells = rows[live], groups[live], cells[live]
            if not len(rows):
                continue
        values = np.take_along_axis(cells, groups[:, :, None], axis=1).reshape(len(rows), -1)
        columns = (groups[:, :, None] * group + np.arange(group)).reshape(len(rows), -1)
        best = np.argpartition(-values, take - 1, axis=1)[:, :k] if values.shape[1] > k else np.tile(np.arange(values.shape[1]), (len(rows), 1))
        score, col = np.take_along_axis(values, best, axis=1), np.take_along_axis(columns, best, axis=1)
        keep = score >= max(least, -1.5)
        r = np.broadcast_to(rows[:, None], score.shape)[keep]
        out.append((ids[r], ids[a + col[keep]], score[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))  # type: ignore[return-value]


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, recall: float = RECALL, query_every: int = 1, dim: int | None = None, seed: int = 11) -> DataFrame:
    """``key``, ``neighbour``, ``cosine``, ``rank``: the k most similar vectors of each vector, approximately.

    ``key`` is a bigint. Rows that repeat a key count once (they hold the same
    vector). Null keys and broken vectors (see :func:`unit_vectors`) are in no
    row; ``dim`` is by default the commonest length in the sample. Pairs under
    ``least`` are left out; it only cuts, ranks are those of all. Of equal
    cosines (to five decimals) the smaller key comes first. With
    ``query_every`` only keys divisible by it ask, against all vectors.

    The curves are fitted on a sample of at most SAMPLE rows; every row is
    indexed. For PROBES rows of the sample the true neighbours among all rows
    are found first, in one pass, and :func:`plan` takes from CURVES curves as
    many, and as long a reach, as bring ``recall`` of these pairs together, so
    both follow the size and shape of the data. Where no curves do, as the
    vectors have no neighbourhoods, the asking vectors are compared with all, in
    blocks: work for a stated query set, not for all of many. Each vector goes, in half
    precision, once per curve to the range that its key falls into, and, near a
    limit, as a guest to the range beyond it. Keys are distinct, so ranges stay
    even however many vectors are equal, and their number follows the data. A
    task orders its range and compares each block with what lies within reach
    on the curve; the windows' results merge by key.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    out = "key bigint, neighbour bigint, cosine float"
    n = rows.count()
    names = {"key": key}
    sample = rows.sample(min(1.0, SAMPLE * 0.95 / max(1, n)), seed=seed).limit(SAMPLE).toArrow()
    if n and not sample.num_rows:  # so few rows that none was drawn
        sample = rows.limit(SAMPLE).toArrow()
    sizes = sample["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    width = dim or (int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0)
    at, fitted = unit_vectors(sample["v"].combine_chunks(), width) if width else (np.zeros(0, int), np.zeros((0, 1), np.float32))
    if not len(fitted):
        empty = spark.createDataFrame([], out + ", rank int")
        return empty.withColumnsRenamed(names)
    curves, ids = Curves(fitted, CURVES, seed), sample["key"].to_numpy()[at]
    probed = np.random.default_rng(seed).choice(len(ids), min(PROBES, len(ids)), replace=False)
    distance = distances(curves, ids[probed], fitted[probed], true_neighbours(rows, ids[probed], fitted[probed], width, k, least), n)
    order = Window.partitionBy("key").orderBy(F.col("cosine").desc(), F.col("neighbour"))
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnsRenamed(names)
    chosen_curves = plan(distance, recall, 1 / query_every) if len(distance) else (1, REACH)
    if chosen_curves is None:
        return best(compared_with_all(rows, query_every, width, k, least))
    curves.use(chosen_curves[0], n, chosen_curves[1])
    n_curves, shared = len(curves.fits), spark.sparkContext.broadcast(curves)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = shared.value
        for batch in batches:
            at, x = unit_vectors(batch.column(1), width)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            first = np.unique(ids, return_index=True)[1]
            ids, x = ids[first], x[first].astype(np.float16)
            if not len(ids):
                continue
            for c in range(n_curves):
                keys = curves.keys(x.astype(np.float32), ids, c)
                row, to, own = curves.ranges(keys, c)
                ends = np.arange(len(row) + 1, dtype=np.int32) * (2 * width)
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(x[row].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(c * curves.n_ranges + to, pa.int32()), pa.array(keys[row]), pa.array(ids[row]), pa.array(own), packed], ["part", "at", "key", "own", "x"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        reach, whole = shared.value.reach, pa.Table.from_batches(held)
        part, at, ids, own = (whole[c].to_numpy() for c in ("part", "at", "key", "own"))
        raw = np.frombuffer(b"".join(c.buffers()[2].slice(*_span(c)).to_pybytes() for c in whole["x"].chunks), np.float16).reshape(-1, width)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            mine = mine[np.lexsort((ids[mine], at[mine]))]
            mine = mine[np.append(True, np.diff(ids[mine]) != 0)]  # copies of a row are neighbours
            a, b, s = best_in_windows(raw[mine].astype(np.float32), ids[mine], k, least, own[mine] & (ids[mine] % query_every == 0), reach)
            for i in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[i : i + 50_000]) for v in (a, b, s)], ["key", "neighbour", "cosine"])

    parts = rows.mapInArrow(spread, "part int, at bigint, key bigint, own boolean, x binary").repartition(n_curves * curves.n_ranges, "part")
    found = parts.mapInArrow(search, out).withColumn("cosine", F.round("cosine", 5)).repartition("key").dropDuplicates(["key", "neighbour"])
    return best(found)


def _nearest_of(ids: np.ndarray, x: np.ndarray, rows: DataFrame, width: int, keep: int, least: float) -> DataFrame:
    """``probe`` (place in ``ids``), ``key``, ``cosine``, ``v``: among ``rows`` the ``keep`` most similar to each of a few vectors in each task."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = shared.value
        floors = Floors(len(q), keep, least)
        for batch in batches:
            at, y = unit_vectors(batch.column(1), width)
            keys = batch.column(0).to_numpy(zero_copy_only=False)[at]
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ y.T
                s[asked[lo : lo + 512, None] == keys] = -2
                found = []
                for i in np.flatnonzero((s >= floors.floor[lo : lo + 512, None]).any(axis=1)).tolist():
                    near = np.flatnonzero(s[i] >= floors.floor[lo + i])
                    near = near[chosen(s[i, near], keep)]
                    floors.add(lo + i, s[i, near])
                    found.append((np.full(len(near), lo + i, np.int32), near, s[i, near]))
                if found:
                    probe, near, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
                    columns = [pa.array(probe), pa.array(keys[near]), pa.array(cosine.astype(np.float32)), batch.column(1).take(pa.array(at[near])).cast(pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["probe", "key", "cosine", "v"])

    return rows.mapInArrow(run, "probe int, key bigint, cosine float, v array<float>")


def true_neighbours(rows: DataFrame, ids: np.ndarray, x: np.ndarray, width: int, k: int, least: float) -> pa.Table:
    """``probe`` (its place), ``key``, ``v`` of the k vectors most similar to each of a few, among all rows: one pass, few rows out."""
    found = _nearest_of(ids, x, rows, width, 2 * k, least).groupBy("probe", "key").agg(F.max("cosine").alias("cosine"), F.max("v").alias("v"))  # twice k, as rows may repeat
    order = Window.partitionBy("probe").orderBy(F.col("cosine").desc(), F.col("key"))
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("probe", "key", "v").toArrow()


def compared_with_all(rows: DataFrame, query_every: int, width: int, k: int, least: float) -> DataFrame:
    """``key``, ``neighbour``, ``cosine`` of the asking vectors' most similar ones: batches of them, bounded, are broadcast; vectors stay where they are."""
    unique = written(rows.groupBy("key").agg(F.max("v").alias("v")), "vectors")  # copies of a row hold the same vector

    def hits(part: pa.Table) -> DataFrame:
        at, x = unit_vectors(part["v"].combine_chunks(), width) if part.num_rows else (np.zeros(0, int), np.zeros((0, width), np.float32))
        ids = part["key"].to_numpy()[at]
        named = rows.sparkSession.sparkContext.broadcast(ids)

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(named.value[batch.column(0).to_numpy()]), batch.column(1), batch.column(2)], ["key", "neighbour", "cosine"])

        return _nearest_of(ids, x, unique, width, k, least).select("probe", "key", "cosine").mapInArrow(name, "key bigint, neighbour bigint, cosine float")

    return per_batch(unique.filter(F.col("key") % query_every == 0), hits, "key", ASKING).withColumn("cosine", F.round("cosine", 5))


def distances(curves: Curves, ids: np.ndarray, x: np.ndarray, pairs: pa.Table, n: int) -> np.ndarray:
    """Rows, by the sample, between the vectors of each pair on each curve; rounded up by one point of the sample."""
    if not pairs.num_rows:
        return np.zeros((0, len(curves.fits)))
    probe, y = pairs["probe"].to_numpy(), unit_vectors(pairs["v"].combine_chunks(), x.shape[1])[1]
    out = np.empty((len(probe), len(curves.fits)))
    for c, points in enumerate(curves.sorted):
        a, b = curves.keys(x, ids, c)[probe], curves.keys(y, pairs["key"].to_numpy(), c)
        out[:, c] = (np.abs(np.searchsorted(points, a) - np.searchsorted(points, b)) + 1) * n / len(points)
    return out


def _span(chunk: pa.Array) -> tuple[int, int]:
    """Offset and length of a binary array's bytes in its buffer."""
    ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
    return int(ends[0]), int(ends[-1] - ends[0])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.85 of which one is among the other's five most similar."""
    best = nearest(table(spark, sf_dir, "dense_vectors"), "vec_id", "embedding", k=5, least=0.85)
    return best.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest, whatever the cosine, of every vector whose id is divisible by 100."""
    return nearest(table(spark, sf_dir, "dense_vectors"), "vec_id", "embedding", k=5, query_every=100)


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
SQL: dict[str, str] = {}
