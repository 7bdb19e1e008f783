"""Problem 4: all similar pairs of set-valued records, by sorted sketch forests."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import strip
from rankloom.operators.records import current_records
from rankloom.session import scratch_path, written
from rankloom.sources.tables import table

#: Bits of the sketch that is compared before two sets are.
SKETCH = 128
#: Chance that a pair at the threshold is a candidate in some tree.
RECALL = 0.9998
#: Standard deviations by which a sketch at the threshold may fall short.
SLACK = 3.5
#: Runs of equal prefixes above this length are divided again before pairs are compared.
RUN = 2_048
#: Chance that a pair at the threshold stays together in some division of a long run.
RUN_RECALL = 0.9995
#: Planted rows that a task compares, about, and those that it holds at once besides an unfinished run.
TASK_ROWS, HELD_ROWS = 400_000, 65_536


def depth_of(n: int, common: float = 0.06) -> int:
    """Prefix length at which a record shares a tree's prefix with some 64 unrelated ones; at least 3."""
    return max(3, ceil(log(max(n, 65) / 64) / log(1 / common)))


def trees_for(share: float, recall: float = RECALL) -> int:
    """Trees after which a pair that meets in one tree with chance ``share`` has met with chance ``recall``."""
    return 1 if share >= recall else ceil(log(1 - recall) / log(1 - share))


def minhashes(values: np.ndarray, starts: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` minhash values (32 bits) per set; ``values`` are 64-bit hashes, sets start at ``starts``."""
    rng = np.random.default_rng(seed)
    factors, masks = rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.empty((n, len(starts)), np.uint32)
    for i in range(n):
        v = (values ^ masks[i]) * factors[i]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[i] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_bits(threshold: float) -> int:
    """Equal sketch bits that a pair at the threshold has, but for SLACK deviations."""
    p = (1 + threshold) / 2
    return int(SKETCH * p - SLACK * (SKETCH * p * (1 - p)) ** 0.5)


def alike(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the index pairs (a, b) can still reach the threshold by size and sketch."""
    sa, sb = sizes[a], sizes[b]
    near = np.minimum(sa, sb) >= threshold * np.maximum(sa, sb)
    near[near] = np.bitwise_count((sketch[a[near]] ^ sketch[b[near]]).view(np.uint64)).sum(axis=1) <= SKETCH - least_bits(threshold)
    return near


def pairs_in_runs(keys: np.ndarray, rows: np.ndarray, test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` with equal keys (sorted) that pass ``test``, by their distance in the run."""
    at, distance = np.arange(len(keys)), 1
    while len(at):
        at = at[at + distance < len(keys)]
        at = at[keys[at] == keys[at + distance]]
        for i in range(0, len(at), 1 << 20):
            a, b = rows[at[i : i + (1 << 20)]], rows[at[i : i + (1 << 20)] + distance]
            ok = test(a, b)
            yield a[ok], b[ok]
        distance += 1


def orders_for(depth: int, threshold: float) -> int:
    """Samples of ``depth`` sketch bits after which a pair at the threshold has agreed on all of one with chance RUN_RECALL.

    All samples are of the same SKETCH bits: a pair that agrees on m of them
    agrees on a sample by the hypergeometric chance of that m. Averaged over m,
    as far as the comparison of sketches lets pairs pass.
    """
    p = (1 + threshold) / 2
    m = np.arange(least_bits(threshold), SKETCH + 1)
    log_comb = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    weight = np.exp([log_comb(SKETCH, int(k)) + k * log(p) + (SKETCH - k) * log(1 - p) for k in m])
    chance = np.array([exp(log_comb(int(k), depth) - log_comb(SKETCH, depth)) if k >= depth else 0.0 for k in m])
    met = lambda t: (weight * (1 - (1 - chance) ** t)).sum() / weight.sum()
    high = 1
    while met(high) < RUN_RECALL:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if met(middle) >= RUN_RECALL else (middle, high)
    return high


def divided(prefix: int, sketch: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """New prefixes of a long run's rows, by as many samples of sketch bits as keep the recall."""
    bits = np.unpackbits(sketch.view(np.uint8), axis=1)
    depth = min(40, max(1, ceil(log(len(sketch) / 64) / log(1 / 0.56))))
    for t in range(orders_for(depth, threshold)):
        chosen = np.random.default_rng(t).choice(SKETCH, depth, replace=False)
        key = bits[:, chosen].astype(np.uint64) @ (np.uint64(1) << np.arange(depth, dtype=np.uint64))
        key = (key ^ np.uint64(prefix & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
        yield ((key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def candidate_pairs(sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """``a`` < ``b``: ids of sets that may reach the threshold. ``sets`` has ``id`` and ``hashes`` (not empty)."""
    depth = depth_of(n)
    trees = trees_for(threshold**depth)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 5_000) for i in range(0, whole.num_rows, 5_000)):
                sizes = batch.column(1).value_lengths().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                mins = minhashes(batch.column(1).flatten().to_numpy().view(np.uint64), starts, max(trees * depth, SKETCH))
                words = np.ascontiguousarray(np.packbits((mins[:SKETCH].T & 1).astype(np.uint8), axis=1)).view(np.int64)
                size = pa.array(np.minimum(sizes, 32_767).astype(np.int16))
                for t in range(trees):
                    key = np.full(len(starts), t + 1, np.uint64)
                    for m in mins[t * depth : (t + 1) * depth]:
                        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(31)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), size, *[pa.array(words[:, i].copy()) for i in range(2)]], ["prefix", "id", "size", "s0", "s1"])

    found = written(_compared(sets.mapInArrow(plant, PLANTED), n * trees, threshold, False), "met")
    pairs, long = found.filter("prefix IS NULL").select("a", "b"), found.filter("prefix IS NOT NULL").drop("a", "b")
    n_long = long.count()
    if n_long:  # runs that are spread over the cluster once more
        pairs = pairs.unionByName(_compared(long, n_long, threshold, True).select("a", "b"))
    return pairs.distinct()


PLANTED = "prefix bigint, id bigint, size smallint, s0 bigint, s1 bigint"


def _compared(planted: DataFrame, n_rows: int, threshold: float, last: bool) -> DataFrame:
    """``a``, ``b`` of rows with equal prefixes, or rows of long runs with new prefixes (not if this is the ``last`` division).

    Tasks are as many as the rows need. They get their rows in the order of
    the prefixes and hold one run, or HELD_ROWS, at a time.
    """

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes = (rows[c].to_numpy() for c in ("prefix", "id", "size"))
        sketch = np.stack([rows["s0"].to_numpy(), rows["s1"].to_numpy()], axis=1)
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        lengths = np.diff(np.append(cuts, len(keys)))
        long = (lengths > RUN) & (not last)
        near = np.flatnonzero(np.repeat(~long, lengths))

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return alike(a, b, sizes, sketch, threshold) & (ids[a] != ids[b])

        kept, size = [], 0
        for a, b in pairs_in_runs(keys[near], near, test):
            kept.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]))
            size += len(a)
            if size > 200_000:
                yield _batch(kept)
                kept, size = [], 0
        if kept:
            yield _batch(kept)
        for lo, n in zip(cuts[long].tolist(), lengths[long].tolist(), strict=True):
            for prefix in divided(int(keys[lo]), np.ascontiguousarray(sketch[lo : lo + n]), threshold):
                none, own = pa.nulls(n, pa.int64()), rows.slice(lo, n)
                yield pa.RecordBatch.from_arrays([none, none, pa.array(prefix), *(own[c].combine_chunks() for c in ("id", "size", "s0", "s1"))], ["a", "b", "prefix", "id", "size", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, HELD_ROWS
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                whole = pa.Table.from_batches(held).combine_chunks()
                keys = whole["prefix"].to_numpy()
                done = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                if done:
                    yield from compare(whole.slice(0, done).combine_chunks())
                held, n = whole.slice(done).to_batches(), n - done
                enough = max(HELD_ROWS, 2 * n)
        if n:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    parts = max(planted.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))
    ordered = planted.repartition(parts, "prefix").sortWithinPartitions("prefix", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint, " + PLANTED)


def _batch(kept: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(kept, axis=1), axis=1)
    none = [pa.nulls(len(pairs[0]), t) for t in (pa.int64(), pa.int64(), pa.int16(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *none], ["a", "b", "prefix", "id", "size", "s0", "s1"])


class SimilarSets:
    """The similar pairs of ``df`` by the Jaccard similarity of its sets.

    ``df`` has unique string keys and an array of strings per row. Order and
    repeats in an array don't matter; null and empty arrays, nulls in arrays
    and null keys are in no pair. Records with equal sets form a class, and
    only classes are compared, so copies cost one row each.

    Each class gets minhash values. A tree is an ordering of the classes by a
    few of them; classes with a common prefix are neighbours, and there are as
    many trees as bring a pair at the threshold together with chance RECALL.
    The prefix gets deeper with the logarithm of the number of classes. A run
    of equal prefixes that is still longer than RUN is divided by samples of
    sketch bits, and shuffled once more by these, to RUN_RECALL; none is cut
    off. Neighbours that pass the comparison
    of sizes and sketches are verified on the sets.

    ``members``: ``key``, ``class`` (its smallest key). ``classes``: ``class``,
    ``n``. ``pairs``: ``class_a`` < ``class_b``, ``similarity``.
    """

    def __init__(self, df: DataFrame, key: str, values: str | Column, threshold: float):
        spark = df.sparkSession
        values = F.col(values) if isinstance(values, str) else values
        records = df.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))).alias("terms"))
        records = records.filter("key IS NOT NULL AND size(terms) > 0").withColumn("print", F.md5(F.array_join(F.transform("terms", lambda v: F.concat(F.length(v), F.lit(":"), v)), "")))
        path = scratch_path(spark, "sets")
        records.write.option("compression", "zstd").parquet(f"{path}/records")
        records = spark.read.parquet(f"{path}/records")
        grouped = records.groupBy("print").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("n"), F.max("terms").alias("terms"))
        grouped.withColumn("id", F.xxhash64("class")).write.option("compression", "zstd").parquet(f"{path}/classes")
        classes = spark.read.parquet(f"{path}/classes")
        self.members = records.select("key", "print").join(classes.select("print", "class"), "print").select("key", "class")
        self.classes = classes.select("class", "n")
        sets = classes.select("id", F.transform("terms", lambda v: F.xxhash64(v)).alias("hashes"))
        found = candidate_pairs(sets, threshold, classes.count())
        side = lambda c: classes.select(F.col("id").alias(c), F.col("class").alias(f"class_{c}"), F.col("terms").alias(f"terms_{c}"))
        both = F.size(F.array_intersect("terms_a", "terms_b"))
        checked = (
            found.join(side("a"), "a")
            .join(side("b"), "b")
            .withColumn("_both", both)
            .withColumn("similarity", F.col("_both") / (F.size("terms_a") + F.size("terms_b") - F.col("_both")))
            .filter((F.col("similarity") >= threshold) & (F.col("class_a") != F.col("class_b")))
        )
        small, large = F.least("class_a", "class_b"), F.greatest("class_a", "class_b")
        self.pairs = checked.select(small.alias("class_a"), large.alias("class_b"), "similarity").distinct()

    def expanded(self) -> DataFrame:
        """``a`` < ``b``: every pair of records, with those inside of a class. A class of n copies gives n (n - 1) / 2 rows: where pairs of
        copies aren't asked for one by one, take ``members`` and ``pairs``, or :meth:`links`."""
        m = self.members
        left, right = m.select(F.col("class").alias("class_a"), F.col("key").alias("x")), m.select(F.col("class").alias("class_b"), F.col("key").alias("y"))
        several = self.classes.filter("n > 1").select("class")
        inside = m.join(several, "class", "left_semi")
        copies = inside.select("class", F.col("key").alias("x")).join(inside.select("class", F.col("key").alias("y")), "class").filter("x < y").select("x", "y")
        across = self.pairs.join(left, "class_a").join(right, "class_b").select("x", "y")
        return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def links(self) -> DataFrame:
        """``key``, ``class``, ``n_links``: of each record the number of records it is similar to."""
        sizes = self.classes.select(F.col("class").alias("other"), F.col("n").alias("m"))
        ends = self.pairs.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionByName(self.pairs.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
        linked = ends.join(sizes, "other").groupBy("class").agg(F.sum("m").alias("m"))
        per_class = self.classes.join(linked, "class", "left").select("class", (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        return self.members.join(per_class, "class").select("key", "class", "n_links")


def terms_of(weights: Column) -> Column:
    """The terms with a weight above 0, lower case, without white space at the ends."""
    kept = F.map_filter(weights, lambda _, w: (w > 0) & ~F.isnan(w))
    return F.filter(F.transform(F.map_keys(kept), lambda k: F.lower(strip(k))), lambda k: k != "")


def _sets(spark: SparkSession, sf_dir: str) -> SimilarSets:
    log_rows = table(spark, sf_dir, "pg_documents").withColumn("_terms", F.array_distinct(terms_of(F.col("splade_terms"))))
    return SimilarSets(current_records(log_rows, "doc_id", ["updated_at"], ["_terms"]), "doc_id", "_terms", 0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of current records that share at least 0.6 of their terms."""
    return _sets(spark, sf_dir).expanded().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of equal sets and its number of similar records."""
    return _sets(spark, sf_dir).links().select(F.col("key").alias("doc_id"), F.col("class").alias("class_id"), "n_links")


QUERIES = {"p4_found": p4_found, "p4_links": p4_links}

_P4 = """
  WITH t AS (
    SELECT DISTINCT doc_id, term FROM (
      SELECT doc_id, lower(trim(e.key, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS term, e.value AS w FROM (
        SELECT doc_id, unnest(map_entries(splade_terms)) AS e FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) AS r FROM pg_documents) WHERE r = 1))
    WHERE w > 0 AND NOT isnan(w) AND term <> ''),
  n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
  p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS c FROM t a JOIN t b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2),
  f AS (SELECT doc_id_a, doc_id_b FROM p JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b
        WHERE c::DOUBLE / (x.n + y.n - c) >= 0.6::DOUBLE)
"""
SQL = {
    "p4_found": _P4 + "SELECT * FROM f",
    "p4_links": _P4
    + """, s AS (SELECT doc_id, string_agg(term, chr(0) ORDER BY term) AS s FROM t GROUP BY 1)
    SELECT s.doc_id, min(s.doc_id) OVER (PARTITION BY s.s) AS class_id, coalesce(l.n, 0) AS n_links
    FROM s LEFT JOIN (SELECT d, count(*) AS n FROM (SELECT doc_id_a AS d FROM f UNION ALL SELECT doc_id_b FROM f) GROUP BY 1) l ON l.d = s.doc_id""",
}
