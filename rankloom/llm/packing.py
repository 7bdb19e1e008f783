"""Problem 9: texts in containers of fixed capacity, by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.tokenize import token_counts
from rankloom.session import scratch_path
from rankloom.sources.tables import table

#: Items that one task packs together; the number of tasks follows the data.
ITEMS_PER_GROUP = 16_384


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given.

    An item goes where the sum over gaps g of (open bins with gap g) squared
    becomes smallest; a full bin has no gap. Of equals, the tightest gap wins,
    and an open bin wins over a new one. Sizes are from 1 to ``capacity``.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, opened = np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 (count[g-s] - count[g]) + 2; to gap 0 by 1 - 2 count[s]
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        g = s + int(change.argmin())
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if count[g] and change[g - s] <= fresh:
            b = bins[g].pop()
            count[g] -= 1
        else:
            b, g, opened = opened, capacity, opened + 1
        out[k] = b
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return out


def pack(df: DataFrame, key: str, size: str, capacity: int = 2048, group_items: int = ITEMS_PER_GROUP) -> DataFrame:
    """``key``, ``piece`` (from 0), ``size``, ``container`` of every item or piece.

    Only an item over the capacity is split: into full pieces, each a container
    of its own, and the rest. Null, zero and negative sizes need no container
    and give no row. Items are spread over groups of about ``group_items`` by a
    hash of key, size and place in the table (the sizes are written to the
    shared folder once and counted there), so that no repeated or null key
    fills a group; the longest are placed first, and every group packs
    on its own, so at most a few containers per group are not full; nothing
    else is shuffled. Repeated rows are items of their own. A written table's
    places don't change, so a lost task repeats its result.
    Other columns are ignored.
    """
    path = scratch_path(df.sparkSession, "sizes")
    df.select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).filter("size > 0").write.parquet(path)
    items = df.sparkSession.read.parquet(path)
    n_groups = max(1, -(-items.count() // group_items))
    kind = df.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).sort_by([("group", "ascending"), ("size", "descending"), ("key", "ascending")])
        group, sizes = whole["group"].to_numpy(), whole["size"].to_numpy()
        for lo, hi in zip(*_runs(group), strict=True):
            own = sizes[lo:hi]
            pieces = own // capacity + (own % capacity > 0)
            at = np.repeat(np.arange(lo, hi), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, sizes[at] - piece * capacity)
            order = np.argsort(-length, kind="stable")
            container = np.empty(len(at), np.int64)
            container[order] = sum_of_squares(length[order], capacity)
            names = [f"{group[lo]}-{b}" for b in container.tolist()]
            rows = [whole["key"].take(pa.array(at)).combine_chunks(), pa.array(piece, pa.int32()), pa.array(length), pa.array(names)]
            yield from pa.Table.from_arrays(rows, ["key", "piece", "size", "container"]).to_batches(max_chunksize=10_000)

    grouped = items.withColumn("group", F.pmod(F.xxhash64("key", "size", F.monotonically_increasing_id()), F.lit(n_groups)).cast("int")).repartition(n_groups, "group")
    return grouped.mapInArrow(place, f"key {kind}, piece int, size bigint, container string").withColumnRenamed("key", key)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last positions of runs of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece, 2,048 tokens of byte_bpe_50k each."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", 2048).withColumnRenamed("size", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, and the share of the room that is used."""
    packed = p9_containers(spark, sf_dir)
    return packed.agg(
        F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / (F.count_distinct("container") * 2048), 6).alias("fill")
    )


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
SQL: dict[str, str] = {}
