"""Problem 3: how much a term is a record's own, by a parsimonious language model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.records import current_records
from rankloom.session import scratch_path
from rankloom.sources.tables import table

#: An unbroken run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Terms with at least this share of all words are looked up in a broadcast
#: table, which can't have more than 1 / HEAD_SHARE rows; the others by a join
#: in which no term is frequent.
HEAD_SHARE = 1e-5


def word_bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_words`` (split at white space), ``words`` (lower case, sorted, distinct), ``tfs``."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, words, tfs, ends = [], [], [], [0]
            for x in batch.column(1).to_pylist():
                x = x or ""
                bag = Counter(WORD.findall(x.lower()))
                terms = sorted(bag)
                n_words.append(len(x.split()))
                words.extend(terms)
                tfs.extend(map(bag.__getitem__, terms))
                ends.append(len(words))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(words, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int32()), *lists], ["key", "n_words", "words", "tfs"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(bags, f"key {kind}, n_words int, words array<string>, tfs array<int>")


def em(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, weight: float, tol: float = 1e-6) -> np.ndarray:
    """Term probabilities of each record's own model; ``starts`` are the records' first positions.

    E: a term's count times the chance that this record's model, not the
    background, produced it. M: the normalised expectations. Each record is
    iterated until none of its probabilities moves by ``tol``, and is left
    alone from then on, so its result does not depend on its neighbours.
    """
    sizes = np.diff(np.append(starts, len(tf)))
    own = tf / np.repeat(np.add.reduceat(tf, starts), sizes)
    place, count, other, at = np.arange(len(tf)), tf, (1 - weight) * background, starts
    mine = own.copy()
    while len(at):
        mass = weight * mine
        expected = count * mass / (other + mass + 1e-300)
        new = expected / np.repeat(np.add.reduceat(expected, at), sizes)
        moving = np.maximum.reduceat(np.abs(new - mine), at) >= tol
        mine = new
        if not moving.all():
            keep = np.repeat(moving, sizes)
            own[place[~keep]] = mine[~keep]
            place, count, other, mine, sizes = place[keep], count[keep], other[keep], mine[keep], sizes[moving]
            at = np.cumsum(sizes) - sizes
    return own


def distinctive_terms(df: DataFrame, key: str, text: str, n: int = 10, least_words: int = 0, least_tf: int = 2, weight: float = 0.05) -> DataFrame:
    """``key``, ``term``, ``score``, ``rank`` (1 to ``n``): each record's most characteristic terms.

    ``df`` has unique keys. The background probability of a term is its share
    of all words of all records; a record's own model keeps, by
    expectation-maximisation, the mass that the background does not explain.
    A term in more than half of the records, or less than ``least_tf`` times in
    the record, is no candidate; equal scores go by term. Records with fewer
    than ``least_words`` words, null or blank text, or no candidate give no
    row, but they count for the background. ``weight`` is the share of the
    record's own model in its words.

    Word bags are written once to the shared folder and read twice. Counting
    has a map-side part. Frequent terms (at most 1 / HEAD_SHARE) are broadcast;
    of the rest, each posting finds its total by a join on its term, which by
    choice holds less than HEAD_SHARE of all words.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "bags")
    word_bags(df, key, text).write.option("compression", "zstd").parquet(path)
    bags = spark.read.parquet(path)
    posting = F.explode(F.arrays_zip("words", "tfs")).alias("p")
    counts = bags.select(posting).groupBy(F.col("p.words").alias("term")).agg(F.sum("p.tfs").alias("cf"), F.count(F.lit(1)).alias("df"))
    total, records = bags.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.count(F.lit(1))).first()
    kind = df.schema[key].dataType.simpleString()
    if not total:
        return spark.createDataFrame([], f"{key} {kind}, term string, score double, rank int")
    head = counts.filter(F.col("cf") >= max(2.0, total * HEAD_SHARE)).toPandas()
    common = (head["df"] * 2 > records).to_numpy()
    shared = spark.sparkContext.broadcast((head["term"].tolist(), (head["cf"] / total).to_numpy(), common))

    head_terms = spark.createDataFrame(head[["term"]]) if len(head) else counts.select("term").limit(0)
    tail = bags.select("key", posting).select("key", F.col("p.words").alias("term"), F.col("p.tfs").alias("tf")).join(F.broadcast(head_terms), "term", "left_anti")
    common_tail = F.count(F.lit(1)) * 2 > records
    totals = tail.groupBy("term").agg(F.when(common_tail, -F.sum("tf")).otherwise(F.sum("tf")).alias("cf"))  # below 0: in more than half of the records
    found = tail.join(totals, "term").groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("term", "cf"))), lambda x: x["cf"]).alias("cfs"))
    wanted = bags.filter((F.col("n_words") >= least_words) & (F.size("words") > 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, probability, common = shared.value
        terms = pa.array(terms, pa.string())
        probability, common = np.append(probability, 0.0), np.append(common, False)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            at = pc.index_in(words, value_set=terms).fill_null(len(terms)).to_numpy()
            background, rare = probability[at], at == len(terms)
            cfs = batch.column(3).flatten().to_numpy()  # both in the order of the terms
            background[rare] = np.abs(cfs) / total
            usual = common[at]
            usual[rare] = cfs < 0
            tf = batch.column(2).flatten().to_numpy().astype(float)
            own = em(tf, background, starts, weight)
            record = np.repeat(np.arange(len(sizes)), sizes)
            able = np.flatnonzero((tf >= least_tf) & ~usual)
            order = able[np.lexsort((able, -np.round(own[able], 9), record[able]))]  # terms are sorted in a record
            first = np.searchsorted(record[order], np.arange(len(sizes)))
            rank = np.arange(len(order)) - first[record[order]] + 1
            order, rank = order[rank <= n], rank[rank <= n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(record[order])), words.take(pa.array(order)), pa.array(own[order]), pa.array(rank.astype("int32"))], ["key", "term", "score", "rank"]
            )

    scored = wanted.join(found, "key", "left").select("key", "words", "tfs", "cfs").mapInArrow(score, f"key {kind}, term string, score double, rank int")
    return scored.withColumnRenamed("key", key)


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_records(table(spark, sf_dir, "pg_documents"), "doc_id", ["updated_at"], ["content"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic word of each current record of at least 30 words."""
    return distinctive_terms(_current(spark, sf_dir), "doc_id", "content", n=1, least_words=30).select("doc_id", "term")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most characteristic terms of every current record, with scores."""
    return distinctive_terms(_current(spark, sf_dir), "doc_id", "content", n=5).withColumn("score", F.round("score", 6))


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
SQL: dict[str, str] = {}
