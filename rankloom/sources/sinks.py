"""Tables, indexes and result files that jobs leave behind."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom import schemas


def create_table(df: DataFrame, path: str, replace: bool = True) -> None:
    """A Parquet table; an existing one is replaced, or left alone."""
    df.write.mode("overwrite" if replace else "ignore").parquet(path)


def positive_terms(df: DataFrame, column: str = "splade_terms") -> DataFrame:
    """Without terms whose weight isn't above 0."""
    return df.withColumn(column, F.map_filter(column, lambda _, w: (w > 0) & ~F.isnan(w)))


def merged(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in place by ``key``.

    Of several new rows of a key that with the greatest version counts, of
    equal ones that with the greatest content as JSON, whatever the order of
    the rows. Null keys are left out.
    """
    row = F.struct(*new.columns)
    order = F.struct(*([F.col(version)] if version else []), F.to_json(row))
    rows = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("_r")).select("_r.*")
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


#: Buckets of a new upsert table; a change rewrites the buckets that it touches.
BUCKETS = 32


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and content of the newest version of a table; 0, None where there is none."""
    numbers = sorted((int(n[:-5]) for n in _names(spark, f"{path}/_versions") if n.endswith(".json")), reverse=True)
    if not numbers:
        return 0, None
    return numbers[0], json.loads(spark.read.text(f"{path}/_versions/{numbers[0]:012d}.json", wholetext=True).first().value)


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The current rows of a table made by :func:`upsert`; None where there is none."""
    _, now = _manifest(spark, path)
    if now is None:
        return None
    schema = StructType.fromJson(now["schema"])
    folders = sorted(now["buckets"].values())
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, version: str | None = None, buckets: int = BUCKETS, newer_only: bool = False) -> None:
    """Insert or replace by ``key`` in a table of Parquet files; a missing table is made.

    Rows lie in buckets by a hash of the key. An upsert writes new files of the
    buckets it touches, beside the old ones, and then one small file that names
    the files of every bucket; that file appears by a rename, and is the table's
    new version. A crash before it leaves the old version, one after it the
    new; what no version names is removed by the next upsert. The version
    before stays for readers that are at work. One writer at a time.
    ``newer_only``: rows with a lesser ``version`` than the table's are dropped.
    """
    number, now = _manifest(spark, path)
    now = now or {"schema": json.loads(new.schema.json()), "n": buckets, "buckets": {}}
    _sweep(spark, path, number)
    bucket = F.pmod(F.xxhash64(key), F.lit(now["n"])).cast("int")
    rows = new.filter(F.col(key).isNotNull())
    touched = [r.b for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
    if not touched and number:
        return
    kept = [f"{path}/{now['buckets'][str(b)]}" for b in touched if str(b) in now["buckets"]]
    old = spark.read.schema(StructType.fromJson(now["schema"])).parquet(*kept) if kept else new.limit(0)
    if newer_only and version:
        held = old.select(key, F.col(version).alias("_held"))
        rows = rows.join(held, key, "left").filter(F.col("_held").isNull() | (F.col(version) >= F.col("_held"))).drop("_held")
    part = f"rows-{uuid.uuid4().hex}"
    merged(old, rows, key, version).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/{part}")
    there = {n.split("=")[1]: f"{part}/{n}" for n in _names(spark, f"{path}/{part}") if n.startswith("_bucket=")}
    left = {b: f for b, f in now["buckets"].items() if int(b) not in set(touched)}
    _publish(spark, path, number + 1, now | {"buckets": left | there})


def _publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    fs, target = _fs(spark, f"{path}/_versions/{number:012d}.json")
    _, beside = _fs(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(beside, target):
        raise RuntimeError(f"another writer made version {number} of {path}")


def _sweep(spark: SparkSession, path: str, number: int) -> None:
    """Removes versions before the last two, and files that neither of these names."""
    if not number:
        return
    kept = set()
    for n in _names(spark, f"{path}/_versions"):
        if n.endswith(".json") and int(n[:-5]) >= number - 1:
            content = json.loads(spark.read.text(f"{path}/_versions/{n}", wholetext=True).first().value)
            kept |= {f.split("/")[0] for f in content["buckets"].values()}
        else:
            fs, p = _fs(spark, f"{path}/_versions/{n}")
            fs.delete(p, False)
    for n in _names(spark, path):
        if n.startswith("rows-") and n not in kept:
            fs, p = _fs(spark, f"{path}/{n}")
            fs.delete(p, True)


def save_index(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """An index as Parquet, contents included; partitioned where a search reads a few parts only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_sparse(docs: DataFrame, path: str) -> None:
    """JSONL of doc_id and splade_terms, without the content."""
    docs.select("doc_id", "splade_terms").write.mode("overwrite").json(path)


def write_results(hits: DataFrame, queries: DataFrame, path: str, by: str = "system", answers: DataFrame | None = None) -> None:
    """JSONL: per query its text, a list of hits per system in rank order, and perhaps ``rag``."""
    hit = F.struct("rank", "doc_id", "score", "content")
    lists = hits.groupBy("query_id", by).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    plain = F.transform("hits", lambda h: F.struct(h["doc_id"].alias("doc_id"), h["score"].alias("score"), h["content"].alias("content")))
    rows = queries.select("query_id", "text").join(lists.select("query_id", by, plain.alias("hits")).groupBy("query_id").pivot(by).agg(F.first("hits")), "query_id", "left")
    if answers is not None:
        rows = rows.join(answers.select("query_id", "rag"), "query_id", "left")
    rows.write.mode("overwrite").json(path)


def write_report(path: str, config: Mapping, timings: Mapping, metrics: Sequence[Mapping]) -> Path:
    """A small JSON report of a benchmark or sweep."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps({"config": dict(config), "timings": dict(timings), "metrics": [dict(m) for m in metrics]}, indent=2))
    return target


def log_experiment(spark: SparkSession, folder: str, **fields) -> None:
    """One row of an experiment log, appended as CSV with a header; missing fields are 0 or empty."""
    from datetime import datetime, timezone

    columns = [c.strip().split(" ") for c in schemas.EXPERIMENT.split(",")]
    if unknown := set(fields) - {c for c, _ in columns}:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    fill = {"double": 0.0, "string": "", "timestamp": datetime.now(timezone.utc).replace(tzinfo=None)}
    row = tuple(fields.get(c, fill[t]) for c, t in columns)
    spark.createDataFrame([row], schemas.EXPERIMENT).coalesce(1).write.mode("append").option("header", True).csv(folder)


def path_size_mb(spark: SparkSession, path: str) -> float:
    """Size of a file or folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() / 1e6 if fs.exists(p) else 0.0


def index_stats(spark: SparkSession, path: str) -> dict:
    """doc_count, size_mb and the mapping of a stored index."""
    df = spark.read.parquet(path)
    return {"doc_count": df.count(), "size_mb": path_size_mb(spark, path), "mapping": json.loads(df.schema.json())}
