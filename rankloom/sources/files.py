"""JSONL and TSV files of documents, queries, judgments and results."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas

#: The public data sets that a run takes by default.
DEFAULT_SUBSET = ("scifact", "nfcorpus", "fiqa", "trec-covid")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSONL files with ``_line``, which follows the files' names and the order in each; blank lines are skipped."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = spark.read.text(path).select("value", place.alias("_line")).filter(F.trim("value") != "")
    return raw.select("_line", F.from_json("value", schema).alias("_o")).select("_line", "_o.*")


def read_documents(spark: SparkSession, path: str, max_docs: int = 0) -> DataFrame:
    """doc_id, content; the first ``max_docs`` in file order, 0 for all. Numeric ids become strings."""
    docs = _lines(spark, path, schemas.DOCUMENTS)
    return (docs.orderBy("_line").limit(max_docs) if max_docs else docs).select("doc_id", "content")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text."""
    return _lines(spark, path, schemas.QUERIES).select("query_id", "text")


def read_binary_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade = 1; of repeated queries the last line counts."""
    rows = _lines(spark, path, schemas.BINARY_QRELS).groupBy("query_id").agg(F.max_by("relevant_doc_ids", "_line").alias("ids"))
    return rows.select("query_id", F.explode("ids").alias("doc_id")).distinct().withColumn("grade", F.lit(1))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested hit lists per query and system."""
    return _lines(spark, path, schemas.RESULTS).drop("_line")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, splade_terms, content (null where the file has none)."""
    return _lines(spark, path, schemas.SPARSE).drop("_line")


def cap_corpus(docs: DataFrame, order: str, cap: int | None, judged: DataFrame) -> DataFrame:
    """The first ``cap`` documents by ``order`` and every judged one; the result can exceed the cap.

    The limit's last position is found by a bounded top-n, not by numbering
    all rows.
    """
    if not cap:
        return docs
    last = F.broadcast(docs.select(order).orderBy(order).limit(cap).agg(F.max(order).alias("_last")))
    ids = judged.select("doc_id").distinct().withColumn("_judged", F.lit(True))
    kept = docs.join(ids, "doc_id", "left").crossJoin(last).filter((F.col(order) <= F.col("_last")) | F.col("_judged"))
    return kept.select(*docs.columns)


def read_qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade: of a pair's lines the last counts, if its grade is above 0.

    The header and lines of fewer than three fields are skipped, as are grades
    that are no number.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_line")
    parts = spark.read.text(path).select(place, F.split(F.rtrim("value"), "\t").alias("p"), F.lower("value").startswith("query-id").alias("header"))
    at = lambda i: F.get("p", F.lit(i))
    rows = parts.filter((F.size("p") >= 3) & ~F.col("header")).select("_line", at(0).alias("query_id"), at(1).alias("doc_id"), at(2).try_cast("int").alias("grade"))
    return rows.filter("grade > 0").groupBy("query_id", "doc_id").agg(F.max_by("grade", "_line").alias("grade"))


def read_beir(spark: SparkSession, folder: str, split: str = "test", cap: int | None = None) -> dict[str, DataFrame]:
    """docs (doc_id, title, text), queries (judged only) and qrels of a local data set; nothing is downloaded."""
    qrels = Path(folder, "qrels")
    if not Path(folder, "corpus.jsonl").exists():
        raise FileNotFoundError(f"no corpus.jsonl in {folder}")
    if not (qrels / f"{split}.tsv").exists():
        raise FileNotFoundError(f"no split {split!r}; there are {sorted(p.stem for p in qrels.glob('*.tsv'))}")
    judged = read_qrels_tsv(spark, str(qrels / f"{split}.tsv"))
    lines = _lines(spark, f"{folder}/corpus.jsonl", schemas.BEIR_CORPUS).withColumnRenamed("_id", "doc_id")
    docs = lines.groupBy("doc_id").agg(F.max(F.struct("_line", "title", "text")).alias("r"), F.min("_line").alias("first")).select("doc_id", "first", "r.title", "r.text")
    docs = cap_corpus(docs, "first", cap, judged).drop("first")
    queries = _lines(spark, f"{folder}/queries.jsonl", schemas.BEIR_QUERIES).select(F.col("_id").alias("query_id"), "text", F.col("_line").alias("line")).join(judged.select("query_id"), "query_id", "left_semi")
    return {"docs": docs, "queries": queries, "qrels": judged}


def load_config(path: str) -> Mapping:
    """A YAML file as a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
