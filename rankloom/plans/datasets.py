"""The project's tables in the shapes that retrieval works on, and the same as SQL.

docs: doc_id, title, text, content. queries: query_id, text. judgments:
query_id, doc_id, grade. postings: doc_id, term, weight. Ids of judgments and
documents compare trimmed and in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normal_id, render_document, strip, token_rows
from rankloom.operators.records import current_records
from rankloom.sources.tables import table


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, content of beir_corpus: of lines with one id the last; title and text rendered."""
    lines = table(spark, folder, "beir_corpus").withColumn("doc_id", normal_id("_id")).withColumn("content", render_document("title", "text"))
    return current_records(lines, "doc_id", ["line_no"], ["content"])


def store_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of all documents of pg_documents."""
    return table(spark, folder, "pg_documents").select(normal_id("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, doc_id, grade of beir_qrels, only grades above 0; of several the highest."""
    rows = table(spark, folder, "beir_qrels").select("query_id", normal_id("corpus_id").alias("doc_id"), F.col("score").alias("grade"))
    return rows.filter("grade > 0 AND doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def binary(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, doc_id, grade = 1 of qrels."""
    rows = table(spark, folder, "qrels").select("query_id", F.explode("relevant_doc_ids").alias("doc_id"))
    return rows.select("query_id", normal_id("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("grade", F.lit(1))


def all_queries(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, text of queries, repeated rows once."""
    return current_records(table(spark, folder, "queries"), "query_id", ["asked_at"], ["text"])


def judged_queries(spark: SparkSession, folder: str, judgments: DataFrame) -> DataFrame:
    """The queries that have a judgment."""
    return all_queries(spark, folder).join(judgments.select("query_id"), "query_id", "left_semi")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, term, weight: how often the query has the term."""
    return token_rows(queries, "query_id", "text").groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def sparse_postings(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, term, weight of the current pg_documents: weights above 0, terms trimmed in lower case, of several the highest."""
    log_rows = table(spark, folder, "pg_documents").withColumn("entries", F.map_entries("splade_terms"))
    current = current_records(log_rows.withColumn("doc_id", normal_id("doc_id")), "doc_id", ["updated_at"], ["entries"])
    flat = current.select("doc_id", F.explode("entries").alias("e")).select("doc_id", F.lower(strip("e.key")).alias("term"), F.col("e.value").alias("weight"))
    return flat.filter("weight > 0 AND NOT isnan(weight) AND term <> ''").groupBy("doc_id", "term").agg(F.max("weight").alias("weight"))


_TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def _norm(c: str) -> str:
    return f"nullif(lower({_TRIM.format(c=c)}), '')"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_T, _B = _TRIM.format(c="coalesce(title, '')"), _TRIM.format(c="coalesce(text, '')")
#: The same tables as common table expressions; put WITH before the ones needed.
CTE = {
    "docs": f"""docs AS (SELECT doc_id, {_TRIM.format(c=f"CASE WHEN {_T} <> '' THEN {_T} || ' ' || {_B} ELSE {_B} END")} AS content
      FROM (SELECT *, {_norm("_id")} AS doc_id, row_number() OVER (PARTITION BY {_norm("_id")} ORDER BY line_no DESC) AS r FROM beir_corpus)
      WHERE r = 1 AND doc_id IS NOT NULL)""",
    "graded": f"""graded AS (SELECT query_id, {_norm("corpus_id")} AS doc_id, max(score) AS grade FROM beir_qrels
      WHERE score > 0 AND {_norm("corpus_id")} IS NOT NULL GROUP BY 1, 2)""",
    "judged_binary": f"""judged_binary AS (SELECT DISTINCT query_id, {_norm("x")} AS doc_id, 1 AS grade
      FROM (SELECT query_id, unnest(relevant_doc_ids) AS x FROM qrels) WHERE {_norm("x")} IS NOT NULL)""",
    "all_q": "all_q AS (SELECT query_id, arg_max(text, asked_at) AS text FROM queries GROUP BY 1)",
    "gq": "gq AS (SELECT * FROM all_q WHERE query_id IN (SELECT query_id FROM graded))",
    "bq": "bq AS (SELECT * FROM all_q WHERE query_id IN (SELECT query_id FROM judged_binary))",
    "gqt": f"gqt AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM gq) GROUP BY 1, 2)",
    "bqt": f"bqt AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT query_id, unnest({_tokens('text')}) AS term FROM bq) GROUP BY 1, 2)",
    "post": f"""post AS (SELECT doc_id, term, max(w) AS weight FROM (
      SELECT doc_id, lower({_TRIM.format(c="e.key")}) AS term, e.value AS w FROM (SELECT doc_id, unnest(map_entries(splade_terms)) AS e FROM (
        SELECT {_norm("doc_id")} AS doc_id, splade_terms, row_number() OVER (PARTITION BY {_norm("doc_id")} ORDER BY updated_at DESC) AS r FROM pg_documents)
      WHERE r = 1 AND doc_id IS NOT NULL)) WHERE w > 0 AND NOT isnan(w) AND term <> '' GROUP BY 1, 2)""",
    "tf": f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('content')}) AS term FROM docs) GROUP BY 1, 2)",
    "bm": """len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
      st AS (SELECT CAST((SELECT count(*) FROM docs) AS DOUBLE) AS n, (SELECT CAST(sum(len) AS DOUBLE) / count(*) FROM len) AS avgdl),
      dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      bm AS (SELECT tf.doc_id, tf.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS weight
             FROM tf JOIN len USING (doc_id) JOIN dfs USING (term) CROSS JOIN st)""",
}


def with_(*names: str) -> str:
    """WITH and the named expressions; each may use those before it."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"
