"""Prompt contexts of retrieved documents, and answers by a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import strip
from rankloom.operators import sparse
from rankloom.plans import datasets as D
from rankloom.session import written

#: The prompt and the answer without a generator.
PROMPT = """Answer the question using only the context below.
If the answer cannot be found in the context, say "I don't know."

Context:
%s

Question: %s

Answer:"""
NO_LLM = "[NO LLM] Prompt:\n"
CHARS_PER_TOKEN = 4


def build_context(hits: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """query_id, context, n_docs from hits with rank and content.

    Documents are taken in rank order while characters are left (four per
    token; labels are free); the first always is, the last is clipped. An
    empty document still brings its label.
    """
    budget = max_tokens * CHARS_PER_TOKEN
    order = Window.partitionBy("query_id").orderBy("rank")
    text = strip(F.coalesce("content", F.lit("")))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hits.select("query_id", "rank", text.alias("t")).withColumn("n", F.length("t")).withColumn("before", before).withColumn("i", F.row_number().over(order))
    kept = placed.filter((F.col("before") < budget) | (F.col("i") == 1))
    part = F.concat(F.lit("[Document "), F.col("i"), F.lit("]  "), F.substring("t", F.lit(1), (F.lit(budget) - F.col("before")).cast("int")))
    parts = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", part.alias("p")))).alias("ps"))
    return parts.select("query_id", F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n").alias("context"), F.size("ps").alias("n_docs"))


def prompts(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt of every query with a context."""
    head, middle, end = PROMPT.split("%s")
    return contexts.join(queries, "query_id").select("query_id", F.concat(F.lit(head), "context", F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end)).alias("prompt"))


def answers(asked: DataFrame, generate: Callable | None = None) -> DataFrame:
    """query_id, answer; without a generator the prompt comes back. An error of the generator becomes the answer's text."""
    if generate is None:
        return asked.select("query_id", F.concat(F.lit(NO_LLM), "prompt").alias("answer"))

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(str(generate(p)))
                except Exception as e:  # noqa: BLE001
                    out.append(f"[LLM error] {e}")
            yield pdf[["query_id"]].assign(answer=out)

    return asked.mapInPandas(run, "query_id string, answer string")


def excerpt(c: str, n: int = 500):
    """The first ``n`` characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))


def shortlist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The five best BM25 documents of every judged query with their contents, and the queries."""
    docs, queries = D.corpus(spark, sf_dir), D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir))
    hits = written(sparse.bm25_topk_of(docs, D.query_tokens(queries), 5), "hits")
    return hits.join(docs, "doc_id"), queries


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_context(shortlist(spark, sf_dir)[0])


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, queries = shortlist(spark, sf_dir)
    return answers(prompts(build_context(hits), queries))


QUERIES = {"rag_context": rag_context, "rag_prompt": rag_prompt}

_S = (
    D.with_("docs", "graded", "all_q", "gq", "gqt", "tf", "bm") + ", hits AS (" + sparse.ranked_sql(sparse._DOT.format(p="bm", q="gqt"), 5) + ")"
    + """, pl AS (SELECT query_id, rank, content AS t, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
      row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM hits JOIN docs USING (doc_id)),
    cx AS (SELECT query_id, string_agg('[Document ' || i || ']  ' || substring(t, 1, CAST(8192 - b AS BIGINT)), chr(10) || chr(10) ORDER BY i) AS context, CAST(count(*) AS INTEGER) AS n_docs
      FROM pl WHERE b < 8192 OR i = 1 GROUP BY 1)"""
)
_Q = [x.replace("'", "''") for x in PROMPT.split("%s")]
SQL = {
    "rag_context": _S + " SELECT * FROM cx",
    "rag_prompt": _S + f" SELECT query_id, '{NO_LLM}' || '{_Q[0]}' || context || '{_Q[1]}' || coalesce(text, '') || '{_Q[2]}' AS answer FROM cx JOIN gq USING (query_id)",
}
