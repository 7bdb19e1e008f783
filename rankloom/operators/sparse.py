"""Sparse retrieval: postings, weights, and exact top-k of many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import token_rows, tokens
from rankloom.operators import blocks
from rankloom.plans import datasets as D
from rankloom.session import written

#: Scores are rounded to so many digits before they are ranked.
DIGITS = 6


def rank_hits(scored: DataFrame, k: int | None, digits: int = DIGITS) -> DataFrame:
    """query_id, doc_id, score, rank from 1: by rounded score, then doc_id ascending; the first ``k``.

    The filter on the row number becomes a group limit on both sides of the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = scored.select("query_id", "doc_id", F.round("score", digits).alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def explode_postings(docs: DataFrame, key: str, weights: str) -> DataFrame:
    """doc_id, term, weight of a map column; only weights above 0."""
    positive = F.map_filter(F.col(weights), lambda _, w: (w > 0) & ~F.isnan(w))
    return docs.select(F.col(key).alias("doc_id"), F.explode(positive).alias("term", "weight"))


def top_k_dot(postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The ``k`` documents of each query with the greatest sum of weight products, exactly.

    Where the postings have a column ``peak``, the greatest product of peak and
    query weight is added to the sum.

    ``postings``: doc_id, term, weight above 0, unique. ``terms``: query_id,
    term, weight above 0, unique. Documents without a common term are in no
    result; a query without terms has none. Ties go by doc_id. Postings become
    blocks of documents (one shuffle); an index that is searched again keeps
    its blocks.
    """
    return rank_hits(blocks.top_k_blocks(blocks.store_blocks(blocks.posting_blocks(postings)), terms, k, DIGITS), k)


def bm25_topk_of(docs: DataFrame, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents (doc_id, content) of each query by BM25, without a shuffle of postings."""
    return rank_hits(blocks.top_k_blocks(blocks.store_blocks(blocks.text_blocks(docs)), terms, k, DIGITS, blocks.Bm25(k1, b)), k)


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf of doc_id, content."""
    return token_rows(docs, "doc_id", "content").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_weights(docs: DataFrame, k1: float = 1.2, b: float = 0.75, keep_k1_factor: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight: what each term adds to a document's BM25 score per occurrence in the query.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), lengths as they are, not
    quantised. N counts all documents, the average length those with a token.
    ``counted``: the :func:`term_counts`, where they are there already.
    """
    counted = term_counts(docs) if counted is None else counted
    lengths = counted.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    totals = docs.agg(F.count(F.lit(1)).cast("double").alias("n")).crossJoin(F.broadcast(lengths.agg((F.sum("len").cast("double") / F.count(F.lit(1))).alias("avgdl"))))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + k1 * ((1 - b) + b * F.col("len") / F.col("avgdl")))
    return counted.join(lengths, "doc_id").join(df, "term").crossJoin(F.broadcast(totals)).select("doc_id", "term", (idf * tf * ((k1 + 1) if keep_k1_factor else 1)).alias("weight"))


def lexical_weights(docs: DataFrame, top_terms: int = 100, counted: DataFrame | None = None) -> DataFrame:
    """doc_id, term, weight: ln(1 + tf) ln(1 + N / df), each document's ``top_terms``; stands in for a learned encoder."""
    counted = term_counts(docs) if counted is None else counted
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    weighted = counted.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", F.round(F.log1p("tf") * F.log(1 + F.col("n") / F.col("df")), DIGITS).alias("weight"))
    return top_terms_of(weighted, top_terms)


def top_terms_of(postings: DataFrame, n: int) -> DataFrame:
    """Each document's ``n`` greatest weights; ties by term."""
    order = Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), F.col("term"))
    return postings.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def pool_logits(logits: DataFrame, special: DataFrame | None = None, top_terms: int = 100) -> DataFrame:
    """Sparse weights from an encoder's output rows doc_id, position, term, logit, mask.

    Masked positions are dropped before pooling, special terms never count,
    and a term's weight is the maximum of log1p(relu(logit)).
    """
    live = logits.filter("mask = 1")
    if special is not None:
        live = live.join(F.broadcast(special.select("term")), "term", "left_anti")
    pooled = live.groupBy("doc_id", "term").agg(F.max(F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0)))).alias("weight"))
    return top_terms_of(pooled.filter("weight > 0"), top_terms)


def global_max(postings: DataFrame) -> DataFrame:
    """One row, ``global_max``: the greatest weight, 1.0 where there is none. Keep it with the index: queries need it too."""
    return postings.agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("global_max"))


def quantize(postings: DataFrame, scale: DataFrame) -> DataFrame:
    """Weights as whole numbers from 0 to 255 of ``scale``'s global_max, truncated; query weights may exceed 255."""
    return postings.crossJoin(F.broadcast(scale)).withColumn("weight", F.floor(F.col("weight") / F.col("global_max") * 255).cast("double")).drop("global_max")


def saturation(postings: DataFrame) -> DataFrame:
    """Weights w / (w + pivot), the pivot being the geometric mean of the term's weights."""
    pivots = postings.groupBy("term").agg(F.exp(F.avg(F.log("weight"))).alias("pivot"))
    return postings.join(pivots, "term").select("doc_id", "term", (F.col("weight") / (F.col("weight") + F.col("pivot"))).alias("weight"))


def dismax_postings(postings: DataFrame, tie: float = 0.7) -> DataFrame:
    """Postings that :func:`top_k_dot` scores by the best term's part, plus ``tie`` of the others'."""
    return postings.select("doc_id", "term", (tie * F.col("weight")).alias("weight"), ((1 - tie) * F.col("weight")).alias("peak"))


def hybrid_postings(bm25: DataFrame, dismax: DataFrame, alpha: float = 0.4, beta: float = 0.6) -> DataFrame:
    """Postings that score alpha BM25 + beta dis-max; a document qualifies by either."""
    parts = bm25.select("doc_id", "term", (alpha * F.col("weight")).alias("w"), F.lit(0.0).alias("p")).unionByName(dismax.select("doc_id", "term", (beta * F.col("weight")).alias("w"), (beta * F.col("peak")).alias("p")))
    return parts.groupBy("doc_id", "term").agg(F.sum("w").alias("weight"), F.max("p").alias("peak"))


def match_all(docs: DataFrame, queries: DataFrame, terms: DataFrame, k: int, score: float = 1.0) -> DataFrame:
    """Queries without a positive term match every document alike: the first ``k`` by id (ids are unique), with a constant score."""
    bare = queries.select("query_id").distinct().join(terms.filter("weight > 0"), "query_id", "left_anti")
    first = docs.select("doc_id").orderBy("doc_id").limit(k)
    order = Window.partitionBy("query_id").orderBy("doc_id")
    return bare.crossJoin(F.broadcast(first)).select("query_id", "doc_id", F.lit(score).alias("score")).withColumn("rank", F.row_number().over(order))


def dot_scores(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every document that shares a term."""
    joined = postings.join(terms.filter("weight > 0").select("query_id", "term", F.col("weight").alias("qw")), "term")
    return joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def unit_length(rows: DataFrame, key: str) -> DataFrame:
    """Weights divided by the length of their vector; vectors of length 0 stay as they are."""
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rows.join(norms, key).withColumn("weight", F.col("weight") / F.coalesce(F.nullif("norm", F.lit(0.0)), F.lit(1.0))).drop("norm")


def hashed_dimension(term: Column | str, modulus: int = 30_522) -> Column:
    """The dimension of a term without a vocabulary: CRC-32 of its UTF-8 bytes."""
    return (F.crc32(F.encode(F.col(term) if isinstance(term, str) else term, "UTF-8")) % modulus).cast("int")


def hashed_postings(postings: DataFrame, modulus: int = 30_522) -> DataFrame:
    """doc_id, idx, weight: of terms that collide the last in term order stays, they are not added."""
    return postings.select("doc_id", hashed_dimension("term", modulus).alias("idx"), "term", "weight").groupBy("doc_id", "idx").agg(F.max_by("weight", "term").alias("weight"))


def vocabulary_postings(postings: DataFrame, vocabulary: DataFrame, dim: int) -> DataFrame:
    """doc_id, idx, weight by a table term, idx; unknown terms and positions outside of 0 to ``dim`` - 1 are dropped."""
    return postings.join(vocabulary, "term").filter(F.col("idx").between(0, dim - 1)).groupBy("doc_id", "idx").agg(F.max_by("weight", "term").alias("weight"))


def vocabulary_terms(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, term, weight of postings doc_id, idx, weight; positions without a term are dropped."""
    return postings.join(vocabulary.select("term", "idx"), "idx").select("doc_id", "term", "weight")


def p_corpus_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.corpus(spark, sf_dir).select("doc_id", "content", F.length("content").alias("n_chars"), F.substring("content", 1, 200).alias("snippet"))


def token_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight: how often the query has the token."""
    return D.query_tokens(queries)


def graded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the queries that have a graded judgment."""
    return D.query_tokens(D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir)))


def bm25_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return bm25_topk_of(D.corpus(spark, sf_dir), graded_queries(spark, sf_dir), k)


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = D.judged_queries(spark, sf_dir, D.binary(spark, sf_dir))
    return written(D.sparse_postings(spark, sf_dir), "postings"), D.query_tokens(queries)


def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_dot(*_sparse(spark, sf_dir), 10)


def sparse_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, terms = _sparse(spark, sf_dir)
    return top_k_dot(unit_length(postings, "doc_id"), unit_length(terms, "query_id"), 10)


def pg_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, terms = _sparse(spark, sf_dir)
    return top_k_dot(postings, terms, 20)


def dismax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a term match all documents."""
    postings, terms = _sparse(spark, sf_dir)
    queries = D.judged_queries(spark, sf_dir, D.binary(spark, sf_dir))
    return top_k_dot(dismax_postings(saturation(postings)), terms, 10).unionByName(match_all(D.store_ids(spark, sf_dir), queries, terms, 10))


def es_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a term match all documents by the dis-max branch."""
    docs, queries = written(D.corpus(spark, sf_dir), "docs"), D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir))
    terms = D.query_tokens(queries)
    counted = written(term_counts(docs), "counts")
    lexical = written(lexical_weights(docs, counted=counted), "lexical")
    return top_k_dot(hybrid_postings(bm25_weights(docs, counted=counted), dismax_postings(saturation(lexical))), terms, 10).unionByName(match_all(docs, queries, terms, 10, 0.6))


def lexical_encode_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_weights(D.corpus(spark, sf_dir), 20)


def weights_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = D.sparse_postings(spark, sf_dir)
    return quantize(postings, global_max(postings))


def hashed_dim_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_postings(D.sparse_postings(spark, sf_dir))


#: Fixed values of the example of an encoder's output: terms that never count, and positions that are read.
SPECIAL, READ = ("the", "of", "and"), 48


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooling of a made-up encoder output over beir_corpus: a logit for every token, by its length and position; later positions are masked."""
    at = D.corpus(spark, sf_dir).select("doc_id", F.posexplode(tokens("content")).alias("position", "term"))
    logit = F.length("term") * F.lit(0.5) - F.lit(1.5) + (F.col("position") % 4) * F.lit(0.25)
    rows = at.select("doc_id", "position", "term", logit.alias("logit"), (F.col("position") < READ).cast("int").alias("mask"))
    special = spark.createDataFrame([(t,) for t in SPECIAL], "term string")
    return pool_logits(rows, special, 20).withColumn("weight", F.round("weight", DIGITS))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by a vocabulary that gives every term its length as position, of which 3 to 9 are within the dimension."""
    postings = D.sparse_postings(spark, sf_dir)
    return vocabulary_postings(postings, postings.select("term").distinct().withColumn("idx", F.length("term") - 3), 7)


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = D.corpus(spark, sf_dir).select(F.size(tokens("content")).alias("len"))
    return words.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("n_tokens"), F.round(F.avg(F.when(F.col("len") > 0, F.col("len"))), 6).alias("avgdl"))


QUERIES = {
    "corpus_render": p_corpus_render,
    "bm25_stats": bm25_stats,
    "bm25_topk": bm25_topk,
    "lexical_encode_topk": lexical_encode_topk,
    "weights_quantized": weights_quantized,
    "sparse_dot_topk": sparse_dot_topk,
    "pg_overlap_topk": pg_overlap_topk,
    "sparse_cosine_topk": sparse_cosine_topk,
    "dismax_topk": dismax_topk,
    "es_hybrid_topk": es_hybrid_topk,
    "hashed_dim_postings": hashed_dim_postings,
    "pool_logits": pooled,
    "vocab_postings": vocabulary,
}


def ranked_sql(scored: str, k: int, digits: int = DIGITS) -> str:
    """SELECT of the ``k`` best rows of a select of query_id, doc_id, score."""
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM (SELECT query_id, doc_id, round(score, {digits}) AS score FROM ({scored}))) WHERE rank <= {k}"""


_DOT = "SELECT query_id, doc_id, sum(p.weight * q.weight) AS score FROM {p} p JOIN {q} q USING (term) GROUP BY 1, 2"
_UNIT = "{n} AS (SELECT * REPLACE (weight / sqrt(sum(weight * weight) OVER (PARTITION BY {k})) AS weight) FROM {t})"
_SAT = "sat AS (SELECT doc_id, term, weight / (weight + exp(avg(ln(weight)) OVER (PARTITION BY term))) AS weight FROM {t})"
_DISMAX = "SELECT query_id, doc_id, 0.3::DOUBLE * max(p.weight * q.weight) + 0.7::DOUBLE * sum(p.weight * q.weight) AS score FROM sat p JOIN {q} q USING (term) GROUP BY 1, 2"
_LEX = """lex AS (SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS r FROM (
  SELECT doc_id, term, round(ln(1 + tf) * ln(1 + n / df), 6) AS weight FROM tf JOIN dfs USING (term) CROSS JOIN st)) WHERE r <= {k})"""
#: Queries of {q} without a term in {t}: the ten first documents of {d}.
_ALL = """SELECT query_id, doc_id, {s}::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank
  FROM (SELECT query_id FROM {q} WHERE query_id NOT IN (SELECT query_id FROM {t})) CROSS JOIN (SELECT doc_id FROM ({d}) WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 10)"""
_GRADED, _BINARY = ("docs", "graded", "all_q", "gq", "gqt", "tf", "bm"), ("judged_binary", "all_q", "bq", "bqt", "post")
SQL = {
    "corpus_render": D.with_("docs") + "SELECT doc_id, content, CAST(length(content) AS INTEGER) AS n_chars, substring(content, 1, 200) AS snippet FROM docs",
    "bm25_stats": D.with_("docs", "tf", "bm") + "SELECT (SELECT count(*) FROM docs) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_tokens, round((SELECT avgdl FROM st), 6) AS avgdl FROM tf",
    "bm25_topk": D.with_(*_GRADED) + ranked_sql(_DOT.format(p="bm", q="gqt"), 10),
    "lexical_encode_topk": D.with_("docs", "tf", "bm") + ", " + _LEX.format(k=20) + " SELECT * FROM lex",
    "weights_quantized": D.with_("post") + "SELECT doc_id, term, floor(weight / (SELECT max(weight) FROM post) * 255) AS weight FROM post",
    "sparse_dot_topk": D.with_(*_BINARY) + ranked_sql(_DOT.format(p="post", q="bqt"), 10),
    "pg_overlap_topk": D.with_(*_BINARY) + ranked_sql(_DOT.format(p="post", q="bqt"), 20),
    "sparse_cosine_topk": D.with_(*_BINARY) + ", " + _UNIT.format(n="pu", k="doc_id", t="post") + ", " + _UNIT.format(n="qu", k="query_id", t="bqt") + " " + ranked_sql(_DOT.format(p="pu", q="qu"), 10),
    "dismax_topk": D.with_(*_BINARY) + ", " + _SAT.format(t="post") + f" {ranked_sql(_DISMAX.format(q='bqt'), 10)} UNION ALL "
    + _ALL.format(q="bq", t="bqt", s="1.0", d=f"SELECT DISTINCT {D._norm('doc_id')} AS doc_id FROM pg_documents"),
    "pool_logits": D.with_("docs") + f""", tk AS (SELECT doc_id, t AS toks, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {D._tokens('content')} AS t FROM docs)),
    pw AS (SELECT doc_id, toks[pos + 1] AS term, max(ln(1 + greatest(length(toks[pos + 1]) * 0.5::DOUBLE - 1.5::DOUBLE + (pos % 4) * 0.25::DOUBLE, 0))) AS w FROM tk WHERE pos < {READ} GROUP BY 1, 2)
    SELECT doc_id, term, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS r FROM pw WHERE w > 0 AND term NOT IN {SPECIAL}) WHERE r <= 20""",
    "vocab_postings": D.with_("post") + "SELECT doc_id, CAST(length(term) - 3 AS INTEGER) AS idx, arg_max(weight, term) AS weight FROM post WHERE length(term) BETWEEN 3 AND 9 GROUP BY 1, 2",
    "es_hybrid_topk": D.with_(*_GRADED)
    + ", " + _LEX.format(k=100) + ", " + _SAT.format(t="lex") + " "
    + ranked_sql(f"SELECT query_id, doc_id, sum(w * score) AS score FROM (SELECT *, 0.4::DOUBLE AS w FROM ({_DOT.format(p='bm', q='gqt')}) UNION ALL SELECT *, 0.6::DOUBLE FROM ({_DISMAX.format(q='gqt')})) GROUP BY 1, 2", 10) + " UNION ALL " + _ALL.format(q="gq", t="gqt", s="0.6", d="SELECT doc_id FROM docs"),
}
