"""Scoring of runs against judgments: two families of measures with different rules.

Own family: ranks are list positions, duplicates collapse, exponential gain.
Run family: documents are ranked by score, equal scores by doc_id descending
(its usual rule), linear gain, every judged query counts, missing ones as 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import fusion, rerank, sparse
from rankloom.plans import datasets as D
from rankloom.session import written
from rankloom.sources.tables import table

CUTOFFS = (1, 3, 5, 10, 100, 1000)
SMALL_SAMPLE = 50


def run_ranks(run: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """query_id, doc_id, rank (and ``by``): by score descending, then doc_id descending. A document counts once, with its highest score; null and NaN scores don't count."""
    live = run.filter("score IS NOT NULL AND NOT isnan(score) AND doc_id IS NOT NULL")
    best = live.groupBy(*by, "query_id", "doc_id").agg(F.max(F.col("score") + F.lit(0.0)).alias("score"))
    order = Window.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return best.select(*by, "query_id", "doc_id", F.row_number().over(order).alias("rank"))


def judged_hits(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, rank, grade of the hits with a grade above 0. Judgments are the small side of a shuffle join on both keys."""
    return ranked.join(judgments.filter("grade > 0").select("query_id", "doc_id", "grade"), ["query_id", "doc_id"]).select("query_id", "rank", "grade")


def _gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def ideal(judgments: DataFrame, exponential: bool) -> DataFrame:
    """query_id, irank, igain / discount: the best possible order of each query's judgments."""
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), F.col("doc_id"))
    return judgments.filter("grade > 0").withColumn("irank", F.row_number().over(order)).select("query_id", "irank", (_gain(F.col("grade"), exponential) / F.log2(F.col("irank") + 1)).alias("ideal"))


def per_query(ranked: DataFrame, judgments: DataFrame, cutoffs: Sequence[int] = CUTOFFS, exponential: bool = False) -> DataFrame:
    """query_id, k, ndcg, recall, map, precision, mrr (no cut-off) of every judged query; 0 where nothing relevant was found.

    Judged means at least one grade above 0. Queries of the run without a
    judgment are left out.
    """
    hits = judged_hits(ranked, judgments)
    so_far = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("n_rel", F.row_number().over(so_far))
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x))
    got = hits.groupBy("query_id").agg(
        (1.0 / F.min("rank")).alias("mrr"),
        *[at(k, _gain(F.col("grade"), exponential) / F.log2(F.col("rank") + 1)).alias(f"dcg{k}") for k in cutoffs],
        *[at(k, F.lit(1)).alias(f"rel{k}") for k in cutoffs],
        *[at(k, F.col("n_rel") / F.col("rank")).alias(f"ap{k}") for k in cutoffs],
    )
    best = ideal(judgments, exponential).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("irank") <= k, F.col("ideal"))).alias(f"idcg{k}") for k in cutoffs])
    both = best.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (zero(f"dcg{k}") / F.col(f"idcg{k}")).alias("ndcg"),
                (zero(f"rel{k}") / F.col("n")).alias("recall"),
                (zero(f"ap{k}") / F.col("n")).alias("map"),
                (zero(f"rel{k}") / F.lit(k)).alias("precision"),
                zero("mrr").alias("mrr"),
            )
            for k in cutoffs
        ]
    )
    return both.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.*")


def means(rows: DataFrame, by: Sequence[str] = ("k",)) -> DataFrame:
    """Averages over queries."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in ("ndcg", "recall", "map", "precision", "mrr")], F.count(F.lit(1)).alias("n_queries"))


def evaluate_run(run: DataFrame, judgments: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """metric, k, value of a run: linear gain, all judged queries, five digits."""
    rows = means(per_query(run_ranks(run), judgments, cutoffs))
    long = rows.select("k", F.explode(F.create_map(*[x for m in ("ndcg", "recall", "map", "precision", "mrr") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    return long.select("metric", "k", F.round(F.round("value", 10), 5).alias("value"))  # whatever order the sum took


def evaluate_lists(ranked: DataFrame, judgments: DataFrame, cutoffs: Sequence[int] = (5, 10, 20), skip_missing: bool = True) -> DataFrame:
    """The own family on list positions: exponential gain. With ``skip_missing`` queries without results don't count, else as 0."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    judged = judgments.join(ranked.select("query_id"), "query_id", "left_semi") if skip_missing else judgments
    return means(per_query(first, judged, cutoffs, exponential=True))


def evaluate_grouped(ranked: DataFrame, judgments: DataFrame, by: str, groups: DataFrame | None = None, cutoffs: Sequence[int] = (5, 10, 20), exponential: bool = True) -> DataFrame:
    """``by``, k and the averages of many systems or settings in one plan.

    ``ranked``: ``by``, query_id, doc_id, rank. Without ``groups`` a group
    counts the judged queries that it has results for; with ``groups`` (a small
    table of ``by``) each counts every judged query.
    """
    both = F.to_json(F.struct(F.col(by).alias("g"), F.col("query_id").alias("q")))
    first = ranked.groupBy(by, "query_id", "doc_id").agg(F.min("rank").alias("rank"))
    if groups is None:
        judged = judgments.join(ranked.select(by, "query_id").distinct(), "query_id")
    else:
        judged = judgments.crossJoin(F.broadcast(groups.select(by)))
    rows = per_query(first.select(both.alias("query_id"), "doc_id", "rank"), judged.select(both.alias("query_id"), "doc_id", "grade"), cutoffs, exponential)
    return means(rows.withColumn(by, F.get_json_object("query_id", "$.g")), (by, "k"))


def missing_judged(judgments: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id of judgments on documents that the corpus lacks."""
    return judgments.join(docs.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")


def small_sample(judgments: DataFrame) -> bool:
    """Whether there are too few judged queries for the averages to mean much."""
    return judgments.filter("grade > 0").select("query_id").distinct().count() < SMALL_SAMPLE


def format_table(rows: Sequence[dict], metrics: Sequence[str] = ("ndcg@10",)) -> str:
    """Lines of a report, best system by the first metric first."""
    if not rows:
        return "(no results)"
    ordered = sorted(rows, key=lambda r: -r.get(metrics[0], 0.0))
    width = max(len("system"), *(len(r["system"]) for r in ordered))
    lines = ["  ".join(["system".ljust(width), *(m.rjust(12) for m in metrics)])]
    lines += ["  ".join([r["system"].ljust(width), *(f"{r[m]:12.5f}" if m in r else " " * 11 + "-" for m in metrics)]) for r in ordered]
    return "\n".join(lines)


def best_setting(rows: DataFrame, setting: Sequence[str], metric: str = "ndcg") -> DataFrame:
    """The setting with the best metric; of equals the first in order."""
    return rows.orderBy(F.col(metric).desc(), *setting).limit(1)


def latency_summary(df: DataFrame, value: Column) -> DataFrame:
    """Count, mean, median, 95th percentile (interpolated) of a duration; nulls don't count.

    Values are counted first, then ordered by ranges: a value's position is
    that of its range, from the ranges' totals, and its place in the range. No
    task sees more than one range, and what is collected is a row per range.
    """
    counted = df.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "values")
    parts = counted.groupBy("part").agg(F.sum("n").alias("m"), F.min("v").alias("low"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))  # a row per range
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = counted.join(F.broadcast(offsets), "part").select("v", "n", (F.col("before") + up_to).alias("last"))
    total = counted.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.lit(None)).alias("mean"))
    at = placed.crossJoin(F.broadcast(total))

    def share(p: float) -> Column:
        place = p * (F.col("all") - 1)
        here = lambda i: F.min(F.when(F.col("last") > i, F.col("v")))
        low, high, part = here(F.floor(place)), here(F.ceil(place)), F.first(place - F.floor(place))
        return F.round(low + (high - low) * part, 6)

    return at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.first("mean"), 6).alias("mean"), share(0.5).alias("p50"), share(0.95).alias("p95"))


def _bm25_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sparse.bm25_topk(spark, sf_dir, 100), D.graded(spark, sf_dir)


def _rounded(rows: DataFrame, metrics: Sequence[str], digits: int = 6) -> DataFrame:
    return rows.select("query_id", "k", *[F.round(m, digits).alias(m) for m in metrics])


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "es_hits").withColumn("doc_id", F.lower("doc_id"))
    return _rounded(per_query(run_ranks(run), D.binary(spark, sf_dir), (5, 10, 20)), ["recall", "mrr"])


def ndcg_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, judgments = _bm25_run(spark, sf_dir)
    return _rounded(per_query(run_ranks(run), judgments, (3, 10)), ["ndcg", "map", "precision"])


def ndcg_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, judgments = _bm25_run(spark, sf_dir)
    return _rounded(per_query(run, judgments, (5, 10, 20), exponential=True), ["ndcg"])


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_run(*_bm25_run(spark, sf_dir))


def results_to_run(lists: DataFrame) -> DataFrame:
    """query_id, doc_id, score of ranked lists (query_id, pos, doc_id, score): of a document's several hits the last counts."""
    return lists.groupBy("query_id", "doc_id").agg(F.max_by("score", "pos").alias("score"))


def listed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The es_hybrid lists of query_results as a run, against the binary judgments: all measures, missing queries as 0."""
    lists = fusion.query_lists(spark, sf_dir).filter("list = 0").withColumn("doc_id", F.lower("doc_id"))
    return evaluate_run(results_to_run(lists), D.binary(spark, sf_dir), (5, 10, 20))


def missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """es_hits as a run: most judged queries are missing in it, and count as 0."""
    return evaluate_run(table(spark, sf_dir, "es_hits").withColumn("doc_id", F.lower("doc_id")), D.binary(spark, sf_dir), (10, 100))


def reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, judgments = _bm25_run(spark, sf_dir)
    return _rounded(per_query(run_ranks(run), judgments, (10,)), ["mrr"]).drop("k")


def map_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, judgments = _bm25_run(spark, sf_dir)
    return _rounded(per_query(run_ranks(run), judgments, CUTOFFS), ["map", "precision"])


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_judged(D.graded(spark, sf_dir), D.corpus(spark, sf_dir))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.judged_queries(spark, sf_dir, D.graded(spark, sf_dir))


def best_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = rerank.blend_sweep(*rerank.first_stage(spark, sf_dir), rerank.BLEND_WEIGHTS)
    keyed = settings.withColumn("query_id", F.concat_ws("|", F.col("weight").cast("string"), "query_id"))
    judgments = D.graded(spark, sf_dir)
    params = F.broadcast(spark.createDataFrame([(float(w),) for w in rerank.BLEND_WEIGHTS], "weight double"))
    wide = judgments.crossJoin(params).withColumn("query_id", F.concat_ws("|", F.col("weight").cast("string"), "query_id")).drop("weight")
    rows = per_query(keyed.select("query_id", "doc_id", "rank"), wide, (10,)).withColumn("weight", F.substring_index("query_id", "|", 1).cast("double"))
    scored = rows.groupBy("weight").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))
    return best_setting(scored, ["weight"])


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list of query_results and their fusion, from one pass over the lists."""
    lists = written(fusion.query_lists(spark, sf_dir), "lists")
    name = F.element_at(F.array(*map(F.lit, fusion.LISTS)), F.col("list") + 1)
    each = lists.select(name.alias("system"), "query_id", F.lower("doc_id").alias("doc_id"), F.col("pos").alias("rank"))
    fused = fusion.fuse(lists, "rrf", fusion.WEIGHTS).select(F.lit("fused").alias("system"), "query_id", F.lower("doc_id").alias("doc_id"), "rank")
    rows = evaluate_grouped(each.unionByName(fused), D.binary(spark, sf_dir), "system", cutoffs=(10,))
    return rows.select("system", "k", *[F.round(m, 6).alias(m) for m in ("ndcg", "recall", "mrr")], "n_queries")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "es_hits")
    return latency_summary(hits, (F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("hit_at").cast("timestamp"))) / F.lit(1e6))


QUERIES = {
    "judged_queries": judged,
    "missing_judged_docs": missing,
    "recall_at_k": recall_at_k,
    "ndcg_linear": ndcg_linear,
    "ndcg_exp": ndcg_exp,
    "evaluate_run": run_metrics,
    "evaluate_run_missing": missing_run,
    "results_to_run": listed_run,
    "mrr": reciprocal_rank,
    "map_precision": map_precision,
    "best_setting": best_blend,
    "compare_systems": systems,
    "latency_stats": latency,
}


def metrics_sql(ranked: str, judgments: str, cutoffs: Sequence[int], exponential: bool = False) -> str:
    """CTE pq: query_id, k and all measures; ``ranked`` and ``judgments`` name expressions."""
    gain = "(pow(2, grade) - 1)" if exponential else "grade::DOUBLE"
    return f"""jh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nrel FROM (SELECT query_id, rank, grade FROM {ranked} JOIN {judgments} USING (query_id, doc_id))),
    idl AS (SELECT query_id, {gain} / log2(ir + 1) AS ideal, ir FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS ir FROM {judgments})),
    ks AS (SELECT unnest([{", ".join(map(str, cutoffs))}]) AS k),
    a AS (SELECT query_id, k, count(*) AS n, sum(ideal) FILTER (ir <= k) AS idcg FROM idl CROSS JOIN ks GROUP BY 1, 2),
    g AS (SELECT query_id, k, 1.0::DOUBLE / min(rank) AS mrr, sum({gain} / log2(rank + 1)) FILTER (rank <= k) AS dcg, count(*) FILTER (rank <= k) AS rel, sum(nrel / rank::DOUBLE) FILTER (rank <= k) AS ap FROM jh CROSS JOIN ks GROUP BY 1, 2),
    pq AS (SELECT a.query_id, a.k, coalesce(dcg, 0) / idcg AS ndcg, coalesce(rel, 0) / n::DOUBLE AS recall, coalesce(ap, 0) / n AS map, coalesce(rel, 0) / a.k::DOUBLE AS precision, coalesce(mrr, 0) AS mrr FROM a LEFT JOIN g USING (query_id, k))"""


_RUN = "rr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM ({t}))"
_BM25 = D.with_("docs", "graded", "all_q", "gq", "gqt", "tf", "bm") + ", hits AS (" + sparse.ranked_sql(sparse._DOT.format(p="bm", q="gqt"), 100) + ")"
_ES = "SELECT query_id, lower(doc_id) AS doc_id, max(score + 0.0) AS score FROM es_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2"
_SYSTEM = """SELECT '{n}' AS system, 10 AS k, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM (
  WITH own AS (SELECT query_id, doc_id, min(rank) AS rank FROM ({r}) GROUP BY 1, 2), jd AS (SELECT * FROM judged_binary WHERE query_id IN (SELECT query_id FROM own)), {m} SELECT * FROM pq)"""
_FUSED = fusion.fused_sql("SELECT *, (CASE list WHEN 2 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) / (60 + pos) AS part FROM hits", "query_id", 10**6)
_LONG = (
    " SELECT metric, k, round(round(value, 10), 5) AS value FROM (UNPIVOT (SELECT k, avg(ndcg) AS ndcg, avg(recall) AS recall, avg(map) AS map, avg(precision) AS precision, avg(mrr) AS mrr FROM pq GROUP BY 1) ON ndcg, recall, map, precision, mrr INTO NAME metric VALUE value)"
)
SQL = {
    "judged_queries": D.with_("graded", "all_q", "gq") + "SELECT * FROM gq",
    "missing_judged_docs": D.with_("docs", "graded") + "SELECT query_id, doc_id FROM graded WHERE doc_id NOT IN (SELECT doc_id FROM docs)",
    "recall_at_k": D.with_("judged_binary") + ", " + _RUN.format(t=_ES) + ", " + metrics_sql("rr", "judged_binary", (5, 10, 20)) + " SELECT query_id, k, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM pq",
    "ndcg_linear": _BM25 + ", " + _RUN.format(t="SELECT * FROM hits") + ", " + metrics_sql("rr", "graded", (3, 10)) + " SELECT query_id, k, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(precision, 6) AS precision FROM pq",
    "ndcg_exp": _BM25 + ", " + metrics_sql("hits", "graded", (5, 10, 20), True) + " SELECT query_id, k, round(ndcg, 6) AS ndcg FROM pq",
    "evaluate_run": _BM25 + ", " + _RUN.format(t="SELECT * FROM hits") + ", " + metrics_sql("rr", "graded", CUTOFFS)
    + _LONG,
    "evaluate_run_missing": D.with_("judged_binary") + ", " + _RUN.format(t=_ES) + ", " + metrics_sql("rr", "judged_binary", (10, 100)) + _LONG,
    "results_to_run": fusion.HITS_CTE + ", " + D.CTE["judged_binary"] + ", "
    + _RUN.format(t="SELECT query_id, lower(doc_id) AS doc_id, arg_max(score, pos) AS score FROM hits WHERE list = 0 GROUP BY 1, 2") + ", " + metrics_sql("rr", "judged_binary", (5, 10, 20)) + _LONG,
    "mrr": _BM25 + ", " + _RUN.format(t="SELECT * FROM hits") + ", " + metrics_sql("rr", "graded", (10,)) + " SELECT query_id, round(mrr, 6) AS mrr FROM pq",
    "map_precision": _BM25 + ", " + _RUN.format(t="SELECT * FROM hits") + ", " + metrics_sql("rr", "graded", CUTOFFS) + " SELECT query_id, k, round(map, 6) AS map, round(precision, 6) AS precision FROM pq",
    "best_setting": rerank.STAGE
    + f""", b AS (SELECT weight, query_id, doc_id, rank AS first, round(weight / (60 + rr) + (1 - weight) / (60 + rank), 9) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rr FROM cov) CROSS JOIN {rerank._BW}),
    sw AS (SELECT weight || '|' || query_id AS query_id, doc_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, first) AS rank FROM b),
    gw AS (SELECT weight || '|' || query_id AS query_id, doc_id, grade FROM graded CROSS JOIN {rerank._BW}), """
    + metrics_sql("sw", "gw", (10,))
    + " SELECT CAST(split_part(query_id, '|', 1) AS DOUBLE) AS weight, round(avg(ndcg), 6) AS ndcg FROM pq GROUP BY 1 ORDER BY ndcg DESC, weight LIMIT 1",
    "compare_systems": fusion.HITS_CTE + ", " + D.CTE["judged_binary"] + " "
    + " UNION ALL ".join(
        _SYSTEM.format(n=n, r=r, m=metrics_sql("own", "jd", (10,), True))
        for n, r in [*[(n, f"SELECT query_id, lower(doc_id) AS doc_id, pos AS rank FROM hits WHERE list = {i}") for i, n in enumerate(fusion.LISTS)], ("fused", f"SELECT query_id, lower(doc_id) AS doc_id, rank FROM ({_FUSED})")]
    ),
    "latency_stats": "SELECT count(v) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM (SELECT (epoch_us(ingested_at) - epoch_us(hit_at)) / 1e6::DOUBLE AS v FROM es_hits)",
}
