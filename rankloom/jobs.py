"""python -m rankloom.jobs beir|index|query|evaluate|tune|tune-blend|benchmark ...: the jobs that a cluster runs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.functions.text import render_document
from rankloom.operators import evaluate, fusion, rerank
from rankloom.operators.rerank import coverage_scores
from rankloom.plans import saved
from rankloom.plans.pipeline import HashedEncoder, HybridRetriever, LexicalEncoder, Settings, query_prefix
from rankloom.session import build_session, drop_scratch, written
from rankloom.sources import files, sinks
from rankloom.utils import peak_memory_mb, stopwatch

log = logging.getLogger("rankloom")
#: Scorers that can be tuned, by name; a cluster adds its models here.
SCORERS = {"coverage": coverage_scores}


def retriever(a: argparse.Namespace) -> HybridRetriever:
    """Branches and settings by the flags."""
    settings = Settings(top_k=a.top_k, strategy=a.strategy, alpha=a.alpha, beta=a.beta, blend_weight=a.blend_weight, rerank_n=a.rerank_n or None)
    return HybridRetriever(None if a.no_sparse else LexicalEncoder(), None if a.no_dense else HashedEncoder(prefix=query_prefix(a.dense_model)), None if a.no_rerank else coverage_scores, settings)


def run_dataset(spark: SparkSession, folder: str, a: argparse.Namespace) -> list[dict]:
    """Metrics of every stage on one data set."""
    data = files.read_beir(spark, folder, a.split, a.max_corpus)
    queries = data["queries"]
    if a.max_queries:
        queries = queries.orderBy("line").limit(a.max_queries)
    judged = data["qrels"].join(queries.select("query_id"), "query_id", "left_semi")
    hits = written(retriever(a).index(data["docs"]).search(queries, all_stages=True).select("stage", "query_id", "doc_id", "score"), "stages")
    ranked = evaluate.run_ranks(hits, ["stage"])
    rows = evaluate.evaluate_grouped(ranked, judged, "stage", hits.select("stage").distinct(), evaluate.CUTOFFS, exponential=False)
    out: dict[str, dict] = {}
    for r in rows.collect():  # at most four stages, six cut-offs
        out.setdefault(r.stage, {"system": r.stage}).update({f"{m}@{r.k}": round(r[m], 5) for m in ("ndcg", "recall", "map", "precision", "mrr")})
    return [out[stage] for stage in sorted(out)]


def beir(spark: SparkSession, a: argparse.Namespace) -> int:
    """Each data set on its own; one that fails doesn't stop the others. 1 if none succeeded."""
    done: dict[str, list[dict]] = {}
    timings: dict[str, float] = {}
    for name in a.datasets:
        try:
            with stopwatch(timings, name):
                done[name] = run_dataset(spark, f"{a.folder}/{name}", a)
            log.info("%s\n%s", name, evaluate.format_table(done[name], ("ndcg@10", "recall@100", "map@100", "mrr@10")))
        except Exception:
            log.exception("%s failed", name)
    if not done:
        return 1
    systems = sorted({m["system"] for rows in done.values() for m in rows})
    found = {s: [m["ndcg@10"] for rows in done.values() for m in rows if m["system"] == s] for s in systems}
    average = [{"system": s, "ndcg@10": sum(v) / len(v)} for s, v in found.items()]
    log.info("average\n%s", evaluate.format_table(average))
    if a.out:
        sinks.write_report(a.out, vars(a), timings, [{"dataset": n} | m for n, rows in done.items() for m in rows])
    return 0


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    """Builds an index that ``query`` loads; logs sizes and seconds, and keeps them beside it."""
    docs = files.read_documents(spark, a.documents, a.max_docs)
    took = saved.build(docs, a.out, None if a.no_sparse else LexicalEncoder(), None if a.no_dense else HashedEncoder())
    stats = {"seconds": took, "size_mb": sinks.path_size_mb(spark, a.out), "memory_mb": peak_memory_mb()} | sinks.index_stats(spark, f"{a.out}/documents")
    spark.createDataFrame([(json.dumps(stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/stats")
    log.info("%s", stats)
    return 0


def query(spark: SparkSession, a: argparse.Namespace) -> int:
    """All systems over a saved index; with ``--rag`` an answer per query. ``evaluate`` reads what it writes."""
    queries = spark.createDataFrame([("q0", a.query)], "query_id string, text string") if a.query else files.read_queries(spark, a.queries)
    found = saved.SavedIndex(spark, a.index)
    weights = {0: a.alpha, 1: a.beta, 2: a.gamma}
    encoders = (None if a.no_sparse else LexicalEncoder(), None if a.no_dense else HashedEncoder(prefix=query_prefix(a.dense_model)))
    hits = written(found.search(queries, *encoders, a.top_k, a.strategy, weights), "hits")
    sinks.write_results(hits, queries, a.out, answers=saved.rag_answers(hits, queries) if a.rag else None)
    return 0


def evaluate_results(spark: SparkSession, a: argparse.Namespace) -> int:
    """The measures of every system in a file of results, in one plan; a row each in the experiment log."""
    judged = files.read_binary_qrels(spark, a.qrels)
    if evaluate.small_sample(judged):
        log.warning("fewer than %d judged queries: averages mean little", evaluate.SMALL_SAMPLE)
    lists = fusion.nested_lists(files.read_results(spark, a.results), schemas.SYSTEMS)
    name = F.element_at(F.array(*map(F.lit, schemas.SYSTEMS)), F.col("list") + 1)
    ranked = written(lists.select(name.alias("system"), "query_id", "doc_id", F.col("pos").alias("rank")), "ranked")
    rows: dict[str, dict] = {}
    for r in evaluate.evaluate_grouped(ranked, judged, "system").collect():  # at most seven systems, three cut-offs
        rows.setdefault(r.system, {"system": r.system, "mrr": r.mrr}).update({f"{m}@{r.k}": r[m] for m in ("ndcg", "recall")})
    log.info("\n%s", evaluate.format_table(list(rows.values()), ("ndcg@10", "recall@10", "mrr")))
    if a.log:
        for m in rows.values():
            recall = {f"recall_at_{k}": m[f"recall@{k}"] for k in (5, 10, 20)}
            sinks.log_experiment(spark, a.log, experiment="retrieval_comparison", system=m["system"], variant="default", ndcg_at_10=m["ndcg@10"], mrr=m["mrr"], **recall)
    return 0


def _setting_scores(spark: SparkSession, swept: DataFrame, judgments: DataFrame, names: Sequence[str]) -> DataFrame:
    """setting, ndcg at 10 of query_id, doc_id, rank by setting: every judged query counts. In the order of ``names``."""
    order = spark.createDataFrame(list(enumerate(names)), "i int, setting string")
    rows = evaluate.evaluate_grouped(swept, judgments, "setting", order, (10,), exponential=False)
    return order.join(rows.select("setting", "ndcg"), "setting").select("i", "setting", F.round("ndcg", 6).alias("ndcg"))


def _tuned(spark: SparkSession, a: argparse.Namespace, sweep) -> int:
    """Runs ``sweep`` on each data set, logs the average of every setting, the best first, and writes all as JSON."""
    done: dict[str, dict[str, float]] = {}
    order: list[str] = []
    for name in a.datasets or [""]:
        scores = sorted(sweep(spark, files.read_beir(spark, f"{a.folder}/{name}".rstrip("/"), a.split), a).collect(), key=lambda r: r.i)
        done[name or "data"] = {r.setting: r.ndcg for r in scores}
        order = [r.setting for r in scores]
    average = {s: sum(d[s] for d in done.values()) / len(done) for s in order}
    best = max(order, key=lambda s: average[s])  # of equal ones the first
    log.info("best setting: %s\n%s", best, evaluate.format_table([{"system": s, "ndcg@10": v} for s, v in average.items()]))
    if a.out:
        sinks.write_report(a.out, {"folder": a.folder, "best": best, "ndcg@10": average[best]}, {}, [{"dataset": n, **d} for n, d in done.items()])
    return 0


def _fusion_sweep(spark: SparkSession, data: dict[str, DataFrame], a: argparse.Namespace) -> DataFrame:
    a.no_rerank = True
    hits = written(retriever(a).index(data["docs"]).search(data["queries"], all_stages=True).select("stage", "query_id", "doc_id", "rank", "score"), "stages")
    part = lambda n, i: hits.filter(F.col("stage") == n).select("query_id", F.lit(i).alias("list"), F.col("rank").alias("pos"), "doc_id", "score", F.lit("").alias("content"))
    lists = reduce(DataFrame.unionByName, [part(n, i) for i, n in enumerate(("sparse", "dense"))])
    named = fusion.fusion_sweep(lists, fusion.ALPHAS, a.top_k).select(F.format_string("%s a=%.1f", "strategy", "alpha").alias("setting"), "query_id", "doc_id", "rank")
    alone = hits.filter("stage IN ('sparse', 'dense')").select(F.concat("stage", F.lit("_only")).alias("setting"), "query_id", "doc_id", "rank")
    names = ["dense_only", "sparse_only", *(f"{s} a={x:.1f}" for s in fusion.STRATEGIES for x in fusion.ALPHAS)]
    return _setting_scores(spark, named.unionByName(alone), data["qrels"], names)


def tune(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fusion settings over both branches, retrieved once."""
    return _tuned(spark, a, _fusion_sweep)


def _blend_sweep(spark: SparkSession, data: dict[str, DataFrame], a: argparse.Namespace) -> DataFrame:
    a.no_rerank = True
    first = written(retriever(a).index(data["docs"]).search(data["queries"]).select("query_id", "doc_id", "rank", "score"), "first")
    docs = data["docs"].select("doc_id", render_document("title", "text").alias("content"))
    rows, names = first.select(F.lit("first_stage").alias("setting"), "query_id", "doc_id", "rank"), ["first_stage"]
    for scorer in a.scorers:  # each scores the pairs once, whatever the number of weights
        swept = rerank.blend_sweep(first, SCORERS[scorer](first, data["queries"], docs), rerank.BLEND_WEIGHTS)
        rows = rows.unionByName(swept.select(F.format_string(scorer + "@%.2f", "weight").alias("setting"), "query_id", "doc_id", "rank"))
        names += [f"{scorer}@{w:.2f}" for w in rerank.BLEND_WEIGHTS]
    return _setting_scores(spark, rows, data["qrels"], names)


def tune_blend(spark: SparkSession, a: argparse.Namespace) -> int:
    """Blend weights of one or several rerankers over the same first stage."""
    return _tuned(spark, a, _blend_sweep)


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    """Documents a second of each encoder, latency of single queries over a saved index, and its size; a row each in the experiment log."""
    docs = files.read_documents(spark, a.documents, a.max_docs).cache()
    n, rows = docs.count(), []
    for name, encoder in (("sparse", LexicalEncoder()), ("dense", HashedEncoder())):
        took: dict[str, float] = {}
        with stopwatch(took, "all"):
            encoder.documents(docs).write.format("noop").mode("overwrite").save()
        rows.append({"system": name, "variant": "encode", "indexing_time_s": took["all"], "docs_per_sec": n / took["all"]})
    if a.index:
        found, latencies = saved.SavedIndex(spark, a.index), []
        for r in docs.filter("content IS NOT NULL").orderBy("doc_id").limit(a.samples).collect():
            began = time.perf_counter()
            one = spark.createDataFrame([("q", " ".join(r.content.split()[:12]))], "query_id string, text string")
            found.search(one, LexicalEncoder(), HashedEncoder(), a.top_k).filter("system = 'hybrid_fused'").count()
            latencies.append(((time.perf_counter() - began) * 1e3,))
        if latencies:
            of = evaluate.latency_summary(spark.createDataFrame(latencies, "ms double"), F.col("ms")).first()
            rows.append({"system": "index", "variant": "query", "query_latency_ms": of["mean"], "index_size_mb": sinks.path_size_mb(spark, a.index), "notes": f"p50 {of.p50} p95 {of.p95}"})
    docs.unpersist()
    for r in rows:
        log.info("%s", r)
        if a.log:
            sinks.log_experiment(spark, a.log, experiment="benchmark", memory_usage_mb=peak_memory_mb(), **r)
    if a.out:
        sinks.write_report(a.out, {"documents": n}, {}, rows)
    return 0


JOBS = {"beir": beir, "index": index, "query": query, "evaluate": evaluate_results, "tune": tune, "tune-blend": tune_blend, "benchmark": benchmark}
#: The options of each job, beside the common ones.
OPTIONS = {
    "beir": ("folder", "datasets", "split", "max-corpus", "max-queries", "out"),
    "index": ("documents", "max-docs", "out"),
    "query": ("index", "queries", "query", "rag", "out"),
    "evaluate": ("results", "qrels", "log"),
    "tune": ("folder", "datasets", "split", "out"),
    "tune-blend": ("folder", "datasets", "split", "scorers", "out"),
    "benchmark": ("documents", "max-docs", "index", "samples", "log", "out"),
}
_KINDS = {
    "split": {"default": "test"},
    "rag": {"action": "store_true"},
    "samples": {"type": int, "default": 20},
    "scorers": {"nargs": "+", "choices": sorted(SCORERS), "default": sorted(SCORERS)},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom")
    sub = p.add_subparsers(dest="job", required=True)
    for job, names in OPTIONS.items():
        s = sub.add_parser(job)
        s.add_argument("--config", default="", help="a YAML file whose keys are options; what the command line sets wins")
        for name in names:
            kind = {"type": int, "default": 0} if name.startswith("max-") else {"default": ""}
            if name == "datasets":
                kind = {"nargs": "*", "default": list(files.DEFAULT_SUBSET) if job == "beir" else []}
            s.add_argument(f"--{name}", **_KINDS.get(name, kind))
        s.add_argument("--top-k", type=int, default=10 if job == "query" else 100)
        s.add_argument("--strategy", choices=fusion.STRATEGIES, default="rrf" if job == "query" else "linear")
        s.add_argument("--alpha", type=float, default=0.4)
        s.add_argument("--beta", type=float, default=0.4 if job == "query" else None, help="1 - alpha where not given")
        s.add_argument("--gamma", type=float, default=0.2)
        s.add_argument("--blend-weight", type=float, default=0.3)
        s.add_argument("--rerank-n", type=int, default=0)
        s.add_argument("--dense-model", default="")
        for flag in ("--no-dense", "--no-sparse", "--no-rerank"):
            s.add_argument(flag, action="store_true")
    return p


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    """The command line over the configuration file over the defaults."""
    p = parser()
    a = p.parse_args(argv)
    if a.config:
        known = {k.replace("-", "_"): v for k, v in files.load_config(a.config).items()}
        if unknown := set(known) - set(vars(a)):
            raise SystemExit(f"unknown options in {a.config}: {sorted(unknown)}")
        sub = next(x for x in p._actions if isinstance(x, argparse._SubParsersAction)).choices[a.job]
        sub.set_defaults(**known)
        a = p.parse_args(argv)
    if a.beta is None:
        a.beta = 1 - a.alpha
    return a


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    if a.no_dense and a.no_sparse:
        raise SystemExit("--no-dense and --no-sparse leave nothing to search")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    spark = spark or build_session()
    try:
        return JOBS[a.job](spark, a)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    sys.exit(main())
