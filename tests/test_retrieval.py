"""Hand-computed cases of retrieval, fusion, reranking, evaluation, graph and prompts."""

from __future__ import annotations

from math import log2

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import blocks, dense, evaluate, fusion, graph, rag, rerank, sparse
from rankloom.plans.pipeline import HashedEncoder, HybridRetriever, LexicalEncoder, ModelDenseEncoder, ModelSparseEncoder, Settings, encode_sparse_with, query_prefix
from rankloom.session import scratch_path

LISTS = "query_id string, list int, pos int, doc_id string, score double, content string"
HITS = "query_id string, doc_id string, rank int, score double"


def lists(spark, *each):
    return spark.createDataFrame([("q", i, p, d, float(s), c) for i, one in enumerate(each) for p, (d, s, c) in enumerate(one, 1)], LISTS)


def ranked(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("query_id", "rank").collect()]


def test_floor_normalisation(spark):
    got = {r.doc_id: r.norm for r in fusion.normalize(lists(spark, [("a", 10, ""), ("b", 5, ""), ("c", 1, "")])).collect()}
    assert got["a"] == 1.0 and got["b"] == pytest.approx(0.5) and got["c"] == pytest.approx(0.1)
    assert [r.norm for r in fusion.normalize(lists(spark, [("a", 2, ""), ("b", 2, "")])).collect()] == [1.0, 1.0]
    low = {r.doc_id: r.norm for r in fusion.normalize(lists(spark, [("a", 0.4, ""), ("b", -0.1, ""), ("c", -0.8, "")])).collect()}
    assert low["a"] > low["b"] > low["c"] > 0


def test_linear_fusion_prefers_retrieved_to_absent(spark):
    two = lists(spark, [("absent", 9, ""), ("d2", 8.5, ""), ("d1", 8, "")], [("d1", 0.95, ""), ("d2", 0.4, "")])
    got = ranked(fusion.fuse(two, "linear", {0: 0.5, 1: 0.5}), "doc_id")
    assert got[0] == "d1" and got.index("d1") < got.index("absent")


def test_rrf_values_and_ties(spark):
    both = lists(spark, [("d1", 9, "")], [("d1", 1, "")])
    assert fusion.fuse(both, "rrf", {0: 1.0, 1: 1.0}).first().score == pytest.approx(2 / 61, abs=1e-9)
    assert fusion.fuse(both, "rrf", {0: 0.4, 1: 0.4}).first().score == pytest.approx(0.8 / 61, abs=1e-9)
    mirrored = lists(spark, [("z", 3, ""), ("m", 2, ""), ("a", 1, "")], [("a", 3, ""), ("m", 2, ""), ("z", 1, "")])
    rows = fusion.fuse(mirrored, "rrf", {0: 1.0, 1: 1.0}).orderBy("rank").collect()
    assert rows[0].doc_id == "z" and rows[0].score == rows[1].score and rows[1].doc_id == "a"  # first appearance


def test_weight_zero_still_brings_rows_and_unknown_strategy_fails(spark):
    got = {r.doc_id: r.score for r in fusion.fuse(lists(spark, [("a", 1, "")], [("b", 1, "")]), "linear", {0: 1.0, 1: 0.0}).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    with pytest.raises(ValueError, match="Unknown fusion strategy"):
        fusion.fuse(lists(spark, [("a", 1, "")]), "bogus", {0: 1.0})


def test_content_of_the_last_list_that_has_one(spark):
    got = fusion.contents(lists(spark, [("a", 1, "sparse"), ("b", 1, "")], [("a", 1, "dense"), ("b", 1, "")], [("a", 1, "")]))
    assert {r.doc_id: r.content for r in got.collect()} == {"a": "dense", "b": ""}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.floats(-5, 5)), max_size=6), st.lists(st.tuples(st.sampled_from("abcdefg"), st.floats(-5, 5)), max_size=6))
def test_fused_documents_are_the_union(spark, one, two):
    df = lists(spark, [(d, s, "") for d, s in one], [(d, s, "") for d, s in two])
    rows = fusion.fuse(df, "linear", {0: 0.4, 1: 0.6}).orderBy("rank").collect()
    assert {r.doc_id for r in rows} == {d for d, _ in one + two}
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))


def head(spark, scores):
    hits = spark.createDataFrame([("q", f"d{i}", i + 1, 1.0 - i / 100) for i in range(len(scores))], HITS)
    return hits, spark.createDataFrame([("q", f"d{i}", float(s)) for i, s in enumerate(scores)], "query_id string, doc_id string, rerank_score double")


def test_blend_limits_and_stability(spark):
    assert ranked(rerank.rerank_blend(*head(spark, [1, 5, 3]), weight=1.0), "doc_id") == ["d1", "d2", "d0"]
    assert ranked(rerank.rerank_blend(*head(spark, [1, 5, 3]), weight=0.0), "doc_id") == ["d0", "d1", "d2"]
    assert ranked(rerank.rerank_blend(*head(spark, [0, 1, 2, 3]), weight=0.5), "doc_id")[0] == "d0"
    assert "d19" in ranked(rerank.rerank_blend(*head(spark, [0] * 19 + [99]), weight=0.7), "doc_id")[:5]


def test_tail_stays_below_the_head(spark):
    rows = rerank.rerank_blend(*head(spark, [1, 2, 3, 9, 9, 9]), top_n=3).orderBy("rank").collect()
    assert len(rows) == 6 and [r.doc_id for r in rows[3:]] == ["d3", "d4", "d5"]
    assert max(r.score for r in rows[3:]) < min(r.score for r in rows[:3]) and rows[3].rerank_score is None
    assert rerank.rerank_blend(*head(spark, [1, 2, 3]), top_k=0).count() == 3


def test_scorer_sees_the_shortlist_only(spark):
    hits, _ = head(spark, [1, 2, 3, 4])
    docs = spark.createDataFrame([(f"d{i}", "x " * i) for i in range(9)], "doc_id string, content string")
    queries = spark.createDataFrame([("q", "x")], "query_id string, text string")
    got = rerank.model_scores(hits.filter("rank <= 2"), queries, docs, lambda q, c: c.str.len().astype(float))
    assert sorted(r.doc_id for r in got.collect()) == ["d0", "d1"]


def judged(spark, rows):
    return spark.createDataFrame(rows, "query_id string, doc_id string, grade int")


def measures(spark, hits, rows, k, exponential=False):
    df = spark.createDataFrame([("q", d, r) for r, d in enumerate(hits, 1)], "query_id string, doc_id string, rank int")
    return evaluate.per_query(df, judged(spark, rows), (k,), exponential).first()


def test_measures(spark):
    assert measures(spark, ["d1", "x", "d2"], [("q", "d1", 1), ("q", "d2", 1)], 2).recall == 0.5
    got = measures(spark, ["a", "b"], [("q", "a", 1), ("q", "b", 3)], 10, True).ndcg
    assert got == pytest.approx((1 / log2(2) + 7 / log2(3)) / (7 / log2(2) + 1 / log2(3)))
    assert measures(spark, ["a"], [("q", "a", 1), ("q", "b", 1), ("q", "c", 1)], 1).ndcg == 1.0
    assert measures(spark, ["x", "y", "a"], [("q", "a", 1)], 3).mrr == pytest.approx(1 / 3)
    assert measures(spark, ["x"], [("q", "a", 1)], 3).mrr == 0.0


def test_run_is_ranked_by_score_and_missing_queries_count(spark):
    run = spark.createDataFrame([("q", "d2", 10.0), ("q", "d1", 5.0), ("other", "d1", 1.0)], "query_id string, doc_id string, score double")
    got = {(r.metric, r.k): r.value for r in evaluate.evaluate_run(run, judged(spark, [("q", "d1", 1)]), (10,)).collect()}
    assert got["ndcg", 10] == pytest.approx(1 / log2(3), abs=1e-5) and got["mrr", 10] == 0.5
    two = {(r.metric, r.k): r.value for r in evaluate.evaluate_run(run, judged(spark, [("q", "d2", 1), ("gone", "d2", 1)]), (10,)).collect()}
    assert two["ndcg", 10] == 0.5
    tied = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0)], "query_id string, doc_id string, score double")
    assert [r.doc_id for r in evaluate.run_ranks(tied).orderBy("rank").collect()] == ["b", "a"]


def test_missing_policies_report_and_best_setting(spark):
    hits = spark.createDataFrame([("q", "a", 1)], "query_id string, doc_id string, rank int")
    both = judged(spark, [("q", "a", 1), ("gone", "a", 1)])
    assert evaluate.evaluate_lists(hits, both, (5,)).first().ndcg == 1.0
    assert evaluate.evaluate_lists(hits, both, (5,), skip_missing=False).first().ndcg == 0.5
    assert evaluate.small_sample(both)
    assert evaluate.format_table([]) == "(no results)"
    assert evaluate.format_table([{"system": "b", "ndcg@10": 0.1}, {"system": "a", "ndcg@10": 0.2}]).splitlines()[1].startswith("a")
    rows = spark.createDataFrame([(0.5, 0.7), (0.2, 0.7), (0.1, 0.6)], "w double, ndcg double")
    assert evaluate.best_setting(rows, ["w"]).first().w == 0.2


POST = "doc_id string, term string, weight double"
TERMS = "query_id string, term string, weight double"


def test_sparse_search(spark):
    postings = spark.createDataFrame([("d1", "1", 2.0), ("d1", "2", 1.0), ("d2", "2", 3.0), ("d3", "5", 1.0)], POST)
    one = sparse.top_k_dot(postings, spark.createDataFrame([("q", "2", 1.0)], TERMS), 10)
    assert ranked(one, "doc_id", "score") == [("d2", 3.0), ("d1", 1.0)]
    two = sparse.top_k_dot(postings, spark.createDataFrame([("q", "1", 1.0), ("q", "2", 1.0)], TERMS), 10)
    assert ranked(two, "doc_id", "score") == [("d1", 3.0), ("d2", 3.0)]
    assert sparse.top_k_dot(postings, spark.createDataFrame([], TERMS), 10).count() == 0
    assert sparse.top_k_dot(postings, spark.createDataFrame([("q", "2", -1.0), ("q", None, 1.0)], TERMS), 10).count() == 0


def test_frequent_terms_change_nothing(spark):
    rows = [(f"d{i:03}", "all", 1.0 + i % 7) for i in range(200)] + [(f"d{i:03}", "rare", 2.0) for i in range(0, 200, 31)] + [(f"d{i:03}", "half", 0.5) for i in range(100)]
    postings = spark.createDataFrame(rows, POST)
    terms = spark.createDataFrame([("q1", "all", 1.0), ("q1", "rare", 3.0), ("q2", "all", 1.0), ("q2", "half", 2.0), ("q3", "rare", 1.0), ("q4", "all", 1.0)], TERMS)
    want = sparse.rank_hits(sparse.dot_scores(postings, terms), 7)
    assert sorted(map(tuple, sparse.top_k_dot(postings, terms, 7).collect())) == sorted(map(tuple, want.collect()))


def test_encoder_pieces(spark):
    logits = spark.createDataFrame([("d", 0, "a", 1.0, 1), ("d", 1, "a", 3.0, 1), ("d", 2, "a", 9.0, 0), ("d", 0, "b", -1.0, 1), ("d", 0, "[CLS]", 5.0, 1)], "doc_id string, position int, term string, logit double, mask int")
    rows = sparse.pool_logits(logits, spark.createDataFrame([("[CLS]",)], "term string")).collect()
    assert [(r.doc_id, r.term) for r in rows] == [("d", "a")] and rows[0].weight == pytest.approx(1.3862943611)
    post = spark.createDataFrame([("d", "a", 10.0), ("d", "b", 5.0)], POST)
    assert {r.term: r.weight for r in sparse.quantize(post, sparse.global_max(post)).collect()} == {"a": 255.0, "b": 127.0}
    assert sparse.global_max(post.limit(0)).first().global_max == 1.0
    assert spark.range(1).select(sparse.hashed_dimension(F.lit("retrieval")).alias("h")).first().h == 4600
    vocab = spark.createDataFrame([("a", 3), ("b", 99)], "term string, idx int")
    by_id = sparse.vocabulary_postings(post, vocab, 10)
    assert [tuple(r) for r in by_id.collect()] == [("d", 3, 10.0)]
    assert [tuple(r) for r in sparse.vocabulary_terms(by_id, vocab).collect()] == [("d", "a", 10.0)]
    assert {r.weight for r in sparse.unit_length(post.withColumn("weight", F.lit(0.0)), "doc_id").collect()} == {0.0}


def test_models_encode_in_batches(spark):
    words = ["[CLS]", "red", "green", "blue"]

    def forward(texts):  # a position per word, the last one is padding
        n = max(len(t.split()) for t in texts) + 1
        logits, mask = np.full((len(texts), n, 4), -1.0), np.zeros((len(texts), n))
        for i, t in enumerate(texts):
            for j, w in enumerate(t.split()):
                logits[i, j, words.index(w)], logits[i, j, 0], mask[i, j] = 1.0 + j, 9.0, 1
            logits[i, -1] = 50.0
        return logits, mask

    docs = spark.createDataFrame([("a", "red green"), ("b", "blue red red"), ("n", None)], "doc_id string, content string")
    queries = spark.createDataFrame([("q", "green"), ("e", "")], "query_id string, text string")
    rows = {(r.doc_id, r.term): r.weight for r in encode_sparse_with(docs, "doc_id", "content", forward, words, [0], 2, 2).collect()}
    assert rows == {("a", "green"): pytest.approx(np.log(3)), ("a", "red"): pytest.approx(np.log(2)), ("b", "red"): pytest.approx(np.log(4)), ("b", "blue"): pytest.approx(np.log(2))}
    encoder = ModelSparseEncoder(forward, words, [0], quantize=True)
    assert [r.weight for r in encoder.queries(queries).collect()] == [pytest.approx(np.log(2))]  # not known yet
    got = {(r.doc_id, r.term): r.weight for r in encoder.documents(docs).collect()}
    assert got["b", "red"] == 255 and got["a", "green"] == int(np.log(3) / np.log(4) * 255)
    assert [r.weight for r in encoder.queries(queries).collect()] == [int(np.log(2) / np.log(4) * 255)]

    dense_model = ModelDenseEncoder(lambda texts: [[len(t), 1.0] for t in texts], 2, "query: ", 1)
    assert dense_model.documents(docs).filter("doc_id = 'n'").first().embedding == [0.0, 1.0]
    assert dense_model.queries(queries).filter("query_id = 'e'").first().embedding == pytest.approx([7 / 50**0.5, 1 / 50**0.5])
    with pytest.raises(Exception, match="the model gave"):
        ModelDenseEncoder(lambda texts: [[1.0]] * len(texts), 2).documents(docs).collect()
    found = HybridRetriever(encoder, dense_model, None, Settings(top_k=2)).index(docs).search(queries, all_stages=True)
    assert found.filter("stage = 'sparse' AND query_id = 'q'").first().doc_id == "a"
    bad = spark.createDataFrame([("a", [1.0])], "doc_id string, embedding array<float>")
    with pytest.raises(ValueError, match="has 1 elements"):
        dense.store_vectors(bad, scratch_path(spark, "v"), "doc_id", "embedding", 2)


def test_batches_of_queries_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(f"d{i:03}", f"t{t}", float(rng.integers(1, 5))) for i in range(150) for t in rng.choice(20, 5, replace=False)]
    post = spark.createDataFrame(rows, POST)
    terms = spark.createDataFrame([(f"q{q}", f"t{t}", 1.0) for q in range(30) for t in rng.choice(20, 3, replace=False)], TERMS)
    stored = blocks.store_blocks(blocks.posting_blocks(post))
    want = sorted(map(tuple, sparse.rank_hits(sparse.dot_scores(post, terms), 6).collect()))
    for size in (None, 7):
        assert sorted(map(tuple, sparse.rank_hits(blocks.top_k_blocks(stored, terms, 6, sparse.DIGITS, size=size), 6).collect())) == want
    x = rng.normal(size=(300, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    one, many = (sorted(map(tuple, dense.exact_topk(v, dense.asking(v), 5, "vec_id", "vec_id", "embedding", 4, size=s).collect())) for s in (None, 1))
    assert one == many and len(one) == 15
    assert sparse.top_k_dot(post.limit(0), terms, 5).count() == 0
    texts = spark.createDataFrame([("a", "x x y"), ("b", None), ("c", ""), (None, "x")], "doc_id string, content string")
    hits = sparse.bm25_topk_of(texts, spark.createDataFrame([("q", "x", 1.0)], TERMS), 5).collect()
    assert [(r.doc_id, r.score) for r in hits] == [("a", round(float(np.log(1 + 2.5 / 1.5)) * 2 / 3.2, 6))]


def test_match_all_without_positive_terms(spark):
    docs = spark.createDataFrame([("b",), ("a",), ("c",)], "doc_id string")
    queries = spark.createDataFrame([("q", "?!"), ("p", "x")], "query_id string, text string")
    got = sparse.match_all(docs, queries, spark.createDataFrame([("p", "x", 1.0)], TERMS), 2)
    assert ranked(got, "query_id", "doc_id", "score") == [("q", "a", 1.0), ("q", "b", 1.0)]


def test_dense_search(spark):
    docs = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.0, 1.0]), ("d3", [0.70710678, 0.70710678]), ("n", None), ("bad", [1.0]), ("nan", [float("nan"), 1.0])], "doc_id string, v array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<float>")
    rows = dense.exact_topk(docs, asked, 99, "doc_id", "query_id", "v", 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == [("d1", 1.0), ("d3", 0.70711), ("d2", 0.0)]
    assert dense.exact_topk(docs.limit(0), asked, 3, "doc_id", "query_id", "v", 2).count() == 0
    with pytest.raises(ValueError, match="index type"):
        dense.build_index("bogus", docs, "doc_id", "v", 2)
    assert dense.build_index("Flat", docs, "doc_id", "v", 2) is None


def test_more_ties_than_k_go_by_id(spark):
    docs = spark.createDataFrame([(f"d{i:04}", [0.6, 0.8]) for i in reversed(range(600))] + [("best", [1.0, 0.0])], "doc_id string, v array<float>").coalesce(1)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<float>")
    got = ranked(dense.exact_topk(docs, asked, 5, "doc_id", "query_id", "v", 2), "doc_id")
    assert got == ["best", "d0000", "d0001", "d0002", "d0003"]


def test_cells_find_most_of_the_exact_neighbours(spark):
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test data")
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    exact = {(r.query_id, r.doc_id) for r in dense.exact_topk(v, dense.asking(v), 10, "vec_id", "vec_id", "embedding", 64).collect()}
    for kind, least in (("IVFFlat", 0.85), ("IVFPQ", 0.6)):
        got = dense.build_index(kind, v, "vec_id", "embedding", 64, 16).search(dense.asking(v), "vec_id", "embedding", 10, 10)
        assert len(exact & {(r.query_id, r.doc_id) for r in got.collect()}) >= least * len(exact)


@pytest.mark.parametrize("name", ["ivf_topk", "pq_topk"])
def test_registered_cells_find_the_exact_neighbours_of_vectors_of_any_length(spark, name):
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test data")
    v = dense.written(dense.passages(spark, str(DATA)), "passages")
    exact = {(r.query_id, r.doc_id) for r in dense.exact_topk(v, dense.asking(v), 10, "vec_id", "vec_id", "embedding", 64).collect()}
    got = {(r.query_id, r.doc_id) for r in dense.QUERIES[name](spark, str(DATA)).collect()}
    assert len(exact & got) >= 0.9 * len(exact)


@pytest.mark.parametrize("kind", ["IVFFlat", "IVFPQ"])
def test_cells_meet_large_vectors_with_the_default_probes(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) * np.where(rng.random(3000) < 0.03, rng.uniform(2, 40, 3000), 1)[:, None]
    x = x.astype(np.float32)
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in dense.build_index(kind, docs, "vec_id", "embedding", 8).search(dense.asking(docs), "vec_id", "embedding", 10).collect():
        got.setdefault(int(r.query_id), {})[r.rank] = r.score
    s = x[::100].astype(float) @ x.astype(float).T
    for i, row in enumerate(s):
        assert [got[i * 100][r] for r in range(1, 11)] == pytest.approx(np.sort(row)[::-1][:10].tolist(), abs=1e-4)


def test_graph(spark):
    post = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.6), ("b", "x", 0.8), ("b", "y", 0.7), ("c", "y", 0.5), ("c", "z", 0.4)], POST)
    g = graph.edges(post)
    assert g.count() == 5
    links = {(r.src, r.dst): r.weight for r in graph.doc_edges(g, 1).collect()}
    assert links == {("a", "b"): 1.4, ("b", "a"): 1.4, ("a", "c"): 0.5, ("c", "a"): 0.5}
    terms = spark.createDataFrame([("q", "x", 1.0)], TERMS)
    got = dict(ranked(graph.hop_scores(g, graph.doc_edges(g, 1), terms), "doc_id", "score"))
    assert got == {"a": pytest.approx(1.0 + 0.5 * 0.8 * 1.4), "b": pytest.approx(0.8 + 0.5 * 1.4), "c": pytest.approx(0.25)}
    only = graph.hop_scores(g, graph.doc_edges(g, 1), terms, allowed=spark.createDataFrame([("c",)], "doc_id string"))
    assert ranked(only, "doc_id") == ["c"]
    assert tuple(graph.stats(post, g, graph.doc_edges(g, 1)).first()) == (5, 5, 3, 2)


def test_whole_graph_against_brute_force(spark, monkeypatch):
    from collections import defaultdict

    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test data")
    monkeypatch.setattr(graph, "GRAPH_BLOCK", 40)
    monkeypatch.setattr(graph, "GRAPH_ROWS", 16)
    docs = defaultdict(dict)
    g = graph._graph(spark, str(DATA))
    for r in g.collect():
        docs[r.doc_id][r.term] = r.weight
    chosen = set()
    for a in docs:
        near = [(-round(sum(min(w, docs[b][t]) for t, w in docs[a].items() if t in docs[b]), 6), b) for b in docs if b != a and docs[a].keys() & docs[b].keys()]
        chosen |= {frozenset((a, b)) for _, b in sorted(near)[:50]}
    assert {frozenset((r.src, r.dst)) for r in graph.doc_edges(g).collect()} == chosen
    row = graph.QUERIES["graph_stats"](spark, str(DATA)).first()
    assert row.doc_edges == len(chosen)
    links = graph.neighbours(g).unionByName(graph.neighbours(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()
    terms = graph.D.query_tokens(graph.D.judged_queries(spark, str(DATA), graph.D.binary(spark, str(DATA))))
    want = graph.hop_scores(g, links, terms, k=20)
    got = graph.QUERIES["graph_score"](spark, str(DATA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    each = sc.statusStore().executorList(True)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_graph_score_moves_no_row_for_a_query_and_a_neighbour(spark, monkeypatch):
    post = spark.createDataFrame([(f"d{i:03}", t, 0.5 + i % 97 / 100) for i in range(600) for t in ("hot", f"t{i % 50}")], POST)
    terms = spark.createDataFrame([(f"q{i:03}", t, 1.0 + i % 3) for i in range(200) for t in ("hot", f"t{i % 50}")], TERMS)
    monkeypatch.setattr(graph, "GRAPH_BLOCK", 150)
    monkeypatch.setattr(graph, "_graph", lambda *_: post)
    for name in ("binary", "judged_queries"):
        monkeypatch.setattr(graph.D, name, lambda *_: None)
    monkeypatch.setattr(graph.D, "query_tokens", lambda *_: terms)
    before = shuffled(spark)
    got = graph.QUERIES["graph_score"](spark, "").collect()
    moved = shuffled(spark) - before
    assert sorted(map(tuple, got)) == sorted(map(tuple, graph.hop_scores(post, graph.doc_edges(post), terms, k=20).collect()))
    assert moved < 1_500_000


def test_graph_allowed_moves_no_row_for_a_query_and_a_neighbour(spark, monkeypatch):
    post = spark.createDataFrame([(f"d{i:03}", t, 0.5 + i % 97 / 100) for i in range(600) for t in ("hot", f"t{i % 50}")], POST)
    terms = spark.createDataFrame([(f"q{i:03}", t, 1.0 + i % 3) for i in range(200) for t in ("hot", f"t{i % 50}")], TERMS)
    monkeypatch.setattr(graph, "GRAPH_BLOCK", 150)
    monkeypatch.setattr(graph, "_graph", lambda *_: post)
    for name in ("binary", "judged_queries"):
        monkeypatch.setattr(graph.D, name, lambda *_: None)
    monkeypatch.setattr(graph.D, "sparse_postings", lambda *_: post)
    monkeypatch.setattr(graph.D, "query_tokens", lambda *_: terms)
    before = shuffled(spark)
    got = graph.QUERIES["graph_allowed"](spark, "").collect()
    moved = shuffled(spark) - before
    allowed = graph.top_k_dot(post, terms, 10).select("query_id", "doc_id")
    want = graph.hop_scores(post, graph.doc_edges(post), terms, allowed=allowed, k=None)
    assert len(got) == 2_000 and sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert moved < 1_500_000


def test_context_budget(spark):
    hits = spark.createDataFrame([("q", "a", 1, " " + "x" * 30), ("q", "b", 2, "y" * 30), ("q", "c", 3, "z"), ("p", "a", 1, None)], "query_id string, doc_id string, rank int, content string")
    got = {r.query_id: r for r in rag.build_context(hits, 10).collect()}
    assert got["q"].context == "[Document 1]  " + "x" * 30 + "\n\n[Document 2]  " + "y" * 10 and got["q"].n_docs == 2
    assert got["p"].context == "[Document 1]  "
    asked = rag.prompts(rag.build_context(hits, 10), spark.createDataFrame([("q", "why?")], "query_id string, text string"))
    assert rag.answers(asked).first().answer.startswith(rag.NO_LLM)

    def broken(_):
        raise RuntimeError("down")

    assert rag.answers(asked, broken).first().answer == "[LLM error] down"


def test_hybrid_stages(spark):
    docs = spark.createDataFrame([("d1", "red apple pie"), ("d2", "green apple"), ("d3", "blue sky"), ("d4", None)], "doc_id string, content string")
    queries = spark.createDataFrame([("q", "apple pie")], "query_id string, text string")
    full = HybridRetriever(LexicalEncoder(), HashedEncoder(), rerank.coverage_scores, Settings(top_k=3)).index(docs)
    rows = full.search(queries, all_stages=True)
    assert {r.stage for r in rows.select("stage").distinct().collect()} == {"dense", "sparse", "hybrid", "hybrid+rerank"}
    assert full.search(queries).filter("rank = 1").first().doc_id == "d1"
    assert full.search(queries.limit(0)).count() == 0
    alone = HybridRetriever(LexicalEncoder()).index(docs).search(queries)
    assert {r.stage for r in alone.collect()} == {"sparse"} and alone.count() == 2
    with pytest.raises(ValueError):
        HybridRetriever()
    assert query_prefix("BAAI/bge-base") != "" and query_prefix("unknown") == ""


def test_registered_stages_keep_a_hundred_candidates(spark):
    from rankloom.plans.queries import hybrid_stages
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test data")
    docs = graph.D.corpus(spark, str(DATA)).count()
    got = hybrid_stages(spark, str(DATA)).groupBy("stage").agg(F.max("rank").alias("n")).collect()
    deepest = {r.stage: r.n for r in got}
    assert docs > 10 and deepest["dense"] == deepest["hybrid"] == deepest["hybrid+rerank"] == min(100, docs)
