"""Top n per group, leximin, nearest vectors, similar sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rankloom.llm import knn, leximin, setjoin
from rankloom.llm.topn import top_n_per_group

NAN = float("nan")


def test_top_n_per_group(spark):
    rows = [("q", "b", 5.0), ("q", "a", 5.0), ("q", "a", 9.0), ("q", "a", 9.0), ("q", "c", NAN), ("q", "d", None), ("q", None, 7.0), ("p", "z", -1.0), (None, "n", 1.0)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "rank string, doc_id string, s double, r int, i int")
    got = sorted(map(tuple, top_n_per_group(df, "rank", "doc_id", "s", 2).toDF("g", "i", "s", "r").collect()), key=str)
    assert got == [("p", "z", -1.0, 1), ("q", "a", 9.0, 1), ("q", "b", 5.0, 2), (None, "n", 1.0, 1)]
    assert top_n_per_group(df.limit(0), "rank", "doc_id", "s", 2).count() == 0


def test_top_n_prunes_before_and_after_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 g", "cast(id as string) i", "cast(id % 50 as double) s")
    plan = top_n_per_group(df, "g", "i", "s", 5)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


LIST = "array<struct<doc_id:string,score:double,content:string>>"


def test_leximin(spark):
    hits = lambda *p: [(d, s, None) for d, s in p]
    rows = [
        ("q", hits(("a", 900.0), ("b", 800.0), ("c", 1.0)), hits(("b", 0.9), ("c", 0.5), ("a", 0.1)), hits(("b", 3.0), ("a", 3.0), ("c", 3.0))),
        ("q", hits(("a", 900.0), ("b", 800.0), ("c", 1.0)), hits(("b", 0.9), ("c", 0.5), ("a", 0.1)), hits(("b", 3.0), ("a", 3.0), ("c", 3.0))),
        ("one", hits(("x", 1.0), ("x", 5.0), (None, 9.0), ("y", NAN), ("z", None)), None, []),
        ("none", None, None, None),
    ]
    df = spark.createDataFrame(rows, f"query_id string, l0 {LIST}, l1 {LIST}, l2 {LIST}")
    long = leximin.long_hits(df, "query_id", ["l0", "l1", "l2"])
    got = {(r.g, r.i): (r.rank, [round(x, 3) for x in r.shares]) for r in leximin.leximin_ranking(long, 3).collect()}
    assert got["q", "b"] == (1, [0.667, 1.0, 1.0]) and got["q", "a"] == (2, [0.333, 1.0, 1.0]) and got["q", "c"] == (3, [0.333, 0.667, 1.0])
    assert got["one", "x"] == (1, [0.0, 0.0, 1.0]) and len(got) == 4
    assert {r.g for r in leximin.leximin_ranking(long, 3, leximin.with_lists(df, "query_id", ["l0", "l1", "l2"], 2)).collect()} == {"q"}
    assert leximin.leximin_ranking(leximin.long_hits(df.limit(0), "query_id", ["l0", "l1", "l2"]), 3).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = knn.hilbert_key(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_nearest_vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 16))
    x = (np.repeat(centers, 20, axis=0) + 0.2 * rng.normal(size=(1200, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist(), 7), (None, x[1].tolist(), 7), (5000, None, 7), (5001, [0.0] * 16, 7), (5002, [NAN] * 16, 7), (5003, [1.0], 7), (5004, [None] * 16, 7)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>, key int")
    got = knn.nearest(df, "id", "v", k=5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {(i, j) for i in range(1200) for j in np.argsort(-s[i])[:5]}
    found = {(r.id, r.neighbour) for r in got}
    assert len(got) == 6000 and len(found & want) >= 0.95 * len(want)
    assert sorted(r["rank"] for r in got if r.id == 3) == [1, 2, 3, 4, 5]
    few = knn.nearest(df, "id", "v", k=5, least=0.9, query_every=100).collect()
    assert {r.id % 100 for r in few} == {0} and all(r.cosine >= 0.9 for r in few)
    assert knn.nearest(df.limit(0), "id", "v").count() == 0
    assert knn.nearest(df.filter("id = 5000"), "id", "v").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)], "id bigint, v array<float>")
    assert knn.nearest(same, "id", "v", k=3).groupBy("id").count().filter("count = 3").count() == 50


@pytest.mark.parametrize(("longest", "rows"), [(32_768, 64), (1, 64), (32_768, 16_384)])
def test_recall_holds_with_small_ranges_and_without_any_curve(spark, monkeypatch, longest, rows):
    monkeypatch.setattr(knn, "REACH", 16)
    monkeypatch.setattr(knn, "BLOCK", 32)
    monkeypatch.setattr(knn, "RANGE_ROWS", rows)
    monkeypatch.setattr(knn, "LONGEST", longest)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12)).astype(np.float32)  # hardly any neighbourhoods
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "id bigint, v array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[::10] @ unit.T
    s[np.arange(300), np.arange(300) * 10] = -2
    want = {(i * 10, int(j)) for i in range(300) for j in np.argsort(-s[i])[:5]}
    got = {(r.id, r.neighbour) for r in knn.nearest(df, "id", "v", k=5, query_every=10).collect()}
    assert len(got) == 1500 and len(got & want) >= (0.95 if longest > 1 else 0.999) * len(want)


def brute(sets, threshold):
    out = set()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and len(x & y) / len(x | y) >= threshold:
                out.add((a, b))
    return out


def test_similar_sets(spark):
    rnd = random.Random(3)
    sets = {}
    for g in range(60):
        base = {f"t{rnd.randrange(900)}" for _ in range(20)}
        for m in range(4):
            sets[f"d{g}_{m}"] = (base - set(rnd.sample(sorted(base), m))) | {f"x{rnd.randrange(99)}" for _ in range(m)}
    sets |= {f"copy{i}": set(sets["d0_0"]) for i in range(5)} | {"small1": {"a", "b"}, "small2": {"a", "b"}, "empty": set(), "one": {"a"}}
    rows = [(k, sorted(v) + sorted(v)[:1] + [None], "c") for k, v in sets.items()] + [("null", None, "c"), (None, ["a"], "c")]
    df = spark.createDataFrame(rows, "key string, terms array<string>, class string")
    joined = setjoin.SimilarSets(df, "key", "terms", 0.6)
    got = {tuple(r) for r in joined.expanded().collect()}
    assert got == brute(sets, 0.6)
    links = {r.key: r for r in joined.links().collect()}
    assert links["copy3"]["class"] == "copy0" and links["copy3"].n_links == sum("copy3" in p for p in got)
    assert "empty" not in links and "null" not in links
    assert setjoin.SimilarSets(df.limit(0), "key", "terms", 0.6).expanded().count() == 0


def test_long_runs_are_divided_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "RUN", 4)
    monkeypatch.setattr(setjoin, "HELD_ROWS", 100)
    rnd = random.Random(2)
    # a hot prefix: 40 sets of which any two share 18 of 30 terms, beside smaller groups
    sets = {f"h{i:02}": {f"hot{t}" for t in range(18)} | {f"own{i}_{t}" for t in range(6)} for i in range(40)}
    sets |= {f"g{g}_{i}": {f"group{g}_{t}" for t in range(20)} | {f"own{g}_{i}_{rnd.random()}"} for g in range(10) for i in range(5)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "key string, terms array<string>")
    want = brute(sets, 0.6)
    got = {tuple(r) for r in setjoin.SimilarSets(df, "key", "terms", 0.6).expanded().collect()}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 780


def test_samples_of_one_sketch_are_counted_as_such():
    for depth in (3, 6, 12):
        n = setjoin.orders_for(depth, 0.6)
        rng = np.random.default_rng(depth)
        m = rng.binomial(setjoin.SKETCH, 0.8, 3000)
        m = m[m >= setjoin.least_bits(0.6)]
        chance = np.prod([(m - i) / (setjoin.SKETCH - i) for i in range(depth)], axis=0)
        assert np.mean(1 - (1 - chance) ** n) >= setjoin.RUN_RECALL - 0.0005 and n >= setjoin.trees_for(0.8**depth, 0.9)


def test_trees_follow_the_threshold():
    assert setjoin.trees_for(0.6**3) == 36 or 30 < setjoin.trees_for(0.6**3) < 40
    assert setjoin.depth_of(10) == 3 and setjoin.depth_of(10**9) > 4
    assert setjoin.trees_for(1.0) == 1


def test_terms_of(spark):
    df = spark.createDataFrame([({" A\t": 1.0, "a": 2.0, "b": 0.0, "c": -1.0, "d": NAN, "  ": 3.0, "e": None},), (None,), ({},)], "m map<string,double>")
    from pyspark.sql import functions as F

    assert [sorted(set(r.t or [])) for r in df.select(setjoin.terms_of(F.col("m")).alias("t")).collect()] == [["a"], [], []]


if __name__ == "__main__":
    pytest.main([__file__])
