"""Files, tables, references, streams and jobs."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from rankloom import jobs, schemas
from rankloom.functions.text import normal_id, render_document, strip, tokens
from rankloom.operators.orphans import orphans
from rankloom.operators.records import current_records, skew_safe_left_join
from rankloom.plans.pipeline import HashedEncoder, LexicalEncoder
from rankloom.session import drop_scratch, path_exists, written
from rankloom.sources import files, sinks
from rankloom.streaming.ingest import ingest, windowed_counts
from rankloom.utils import peak_memory_mb, stopwatch


def write(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_text_functions(spark):
    df = spark.createDataFrame([(" T\t", " body\r\n"), (None, " b "), ("x", None), (None, None)], "t string, b string")
    assert [r.r for r in df.select(render_document("t", "b").alias("r")).collect()] == ["T body", "b", "x", ""]
    one = spark.createDataFrame([("  Ab-C1 é\t",), ("  ",), (None,)], "x string")
    assert [tuple(r) for r in one.select(strip("x"), normal_id("x"), tokens("x")).collect()] == [("Ab-C1 é", "ab-c1 é", ["ab", "c1", "é"]), ("", None, []), (None, None, None)]


def test_current_records(spark):
    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 2, None, 0), ("a", 2, "y", 0), ("b", None, "z", 0), (None, 1, "q", 0)], "k string, v int, c string, _row int")
    assert sorted(map(tuple, current_records(df, "k", ["v"], ["c"]).collect())) == [("a", "y"), ("b", "z")]
    assert current_records(df.limit(0), "k", ["v"], ["c"]).count() == 0


def test_skew_safe_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k5", 2)], "k string, w int")
    got = skew_safe_left_join(left, right, "k", 4)
    assert got.count() == 1001 and got.filter("w = 1").count() == 900 and got.filter("w = 2").count() == 1


REFS = "a string, b string, at int, from_ int"


@pytest.mark.parametrize(("semantics", "want"), [("simple", {1}), ("partial", {1, 4}), ("full", {1, 2, 4})])
def test_orphans_with_partial_nulls(spark, semantics, want):
    refs = spark.createDataFrame([("x", "y", 0), ("x", "?", 1), ("x", None, 2), (None, None, 3), (None, "?", 4), ("x", "y", 0)], "a string, b string, n int")
    targets = spark.createDataFrame([("x", "y", 9), ("x", "y", 9), (None, "z", 9)], "a string, b string, n int")
    assert {r.n for r in orphans(refs, targets, {"a": "a", "b": "b"}, semantics).collect()} == want


def test_orphans_in_time_and_on_hot_keys(spark):
    refs = spark.createDataFrame([("h", i % 40) for i in range(400)] + [("gone", 5), ("late", None), ("late", 1), ("late", 3)], "id string, at int")
    targets = spark.createDataFrame([("h", 10, 30), ("late", 2, None), ("late", 4, None)], "id string, s int, e int")
    kept = targets.select("id", targets.s.cast("timestamp_ltz").alias("s"), targets.e.cast("timestamp_ltz").alias("e"))
    got = orphans(refs.select("id", refs.at.cast("timestamp_ltz").alias("at")), kept, {"id": "id"}, "partial", ("at", "s", "e"))
    counts = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert counts == {"h": 200, "gone": 1, "late": 1}
    assert orphans(refs, targets.limit(0), {"id": "id"}).count() == 404
    assert orphans(refs.limit(0), targets, {"id": "id"}).count() == 0
    with pytest.raises(ValueError):
        orphans(refs, targets, {"id": "id"}, "bogus")


def test_a_null_time_has_a_mask_of_its_own(spark):
    refs = spark.createDataFrame([("t", "h", 5), ("t", "h", None), ("t", "gone", None), ("t", "late", 1), ("t", None, 1)] + [("t", "h", 20)] * 50, "src string, id string, at int")
    targets = spark.createDataFrame([("t", "h", 10, 30), ("t", "late", 2, None)], "src string, id string, s int, e int")
    stamp = lambda df, *c: df.withColumns({x: df[x].cast("timestamp_ltz") for x in c})
    got = orphans(stamp(refs, "at"), stamp(targets, "s", "e"), {"src": "src", "id": "id"}, "simple", ("at", "s", "e"))
    assert sorted((r.id, r.at is None) for r in got.collect()) == [("gone", True), ("h", False), ("late", False)]


def test_json_lines(spark, tmp_path):
    docs = write(tmp_path / "d.jsonl", {"doc_id": 7, "content": "seven"}, "", {"doc_id": "a", "content": None}, {"doc_id": "b"})
    assert [tuple(r) for r in files.read_documents(spark, docs, 2).collect()] == [("7", "seven"), ("a", None)]
    qrels = write(tmp_path / "q.jsonl", {"query_id": "q", "relevant_doc_ids": ["x"]}, {"query_id": "q", "relevant_doc_ids": ["a", "b", "a"]})
    assert sorted(r.doc_id for r in files.read_binary_qrels(spark, qrels).collect()) == ["a", "b"]
    sparse = write(tmp_path / "s.jsonl", {"doc_id": "a", "splade_terms": {"x": 1.5}})
    assert files.read_sparse(spark, sparse).first().splade_terms == {"x": 1.5}
    (tmp_path / "c.yaml").write_text("a: {b: 1}\n")
    assert files.load_config(str(tmp_path / "c.yaml"))["a"]["b"] == 1


def beir(tmp_path):
    root = tmp_path / "beir" / "tiny"
    (root / "qrels").mkdir(parents=True)
    corpus = [{"_id": f"d{i}", "title": "", "text": f"word{i} shared text"} for i in range(6)]
    write(root / "corpus.jsonl", *corpus, {"_id": "d0", "title": "T", "text": "word0 again"})
    write(root / "queries.jsonl", {"_id": "q1", "text": "word0"}, {"_id": "q2", "text": "word5"}, {"_id": "q3", "text": "x"})
    write(root / "qrels" / "test.tsv", "query-id\tcorpus-id\tscore", "q1\td0\t2", "q2\td5\t1", "q2\td1\t0", "broken\tline", "q1\td3\tx")
    return root


def test_beir_folder(spark, tmp_path):
    root = str(beir(tmp_path))
    data = files.read_beir(spark, root)
    assert sorted(map(tuple, data["qrels"].collect())) == [("q1", "d0", 2), ("q2", "d5", 1)]
    assert sorted(r.query_id for r in data["queries"].collect()) == ["q1", "q2"]
    assert data["docs"].filter("doc_id = 'd0'").first().text == "word0 again"
    assert sorted(r.doc_id for r in files.read_beir(spark, root, cap=2)["docs"].collect()) == ["d0", "d1", "d5"]
    with pytest.raises(FileNotFoundError, match="test"):
        files.read_beir(spark, root, "dev")
    with pytest.raises(FileNotFoundError):
        files.read_beir(spark, str(tmp_path))


def test_jobs(spark, tmp_path):
    root = beir(tmp_path)
    out = tmp_path / "report.json"
    assert jobs.main(["beir", "--folder", str(root.parent), "--datasets", "tiny", "missing", "--out", str(out), "--top-k", "5"], spark) == 0
    report = json.loads(out.read_text())
    assert {m["system"] for m in report["metrics"]} == {"dense", "sparse", "hybrid", "hybrid+rerank"}
    assert jobs.main(["beir", "--folder", str(root.parent), "--datasets", "missing"], spark) == 1
    with pytest.raises(SystemExit):
        jobs.main(["beir", "--no-dense", "--no-sparse"], spark)


def test_index_query_evaluate_tune(spark, tmp_path, monkeypatch):
    words = ["apple", "pear", "plum", "fig", "kiwi", "lime"]
    docs = write(tmp_path / "docs.jsonl", *[{"doc_id": f"d{i}", "content": f"{w} {w} tree number {i}"} for i, w in enumerate(words)], {"doc_id": "none", "content": None})
    idx, res, log = (str(tmp_path / n) for n in ("idx", "res", "log"))
    assert jobs.main(["index", "--documents", docs, "--out", idx], spark) == 0
    assert json.loads(spark.read.text(f"{idx}/stats").first().value)["doc_count"] == 7

    assert files.read_sparse(spark, f"{idx}/sparse").filter("doc_id = 'd1'").first().splade_terms["pear"] > 0

    def gone(*_):
        raise AssertionError("documents are encoded once")

    with monkeypatch.context() as m:
        m.setattr(LexicalEncoder, "documents", gone)
        m.setattr(HashedEncoder, "documents", gone)
        queries = write(tmp_path / "q.jsonl", *[{"query_id": f"q{i}", "text": w} for i, w in enumerate(words)], {"query_id": "bare", "text": "?!"})
        assert jobs.main(["query", "--index", idx, "--queries", queries, "--rag", "--out", res], spark) == 0
    rows = {r.query_id: r for r in files.read_results(spark, res).collect()}
    for system in schemas.SYSTEMS:
        assert rows["q2"][system][0].doc_id == "d2" and rows["q2"][system][0].content.startswith("plum"), system
    answer = rows["q2"].rag
    assert answer.answer.startswith("[NO LLM]") and "plum" in answer.context and answer.question == "plum" and answer.retrieved_docs[0].doc_id == "d2"
    assert [h.doc_id for h in rows["bare"].es_hybrid][:2] == ["d0", "d1"] and not rows["bare"].es_bm25  # without a term all match alike
    qrels = write(tmp_path / "j.jsonl", *[{"query_id": f"q{i}", "relevant_doc_ids": [f"d{i}"]} for i in range(6)])
    assert jobs.main(["evaluate", "--results", res, "--qrels", qrels, "--log", log], spark) == 0
    logged = {r.system: r for r in spark.read.option("header", True).csv(log).collect()}
    assert set(logged) == set(schemas.SYSTEMS) and all(float(r.ndcg_at_10) == 1.0 for r in logged.values())

    root, out = beir(tmp_path), tmp_path / "tuned.json"
    (tmp_path / "c.yaml").write_text("top-k: 5\n")
    assert jobs.main(["tune", "--folder", str(root), "--config", str(tmp_path / "c.yaml"), "--out", str(out)], spark) == 0
    report = json.loads(out.read_text())
    assert report["config"]["best"] in report["metrics"][0] and len(report["metrics"][0]) == 3 + 2 * 8
    assert report["config"]["ndcg@10"] == max(v for k, v in report["metrics"][0].items() if k != "dataset")
    assert jobs.main(["tune-blend", "--folder", str(root.parent), "--datasets", "tiny", "--out", str(out)], spark) == 0
    assert "first_stage" in json.loads(out.read_text())["metrics"][0]
    assert jobs.main(["benchmark", "--documents", docs, "--index", idx, "--samples", "1", "--out", str(out)], spark) == 0
    assert {r["variant"] for r in json.loads(out.read_text())["metrics"]} == {"encode", "query"}
    (tmp_path / "bad.yaml").write_text("bogus: 1\n")
    with pytest.raises(SystemExit):
        jobs.main(["tune", "--config", str(tmp_path / "bad.yaml")], spark)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "doc_id string, v int, c string")
    sinks.create_table(rows(("a", 3, "y"), ("b", 1, "w")), path)
    assert sinks.index_stats(spark, path)["doc_count"] == 2 and sinks.path_size_mb(spark, path) > 0
    sinks.create_table(rows(("z", 1, "")), path, replace=False)
    assert spark.read.parquet(path).count() == 2
    sinks.log_experiment(spark, str(tmp_path / "log"), system="sparse", mrr=0.5)
    sinks.log_experiment(spark, str(tmp_path / "log"), system="dense")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        sinks.log_experiment(spark, str(tmp_path / "log"), bogus=1)
    maps = spark.createDataFrame([("a", {"x": 1.0, "y": 0.0, "z": -1.0})], "doc_id string, splade_terms map<string,double>")
    assert sinks.positive_terms(maps).first().splade_terms == {"x": 1.0}
    sinks.write_sparse(maps, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).columns == ["doc_id", "splade_terms"]


@pytest.mark.parametrize("step", ["merged", "_publish", "_sweep"])
def test_upsert_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "doc_id string, v int, c string")
    held = lambda: sorted(map(tuple, sinks.read_upserted(spark, path).collect()))
    assert sinks.read_upserted(spark, path) is None
    sinks.upsert(spark, path, rows(("a", 1, "x"), ("a", 1, "x"), (None, 1, "n"), ("b", 1, "w")), "doc_id", "v", 4)
    assert held() == [("a", 1, "x"), ("b", 1, "w")]

    def crash(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, step, crash)
        with pytest.raises(OSError):
            sinks.upsert(spark, path, rows(("a", 2, "y"), ("c", 1, "c")), "doc_id", "v")
    assert held() == [("a", 1, "x"), ("b", 1, "w")]
    sinks.upsert(spark, path, rows(("c", 1, "c")), "doc_id", "v")
    sinks.upsert(spark, path, rows(("d", 1, "d"), ("a", 5, "m"), ("a", 5, "z"), ("a", 5, "k")), "doc_id", "v")
    assert held() == [("a", 5, "z"), ("b", 1, "w"), ("c", 1, "c"), ("d", 1, "d")]  # of equal versions the greatest row
    sinks.upsert(spark, path, rows(("a", 4, "late")), "doc_id", "v", newer_only=True)
    sinks.upsert(spark, path, rows().limit(0), "doc_id", "v")
    assert ("a", 5, "z") in held() and len(list((tmp_path / "t").glob("rows-*"))) <= 8


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, spark.range(200).selectExpr("cast(id as string) k", "1 v"), "k", "v", 8)
    before = sinks._manifest(spark, path)[1]["buckets"]
    sinks.upsert(spark, path, spark.createDataFrame([("7", 2)], "k string, v int"), "k", "v")
    after = sinks._manifest(spark, path)[1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and sinks.read_upserted(spark, path).count() == 200


def test_stream(spark, tmp_path):
    schema = "doc_id string, updated_at timestamp, c string"
    for i, r in enumerate([("a", "2024-01-02 00:00:00", "new"), ("a", "2024-01-01 00:00:00", "late"), ("b", "2024-01-01 00:00:00", "b")]):
        spark.createDataFrame([r], "doc_id string, updated_at string, c string").selectExpr("doc_id", "cast(updated_at as timestamp) updated_at", "c").write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        assert i == 0 or sinks.read_upserted(spark, str(tmp_path / "out")).filter("doc_id = 'a'").first().c == "new"
    assert sinks.read_upserted(spark, str(tmp_path / "out")).count() == 2
    counted = windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "updated_at", "doc_id")
    assert counted.isStreaming


def test_utils(spark, tmp_path):
    took = {}
    for _ in range(2):
        with stopwatch(took, "x") as so_far:
            assert so_far() >= 0
    assert took["x"] >= 0 and peak_memory_mb() > 0
    table = written(spark.range(3), "t")
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    assert path_exists(spark, path)
    drop_scratch(spark)
    assert not path_exists(spark, path)


def test_only_the_subpackage_itself_may_be_missing(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for lost, fine in (("rankloom.llm.catalog", True), ("regex", False)):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, lost, None)
            for name in [n for n in sys.modules if n.startswith("rankloom.llm") and n != lost]:
                m.delitem(sys.modules, name)
            if fine:
                assert not any(n.startswith("p1_") for n in importlib.reload(entry).queries())
            elif (Path(__file__).parents[1] / "rankloom" / "llm").exists():
                with pytest.raises(ModuleNotFoundError):
                    importlib.reload(entry)
    importlib.reload(entry)
