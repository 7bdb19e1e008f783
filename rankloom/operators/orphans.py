"""Problem 7: references to records that do not exist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normal_id
from rankloom.session import written
from rankloom.sources.tables import table

#: simple: any null part and the reference counts as satisfied. partial: what
#: is given must match. full: all parts or none, a mix is an orphan.
SEMANTICS = ("simple", "partial", "full")


def orphans(refs: DataFrame, targets: DataFrame, keys: Mapping[str, str], semantics: str = "partial", valid: tuple[str, str, str] | None = None, never_null: Sequence[str] = (), share: int = 256) -> DataFrame:
    """The rows of ``refs`` that point to nothing in ``targets``, all columns kept.

    ``keys`` maps columns of ``refs`` to those of ``targets``; a key may have
    several parts, each of which may be null. References are grouped by which
    parts are null, and each group is anti-joined on its other parts, each as
    ``semantics`` says (see SEMANTICS). A reference without any part is none,
    and never an orphan. ``valid`` = (time in ``refs``, start, end in
    ``targets``) is one more part, the time, with a mask of its own: where it is
    set, a target matches only from its start on and before its end (null:
    open); where it is null, it is left out whatever the ``semantics``. Parts
    named in ``never_null`` are known to be set, which spares their masks.

    Targets are made unique per group first (the earliest start, the latest
    end), so no reference is doubled. Hot keys, with 1/``share`` of the
    references or more, are at most ``share`` and looked up by a broadcast of
    as many target rows; the others shuffle. Repeated references stay repeated.
    Empty tables: no references, no orphans; no targets, all are.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown semantics {semantics!r}")
    names = list(keys)
    found = []
    for mask in product((False, True), repeat=len(names)):  # True: the part is null
        given = [n for n, null in zip(names, mask, strict=True) if not null]
        if set(never_null) - set(given):
            continue
        own = refs.filter(reduce(lambda a, b: a & b, [F.col(n).isNull() if null else F.col(n).isNotNull() for n, null in zip(names, mask, strict=True)]))
        if not given or any(mask) and semantics == "simple":
            continue
        if any(mask) and semantics == "full":
            found.append(own)
            continue
        if valid:
            t = F.col(valid[0])
            found.append(_missing(own.filter(t.isNull()), targets, given, keys, None, share))
            own = own.filter(t.isNotNull())
        found.append(_missing(own, targets, given, keys, valid, share))
    if not found:
        return refs.limit(0)
    return reduce(DataFrame.unionByName, found)


def _missing(refs: DataFrame, targets: DataFrame, given: list[str], keys: Mapping[str, str], valid: tuple[str, str, str] | None, share: int) -> DataFrame:
    """The rows of ``refs`` without a target: anti-joins on the parts in ``given``, which are all set, and with ``valid`` on the time, also set."""
    here, there = [f"_k{i}" for i in range(len(given))], [f"_t{i}" for i in range(len(given))]
    parts = [F.col(keys[n]).alias(t) for n, t in zip(given, there, strict=True)]
    known = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in there])
    if valid:
        never = F.lit("9999-12-31").cast("timestamp_ntz").cast(targets.schema[valid[2]].dataType)
        ends = [F.min(valid[1]).alias("_from"), F.max(F.coalesce(F.col(valid[2]), never)).alias("_to")]
        unique = targets.groupBy(*parts).agg(*ends).filter(known)
    else:
        unique = targets.select(*parts).distinct().filter(known)
    mine = refs.withColumns({k: F.col(n) for n, k in zip(given, here, strict=True)})
    match: Column = reduce(lambda a, b: a & b, [F.col(k) == F.col(t) for k, t in zip(here, there, strict=True)])
    if valid:
        at = F.col(valid[0])
        match = match & (F.col("_from").isNull() | (at >= F.col("_from"))) & (at < F.col("_to"))
    total = mine.agg(F.count(F.lit(1)).alias("_all"))
    counted = mine.groupBy(*here).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total))
    hot = counted.filter(F.col("_n") * share >= F.col("_all")).select(*here)
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(t) for k, t in zip(here, there, strict=True)])
    hot_targets = F.broadcast(unique.join(F.broadcast(hot), same, "left_semi"))
    marked = mine.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), here, "left")
    lost = marked.filter("_hot").join(hot_targets, match, "left_anti").unionByName(marked.filter("_hot IS NULL").join(unique, match, "left_anti"))
    return lost.select(*[F.col(f"`{c}`") for c in refs.columns])


def _refs(df: DataFrame, name: str, ref: str, id_of: Column, at: str) -> DataFrame:
    refs = df.select(F.lit(name).alias("ref_table"), F.col(ref).cast("bigint").alias("ref_id"), id_of.alias("doc_id"), F.col(at).alias("at"))
    return refs.withColumn("doc_id", normal_id("doc_id")).filter("doc_id IS NOT NULL")


def _versions(df: DataFrame, name: str, key: str, start: str, stop: str | None = None) -> DataFrame:
    """A row per version of a record: when it began, and whether it ended one."""
    end = F.col(stop) if stop else F.lit(None).cast(df.schema[start].dataType)
    return df.select(F.lit(name).alias("ref_table"), normal_id(F.col(key).cast("string")).alias("id"), F.col(start).alias("start"), end.alias("end")).filter("id IS NOT NULL")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of qrels, beir_qrels and labels that point to nothing at their time.

    All three tables are one set of references with a two-part key, the
    referring table and the id; ids compare trimmed and in lower case.
    """
    exploded = F.explode(F.array_distinct(F.coalesce(F.col("relevant_doc_ids"), F.array().cast("array<string>"))))
    refs = (
        _refs(table(spark, sf_dir, "qrels"), "qrels", "qrel_id", exploded, "judged_at")
        .unionByName(_refs(table(spark, sf_dir, "beir_qrels"), "beir_qrels", "judgment_id", F.col("corpus_id"), "judged_at"))
        .unionByName(_refs(table(spark, sf_dir, "labels"), "labels", "label_id", F.col("doc_id").cast("string"), "labelled_at"))
        .distinct()
    )
    versions = (
        _versions(table(spark, sf_dir, "pg_documents"), "qrels", "doc_id", "updated_at", "deleted_at")
        .unionByName(_versions(table(spark, sf_dir, "beir_corpus"), "beir_qrels", "_id", "loaded_at"))
        .unionByName(_versions(table(spark, sf_dir, "documents"), "labels", "doc_id", "added_at"))
    )
    targets = (
        versions.groupBy("ref_table", "id")
        .agg(F.min("start").alias("start"), F.max(F.struct("start", "end")).alias("_last"))
        .select("ref_table", "id", "start", F.col("_last.end").alias("end"))
    )
    refs, targets = written(refs, "refs"), written(targets, "targets")  # read by both masks, for hot keys and for the rest
    lost = orphans(refs, targets, {"ref_table": "ref_table", "doc_id": "id"}, "partial", ("at", "start", "end"), never_null=("ref_table", "doc_id"))
    return lost.select("ref_table", "ref_id", "doc_id", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("period")).distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month: references, and distinct ids."""
    found = p7_found(spark, sf_dir)
    return found.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("doc_id").alias("n_ids"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}

_NORM = "nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
_P7 = f"""
  WITH refs AS (
    SELECT 'qrels' AS ref_table, qrel_id AS ref_id, {_NORM.format(c="x")} AS doc_id, judged_at AS at
    FROM (SELECT qrel_id, judged_at, unnest(relevant_doc_ids) AS x FROM qrels)
    UNION ALL SELECT 'beir_qrels', judgment_id, {_NORM.format(c="corpus_id")}, judged_at FROM beir_qrels
    UNION ALL SELECT 'labels', label_id, CAST(doc_id AS VARCHAR), labelled_at FROM labels),
  targets AS (
    SELECT 'qrels' AS ref_table, id, min(updated_at) AS start, arg_max(struct_pack(d := deleted_at), updated_at).d AS stop
    FROM (SELECT {_NORM.format(c="doc_id")} AS id, updated_at, deleted_at FROM pg_documents) GROUP BY id
    UNION ALL SELECT 'beir_qrels', {_NORM.format(c="_id")}, min(loaded_at), NULL FROM beir_corpus GROUP BY 2
    UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), min(added_at), NULL FROM documents GROUP BY 2),
  found AS (
    SELECT DISTINCT r.ref_table, r.ref_id, r.doc_id, coalesce(strftime(r.at, '%Y-%m'), '') AS period
    FROM refs r LEFT JOIN targets t ON r.ref_table = t.ref_table AND r.doc_id = t.id
    WHERE r.doc_id IS NOT NULL AND (t.id IS NULL OR coalesce(r.at < t.start OR r.at >= t.stop, false)))
"""
SQL = {
    "p7_found": _P7 + "SELECT * FROM found",
    "p7_report": _P7 + "SELECT ref_table, period, count(*) AS n_refs, count(DISTINCT doc_id) AS n_ids FROM found GROUP BY ALL",
}
