"""Documents that arrive as a stream, kept as current records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.sinks import positive_terms, upsert


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", version: str = "updated_at", once: bool = True) -> StreamingQuery:
    """Upserts each batch of a stream of documents into the table at ``path``; read it by :func:`rankloom.sources.sinks.read_upserted`.

    Within a batch the latest version counts; a batch may be repeated after a
    failure without changing the result. Versions older than what the table
    holds are dropped, so late rows don't undo newer ones.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = positive_terms(batch) if "splade_terms" in batch.columns else batch
        upsert(batch.sparkSession, path, rows, key, version, newer_only=True)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 day", late: str = "14 days") -> DataFrame:
    """Rows per group and window of a stream; windows close ``late`` after their end."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", group, "n")
