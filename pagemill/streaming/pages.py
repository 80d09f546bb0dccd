"""A stream of pages: facts, exactly-once tables and event-time counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.extract import extract_many


def page_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Pages from parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_facts(pages: DataFrame, kinds: list[str], target: str, checkpoint: str, url: str | None = None) -> StreamingQuery:
    """Append one table per kind under ``target``; a batch that is run again replaces its own rows.

    Each batch is parsed once and written under its number, so the hand-off may repeat but the
    tables hold each batch once.
    """

    def batch(df: DataFrame, n: int) -> None:
        facts = extract_many(df, kinds, url=url).persist()
        for k in kinds:
            facts.select("page_id", F.explode(k).alias("r")).select("page_id", "r.*").write.mode("overwrite").parquet(f"{target}/{k}/batch={n}")
        facts.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_handler(pages: DataFrame, handler: Callable, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Rows that a user's function makes of each batch of pages (pandas in, pandas out), appended to ``target``."""
    return pages.mapInPandas(handler, schema).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def upsert(rows: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write the result of a stream to ``target``, each batch in the place of the last one ('complete') or after it ('append')."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    return rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(pages: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Pages per window and status of a stream (or a table), late deliveries awaited for ``late``."""
    p = pages.withWatermark("stored_at", late) if pages.isStreaming else pages
    return p.groupBy(F.window("stored_at", window), "status").agg(F.count("*").alias("pages")).select(F.col("window.start").alias("start"), "status", "pages")


def first_deliveries(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without repeated deliveries of a record that come within ``late``."""
    return pages.withWatermark("stored_at", late).dropDuplicatesWithinWatermark(["page_id"])
