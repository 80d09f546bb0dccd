"""Streaming queries, run to the end of what their tables hold now, with the SQL of the whole table."""

from pyspark.sql import functions as F

from pagemill.session import load, new_folder
from pagemill.streaming import pages as P


def _stream(spark, d, name: str):
    """A table of a folder as a stream; the table is one file or a folder of files."""
    schema = load(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    try:
        files = spark.read.format("binaryFile").load(f"{d}/{name}.parquet").select("path").limit(1).count()
        single = files and spark.read.format("binaryFile").load(f"{d}/{name}.parquet").select("path").first()[0].endswith(f"/{name}.parquet")
    except Exception:  # a folder of partitions has no files of its own
        single = False
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d) if single else reader.parquet(f"{d}/{name}.parquet")


def streamed_hourly_status(spark, d):
    """Pages per hour and status, counted by event time."""
    out, check = new_folder(spark), new_folder(spark)
    counts = P.status_counts(_stream(spark, d, "crawl_pages").where("stored_at is not null").withColumn("stored_at", F.col("stored_at").cast("timestamp")))
    P.upsert(counts, out, check, "complete").awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "status", "pages")


def streamed_deliveries(spark, d):
    """Records without the repeated deliveries of a week."""
    out, check = new_folder(spark), new_folder(spark)
    first = P.first_deliveries(_stream(spark, d, "crawl_pages").where("stored_at is not null and page_id is not null").withColumn("stored_at", F.col("stored_at").cast("timestamp")))
    first.select("page_id", "status").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("page_id bigint, status string").parquet(out).select("page_id")


def streamed_outlines(spark, d):
    """Headings of cached pages, one table per kind of fact."""
    out, check = new_folder(spark), new_folder(spark)
    P.stream_facts(_stream(spark, d, "http_cache").select("page_id", "html"), ["outline"], out, check).awaitTermination()
    return spark.read.parquet(f"{out}/outline").drop("batch")


QUERIES = {f.__name__: f for f in (streamed_hourly_status, streamed_deliveries, streamed_outlines)}
SQL = {
    "streamed_hourly_status": "SELECT strftime(date_trunc('hour', stored_at), '%Y-%m-%d %H:%M:%S') AS hour, status, count(*) AS pages FROM crawl_pages WHERE stored_at IS NOT NULL GROUP BY 1, 2",
    "streamed_deliveries": "SELECT DISTINCT page_id FROM crawl_pages WHERE stored_at IS NOT NULL AND page_id IS NOT NULL",
}
