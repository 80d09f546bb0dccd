"""Processing only new or changed records, exactly once, across failing runs.

The log of deliveries is read through a *bounded watermark*: a run fixes its
upper limit (its own start) before it reads, handles every commit in
``[watermark, upper)`` and publishes output and watermark in one atomic step.
A failed run publishes nothing, so the next run covers the same interval again.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def first_deliveries(pages: DataFrame) -> DataFrame:
    """Success records, one per ``page_id``, as first delivered.

    Repeated deliveries collapse to the earliest ``stored_at``; ties are settled by the
    other compared columns, so repeated rows give one row. Null ``page_id`` or null
    ``stored_at`` rows can't be ordered in the log and are left out.
    """
    cols = ["stored_at", "started", "url", "response_changed", "entity_tag", "last_modified"]
    return (
        pages.where((F.col("status") == "Success") & F.col("page_id").isNotNull() & F.col("stored_at").isNotNull())
        .groupBy("page_id")
        .agg(F.min(F.struct(*cols)).alias("r"))
        .select("page_id", *[F.col(f"r.{c}").alias(c) for c in cols])
    )


def strong_tag(tag: Column) -> Column:
    """Entity tag without the weak prefix; null when absent or blank."""
    t = F.regexp_replace(F.trim(tag), "^W/", "")
    return F.when(t != "", t)


def with_previous(rows: DataFrame, key: str, order: list[str], carry: list[str], bucket: Column) -> DataFrame:
    """The previous row of the same key, without ever sorting a whole key in one task.

    A key's rows are cut into ordered ``bucket``s; inside a bucket a window gives the previous
    row, and the first row of a bucket takes the last row of the nearest earlier bucket, found
    on one row per (key, bucket). A key with a third of all rows thus spreads over its buckets.
    """
    r = rows.withColumn("_b", bucket)
    inner = Window.partitionBy(key, "_b").orderBy(*order)
    r = r.withColumn("_p", F.lag(F.struct(*carry)).over(inner))
    last = r.groupBy(key, "_b").agg(F.max(F.struct(*order, *[c for c in carry if c not in order])).alias("_l"))
    last = last.select(
        F.col(key).alias("_k"), F.col("_b").alias("_c"), F.lag(F.struct(*[F.col(f"_l.{c}").alias(c) for c in carry])).over(Window.partitionBy(key).orderBy("_b")).alias("_q")
    ).where("_q is not null")
    j = r.join(last, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")), "left")
    return j.select(*rows.columns, F.coalesce("_p", "_q").alias("previous"))


def changed_records(pages: DataFrame) -> DataFrame:
    """New or changed Success records with ``page_id, url, stored_at, reason``.

    A record is compared with the previous one of its url by (started, page_id):
    ``response_changed`` decides if not null, else both entity tags apart from ``W/``,
    else both modification dates; with none of these it counts as changed. A null url
    has no previous record: each such record is new. Null ``started`` orders first.
    """
    r = first_deliveries(pages)
    known = r.where(F.col("url").isNotNull())
    # Days, and within records without a start ranges of ids, which order as the records do.
    bucket = F.struct(F.date_trunc("day", "started").alias("day"), F.when(F.col("started").isNull(), F.expr("page_id div 65536")).alias("range"))
    p = with_previous(known, "url", ["started", "page_id"], ["page_id", "entity_tag", "last_modified"], bucket)
    a, b = strong_tag(F.col("entity_tag")), strong_tag(F.col("previous.entity_tag"))
    p = p.withColumn(
        "reason",
        F.when(F.col("previous").isNull(), "new")
        .when(F.col("response_changed").isNotNull(), F.when(F.col("response_changed"), "flag"))
        .when(a.isNotNull() & b.isNotNull(), F.when(a != b, "tag"))
        .when(
            F.col("last_modified").isNotNull() & F.col("previous.last_modified").isNotNull(),
            F.when(F.col("last_modified") != F.col("previous.last_modified"), "date"),
        )
        .otherwise("unknown"),
    )
    out = ["page_id", "url", "stored_at", "reason"]
    return p.where("reason is not null").select(*out).unionByName(r.where("url is null").withColumn("reason", F.lit("new")).select(*out))


def commit_windows(runs: DataFrame) -> DataFrame:
    """One half-open commit window ``[low, high)`` per succeeded attempt.

    ``high`` is the attempt's own start; ``low`` the start of the succeeded attempt before it
    (null for the first). Attempts without a start are left out; equal starts leave the later
    ids an empty window. Attempts are ordered month by month, never all in one task.
    """
    ok = runs.where((F.col("proc_state") == "succeeded") & F.col("started").isNotNull()).select("proc_id", "started").distinct()
    w = with_previous(ok.withColumn("_all", F.lit(1)), "_all", ["started", "proc_id"], ["started"], F.date_trunc("month", "started"))
    return w.select("proc_id", F.col("previous.started").alias("low"), F.col("started").alias("high"))


#: Parts of a day's records; windows are repeated for each.
PARTS = 16


def assign_windows(records: DataFrame, windows: DataFrame, at: str = "stored_at", key: str = "page_id") -> DataFrame:
    """Give each record the window that holds its commit time.

    An interval join by day and part of the day's records: windows are repeated for each day they
    touch, so it is an equi-join whatever the number of windows, and a day with most of all records
    is many tasks. The one window without a lower bound is the only row fetched; the records before
    its end are its own.
    """
    first = windows.where("low is null").agg(F.min(F.struct("high", "proc_id")).alias("f")).first()["f"]
    w = windows.where("low < high").select("proc_id", "low", "high", F.explode(F.sequence(F.to_date("low"), F.to_date("high"))).alias("_w"))
    w = w.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    r = records.withColumn("_d", F.to_date(at)).withColumn("_q", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    j = r.join(w, (F.col("_d") == F.col("_w")) & (F.col("_q") == F.col("_p")) & (F.col(at) >= F.col("low")) & (F.col(at) < F.col("high")), "left")
    owner = F.col("proc_id") if first is None else F.when(F.col(at) < F.lit(first["high"]), F.lit(first["proc_id"])).otherwise(F.col("proc_id"))
    return j.select(owner.alias("proc_id"), *records.columns).where("proc_id is not null")


def run_assignment(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """``proc_id, page_id``: what each succeeded attempt handles; together each record at most once."""
    return assign_windows(changed_records(pages), commit_windows(runs)).select("proc_id", "page_id").distinct()


def catch_up(job: IncrementalJob, pages: DataFrame, runs: DataFrame) -> dict | None:
    """One run of ``job`` that publishes what all succeeded attempts since its last one handle.

    The upper limit is the start of the last succeeded attempt, fixed before anything is read; only
    changes committed from the watermark up to it are handled, and the rows of all these attempts
    become visible with the new watermark in one step. None if no attempt is new.
    """
    windows = commit_windows(runs)
    upper = windows.agg(F.max("high").alias("h")).first()["h"]
    if upper is None or job.watermark() == str(upper):
        return None
    return job.run(changed_records(pages), "stored_at", upper, lambda part: assign_windows(part, windows).select("proc_id", "page_id").distinct())


class IncrementalJob:
    """Runs ``transform`` over the commits since the last successful run.

    State is a chain of manifest files ``_log/<n>.json`` in ``target``; a manifest names the
    output folder of its run and the upper limit reached. It is created whole and only if its
    name is free, by the file manager that streaming queries commit with: that is the only
    commit point. Before it nothing is visible, after it both output and watermark are. Of two runs
    with one number one publishes and the other raises. Every ``COMPACT`` manifests one holds all
    before it, so a run reads a bounded number of them, without a Spark job.

    The commit column must be a sequence that never falls: what is committed later must not be
    below an upper limit used before. Rows with a null commit are not committed yet and are never handled.
    """

    COMPACT = 20

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._log = self._path(f"{self.target}/_log")
        self._files = self._jvm.org.apache.spark.sql.execution.streaming.checkpointing.CheckpointFileManager.create(self._log, spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _read(self, name: str) -> dict:
        f = self._files.open(self._path(f"{self.target}/_log/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()

    def manifests(self) -> list[dict]:
        """All manifests, first run first."""
        if not self._files.exists(self._log):
            return []
        names = sorted(n for st in self._files.list(self._log) if re.fullmatch(r"\d{12}\.json", n := st.getPath().getName()))
        if not names:
            return []
        start = (len(names) - 1) // self.COMPACT * self.COMPACT
        late = [self._read(n) for n in names[start:]]
        return late[0].pop("before", []) + late

    def watermark(self):
        m = self.manifests()
        return m[-1]["upper"] if m else None

    def run(self, source: DataFrame, commit_col: str, upper, transform: Callable[[DataFrame], DataFrame]) -> dict:
        """Handle commits in ``[watermark, upper)``; raises, publishing nothing, when ``transform`` fails."""
        done = self.manifests()
        low = done[-1]["upper"] if done else None
        n = done[-1]["n"] + 1 if done else 0
        part = source.where(F.col(commit_col) < F.lit(upper))
        if low is not None:
            part = part.where(F.col(commit_col) >= F.lit(low).cast(source.schema[commit_col].dataType))
        folder = f"{self.target}/data/run-{n}-{uuid.uuid4().hex[:8]}"
        transform(part).write.parquet(folder)
        manifest = {"n": n, "low": low, "upper": str(upper), "folder": folder}
        self._publish(manifest, {"before": done} if n % self.COMPACT == 0 else {})
        return manifest

    def _publish(self, manifest: dict, more: dict) -> None:
        if not self._files.exists(self._log):
            self._files.mkdirs(self._log)
        stream = self._files.createAtomic(self._path(f"{self.target}/_log/{manifest['n']:012d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(manifest | more).encode()))
            stream.close()
        except Py4JJavaError as e:
            stream.cancel()
            raise RuntimeError(f"run {manifest['n']} was published by another process") from e

    def read(self) -> DataFrame | None:
        folders = [m["folder"] for m in self.manifests()]
        return self.spark.read.parquet(*folders) if folders else None
