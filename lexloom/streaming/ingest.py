"""Jobs and events as streams of files: each one is applied once, whatever fails in between."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can read, under spark.checkpoint.dir. Where that isn't set, one of the machine's
    own for a session that runs on it alone, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets a folder for checkpoint() where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def kept(rows: DataFrame, most: int = 0) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, and readers get the columns they need only. With ``most``,
    files have so many rows at most, so that few large ones don't make few tasks."""
    path = shared_folder(rows.sparkSession)
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def events_of(spark: SparkSession, path: str, *, files: int = 1) -> DataFrame:
    """New parquet files under the path or pattern as a stream, ``files`` at a time."""
    schema = spark.read.parquet(path).schema
    pattern = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def windowed_counts(events: DataFrame, *, time: str = "ts", late: str | None = "1 hour", window: str = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by window and keys; events later than ``late`` may be dropped, none if that is None."""
    kept = events if late is None else events.withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def drained(result: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs an updating stream over everything that is there and gives its last state.

    Each batch is written under its number, so one that runs again overwrites itself; of a key the latest batch counts.
    """
    spark = result.sparkSession
    out = f"{folder}/out"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = [c for c in result.columns if c not in keys]
    last = state.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def worked(jobs: DataFrame, handle: Callable[[Row], None], folder: str, flush: int = 1000) -> DataFrame:
    """Runs a stream of jobs one after the other until it has caught up; gives (batch, job, state, error) of each.

    A job that fails doesn't stop the others. Jobs of a batch that ran only in part run again, so ``handle`` must be
    a keyed change; their status is then written anew. A batch holds the jobs of the files of one trigger; they come
    to the driver one partition at a time, and their status is written every ``flush`` jobs.
    """
    spark = jobs.sparkSession
    out = f"{folder}/status"

    def write(done: list[tuple], batch: int, part: int) -> None:
        spark.createDataFrame(done, "batch long, job string, state string, error string").coalesce(1).write.mode("overwrite" if part == 0 else "append").parquet(f"{out}/{batch}")

    def batch_of(rows: DataFrame, batch: int) -> None:
        done: list[tuple] = []
        part = 0
        for job in rows.toLocalIterator():
            if len(done) == flush:
                write(done, batch, part)
                done, part = [], part + 1
            try:
                handle(job)
                done.append((batch, json.dumps(job.asDict(), default=str), "done", None))
            except Exception as problem:  # noqa: BLE001
                done.append((batch, json.dumps(job.asDict(), default=str), "failed", str(problem)[:500]))
        write(done, batch, part)

    query = jobs.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(batch_of).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/*")


def interrupted(status: DataFrame, *, state: str = "state", error: str = "error") -> DataFrame:
    """The status rows after a restart: what was running has failed."""
    running = F.col(state) == "running"
    return status.withColumn(error, F.when(running, "interrupted").otherwise(F.col(error))).withColumn(state, F.when(running, "failed").otherwise(F.col(state)))
