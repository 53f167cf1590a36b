"""What runs: progress of streams as a table, and jobs and their stages with the share of tasks done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, run string, batch long, event string, rows long, rows_per_second double, at string"


class ProgressTable(StreamingQueryListener):
    """Appends a row to a Parquet table for every start, batch and end of every stream of the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event):
        self._append(event.name or str(event.id), str(event.runId), None, "started", None, None, event.timestamp)

    def onQueryProgress(self, event):
        p = event.progress
        self._append(p.name or str(p.id), str(p.runId), p.batchId, "progress", p.numInputRows, p.processedRowsPerSecond, p.timestamp)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._append(str(event.id), str(event.runId), None, "failed" if event.exception else "ended", None, None, None)


def watch(spark: SparkSession, path: str) -> ProgressTable:
    """Start to keep the progress of all streams in a table; ``spark.streams.removeListener`` ends it."""
    listener = ProgressTable(spark, path)
    spark.streams.addListener(listener)
    return listener


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(path)


def running(spark: SparkSession) -> list[tuple[int, int, str, int, int, float]]:
    """(job, stage, name, tasks done, tasks, share) of the stages that run now."""
    tracker, out = spark.sparkContext.statusTracker(), []
    for job in sorted(tracker.getActiveJobsIds()):
        found = tracker.getJobInfo(job)
        for stage in found.stageIds if found else ():
            info = tracker.getStageInfo(stage)
            if info and info.numTasks:
                out.append((job, stage, info.name, info.numCompletedTasks, info.numTasks, info.numCompletedTasks / info.numTasks))
    return out
