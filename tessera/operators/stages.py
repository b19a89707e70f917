"""Rows, seconds, jobs and tasks of the stages of a run, as a table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialized

SCHEMA = "stage string, rows long, seconds double, jobs int, tasks int"


class Stages:
    """Runs frames one after the other under a job group of their own and keeps a row on each."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.done: list[tuple] = []

    def run(self, stage: str, make: Callable[[], DataFrame], action: Callable[[DataFrame], DataFrame | None] | None = None) -> DataFrame | None:
        """What action makes of the frame (by default, the frame as a stored table); making the frame counts as part of the stage.

        Rows are counted while the action runs, without a pass of their own.
        """
        context, group, rows = self.spark.sparkContext, uuid.uuid4().hex, Observation()
        context.setJobGroup(group, stage)
        began = time.perf_counter()
        try:
            frame = make().observe(rows, F.count(F.lit(1)).alias("rows"))
            out = materialized(frame, stage) if action is None else action(frame)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
        seconds = time.perf_counter() - began
        status = context.statusTracker()
        jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(group)]
        # a stage that another job had computed has no information of its own
        known = [status.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        self.done.append((stage, rows.get["rows"], round(seconds, 3), len(jobs), sum(s.numCompletedTasks for s in known if s)))
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.done, SCHEMA)

    def append(self, path: str, run: str) -> None:
        """Add the rows to a table of runs."""
        self.table().withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(path)
