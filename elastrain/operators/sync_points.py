"""When workers exchange, snapshot and evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.functions.schedules import is_due, whole_steps


def iteration_plan(df: DataFrame, iterations: int, k: int) -> DataFrame:
    """Outer steps of each worker: its share of the iterations, over ``k``; 64-bit, left to right."""
    sizes = df.groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    share = F.expr("div(wanted * n, total)")
    # One row per worker.
    return sizes.withColumn("total", F.sum("n").over(W.partitionBy())).withColumn("wanted", F.lit(iterations).cast("bigint")).select(
        "worker", "n", F.floor(share / F.lit(k)).alias("steps")
    )


def snapshot_points(updates: DataFrame, number: str, snapshot: int, workers: int, period: int) -> DataFrame:
    """Centre snapshots: every snapshot * workers / period updates."""
    return updates.where(is_due(F.col(number), whole_steps(snapshot, workers, period)))


def worker_snapshot_points(log: DataFrame, iteration: str, snapshot: int, worker: int = 0) -> DataFrame:
    """Snapshots of one worker: every ``snapshot`` local iterations."""
    return log.where((F.col("worker") == worker) & is_due(F.col(iteration), snapshot))


def eval_points(updates: DataFrame, number: str, test_interval: int) -> DataFrame:
    """Evaluations of the centre: every ``test_interval`` exchanges."""
    return updates.where(is_due(F.col(number), test_interval))
