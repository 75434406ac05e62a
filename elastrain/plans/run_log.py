"""The log of a training run as it happens, and where a stopped run goes on.

Every round has one folder of log lines, written when the round is over: its losses and step times, tests, snapshots,
exchanges with their rates, decays, and one line that says what the next round needs to start. A round counts once its
folder is committed, so a round that is run again replaces its lines, and a run goes on after its last whole round.
"""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.functions.schedules import centre_factor, centre_rate, worker_rate
from elastrain.schema import TRAINING_LOG, ExchangeParams

NAMES = [f.name for f in TRAINING_LOG.fields]


class RunLog:
    """Lines of a run below ``base``; ``settings`` must be those the run was begun with."""

    def __init__(self, spark: SparkSession, base: str, settings: dict):
        self.spark, self.path, self.name = spark, f"{base}/log", base.rstrip("/").rsplit("/", 1)[-1]
        self.settings = json.loads(json.dumps(settings, sort_keys=True, default=str))
        self.events: list[tuple] = []
        self.lines: list[DataFrame] = []
        self.rounds = self._whole_rounds()
        self.last = self._manifest() if self.rounds else None
        self.started = time.time() - (self.last["elapsed_s"] if self.last else 0.0)

    def _whole_rounds(self) -> int:
        jvm = self.spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        n = 0
        while fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={n}/_SUCCESS")):
            n += 1
        return n

    def _manifest(self) -> dict:
        kept = self.spark.read.parquet(f"{self.path}/round={self.rounds - 1}").where("manifest IS NOT NULL")
        found = json.loads(kept.first()["manifest"])
        if found["settings"] != self.settings:
            raise ValueError(f"the run in {self.path} has other settings: {found['settings']}")
        return found

    def elapsed(self) -> float:
        return time.time() - self.started

    def note(self, kind: str, value: float | None, update: int, worker: int | None = None, iteration: int | None = None) -> None:
        self.events.append((self.name, worker, update, iteration, kind, value, self.elapsed()))

    def exchanges(self, met: list[tuple[int, int, int, int]], params: ExchangeParams, workers: int) -> None:
        """Lines for (worker, update, its exchanges before, iteration): both coefficients, and what has decayed since the update before."""
        rows = self.spark.createDataFrame(met, "worker int, update_no bigint, before bigint, iter bigint")
        update = F.col("update_no")
        rate, factor = centre_rate(update, params, workers), centre_factor(update, params, workers)

        def line(kind, value):
            return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))

        def fallen(kind, now, earlier):
            return F.when((update > 1) & (now != earlier), line(kind, now))

        found = F.array(
            line("exchange", rate * factor), line("worker_rate", worker_rate(F.col("before"), params)),
            fallen("decay", rate, centre_rate(update - 1, params, workers)),
            fallen("factor_decay", factor, centre_factor(update - 1, params, workers)))
        lines = rows.select("worker", "update_no", "iter", F.explode(F.array_compact(found)).alias("line"))
        self.lines.append(lines.select(
            F.lit(self.name).alias("run"), "worker", "update_no", "iter", "line.*", F.lit(self.elapsed()).alias("elapsed_s")))

    def close_round(self, number: int, local: DataFrame, manifest: dict) -> None:
        """Write the lines of a round, those of its steps from its ``local`` table, and what comes after it needs."""
        at = self.elapsed()
        steps = local.where(F.col("kind") == "loss").select("worker", "iter", "loss", "ms")

        def of_steps(kind, value):
            return steps.select(
                F.lit(self.name).alias("run"), "worker", F.lit(None).cast("bigint").alias("update_no"), F.col("iter").cast("bigint").alias("iter"),
                F.lit(kind).alias("kind"), F.col(value).cast("double").alias("value"), F.lit(at).alias("elapsed_s"))

        parts = [*self.lines, of_steps("loss", "loss"), of_steps("step_ms", "ms")]
        if self.events:
            parts.append(self.spark.createDataFrame(self.events, TRAINING_LOG))
        text = json.dumps({**manifest, "settings": self.settings, "elapsed_s": at})
        end = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in TRAINING_LOG.fields], F.lit(text).alias("manifest"))
        lines = reduce(DataFrame.unionByName, parts).withColumn("manifest", F.lit(None).cast("string"))
        lines.unionByName(end).write.mode("overwrite").parquet(f"{self.path}/round={number}")
        self.events, self.lines, self.rounds = [], [], number + 1

    def read(self) -> DataFrame:
        """All lines of whole rounds, and the events since."""
        since = self.spark.createDataFrame(self.events, TRAINING_LOG)
        return read_run_log(self.spark, self.path, self.rounds).unionByName(since) if self.rounds else since


def read_run_log(spark: SparkSession, path: str, rounds: int | None = None) -> DataFrame:
    """The lines of a stored log, of its first ``rounds`` rounds if given."""
    stored = spark.read.schema("run string, worker int, update_no bigint, iter bigint, kind string, value double, elapsed_s double, "
                               "manifest string, round int").parquet(path)
    whole = stored.where("manifest IS NULL")
    return (whole if rounds is None else whole.where(F.col("round") < rounds)).select(*NAMES)
