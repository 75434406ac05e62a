"""Loss metrics of a log while its entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elastrain.operators.aggregates import period_loss
from elastrain.schema import TRAINING_LOG

LOG = T.StructType([
    T.StructField("worker", T.LongType()),
    T.StructField("iter", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("ms", T.LongType()),
])


def stream_log_metrics(spark: SparkSession, source: str, out: str, checkpoint: str, period: int) -> DataFrame:
    """Period losses over all entries of ``source`` so far.

    A micro-batch writes the periods that it changed, under its own number, so a replay overwrites
    them; the newest version of each period counts.
    """

    def handle(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={version}")

    log = spark.readStream.schema(LOG).parquet(source)
    running = period_loss(log, period).writeStream.outputMode("update").foreachBatch(handle)
    running.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_metrics(spark, out)


def stream_update_counts(spark: SparkSession, source: str, out: str, checkpoint: str) -> DataFrame:
    """Running update counts of the runs whose log lines are in ``source``.

    (run, worker, update_no, iter, updates): the last update and iteration of each worker, and how many updates its run
    has had. Lines carry their update number, so lines of a round that was run again count once.
    """

    def handle(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={version}")

    lines = spark.readStream.schema(TRAINING_LOG).parquet(source).where("kind = 'exchange'")
    last = lines.groupBy("run", "worker").agg(F.max("update_no").alias("update_no"), F.max("iter").alias("iter"))
    running = last.writeStream.outputMode("update").foreachBatch(handle)
    running.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    newest = read_metrics(spark, out, ("run", "worker"))
    return newest.join(newest.groupBy("run").agg(F.max("update_no").alias("updates")), "run")


def read_metrics(spark: SparkSession, out: str, keys: tuple[str, ...] = ("worker", "span")) -> DataFrame:
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c != "version"]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "version").alias("row"))
    return newest.select("row.*")
