"""A centre that moves with a stream of arriving weights or updates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elastrain.functions.schedules import centre_factor, centre_rate, centre_segment, whole_steps
from elastrain.operators.numbering import number_by_value
from elastrain.operators.weights import fold_weighted
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.session import remove_path
from elastrain.sources.stores import centre_tags, save_tagged
from elastrain.streaming.blocks import MOVED, BlockCentre, centre_decays

# ``seq`` numbers the arrivals; an arrival is the rows sharing one seq, one for each block of the centre.
ARRIVAL = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])


@dataclass(frozen=True)
class CentreStore:
    """Versions of the centre under a folder: batch=<id> holds the centre after that micro-batch.

    A replayed micro-batch starts from the version before it and overwrites its own, so it never
    counts twice. ``version`` -1 is the start.
    """

    spark: SparkSession
    path: str

    def start(self, centre: DataFrame) -> None:
        self.put(centre, 0, -1)

    def put(self, centre: DataFrame, updates: int, version: int) -> None:
        rows = centre.select("layer", "chunk", "values").withColumn("updates", F.lit(updates).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def before(self, version: int | None = None) -> tuple[DataFrame, int]:
        """The newest centre (older than ``version``) and its number of updates."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [int(n.split("=")[1]) for n in names
                if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        newest = max(v for v in done if version is None or v < version)
        rows = self.spark.read.parquet(f"{self.path}/version={newest}")
        return rows.select("layer", "chunk", "values"), rows.select("updates").first()[0]


def number_arrivals(batch: DataFrame, updates: int) -> DataFrame:
    """(seq, update_no) of the arrivals of a micro-batch, going on from ``updates``."""
    numbered = number_by_value(batch.select("seq").distinct(), [], "seq", "_n")
    return numbered.select("seq", (F.col("_n") + updates).alias("update_no"))


def check_whole(batch: DataFrame, centre: DataFrame) -> None:
    """Every arrival must bring each block of the centre once: a part of one would shrink what it lacks."""
    blocks = centre.count()
    counted = batch.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("layer", "chunk").alias("of"))
    partial = counted.where((F.col("n") != blocks) | (F.col("of") != blocks)).first()
    if partial:
        raise ValueError(f"arrival {partial['seq']} has {partial['n']} rows for the {blocks} blocks of the centre")


def _shares(numbered: DataFrame, params: ExchangeParams, workers: int) -> DataFrame:
    """Share of each arrival after all later ones: its coefficient b times the (1 - b)s behind it.

    b is constant between two decays, so within such a segment the product is a power of 1 - b; only
    the table of segments is walked in order. Coefficients above 1 turn the sign, as in a plain fold.
    """
    update = F.col("update_no")
    marked = numbered.withColumn("segment", centre_segment(update, params, workers))
    b = (centre_rate(F.col("last"), params, workers) * centre_factor(F.col("last"), params, workers)).alias("b")
    segments = marked.groupBy("segment").agg(F.max("update_no").alias("last"), F.count(F.lit(1)).alias("n")).select("segment", "last", "n", b)
    size = F.when(F.col("b") == 1, F.lit(float("-inf"))).otherwise(F.col("n") * F.log(F.abs(1 - F.col("b"))))
    segments = segments.withColumns({"size": size, "turns": F.when(F.col("b") > 1, F.col("n")).otherwise(F.lit(0))})

    def product(window):
        sign = 1.0 - 2.0 * (F.coalesce(F.sum("turns").over(window), F.lit(0)) % 2)
        return sign * F.exp(F.coalesce(F.sum("size").over(window), F.lit(0.0)))

    later = W.orderBy(F.col("last").desc()).rowsBetween(W.unboundedPreceding, -1)
    segments = segments.withColumns({"behind": product(later), "kept": product(W.partitionBy())})
    weight = F.col("b") * F.pow(1 - F.col("b"), F.col("last") - update) * F.col("behind")
    return marked.join(segments.select("segment", "last", "b", "behind", "kept"), "segment").select("seq", weight.alias("weight"), "kept")


def fold_numbered(batch: DataFrame, numbered: DataFrame, centre: DataFrame, params: ExchangeParams, workers: int) -> DataFrame:
    """The centre after the arrivals of ``batch`` that ``numbered`` lists."""
    return fold_weighted(batch.join(_shares(numbered, params, workers), "seq"), centre)


def fold_batch(batch: DataFrame, centre: DataFrame, updates: int, params: ExchangeParams, workers: int) -> tuple[DataFrame, DataFrame]:
    """The centre after all arrivals of ``batch``, and their numbers."""
    check_whole(batch, centre)
    numbered = number_arrivals(batch, updates)
    return fold_numbered(batch, numbered, centre, params, workers), numbered


class _Results:
    """What blocks hand on: due centres until all their blocks are there, and each block's latest values."""

    def __init__(self, store: CentreStore):
        self.spark, self.path = store.spark, store.path
        self.start = store.before(0)
        self.blocks = self.start[0].count()

    def _read(self, name: str, version: int) -> DataFrame:
        return self.spark.read.schema(MOVED).parquet(f"{self.path}/{name}/version={version}")

    def add(self, emitted: DataFrame, version: int) -> tuple[list[int], DataFrame, DataFrame]:
        """Due updates that are now whole, their rows, and the latest row of every block.

        What goes on waiting is written under the version, so a replay starts from the version before again.
        """
        emitted.write.mode("overwrite").parquet(f"{self.path}/emitted/version={version}")
        if version == 0:
            centre, updates = self.start
            held = centre.select(F.lit("latest").alias("kind"), F.lit(updates).cast("bigint").alias("update_no"), "layer", "chunk", "values")
        else:
            held = self._read("held", version - 1)
        rows = held.unionByName(self._read("emitted", version))
        due = rows.where("kind = 'due'")
        # Two numbers for each update that a test or snapshot is due at.
        counted = due.groupBy("update_no").count().collect()
        whole = sorted(r["update_no"] for r in counted if r["count"] == self.blocks)
        part = [r["update_no"] for r in counted if r["count"] < self.blocks]
        latest = rows.where("kind = 'latest'").groupBy("kind", "layer", "chunk").agg(
            F.max("update_no").alias("update_no"), F.max_by("values", "update_no").alias("values"))
        waiting = due.where(F.col("update_no").isin(part)) if part else due.where("false")
        waiting.unionByName(latest.select(*due.columns)).write.mode("overwrite").parquet(f"{self.path}/held/version={version}")
        return whole, due, self._read("held", version).where("kind = 'latest'")

    def forget(self, version: int) -> None:
        """Drop what no replay can ask for again."""
        remove_path(self.spark, f"{self.path}/emitted/version={version}")
        remove_path(self.spark, f"{self.path}/held/version={version - 2}")


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Several state variables for a key need the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_centre(spark: SparkSession, source: str, store: CentreStore, checkpoint: str, params: ExchangeParams,
                  solver: SolverParams, workers: int, updates_only: bool = False, on_test=None,
                  snapshots: str | None = None, files_per_batch: int | None = None) -> None:
    """Fold all arrivals now present in ``source`` into the stored centre, then stop.

    ``seq`` numbers the arrivals from 0 without gaps: it makes update seq + 1, in whatever order arrivals come. Each
    block of the centre is a state of its own, so parts of an arrival may come in different micro-batches; a part
    before its turn waits in the state, one that comes again counts once. The stored centre moves on when all blocks
    stand at the same update. ``updates_only`` subtracts arriving update values instead of averaging weights.
    Snapshots and ``on_test(update_no, centre)`` see the centre after exactly the update they are due at, in the
    micro-batch that completes it.
    """
    save_every = whole_steps(solver.snapshot, workers, params.period) if snapshots else 0
    test_every = solver.test_interval if on_test else 0
    results = _Results(store)

    def handle(emitted: DataFrame, version: int) -> None:
        whole, due, latest = results.add(emitted, version)
        saved = [u for u in whole if save_every and u % save_every == 0]
        if saved:
            save_tagged(due.where(F.col("update_no").isin(saved)), f"{snapshots}/batch={version}", centre_tags("update_no"))
        for update in whole:
            if test_every and update % test_every == 0:
                on_test(update, due.where(F.col("update_no") == update).select("layer", "chunk", "values"))
        low, high = latest.agg(F.min("update_no"), F.max("update_no")).first()
        if low == high:
            store.put(latest, high, version)
        results.forget(version)

    reader = spark.readStream.schema(ARRIVAL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    decays = None if updates_only else centre_decays(params, workers)
    centre, updates = results.start
    first = centre.select("layer", "chunk", "values", F.lit(updates).cast("bigint").alias("updates")).groupBy("layer", "chunk")
    moved = reader.parquet(source).groupBy("layer", "chunk").transformWithStateInPandas(
        BlockCentre(decays, (save_every, test_every)), MOVED, "Append", "None", initialState=first)
    with _keyed_state(spark):
        query = moved.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
