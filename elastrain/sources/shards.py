"""Stored shards: one numbered sample store per worker, as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.functions.arrays import decode_u8, encode_u8, quantised
from elastrain.operators.numbering import number_by_value

COMMIT_ROWS = 1000
BLOCK_ROWS = 65536


def number_samples(df: DataFrame, order: str, commit_rows: int = COMMIT_ROWS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Running number of every sample in its worker's store, its key, and its commit group; ``ties`` break equal values."""
    numbered = number_by_value(df, ["worker"], order, "_n", ties=ties).withColumn("pos", F.col("_n") - 1).drop("_n")
    return numbered.withColumns({
        "key": F.format_string("%08d", "pos"), "commit": F.floor(F.col("pos") / commit_rows)})


def materialise_shards(df: DataFrame, order: str, path: str, quantise: bool = True, block_rows: int = BLOCK_ROWS) -> None:
    """Write the samples of every worker under worker=/block=, sorted by number.

    ``df`` has worker, data, label, dim and the ``order`` column. Values are stored as bytes. A
    block is a run of numbers, so a reader of a range opens only its blocks, and a large shard is
    written by many tasks.
    """
    data = encode_u8(quantised(F.col("data"))) if quantise else encode_u8(F.col("data"))
    rows = number_samples(df, order).withColumn("block", F.floor(F.col("pos") / block_rows))
    stored = rows.select(
        "key", "pos", F.get("dim", 0).alias("channels"), F.get("dim", 1).alias("height"), F.get("dim", 2).alias("width"),
        data.alias("data"), F.col("label").cast("int").alias("label"), "worker", "block")
    clustered = stored.repartition("worker", "block").sortWithinPartitions("worker", "block", "pos")
    clustered.write.partitionBy("worker", "block").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Stored samples with decoded values; filters on worker, block and pos reach the scan."""
    stored = spark.read.parquet(path)
    return stored.withColumns({
        "data": decode_u8("data").cast("array<float>"), "label": F.col("label").cast("float"),
        "dim": F.array("channels", "height", "width")}).drop("channels", "height", "width")


@dataclass(frozen=True)
class WorkerStore:
    """Stored samples as a table with one bucket, and in it one file, for each worker, sorted by number.

    A scan of it is dealt by ``lane`` already, and so is everything else that is dealt by lane into as many
    partitions: rounds that read it need no shuffle of the samples. ``lanes[w]`` is a number whose bucket is w's alone.
    """

    table: str
    lanes: tuple[int, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def lane(self, worker: str = "worker") -> F.Column:
        return F.get(F.array(*map(F.lit, self.lanes)), F.col(worker))


def _lanes(spark: SparkSession, n_workers: int) -> tuple[int, ...]:
    """For each worker the smallest number that Spark's hash puts into that worker's bucket of ``n_workers``."""
    found: dict[int, int] = {}
    tried = 8 * n_workers
    while len(found) < n_workers:
        tried *= 2
        numbers = spark.range(tried).select(F.col("id").cast("int").alias("lane"))
        buckets = numbers.groupBy(F.pmod(F.hash("lane"), F.lit(n_workers)).alias("worker")).agg(F.min("lane").alias("lane"))
        found = {r["worker"]: r["lane"] for r in buckets.collect()}
    return tuple(found[w] for w in range(n_workers))


def _name_of(path: str) -> str:
    return "store_" + md5(path.rstrip("/").encode()).hexdigest()


def store_by_worker(df: DataFrame, order: str, path: str, n_workers: int, quantise: bool = True, ties: tuple[str, ...] = ()) -> WorkerStore:
    """Write the samples of every worker as one sorted bucket under ``path``; the samples move once, here.

    ``df`` has worker, data, label, dim and the ``order`` column. Values are stored as bytes and stay bytes when read.
    """
    spark = df.sparkSession
    store = WorkerStore(_name_of(path), _lanes(spark, n_workers))
    data = encode_u8(quantised(F.col("data"))) if quantise else encode_u8(F.col("data"))
    rows = number_samples(df, order, ties=ties).select(
        "worker", store.lane().alias("lane"), F.col("pos").cast("bigint").alias("pos"), data.alias("data"), F.col("label").cast("int").alias("label"))
    in_files = rows.repartition(n_workers, "lane").sortWithinPartitions("lane", "pos")
    in_files.write.bucketBy(n_workers, "lane").sortBy("lane", "pos").option("path", path).saveAsTable(store.table)
    return store


def open_store(spark: SparkSession, path: str, n_workers: int) -> WorkerStore:
    """The store under ``path``, known to this session's catalog again."""
    store = WorkerStore(_name_of(path), _lanes(spark, n_workers))
    columns = "worker INT, lane INT, pos BIGINT, data BINARY, label INT"
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {store.table} ({columns}) USING parquet "
              f"CLUSTERED BY (lane) SORTED BY (lane, pos) INTO {n_workers} BUCKETS LOCATION '{where}'")
    return store


@contextmanager
def bucketed_scans(spark: SparkSession) -> Iterator[None]:
    """Scans keep their buckets, and unions of equally dealt inputs stay dealt, while a plan is made."""
    wanted = {"spark.sql.sources.bucketing.enabled": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
              "spark.sql.unionOutputPartitioning": "true"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def list_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of all stores in the order of their numbers (as text they sort alike only up to eight digits)."""
    return spark.read.parquet(path).select("worker", "key", "pos").orderBy("worker", "pos").drop("pos")
