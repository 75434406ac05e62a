"""Which samples each worker sees in which round.

Tables are laid out so that a round opens only its own rows: shuffled epochs are stored by round,
stored shards are read by block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.functions.hashing import hash_key
from elastrain.operators.numbering import number_by_hash
from elastrain.plans.learners import Learner
from elastrain.plans.local_steps import RoundRule, dealt_round, local_round
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import SolverParams
from elastrain.session import fresh_path, remove_path
from elastrain.sources.shards import BLOCK_ROWS, WorkerStore, bucketed_scans


def worker_rows(df: DataFrame, n_workers: int) -> dict[int, int]:
    """Shard sizes, one number per worker."""
    found = {r["worker"]: r["n"] for r in df.groupBy("worker").agg(F.count(F.lit(1)).alias("n")).collect()}
    strange = [w for w in found if w is None or not 0 <= w < n_workers]
    if strange:
        raise ValueError(f"worker {strange[0]} is not one of 0 to {n_workers - 1}")
    return {w: found.get(w, 0) for w in range(n_workers)}


class ShuffledEpochs:
    """Every epoch reshuffles each shard by seed and drops the rows beyond its last full batch.

    An epoch is numbered and written once, under round=; a step of a worker is its iteration number
    over all epochs. Shards may differ in size, so a round can reach into several epochs.
    ``transform(samples, epoch)`` changes the samples anew in every epoch, as a random crop does.
    """

    def __init__(self, df: DataFrame, ids: list[str], n_workers: int, batch: int, period: int, seed: int,
                 transform: Callable[[DataFrame, int], DataFrame] | None = None):
        self.df, self.ids, self.seed, self.transform = df, ids, seed, transform
        self.batch, self.period, self.n_workers = batch, period, n_workers
        self.rows = worker_rows(df, n_workers)
        small = [w for w, n in self.rows.items() if n < batch]
        if small:
            raise ValueError(f"shard smaller than one batch: workers {small[:10]}")
        self.per_epoch = {w: n // batch for w, n in self.rows.items()}
        self.path = fresh_path(df.sparkSession, "epochs")
        self.written = self.removed = 0

    def _write_epoch(self, epoch: int) -> None:
        spark = self.df.sparkSession
        rows = self.transform(self.df, epoch) if self.transform else self.df
        keyed = rows.withColumn("_key", hash_key(self.seed, epoch, *[F.col(c) for c in self.ids]))
        placed = number_by_hash(keyed, ["worker"], "_key", "pos", "shard_rows")
        batches = F.floor(F.col("shard_rows") / self.batch)
        step = F.floor((F.col("pos") - 1) / self.batch)
        kept = placed.where(step < batches).select(
            "worker", (batches * epoch + step).alias("step"), "pos", "data", "label")
        with_round = kept.withColumn("round", F.floor(F.col("step") / self.period))
        files = min(self.n_workers, int(spark.conf.get("spark.sql.shuffle.partitions")))
        clustered = with_round.repartition("round", F.pmod("worker", F.lit(files)))
        clustered.sortWithinPartitions("round", "worker", "step").write.partitionBy("round").parquet(f"{self.path}/epoch={epoch}")

    def _epochs_of(self, number: int) -> range:
        first = min(number * self.period // m for m in self.per_epoch.values())
        last = max(((number + 1) * self.period - 1) // m for m in self.per_epoch.values())
        return range(first, last + 1)

    def _has(self, epoch: int, number: int) -> bool:
        low, high = number * self.period, (number + 1) * self.period
        return any(epoch * m < high and (epoch + 1) * m > low for m in self.per_epoch.values())

    def samples(self, number: int) -> DataFrame:
        epochs = self._epochs_of(number)
        # A run that goes on needs no epoch before its first.
        if self.written < epochs[0]:
            self.written = self.removed = epochs[0]
        while self.written <= epochs[-1]:
            self._write_epoch(self.written)
            self.written += 1
        # Rounds before this one are stored, so epochs that no worker reads any more can go.
        while self.removed < epochs[0]:
            remove_path(self.df.sparkSession, f"{self.path}/epoch={self.removed}")
            self.removed += 1
        folders = [f"{self.path}/epoch={e}/round={number}" for e in epochs if self._has(e, number)]
        return self.df.sparkSession.read.parquet(*folders)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


#: Most spans of positions that a filter names; closer ones are joined.
MOST_SPANS = 16


def _few(spans: list[tuple[int, int]], most: int = MOST_SPANS) -> list[tuple[int, int]]:
    """At most ``most`` spans that hold all of the given ones, joined over the smallest gaps."""
    spans = _merged(spans)
    gaps = sorted(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1])
    joined = set(gaps[: max(0, len(spans) - most)])
    out: list[tuple[int, int]] = []
    for i, (low, high) in enumerate(spans):
        if i in joined:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


class _Cyclic:
    """Shards read in key order, over and over, ``batch`` rows a step."""

    def __init__(self, rows: dict[int, int], batch: int, transform: SampleTransform | None):
        self.rows, self.batch, self.transform, self.n_workers = rows, batch, transform, len(rows)
        empty = [w for w, n in rows.items() if n == 0]
        if empty:
            raise ValueError(f"no stored samples: workers {empty[:10]}")

    def _passes(self, worker: int, first: int, steps: int):
        """(lowest and highest position, pass over the shard) of the rows behind a run of steps, in order."""
        n, at, end = self.rows[worker], first * self.batch, (first + steps) * self.batch
        while at < end:
            stop = min(end, at - at % n + n)
            yield at % n, (stop - 1) % n, at // n
            at = stop

    def _stepped(self, found: DataFrame, pass_no: F.Column, *more: str) -> DataFrame:
        """Rows with their step and place among all passes, and the draws of the transform."""
        sizes = F.array(*[F.lit(self.rows[w]).cast("bigint") for w in range(self.n_workers)])
        place = F.col("pos") + pass_no * F.get(sizes, F.col("worker"))
        draws = [self.transform.draws(pass_no, [F.col("worker"), F.col("pos")]).alias("draws")] if self.transform else []
        return found.select("worker", F.floor(place / self.batch).alias("step"), place.alias("pos"), "data", "label", *draws, *more)


class StoredShards(_Cyclic):
    """Shards stored by block, as a DataFrame; a round opens its blocks and deals their rows to the workers."""

    def __init__(self, shards: DataFrame, n_workers: int, batch: int, block_rows: int = BLOCK_ROWS,
                 transform: SampleTransform | None = None):
        super().__init__(worker_rows(shards, n_workers), batch, transform)
        self.shards, self.block_rows = shards, block_rows

    def _stretches(self, worker: int, first: int, steps: int):
        """(worker, block, lowest and highest position, pass) of the rows behind a run of steps."""
        for low, high, pass_no in self._passes(worker, first, steps):
            for block in range(low // self.block_rows, high // self.block_rows + 1):
                yield worker, block, low, high, pass_no

    def samples(self, starts: dict[int, int], steps: dict[int, int]) -> DataFrame:
        """Rows of ``steps[w]`` steps from iteration ``starts[w]`` on, for each worker named.

        The list of stretches has a few rows per worker. Their blocks and a few spans of positions prune
        the scan; the join gives each worker its own rows.
        """
        stretches = [s for w, first in starts.items() for s in self._stretches(w, first, steps[w])]
        spark = self.shards.sparkSession
        wanted = spark.createDataFrame(stretches, "worker int, block int, low long, high long, pass_no long")
        spans = [F.col("pos").between(low, high) for low, high in _few([s[2:4] for s in stretches])]
        opened = self.shards.where(F.col("block").isin(sorted({s[1] for s in stretches}))).where(reduce(or_, spans))
        found = opened.join(wanted, ["worker", "block"]).where(F.col("pos").between(F.col("low"), F.col("high")))
        return self._stepped(found, F.col("pass_no"))

    def round(self, starts: dict[int, int], steps: dict[int, int], state: DataFrame, learner: Learner, solver: SolverParams,
              rule: RoundRule) -> DataFrame:
        return local_round(self.samples(starts, steps), state, learner, solver, rule, self.n_workers, self.transform)


class DealtShards(_Cyclic):
    """Shards stored by worker: a round is a scan of each bucket from one position to another, without a shuffle."""

    def __init__(self, spark, store: WorkerStore, batch: int, transform: SampleTransform | None = None):
        self.store, self.table = store, store.read(spark)
        super().__init__(worker_rows(self.table, len(store.lanes)), batch, transform)

    def stretches(self, starts: dict[int, int], steps: dict[int, int]) -> list[DataFrame]:
        """The n-th scan has the n-th pass that each worker makes in this round (most rounds have one or two)."""
        passes = {w: list(self._passes(w, first, steps[w])) for w, first in starts.items()}
        out = []
        for i in range(max(map(len, passes.values()))):
            here = {w: p[i] for w, p in passes.items() if i < len(p)}
            low, high, pass_no = (
                F.get(F.array(*[F.lit(here[w][k] if w in here else None).cast("bigint") for w in range(self.n_workers)]), F.col("worker"))
                for k in range(3))
            spans = [F.col("pos").between(a, b) for a, b in _few([p[:2] for p in here.values()])]
            found = self.table.where(reduce(or_, spans)).where(F.col("pos").between(low, high))
            out.append(self._stepped(found, pass_no, "lane"))
        return out

    def round(self, starts: dict[int, int], steps: dict[int, int], state: DataFrame, learner: Learner, solver: SolverParams,
              rule: RoundRule) -> DataFrame:
        return dealt_round(
            self.stretches(starts, steps), state, self.store.lane(), learner, solver, rule, self.n_workers, self.transform)


def stored_shards(spark, shards: DataFrame | WorkerStore, n_workers: int, batch: int, block_rows: int,
                  transform: SampleTransform | None) -> StoredShards | DealtShards:
    if isinstance(shards, WorkerStore):
        if len(shards.lanes) != n_workers:
            raise ValueError(f"the store has {len(shards.lanes)} workers, the run {n_workers}")
        return DealtShards(spark, shards, batch, transform)
    return StoredShards(shards, n_workers, batch, block_rows, transform)
