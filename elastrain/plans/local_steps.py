"""Local solver steps of many workers as one Spark job.

A worker's state rows and its samples of the round arrive in one partition, sorted: state first,
then samples by step. They stream through in Arrow batches and a mini-batch is folded into its mean
gradient piece by piece, so a task holds one model, its gradient and one piece, whatever the length of
the round or the size of a mini-batch.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.functions.arrow import as_matrix, runs
from elastrain.operators.weights import CHUNK
from elastrain.plans.learners import Learner, apply_gradients, mean_step
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import SolverParams
from elastrain.session import bounded_batches

STATE, SAMPLE = 0, 1
# Layer number of the row that keeps (iteration, loss since the last exchange, cut, due).
PROGRESS = -1
#: Values (rows times features) of a mini-batch that are held before they are folded into the gradient.
PIECE = 1 << 20

OUT = pa.schema([
    ("kind", pa.string()), ("worker", pa.int32()), ("layer", pa.int32()), ("chunk", pa.int32()),
    ("values", pa.list_(pa.float64())), ("velocity", pa.list_(pa.float64())),
    ("iter", pa.int64()), ("loss", pa.float64()), ("ms", pa.float64()),
])
OUT_DDL = ("kind string, worker int, layer int, chunk int, values array<double>, velocity array<double>, "
           "iter long, loss double, ms double")


@dataclass(frozen=True)
class RoundRule:
    """What a worker does in a round besides stepping."""

    sum_updates: bool = False
    #: Worker 0 hands out its weights whenever its iteration is a multiple of this; 0 is never.
    snapshot: int = 0
    adaptive_period: int = 0
    last_iteration: int = 0


class _Worker:
    def __init__(self, number: int, learner: Learner, solver: SolverParams, rule: RoundRule):
        self.number, self.learner, self.solver, self.rule = number, learner, solver, rule
        self.blocks: list[tuple] = []
        self.params = self.velocity = None
        self.iteration, self.loss_sum, self.cut, self.due = 0, 0.0, -1.0, False
        self.log: list[tuple] = []
        self.snapshots: list[tuple] = []
        self.step_no, self.parts, self.held = None, [], 0
        self.mean, self.n, self.spent = None, 0, 0.0

    def add_block(self, layer: int, chunk: int, values: np.ndarray, velocity: np.ndarray) -> None:
        if layer == PROGRESS:
            self.iteration, self.loss_sum, self.cut = int(values[0]), float(values[1]), float(values[2])
        else:
            self.blocks.append((layer, chunk, values, velocity))

    def _assemble(self) -> None:
        self.blocks.sort(key=lambda b: b[:2])
        of_layer = {spec.layer: [b for b in self.blocks if b[0] == spec.layer] for spec in self.learner.layers()}
        self.params = [np.concatenate([b[2] for b in bs]) for bs in of_layer.values()]
        self.velocity = [np.concatenate([b[3] for b in bs]) for bs in of_layer.values()]
        self.updates = [np.zeros_like(p) for p in self.params]

    def add_samples(self, step: int, x: np.ndarray, y: np.ndarray) -> None:
        if self.step_no is not None and step != self.step_no:
            self.finish_step()
        self.step_no = step
        if not self.due:
            self.parts.append((x, y))
            self.held += x.size
            if self.held >= PIECE:
                self._fold()

    def _fold(self) -> None:
        """What is held joins the mean loss and gradients of the step."""
        x, y = (np.concatenate(p) for p in zip(*self.parts))
        self.parts, self.held = [], 0
        if self.params is None:
            self._assemble()
        start = time.perf_counter()
        self.mean = mean_step(self.mean, self.n, self.learner.loss_and_gradients(self.params, x, y), len(y))
        self.n += len(y)
        self.spent += (time.perf_counter() - start) * 1000

    def finish_step(self) -> None:
        if self.parts:
            self._fold()
        if self.mean is None:
            return
        start = time.perf_counter()
        loss, gradients = self.mean
        updates = apply_gradients(self.learner, self.params, self.velocity, gradients, self.iteration, self.solver)
        spent = self.spent + (time.perf_counter() - start) * 1000
        self.mean, self.n, self.spent = None, 0, 0.0
        if self.rule.sum_updates:
            for total, u in zip(self.updates, updates):
                total += u
        self.iteration += 1
        self.log.append((self.iteration, loss, spent))
        if self.number == 0 and self.rule.snapshot and self.iteration % self.rule.snapshot == 0:
            self.snapshots += [
                ("snapshot", 0, layer, chunk, w.copy(), None, self.iteration, None, None) for layer, chunk, w, _, _ in self._chunks()]
        if self.rule.adaptive_period:
            self._watch(loss)

    def _watch(self, loss: float) -> None:
        """Exchange at the first period, then whenever the loss since the last exchange tops the cut."""
        self.loss_sum += loss
        if self.iteration == self.rule.adaptive_period:
            self.cut, self.due = self.loss_sum, True
        elif self.cut > 0 and self.loss_sum > self.cut:
            self.due = True
        if self.iteration >= self.rule.last_iteration:
            self.due = True
        if self.due:
            self.loss_sum = 0.0

    def _chunks(self) -> Iterator[tuple]:
        for spec, w, v, u in zip(self.learner.layers(), self.params, self.velocity, self.updates):
            for chunk, at in enumerate(range(0, spec.size, CHUNK)):
                cut = slice(at, at + CHUNK)
                yield spec.layer, chunk, w[cut], v[cut], u[cut]

    def taken_snapshots(self) -> list[tuple]:
        taken, self.snapshots = self.snapshots, []
        return taken

    def rows(self) -> Iterator[tuple]:
        self.finish_step()
        if self.params is None:
            self._assemble()
        yield from self.taken_snapshots()
        for layer, chunk, w, v, u in self._chunks():
            yield ("weights", self.number, layer, chunk, w, v, None, None, None)
            if self.rule.sum_updates:
                yield ("delta", self.number, layer, chunk, u, None, None, None, None)
        for iteration, loss, spent in self.log:
            yield ("loss", self.number, None, None, None, None, iteration, loss, spent)
        if self.rule.adaptive_period:
            progress = np.array([self.iteration, self.loss_sum, self.cut, float(self.due)])
            yield ("progress", self.number, PROGRESS, 0, progress, None, None, None, None)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in OUT]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, OUT)], schema=OUT)


def _stepper(learner: Learner, solver: SolverParams, rule: RoundRule, transform: SampleTransform | None = None):
    width = learner.n_features
    if transform is not None:
        if transform.n_features != width:
            raise ValueError(f"transformed samples have {transform.n_features} values, the model takes {width}")
        channels, height, columns = transform.dims
        width = channels * height * columns

    def values_of(batch: pa.RecordBatch, lo: int, n: int) -> np.ndarray:
        x = as_matrix(batch.column("data").slice(lo, n), width)
        return x if transform is None else transform.apply(x, as_matrix(batch.column("draws").slice(lo, n), 3).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            numbers, kinds, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("worker", "kind", "a", "b"))
            group = np.where(kinds == STATE, b, a)
            for lo, hi in runs(numbers, kinds, a, group):
                if worker is None or worker.number != numbers[lo]:
                    if worker is not None:
                        yield _batch_of(list(worker.rows()))
                    worker = _Worker(int(numbers[lo]), learner, solver, rule)
                if kinds[lo] == STATE:
                    values = batch.column("values").slice(lo, hi - lo)
                    velocity = batch.column("velocity").slice(lo, hi - lo)
                    for i in range(hi - lo):
                        block = values[i].values.to_numpy()
                        speed = velocity[i].values.to_numpy() if velocity[i].is_valid else np.zeros(len(block))
                        worker.add_block(int(a[lo + i]), int(b[lo + i]), block, speed)
                else:
                    y = batch.column("label").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    worker.add_samples(int(a[lo]), values_of(batch, lo, hi - lo), y)
                    if worker.snapshots:
                        yield _batch_of(worker.taken_snapshots())
        if worker is not None:
            yield _batch_of(list(worker.rows()))

    return run


def _state_rows(state: DataFrame, data_type) -> DataFrame:
    none = F.lit(None)
    return state.select(
        "worker", F.lit(STATE).alias("kind"), F.col("layer").cast("bigint").alias("a"), F.col("chunk").cast("bigint").alias("b"),
        "values", "velocity", none.cast(data_type).alias("data"), none.cast("double").alias("label"), none.cast("array<int>").alias("draws"))


def _sample_rows(samples: DataFrame, *more: str) -> DataFrame:
    none = F.lit(None)
    draws = F.col("draws") if "draws" in samples.columns else none.cast("array<int>").alias("draws")
    return samples.select(
        "worker", F.lit(SAMPLE).alias("kind"), F.col("step").cast("bigint").alias("a"), F.col("pos").cast("bigint").alias("b"),
        none.cast("array<double>").alias("values"), none.cast("array<double>").alias("velocity"),
        "data", F.col("label").cast("double").alias("label"), draws, *more)


def local_round(samples: DataFrame, state: DataFrame, learner: Learner, solver: SolverParams, rule: RoundRule, n_workers: int,
                transform: SampleTransform | None = None) -> DataFrame:
    """One round of local steps of every worker.

    ``samples`` has (worker, step, pos, data, label), where data is numbers or bytes and travels as it
    is, and with a transform its draws; ``state`` has (worker, layer, chunk, values, velocity). Returns rows of
    kind weights, delta, loss, progress and snapshot.
    """
    bounded_batches(samples.sparkSession)
    together = _state_rows(state, samples.schema["data"].dataType).unionByName(_sample_rows(samples))
    in_order = together.repartitionById(n_workers, F.col("worker")).sortWithinPartitions("worker", "kind", "a", "b")
    return in_order.mapInArrow(_stepper(learner, solver, rule, transform), OUT_DDL)


def dealt_round(stretches: list[DataFrame], state: DataFrame, lane: F.Column, learner: Learner, solver: SolverParams, rule: RoundRule,
                n_workers: int, transform: SampleTransform | None = None) -> DataFrame:
    """The same round over samples that are dealt by lane already, a partition and a sorted run for each worker.

    ``stretches`` come in the order in which they are stepped over. Only the state is shuffled; the union puts a
    worker's state before its stretches, partition by partition, so nothing is sorted either.
    """
    bounded_batches(state.sparkSession)
    data = stretches[0].schema["data"].dataType
    parts = [_state_rows(state, data).withColumn("lane", lane).repartition(n_workers, "lane")]
    parts += [_sample_rows(part, "lane") for part in stretches]
    together = parts[0]
    for part in parts[1:]:
        together = together.union(part)
    return together.mapInArrow(_stepper(learner, solver, rule, transform), OUT_DDL)
