"""Data-parallel training: workers step on their shards, a centre pulls them together.

Every round is a Spark job over the round's samples followed by the exchange as joins on weight
blocks. Round results are written to the shared folder under the round's number, so a lost executor
costs a recomputation of its tasks, and lineage never grows beyond one round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.functions.schedules import centre_factor, centre_rate, rounds_of, whole_steps, worker_rate
from elastrain.operators.batching import assign_workers
from elastrain.operators.exchanges import exchange_scan
from elastrain.operators.weights import BLOCK, apply_deltas, to_every_worker
from elastrain.plans.learners import Learner
from elastrain.plans.local_steps import PROGRESS, RoundRule, local_round
from elastrain.plans.parameters import init_weights, layer_table
from elastrain.plans.rounds import ShuffledEpochs, stored_shards
from elastrain.plans.run_log import RunLog
from elastrain.plans.scoring import evaluate
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.session import fresh_path, materialise
from elastrain.sources.shards import WorkerStore, bucketed_scans
from elastrain.sources.stores import centre_tag, save_weights, worker_tag


@dataclass
class Trained:
    """The last centre, every worker's last weights and the log."""

    centre: DataFrame
    workers: DataFrame
    log: DataFrame
    snapshots: str
    updates: int


class _Run:
    """Paths, log and progress of one training run.

    In a ``folder`` that holds rounds of this run it goes on after the last whole one.
    """

    def __init__(self, spark: SparkSession, name: str, learner: Learner, solver: SolverParams, n_workers: int,
                 test: DataFrame | None, snapshots: str | None, folder: str | None = None, **more):
        self.spark, self.learner, self.solver, self.n_workers, self.test = spark, learner, solver, n_workers, test
        self.base = folder.rstrip("/") if folder else fresh_path(spark, name)
        self.snapshots = snapshots or f"{self.base}/snapshots"
        # A run may be given more iterations when it goes on.
        steps = {k: v for k, v in vars(solver).items() if k != "max_iter"}
        layers = [vars(layer) for layer in learner.layers()]
        self.lines = RunLog(spark, self.base, {"kind": name, "workers": n_workers, "solver": steps, "layers": layers, **more})
        self.first = self.lines.rounds
        self.last = self.lines.last or {"updates": 0, "centre": None}
        self.updates, self.centre_round = self.last["updates"], self.last["centre"]
        # A round that was not finished may have left its snapshots behind.
        self.again = self.first > 0 or folder is not None

    def write(self, df: DataFrame, number: int, part: str) -> DataFrame:
        path = f"{self.base}/{part}/round={number}"
        with bucketed_scans(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, number: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{part}/round={number}")

    def note(self, kind: str, value: float | None) -> None:
        self.lines.note(kind, value, self.updates)

    def close_round(self, number: int, local: DataFrame, **more) -> None:
        self.lines.close_round(number, local, {"updates": self.updates, "centre": self.centre_round, **more})
        self.again = False

    def evaluate(self, centre: DataFrame) -> None:
        found = evaluate(self.test, centre, self.learner).first()
        self.note("accuracy", found["accuracy_1"])
        self.note("test_loss", found["loss"])

    def save(self, weights: DataFrame, tag: str) -> None:
        save_weights(weights, self.snapshots, tag, again=self.again)
        self.note("snapshot", None)

    def log(self) -> DataFrame:
        """The lines of every round, and what was noted since the last one."""
        return self.lines.read()


def _start(run: _Run, weights: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The centre and every worker's state before the first round."""
    if run.first:
        return _after(run)
    first = weights if weights is not None else init_weights(layer_table(run.spark, run.learner.layers()), seed)
    centre = run.write(first.select("layer", "chunk", "values"), -1, "centre")
    state = to_every_worker(centre, run.n_workers).withColumn("velocity", F.transform("values", lambda x: F.lit(0.0)))
    return centre, state


def _after(run: _Run) -> tuple[DataFrame, DataFrame]:
    """The centre and every worker's state after the last whole round of a run that goes on."""
    local = run.read(run.first - 1, "local")
    if run.centre_round is None:
        return run.read(-1, "centre"), _weights_of(local)
    met = run.read(run.centre_round, "met")
    centre = _centre_after(met, run.n_workers - 1)
    return centre, _left(_weights_of(local), met) if run.centre_round == run.first - 1 else _weights_of(local)


def _centre_after(met: DataFrame, worker: int) -> DataFrame:
    return met.where((F.col("kind") == "centre") & (F.col("worker") == worker)).select(*BLOCK, "values")


def _left(weights: DataFrame, met: DataFrame) -> DataFrame:
    """What workers leave the exchange with; those that stayed away keep their weights."""
    moved = met.where(F.col("kind") == "met").select("worker", *BLOCK, F.col("values").alias("moved"))
    return weights.join(moved, ["worker", *BLOCK], "left").select(
        "worker", *BLOCK, F.coalesce("moved", "values").alias("values"), "velocity")


def _weights_of(local: DataFrame) -> DataFrame:
    return local.where(F.col("kind") == "weights").select("worker", *BLOCK, "values", "velocity")


def _exchange(run: _Run, number: int, local: DataFrame, centre: DataFrame, arrivals: dict[int, int],
              iterations: dict[int, int], params: ExchangeParams) -> tuple[DataFrame, DataFrame]:
    """Fold the arriving workers into the centre; workers that stayed away keep their weights.

    ``arrivals`` maps a worker to the number of exchanges it did before (its decay counter), ``iterations`` to the
    iterations it has done.
    """
    # Two numbers per worker, looked up by worker number.
    order = sorted(arrivals)
    places = {w: i for i, w in enumerate(order)}
    place, exchange = (
        F.get(F.array(*[F.lit(found.get(w)).cast("bigint") for w in range(run.n_workers)]), F.col("worker"))
        for found in (places, arrivals))
    update = F.col("place") + F.lit(run.updates + 1)
    weights = _weights_of(local)
    meeting = weights.withColumn("place", place).where(F.col("place").isNotNull()).withColumns({
        "a": worker_rate(exchange, params),
        "b": centre_rate(update, params, run.n_workers) * centre_factor(update, params, run.n_workers)})
    due = {order[i]: wanted for i, wanted in _due(run, len(order), params).items()}
    # One scan gives every worker's view and the centre after each update that is due.
    met = run.write(exchange_scan(meeting, centre, run.n_workers, tuple(due)), number, "met")

    run.lines.exchanges([(w, run.updates + i + 1, arrivals[w], iterations[w]) for i, w in enumerate(order)], params, run.n_workers)
    before = run.updates
    for worker, (testing, saving) in due.items():
        run.updates = before + places[worker] + 1
        if testing:
            run.evaluate(_centre_after(met, worker))
        if saving:
            run.save(_centre_after(met, worker), centre_tag(run.updates))
    run.updates, run.centre_round = before + len(order), number
    return _centre_after(met, run.n_workers - 1), _left(weights, met)


def _due(run: _Run, n: int, params: ExchangeParams) -> dict[int, tuple[bool, bool]]:
    """(test, snapshot) by place, for the updates of this round on which one falls."""
    save_every = whole_steps(run.solver.snapshot, run.n_workers, params.period)
    test_every = run.solver.test_interval if run.test is not None else 0
    updates = {place: run.updates + place + 1 for place in range(n)}
    wanted = {p: (bool(test_every) and u % test_every == 0, bool(save_every) and u % save_every == 0) for p, u in updates.items()}
    return {p: w for p, w in wanted.items() if any(w)}


def _worker_snapshots(run: _Run, local: DataFrame, first: int, last: int) -> None:
    """Worker 0's weights after each iteration of the round that is a multiple of ``snapshot``, as they were then."""
    every = run.solver.snapshot
    for iteration in range(first - first % every + every, last + 1, every) if every > 0 else ():
        taken = local.where((F.col("kind") == "snapshot") & (F.col("iter") == iteration))
        run.save(taken.select(*BLOCK, "values"), worker_tag(iteration))


def _round_count(spark: SparkSession, iterations: int, period: int) -> int:
    return spark.range(1).select(rounds_of(F.lit(iterations), period)).first()[0]


def _elastic_rounds(run: _Run, round_of, centre: DataFrame, state: DataFrame, params: ExchangeParams, worker_saves: bool) -> Trained:
    """``round_of(number, state, rule)`` is the round's local steps."""
    rule = RoundRule(snapshot=run.solver.snapshot if worker_saves else 0)
    for number in range(run.first, _round_count(run.spark, run.solver.max_iter, params.period)):
        local = run.write(round_of(number, _at_iteration(state, number * params.period, run), rule), number, "local")
        if worker_saves:
            _worker_snapshots(run, local, number * params.period, (number + 1) * params.period)
        everyone = range(run.n_workers)
        centre, state = _exchange(
            run, number, local, centre, dict.fromkeys(everyone, number), dict.fromkeys(everyone, (number + 1) * params.period), params)
        run.close_round(number, local)
    return Trained(centre, state, run.log(), run.snapshots, run.updates)


def _with_progress(samples: DataFrame) -> DataFrame:
    return samples.select("worker", "step", "pos", "data", "label")


def _at_iteration(state: DataFrame, iteration: int, run: _Run) -> DataFrame:
    """State rows plus one row per worker that tells its iteration number."""
    progress = run.spark.range(run.n_workers).select(
        F.col("id").cast("int").alias("worker"), F.lit(PROGRESS).alias("layer"), F.lit(0).alias("chunk"),
        F.array(F.lit(float(iteration)), F.lit(0.0), F.lit(-1.0), F.lit(0.0)).alias("values"),
        F.lit(None).cast("array<double>").alias("velocity"))
    return state.unionByName(progress)


def train_elastic(df: DataFrame, ids: list[str], n_workers: int, learner: Learner, solver: SolverParams, params: ExchangeParams,
                  seed: int = 0, weights: DataFrame | None = None, test: DataFrame | None = None,
                  snapshots: str | None = None, transform: Callable[[DataFrame, int], DataFrame] | None = None,
                  folder: str | None = None) -> Trained:
    """Elastic averaging at a fixed period over reshuffled epochs of ``df`` (ids, data, label).

    ``transform(samples, epoch)`` is applied to the training samples of each epoch; ``test`` is scored as it is.
    ``folder`` keeps the rounds and the log; a run that was stopped goes on from there after its last whole round,
    as does one that is given more iterations. Without it the run has a folder of its own.
    """
    run = _Run(df.sparkSession, "elastic", learner, solver, n_workers, test, snapshots, folder, exchange=vars(params), seed=seed)
    sharded = df if "worker" in df.columns else assign_workers(df, ids, n_workers, seed)
    epochs = ShuffledEpochs(sharded, ids, n_workers, solver.batch_size, params.period, seed, transform)
    centre, state = _start(run, weights, seed)

    def round_of(number, state, rule):
        return local_round(_with_progress(epochs.samples(number)), state, learner, solver, rule, n_workers)

    return _elastic_rounds(run, round_of, centre, state, params, worker_saves=False)


def _tested(test: DataFrame | None, transform: SampleTransform | None) -> DataFrame | None:
    """Held-out samples as the model sees them, written once."""
    return test if test is None or transform is None else materialise(transform.for_test().table(test), "held-out")


def train_elastic_from_shards(shards: DataFrame | WorkerStore, n_workers: int, learner: Learner, solver: SolverParams, params: ExchangeParams,
                              block_rows: int, seed: int = 0, weights: DataFrame | None = None, test: DataFrame | None = None,
                              snapshots: str | None = None, transform: SampleTransform | None = None, folder: str | None = None) -> Trained:
    """Elastic averaging at a fixed period over stored shards, read in key order again and again.

    A ``WorkerStore`` is read where it lies, without a shuffle. ``transform`` changes the samples anew in every pass
    over a shard; held-out samples get its form for tests. ``folder`` as in ``train_elastic``.
    """
    spark = SparkSession.getActiveSession()
    run = _Run(spark, "elastic-shards", learner, solver, n_workers, _tested(test, transform), snapshots, folder, exchange=vars(params), seed=seed)
    stored = stored_shards(spark, shards, n_workers, solver.batch_size, block_rows, transform)
    centre, state = _start(run, weights, seed)

    def round_of(number, state, rule):
        starts = {w: number * params.period for w in range(n_workers)}
        return stored.round(starts, {w: params.period for w in starts}, state, learner, solver, rule)

    return _elastic_rounds(run, round_of, centre, state, params, worker_saves=True)


def train_elastic_adaptive(shards: DataFrame | WorkerStore, n_workers: int, learner: Learner, solver: SolverParams, params: ExchangeParams,
                           block_rows: int, seed: int = 0, weights: DataFrame | None = None, test: DataFrame | None = None,
                           snapshots: str | None = None, decay_by_iteration: bool = False,
                           transform: SampleTransform | None = None, folder: str | None = None) -> Trained:
    """Elastic averaging in which each worker exchanges when its loss sum says so.

    A round offers every worker some steps; it stops at its exchange, and the steps it did not take
    are offered again. ``decay_by_iteration`` counts the decay of the worker's rate in iterations.
    ``folder`` as in ``train_elastic``.
    """
    spark = SparkSession.getActiveSession()
    run = _Run(spark, "elastic-adaptive", learner, solver, n_workers, _tested(test, transform), snapshots, folder, exchange=vars(params), seed=seed)
    stored = stored_shards(spark, shards, n_workers, solver.batch_size, block_rows, transform)
    centre, state = _start(run, weights, seed)
    rule = RoundRule(adaptive_period=params.period, last_iteration=solver.max_iter, snapshot=solver.snapshot)
    progress = {w: (0, 0.0, -1.0) for w in range(n_workers)}
    exchanges = dict.fromkeys(progress, 0)
    if run.first:
        progress = {w: (int(p[0]), p[1], p[2]) for w, p in enumerate(run.last["progress"])}
        exchanges = dict(enumerate(run.last["exchanges"]))
    number = run.first
    while starts := {w: p[0] for w, p in progress.items() if p[0] < solver.max_iter}:
        offered = {w: min(2 * params.period, solver.max_iter - at) for w, at in starts.items()}
        rows = [(w, PROGRESS, 0, [float(x) for x in (*p, 0.0)], None) for w, p in progress.items()]
        known = run.spark.createDataFrame(
            rows, "worker int, layer int, chunk int, values array<double>, velocity array<double>")
        local = run.write(stored.round(starts, offered, state.unionByName(known), learner, solver, rule), number, "local")
        # One row of four numbers per worker.
        ended = {r["worker"]: r["values"] for r in local.where(F.col("kind") == "progress").select("worker", "values").collect()}
        met = [w for w in sorted(starts) if ended[w][3] > 0]
        if 0 in starts:
            _worker_snapshots(run, local, starts[0], int(ended[0][0]))
        if met:
            arrivals = {w: int(ended[w][0]) - 1 if decay_by_iteration else exchanges[w] for w in met}
            centre, state = _exchange(run, number, local, centre, arrivals, {w: int(ended[w][0]) for w in met}, params)
            for w in met:
                exchanges[w] += 1
        else:
            state = _weights_of(local)
        progress = {w: (int(v[0]), v[1], v[2]) for w, v in ended.items()}
        run.close_round(number, local, progress=[progress[w] for w in range(n_workers)], exchanges=[exchanges[w] for w in range(n_workers)])
        number += 1
    return Trained(centre, state, run.log(), run.snapshots, run.updates)


def _pushed(run: _Run, number: int) -> tuple[DataFrame, DataFrame]:
    """The centre after the pushes of a round, and workers that take it and keep their velocity."""
    centre = run.read(number, "centre")
    velocity = _weights_of(run.read(number, "local")).select("worker", *BLOCK, "velocity")
    return centre, velocity.join(centre, BLOCK).select("worker", *BLOCK, "values", "velocity")


def train_delta(df: DataFrame, ids: list[str], n_workers: int, k: int, learner: Learner, solver: SolverParams,
                seed: int = 0, weights: DataFrame | None = None, test: DataFrame | None = None,
                transform: Callable[[DataFrame, int], DataFrame] | None = None, folder: str | None = None) -> Trained:
    """Each worker takes the centre, does ``k`` steps, and pushes the sum of its updates.

    A worker's share of the iterations follows its share of the rows, so small shards stop early.
    ``folder`` as in ``train_elastic``.
    """
    run = _Run(df.sparkSession, "delta", learner, solver, n_workers, test, None, folder, k=k, seed=seed)
    sharded = df if "worker" in df.columns else assign_workers(df, ids, n_workers, seed)
    epochs = ShuffledEpochs(sharded, ids, n_workers, solver.batch_size, k, seed, transform)
    total = sum(epochs.rows.values())
    pushes = {w: solver.max_iter * n // total // k for w, n in epochs.rows.items()}
    centre, state = _start(run, weights, seed) if not run.first else _pushed(run, run.first - 1)
    rounds = max(pushes.values())
    for number in range(run.first, rounds):
        active = F.array(*[F.lit(pushes[w] > number) for w in range(n_workers)])
        samples = epochs.samples(number).where(F.get(active, F.col("worker")))
        local = run.write(
            local_round(_with_progress(samples), _at_iteration(state, number * k, run), learner, solver,
                        RoundRule(sum_updates=True), n_workers), number, "local")
        deltas = local.where(F.col("kind") == "delta").select(*BLOCK, "values")
        run.write(apply_deltas(centre, deltas), number, "centre")
        centre, state = _pushed(run, number)
        run.updates += sum(p > number for p in pushes.values())
        if test is not None and number == rounds - 1:
            run.evaluate(centre)
        run.close_round(number, local)
    if test is not None and rounds == 0:
        run.evaluate(centre)
    return Trained(centre, state, run.log(), run.snapshots, run.updates)


def training_report(log: DataFrame) -> DataFrame:
    """Per run: wall seconds, last accuracy, mean loss of the first and of the last step, number of losses.

    Grouped by step first, so a long run is merged from many small groups.
    """
    loss, accuracy = F.col("kind") == "loss", F.col("kind") == "accuracy"
    when = F.when(accuracy, F.struct("elapsed_s", "update_no", "value"))
    steps = log.groupBy("run", "iter").agg(
        F.min("elapsed_s").alias("first_s"), F.max("elapsed_s").alias("last_s"), F.max(when).alias("last_test"),
        F.avg(F.when(loss, F.col("value"))).alias("loss"), F.count(F.when(loss, 1)).alias("losses"))
    step = F.when(F.col("losses") > 0, F.col("iter"))
    return steps.groupBy("run").agg(
        (F.max("last_s") - F.min("first_s")).alias("seconds"), F.max("last_test")["value"].alias("accuracy"),
        F.min_by("loss", step).alias("first_loss"), F.max_by("loss", step).alias("last_loss"), F.sum("losses").alias("steps"))
