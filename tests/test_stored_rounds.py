"""Rounds over shards stored by worker: no shuffle of samples, and transforms that change with every pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training import BATCH, C, SEED, WORKERS, cyclic, planted, shards, start

from elastrain.operators.batching import assign_workers
from elastrain.plans import training as T
from elastrain.plans.learners import LinearSoftmax, local_step
from elastrain.plans.local_steps import RoundRule
from elastrain.plans.rounds import DealtShards, _few
from elastrain.plans.scoring import to_arrays
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.sources.shards import bucketed_scans, materialise_shards, open_store, read_shards, store_by_worker

DIMS = (2, 3, 4)
D = 24


def frame(spark, n=50):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 200, size=(n, D)), rng.integers(0, C, size=n)
    rows = [(i, [float(v) for v in r], float(c), list(DIMS)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, data array<float>, label float, dim array<int>")
    return x.astype(float), y, assign_workers(df, ["id"], WORKERS, SEED)


def same(a, b):
    for got, want in zip(to_arrays(LinearSoftmax(b[1], C), a), b[0]):
        assert got == pytest.approx(want)


def test_a_round_moves_no_samples(spark, tmp_path):
    _, _, df = frame(spark)
    store = store_by_worker(df, "id", str(tmp_path / "s"), WORKERS)
    learner = LinearSoftmax(D, C)
    state = T._at_iteration(spark.range(0).selectExpr("0 worker", "0 layer", "0 chunk", "array(0D) values", "array(0D) velocity"), 0, type("R", (), {"spark": spark, "n_workers": WORKERS}))
    with bucketed_scans(spark):
        found = DealtShards(spark, store, BATCH).round({w: 3 for w in range(WORKERS)}, {w: 2 for w in range(WORKERS)}, state, learner,
                                                       SolverParams(base_lr=0.1, max_iter=4), RoundRule())
        plan = found._jdf.queryExecution().executedPlan().toString()
    scans = plan[plan.index("FileScan"):]
    above = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Bucketed: true" in scans and "Sort" not in plan
    assert len(above) == 1 and "hashpartitioning(lane" in above[0]  # the state's
    assert "Exchange" not in scans


def test_both_layouts_give_the_same_weights(spark, tmp_path):
    _, _, df = frame(spark)
    materialise_shards(df, "id", str(tmp_path / "blocks"), block_rows=6)
    store = store_by_worker(df, "id", str(tmp_path / "by-worker"), WORKERS)
    learner, transform = LinearSoftmax(8, C), SampleTransform(DIMS, crop=2, mirror=True, channel_means=(90.0, 110.0), scale=0.01, seed=3)
    solver, params = SolverParams(base_lr=0.1, max_iter=10, momentum=0.5, batch_size=BATCH), ExchangeParams(5, 0.3)
    for train in (T.train_elastic_from_shards, T.train_elastic_adaptive):
        a, b = (train(s, WORKERS, learner, solver, params, 6, SEED, transform=transform) for s in (read_shards(spark, str(tmp_path / "blocks")), store))
        assert a.updates == b.updates
        same(b.centre, (to_arrays(learner, a.centre), 8))


def test_many_passes_equal_a_loop(spark, tmp_path):
    """A round longer than a shard steps over it again and again, with windows and flips of each pass."""
    x, y, df = frame(spark, 20)
    store = store_by_worker(df, "id", str(tmp_path / "s"), WORKERS)
    mean = np.arange(D) / 2
    transform = SampleTransform(DIMS, crop=3, mirror=True, mean_image=tuple(mean), scale=0.02, seed=9)
    learner = LinearSoftmax(18, C)
    solver = SolverParams(base_lr=0.1, max_iter=6, momentum=0.5, batch_size=BATCH)
    trained = T.train_elastic_from_shards(store, WORKERS, learner, solver, ExchangeParams(6, 0.5), 6, SEED, transform=transform)
    members, centre = shards(20), start(learner)
    for w in range(WORKERS):
        params, speed = start(learner), start(learner)
        drawn = spark.range(6 * BATCH).selectExpr("id DIV {0} AS pass_no".format(len(members[w])), "id % {0} AS pos".format(len(members[w])), f"{w} AS worker")
        places = drawn.select("pass_no", "pos", transform.draws(F.col("pass_no"), [F.col("worker"), F.col("pos")]).alias("d")).orderBy("pass_no", "pos").collect()
        for t, rows in enumerate(cyclic(members[w], 0, 6)):
            seen = []
            for i, place in zip(rows, places[t * BATCH:(t + 1) * BATCH]):
                top, left, flip = place.d
                cut = (x[i] - mean).reshape(DIMS)[:, top:top + 3, left:left + 3]
                seen.append((cut[..., ::-1] if flip else cut).ravel() * 0.02)
            local_step(learner, params, speed, np.array(seen), y[rows], t, solver)
        centre = [0.5 * c + 0.5 * p for c, p in zip(centre, params)]
    same(trained.centre, (centre, 18))


def test_held_out_samples_get_the_centre(spark):
    x, _, df = frame(spark, 6)
    transform = SampleTransform(DIMS, crop=2, mirror=True, channel_means=(1.0, 2.0), scale=0.5, seed=1).for_test()
    draws = np.array([r.d for r in df.select(transform.draws(F.lit(0), [F.col("id")]).alias("d")).collect()])
    want = transform.apply(x, draws)
    assert (draws == [0, 1, 0]).all() and want.shape == (6, transform.n_features)
    got = {r.id: r.data for r in transform.table(df).collect()}
    for i in range(6):
        assert got[i] == pytest.approx(list(want[i]))


def test_a_store_is_opened_again(spark, tmp_path):
    _, _, df = frame(spark)
    path = str(tmp_path / "again")
    store = store_by_worker(df, "id", path, WORKERS)
    rows = sorted(map(tuple, store.read(spark).select("worker", "pos", "label").collect()))
    spark.sql(f"DROP TABLE {store.table}")
    opened = open_store(spark, path, WORKERS)
    assert opened == store and sorted(map(tuple, opened.read(spark).select("worker", "pos", "label").collect())) == rows
    with pytest.raises(ValueError, match="the store has"):
        T.train_elastic_from_shards(opened, WORKERS + 1, LinearSoftmax(D, C), SolverParams(base_lr=0.1, max_iter=1), ExchangeParams(1, 0.1), 6)


def test_wrong_shapes_are_errors(spark, tmp_path):
    for wrong in ({"crop": 4}, {"channel_means": (1.0,)}, {"mean_image": (1.0,)}):
        with pytest.raises(ValueError):
            SampleTransform(DIMS, **wrong)
    _, _, df = frame(spark)
    store = store_by_worker(df, "id", str(tmp_path / "s"), WORKERS)
    with pytest.raises(ValueError, match="the model takes"):
        T.train_elastic_from_shards(store, WORKERS, LinearSoftmax(D, C), SolverParams(base_lr=0.1, max_iter=1), ExchangeParams(1, 0.1), 6,
                                    transform=SampleTransform(DIMS, crop=2))


def test_few_spans():
    assert _few([(0, 3), (10, 12), (14, 20), (40, 41)], 2) == [(0, 20), (40, 41)]
    assert _few([(0, 3), (10, 12)], 2) == [(0, 3), (10, 12)]
