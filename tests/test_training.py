"""Training runs against plain numpy loops over the same seeded order."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from elastrain.operators.batching import assign_workers
from elastrain.plans import training as T
from elastrain.plans.learners import LinearSoftmax, ReluNet, local_step
from elastrain.plans.parameters import init_weights, layer_table
from elastrain.plans.rounds import StoredShards, _merged
from elastrain.plans.scoring import evaluate, gradient, score, to_arrays
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.sources.shards import materialise_shards, read_shards
from elastrain.sources.stores import load_weights

D, C, WORKERS, BATCH, SEED = 4, 3, 3, 4, 5
LEARNER = LinearSoftmax(D, C)


def planted(n=80, seed=0, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, D)) if levels is None else rng.integers(0, levels, size=(n, D)).astype(float)
    x = x.astype(np.float32).astype(np.float64)
    centre = np.zeros(D) if levels is None else np.full(D, (levels - 1) / 2)
    y = ((x - centre) @ rng.normal(size=(D, C))).argmax(axis=1)
    return x, y


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(c), [1, 2, 2]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, data array<float>, label float, dim array<int>")


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def shards(n):
    out = {w: [] for w in range(WORKERS)}
    for i in range(n):
        out[int(digest(SEED, "shard", i)[:8], 16) % WORKERS].append(i)
    return out


def epoch_batches(members, until):
    """Batches of a shard, reshuffled each epoch, remainder dropped."""
    out, epoch = [], 0
    while len(out) < until:
        order = sorted(members, key=lambda i: digest(SEED, epoch, i))
        out += [order[b * BATCH:(b + 1) * BATCH] for b in range(len(order) // BATCH)]
        epoch += 1
    return out[:until]


def start(learner=LEARNER):
    return [np.zeros(s.size) for s in learner.layers()]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    x, y = planted(12)
    for learner in (LEARNER, ReluNet(D, 6, C)):
        params = [rng.normal(size=s.size) for s in learner.layers()]
        _, grads = learner.loss_and_gradients(params, x, y)
        for p, g in zip(params, grads):
            for i in range(len(p)):
                p[i] += 1e-6
                up = learner.loss_and_gradients(params, x, y)[0]
                p[i] -= 2e-6
                down = learner.loss_and_gradients(params, x, y)[0]
                p[i] += 1e-6
                assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_label_outside_the_classes_is_an_error():
    with pytest.raises(ValueError, match="label outside"):
        LEARNER.loss_and_gradients(start(), np.zeros((1, D)), np.array([3.0]))


def test_clipping_and_step_policy():
    solver = SolverParams(base_lr=1.0, max_iter=1, lr_policy="step", gamma=0.1, stepsize=2, clip_gradients=0.01)
    x, y = planted(12)
    params, velocity = start(), start()
    local_step(LEARNER, params, velocity, x, y, 2, solver)
    _, grads = LEARNER.loss_and_gradients(start(), x, y)
    norm = np.sqrt(sum(g @ g for g in grads))
    assert params[0] == pytest.approx(-0.1 * grads[0] * 0.01 / norm)
    assert params[1] == pytest.approx(-0.1 * 2 * grads[1] * 0.01 / norm)


def test_elastic_equals_a_loop(spark, tmp_path):
    x, y = planted(83)
    solver = SolverParams(base_lr=0.3, max_iter=11, momentum=0.9, weight_decay=0.01, batch_size=BATCH, snapshot=4, test_interval=4)
    params = ExchangeParams(period=3, moving_rate=0.4, decay_rate=0.5, decay_step=6, server_factor=0.8,
                            factor_decay_rate=0.5, factor_decay_step=4)
    df = frame(spark, x, y)
    trained = T.train_elastic(df, ["id"], WORKERS, LEARNER, solver, params, SEED, test=df, snapshots=str(tmp_path / "s"))

    rounds, per_round = round(11 / 3), 3
    batches = {w: epoch_batches(m, rounds * per_round) for w, m in shards(83).items()}
    centre = start()
    w_params, w_speed = ([start() for _ in range(WORKERS)] for _ in range(2))
    update, snaps, losses = 0, {}, []
    save_every, centre_step, factor_step = 4 * WORKERS // 3, 6 * WORKERS // 3, 4 * WORKERS // 3
    for r in range(rounds):
        for w in range(WORKERS):
            for t in range(r * 3, r * 3 + 3):
                rows = batches[w][t]
                losses.append(local_step(LEARNER, w_params[w], w_speed[w], x[rows], y[rows], t, solver)[0])
        for w in range(WORKERS):
            a = 0.4 * 0.5 ** (r // 2)
            b = 0.4 * 0.5 ** (update // centre_step) * 0.8 * 0.5 ** (update // factor_step)
            old = [c.copy() for c in centre]
            centre = [(1 - b) * c + b * p for c, p in zip(centre, w_params[w])]
            w_params[w] = [(1 - a) * p + a * c for p, c in zip(w_params[w], old)]
            update += 1
            if update % save_every == 0:
                snaps[update] = [c.copy() for c in centre]
    assert trained.updates == update == 12
    for got, want in zip(to_arrays(LEARNER, trained.centre), centre):
        assert got == pytest.approx(want)
    for w in range(WORKERS):
        mine = to_arrays(LEARNER, trained.workers.where(F.col("worker") == w))
        for got, want in zip(mine, w_params[w]):
            assert got == pytest.approx(want)
    for u, want in snaps.items():
        saved = to_arrays(LEARNER, load_weights(spark, trained.snapshots, f"state_iter_{u}.weight"))
        assert saved[0] == pytest.approx(want[0], abs=1e-6)
    log = trained.log.toPandas()
    assert sorted(log[log.kind == "loss"]["value"]) == pytest.approx(sorted(losses))
    tests = log[log.kind == "accuracy"].sort_values("update_no")
    assert list(tests["update_no"]) == [4, 8, 12]
    report = T.training_report(trained.log).first()
    assert report["accuracy"] == pytest.approx(tests["value"].iloc[-1]) and report["steps"] == len(losses)
    assert report["last_loss"] < report["first_loss"]


def test_same_seed_gives_the_same_weights(spark):
    x, y = planted(40)
    solver = SolverParams(base_lr=0.3, max_iter=4, batch_size=BATCH)
    runs = [T.train_elastic(frame(spark, x, y).repartition(n), ["id"], 2, LEARNER, solver, ExchangeParams(2, 0.3), SEED) for n in (1, 5)]
    first, second = (to_arrays(LEARNER, r.centre) for r in runs)
    assert all((a == b).all() for a, b in zip(first, second))


def test_shard_smaller_than_a_batch_is_an_error(spark):
    x, y = planted(5)
    with pytest.raises(ValueError, match="shard smaller"):
        T.train_elastic(frame(spark, x, y), ["id"], WORKERS, LEARNER, SolverParams(base_lr=1.0, max_iter=1), ExchangeParams(1, 0.1))


def test_delta_equals_a_loop(spark):
    n, k = 83, 2
    x, y = planted(n)
    solver = SolverParams(base_lr=0.2, max_iter=17, momentum=0.5, batch_size=BATCH)
    trained = T.train_delta(frame(spark, x, y), ["id"], WORKERS, k, LEARNER, solver, SEED)
    members = shards(n)
    pushes = {w: 17 * len(m) // n // k for w, m in members.items()}
    batches = {w: epoch_batches(m, pushes[w] * k) for w, m in members.items()}
    centre, speed = start(), {w: start() for w in range(WORKERS)}
    for r in range(max(pushes.values())):
        total = start()
        for w in range(WORKERS):
            if r >= pushes[w]:
                continue
            mine = [c.copy() for c in centre]
            for t in range(r * k, r * k + k):
                rows = batches[w][t]
                _, updates = local_step(LEARNER, mine, speed[w], x[rows], y[rows], t, solver)
                total = [a + u for a, u in zip(total, updates)]
        centre = [c - d for c, d in zip(centre, total)]
    for got, want in zip(to_arrays(LEARNER, trained.centre), centre):
        assert got == pytest.approx(want)
    assert trained.updates == sum(pushes.values())


def stored(spark, tmp_path, n, block_rows):
    x, y = planted(n, levels=6)
    path = str(tmp_path / "shards")
    materialise_shards(assign_workers(frame(spark, x, y), ["id"], WORKERS, SEED), "id", path, block_rows=block_rows)
    return x, y, read_shards(spark, path)


def cyclic(members, first, steps):
    at = [members[(first * BATCH + i) % len(members)] for i in range(steps * BATCH)]
    return [at[s * BATCH:(s + 1) * BATCH] for s in range(steps)]


def test_elastic_from_shards_equals_a_loop(spark, tmp_path):
    x, y, df = stored(spark, tmp_path, 50, block_rows=6)
    solver = SolverParams(base_lr=0.05, max_iter=12, momentum=0.5, batch_size=BATCH, snapshot=6)
    trained = T.train_elastic_from_shards(df, WORKERS, LEARNER, solver, ExchangeParams(4, 0.3), 6, SEED)
    members, centre = shards(50), start()
    w_params, w_speed = ([start() for _ in range(WORKERS)] for _ in range(2))
    for r in range(3):
        for w in range(WORKERS):
            for t, rows in enumerate(cyclic(members[w], r * 4, 4), r * 4):
                local_step(LEARNER, w_params[w], w_speed[w], x[rows], y[rows], t, solver)
                if (w, t) == (0, 5):
                    at_six = [p.copy() for p in w_params[0]]
        for w in range(WORKERS):
            old = [c.copy() for c in centre]
            centre = [0.7 * c + 0.3 * p for c, p in zip(centre, w_params[w])]
            w_params[w] = [0.7 * p + 0.3 * c for p, c in zip(w_params[w], old)]
    for got, want in zip(to_arrays(LEARNER, trained.centre), centre):
        assert got == pytest.approx(want)
    assert load_weights(spark, trained.snapshots, "state_worker_iter_6.weight").count() == 2
    for got, want in zip(to_arrays(LEARNER, load_weights(spark, trained.snapshots, "state_worker_iter_6.weight")), at_six):
        assert got == pytest.approx(want, abs=1e-5)


def test_a_round_opens_only_its_rows(spark, tmp_path):
    _, _, df = stored(spark, tmp_path, 50, block_rows=6)
    source = StoredShards(df, WORKERS, BATCH, block_rows=6)
    found = source.samples({w: 1 for w in range(WORKERS)}, {w: 1 for w in range(WORKERS)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(pos,4), LessThanOrEqual(pos,7)" in plan
    assert found.count() == WORKERS * BATCH


def test_spans_are_merged():
    assert _merged([(5, 9), (0, 3), (4, 4), (20, 25), (8, 12)]) == [(0, 12), (20, 25)]


def test_adaptive_equals_a_loop(spark, tmp_path):
    x, y, df = stored(spark, tmp_path, 50, block_rows=6)
    solver = SolverParams(base_lr=0.05, max_iter=23, momentum=0.5, batch_size=BATCH)
    trained = T.train_elastic_adaptive(df, WORKERS, LEARNER, solver, ExchangeParams(3, 0.3), 6, SEED)
    members, centre = shards(50), start()
    params, speed = ([start() for _ in range(WORKERS)] for _ in range(2))
    at, acc, cut = [0] * WORKERS, [0.0] * WORKERS, [-1.0] * WORKERS
    points = []
    while min(at) < 23:
        arriving = []
        for w in range(WORKERS):
            stop = min(at[w] + 6, 23)
            while at[w] < stop:
                rows = cyclic(members[w], at[w], 1)[0]
                acc[w] += local_step(LEARNER, params[w], speed[w], x[rows], y[rows], at[w], solver)[0]
                at[w] += 1
                due = at[w] == 3 or (cut[w] > 0 and acc[w] > cut[w]) or at[w] == 23
                if at[w] == 3:
                    cut[w] = acc[w]
                if due:
                    acc[w] = 0.0
                    arriving.append(w)
                    points.append((w, at[w]))
                    break
        for w in arriving:
            old = [c.copy() for c in centre]
            centre = [0.7 * c + 0.3 * p for c, p in zip(centre, params[w])]
            params[w] = [0.7 * p + 0.3 * c for p, c in zip(params[w], old)]
    for got, want in zip(to_arrays(LEARNER, trained.centre), centre):
        assert got == pytest.approx(want)
    log = trained.log.toPandas()
    assert sorted(map(tuple, log[log.kind == "exchange"][["worker", "iter"]].astype(int).values)) == sorted(points)


def test_slabs_of_any_size_agree(spark):
    x, y = planted(30)
    df = frame(spark, x, y)
    rng = np.random.default_rng(2)
    rows = [(0, 0, [float(v) for v in rng.normal(size=C * D)]), (1, 0, [float(v) for v in rng.normal(size=C)])]
    w = spark.createDataFrame(rows, "layer int, chunk int, values array<double>")
    small, large = ({r["id"]: r["scores"] for r in score(df, w, LEARNER, limit).collect()} for limit in (1 << 20, 0))
    for i in small:
        assert large[i] == pytest.approx(small[i])
    a, b = ({(r["layer"], r["chunk"]): r["values"] for r in gradient(df, w, LEARNER, limit).collect()} for limit in (1 << 20, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k])


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_rows_do_not_depend_on_the_size_of_the_model(spark, limit):
    w = init_weights(layer_table(spark, LEARNER.layers()), 3)
    data = [float(i) for i in range(D)]
    rows = [(None, data, 0.0), (1, data, 0.0), (1, data[::-1], 0.0)]
    df = spark.createDataFrame(rows, "id long, data array<float>, label float")
    found = [(r["id"], r["data"]) for r in score(df, w, LEARNER, limit).collect()]
    assert sorted(found, key=str) == sorted(((i, d) for i, d, _ in rows), key=str)
    with pytest.raises(Exception, match="values each"):
        score(spark.createDataFrame([(1, data[1:], 0.0)], df.schema), w, LEARNER, limit).collect()
    with pytest.raises(ValueError, match="expected"):
        score(df, w.where("layer = 0"), LEARNER, limit)


def test_samples_may_travel_as_bytes(spark):
    x, y = planted(60, levels=6)
    numbers = frame(spark, x, y)
    packed = spark.createDataFrame([(i, bytes(int(v) for v in row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "id long, data binary, label float")
    solver = SolverParams(base_lr=0.01, max_iter=4, batch_size=5)
    a, b = (T.train_elastic(df, ["id"], 2, LEARNER, solver, ExchangeParams(2, 0.4), SEED) for df in (numbers, packed))
    for got, want in zip(to_arrays(LEARNER, b.centre), to_arrays(LEARNER, a.centre)):
        assert got == pytest.approx(want)


def test_relu_scores_by_blocks(spark):
    net = ReluNet(D, 5, C)
    x, y = planted(20)
    df, w = frame(spark, x, y), init_weights(layer_table(spark, net.layers()), 3)
    small, large = ({r["id"]: r["scores"] for r in score(df, w, net, limit).collect()} for limit in (1 << 20, 0))
    for i in small:
        assert large[i] == pytest.approx(small[i])


def test_held_out_accuracy_beats_the_majority(spark):
    x, y = planted(400, seed=3)
    solver = SolverParams(base_lr=0.3, max_iter=20, momentum=0.9, batch_size=20)
    trained = T.train_elastic(frame(spark, x[:300], y[:300]), ["id"], 2, LEARNER, solver, ExchangeParams(5, 0.4), SEED)
    found = evaluate(frame(spark, x[300:], y[300:]), trained.centre, LEARNER, ks=(1, 2)).first()
    assert found["accuracy_1"] > np.bincount(y[300:]).max() / 100 + 0.1
    assert found["accuracy_2"] >= found["accuracy_1"]


def test_fillers_do_not_depend_on_the_chunks(spark):
    layers = layer_table(spark, ReluNet(50, 40, 3).layers())
    whole = to_arrays(ReluNet(50, 40, 3), init_weights(layers, 1))
    pieces = to_arrays(ReluNet(50, 40, 3), init_weights(layers, 1, chunk=64))
    assert all((a == b).all() for a, b in zip(whole, pieces))
    reach = (3 / 50) ** 0.5
    assert abs(whole[0]).max() <= reach and whole[0].std() == pytest.approx(reach / 3**0.5, rel=0.05)
    assert whole[2].std() == pytest.approx(0.1, rel=0.25)


