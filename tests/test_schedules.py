"""Schedules and exchange points against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from elastrain.functions import schedules as H
from elastrain.operators.adaptive_sync import adaptive_sync_points
from elastrain.schema import ExchangeParams, SolverParams


def loop_rates(start, rate, step, limit, n):
    """The rate before each exchange, decayed as a running value."""
    out, left = [], limit
    for i in range(n):
        if step > 0 and i != 0 and left != 0 and i % step == 0:
            left -= 1
            start *= rate
        out.append(start)
    return out


@pytest.mark.parametrize("step, limit", [(0, -1), (-1, 3), (1, -1), (3, 2), (3, 0), (4, -1)])
def test_decay_equals_a_running_value(spark, step, limit):
    got = [r[0] for r in spark.range(30).select(H.decayed(F.col("id"), 0.8, 0.5, step, limit)).collect()]
    assert got == pytest.approx(loop_rates(0.8, 0.5, step, limit, 30))


def test_short_step_is_off_with_a_warning():
    with pytest.warns(UserWarning, match="it is off"):
        assert H.whole_steps(3, 1, 5) == 0
    assert H.whole_steps(30, 4, 5) == 24 and H.whole_steps(-1, 4, 5) == 0


def test_rounds_round_halves_up(spark):
    got = [r[0] for r in spark.range(0, 12).select(H.rounds_of(F.col("id"), 4)).collect()]
    assert got == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3]


def test_lr_policies(spark):
    got = [r[0] for r in spark.range(5).select(H.lr_at(F.col("id"), 1.0, "step", 0.5, 2)).collect()]
    assert got == [1.0, 1.0, 0.5, 0.5, 0.25]
    with pytest.raises(ValueError):
        H.lr_at(F.lit(1), 1.0, "poly")


def test_settings_are_checked():
    with pytest.raises(ValueError):
        ExchangeParams(period=0, moving_rate=0.1)
    with pytest.raises(TypeError):
        ExchangeParams(period=1)
    with pytest.raises(ValueError):
        SolverParams(base_lr=1.0, max_iter=1, lr_policy="inv")


def loop_points(losses, period):
    """(exchange, iter, steps, loss sum, final) by one pass over the losses in billionths."""
    cut, acc, last, out = -1, 0, 0, []
    for i, loss in enumerate(losses, 1):
        acc += round(loss * 10**9)
        if i == period:
            cut = acc
            out.append((len(out) + 1, i, i - last, acc, False))
            acc, last = 0, i
        if cut > 0 and acc > cut:
            out.append((len(out) + 1, i, i - last, acc, False))
            acc, last = 0, i
    if last != len(losses):
        out.append((len(out) + 1, len(losses), len(losses) - last, acc, True))
    return out


@pytest.mark.parametrize("block_rows", [1, 3, 7, 50, 1000])
@pytest.mark.parametrize("period", [1, 5, 8])
def test_adaptive_points_do_not_depend_on_the_blocks(spark, block_rows, period):
    rng = random.Random(block_rows * 100 + period)
    logs = {
        0: [rng.choice([0.0, 0.01, 1.0, 2.5, 40.0]) for _ in range(150)],
        1: [rng.uniform(0, 3) * 0.97**i for i in range(60)],
        2: [0.0] * 20,
        3: [1.0] * 3,
        4: [2.0] * period,
        5: [5.0] * period + [0.0] * 30,
        6: [0.25] * 41,
        7: [0.0] * period + [3.0] * 10,
    }
    rows = [(w, i, x) for w, xs in logs.items() for i, x in enumerate(xs, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "worker long, iter long, loss double")
    found = {}
    for r in adaptive_sync_points(df, period, block_rows).orderBy("worker", "exchange").collect():
        found.setdefault(r["worker"], []).append((r["exchange"], r["iter"], r["steps"], round(r["loss_sum"] * 10**9), r["final"]))
    assert found == {w: loop_points(xs, period) for w, xs in logs.items()}
    for w, points in found.items():
        assert points[-1][1] == len(logs[w]) or points[-1][4] is False


def test_negative_loss_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, -1.0)], "worker long, iter long, loss double")
    with pytest.raises(Exception, match="negative loss"):
        adaptive_sync_points(df, 5).collect()


def points_of(spark, logs, period, **sizes):
    rows = [(w, i, x) for w, xs in logs.items() for i, x in enumerate(xs, 1)]
    df = spark.createDataFrame(rows, "worker long, iter long, loss double")
    found = {}
    for r in adaptive_sync_points(df, period, **sizes).orderBy("worker", "exchange").collect():
        found.setdefault(r["worker"], []).append((r["exchange"], r["iter"], r["steps"], r["loss_sum"], r["final"]))
    return found


def exact(logs, period):
    return {w: [(*p[:3], p[3] / 10**9, p[4]) for p in loop_points(xs, period)] for w, xs in logs.items()}


@pytest.mark.parametrize("block_rows, fan", [(1, 2), (3, 2), (5, 4), (2, 3)])
def test_adaptive_points_by_a_tree_of_several_levels(spark, block_rows, fan):
    rng = random.Random(block_rows * 10 + fan)
    logs = {
        0: [rng.choice([0.0, 0.01, 1.0, 2.5, 40.0]) for _ in range(300)],
        1: [rng.uniform(0, 3) * 0.99**i for i in range(200)],
        2: [0.0] * 70, 3: [1.0] * 3, 4: [0.25] * 130, 5: [5.0] * 7 + [0.0] * 90, 6: [0.001] * 40 + [7.0, 0.0] * 60}
    assert points_of(spark, logs, 7, block_rows=block_rows, fan=fan) == exact(logs, 7)


def test_one_outlier_among_ordinary_losses(spark):
    rng = random.Random(3)
    losses = [rng.uniform(0.5, 1.5) for _ in range(4000)]
    losses[1234] = 1e8
    for period in (10, 2000):
        assert points_of(spark, {0: losses}, period, block_rows=500, fan=3) == exact({0: losses}, period)


@pytest.mark.parametrize("loss", [9.2e9, 1e10, 1.5e17, 1e25])
def test_losses_beyond_64_bits(spark, loss):
    logs = {0: [loss * (1 + i % 3) for i in range(90)], 1: [1.0] * 30 + [loss] + [1.0] * 30, 2: [loss] * 4 + [1.0] * 50}
    found, want = (f(logs) for f in (lambda x: points_of(spark, x, 4, block_rows=7, fan=2), lambda x: exact(x, 4)))
    assert {w: [(*p[:3], p[4]) for p in ps] for w, ps in found.items()} == {w: [(*p[:3], p[4]) for p in ps] for w, ps in want.items()}
    for w, points in found.items():
        assert [p[3] for p in points] == pytest.approx([p[3] for p in want[w]], rel=1e-12)


def test_adaptive_points_of_very_large_losses(spark):
    loss, period, n = 3e8, 5, 40
    df = spark.createDataFrame([(0, i, loss) for i in range(1, n + 1)], "worker long, iter long, loss double")
    got = [(r["iter"], r["final"]) for r in adaptive_sync_points(df, period).orderBy("exchange").collect()]
    want, total, cut = [(period, False)], 0.0, period * loss
    for i in range(period + 1, n + 1):
        total += loss
        if total > cut:
            want.append((i, False))
            total = 0.0
    assert got == want + ([(n, True)] if want[-1][0] < n else [])
