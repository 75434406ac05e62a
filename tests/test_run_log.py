"""The log of a run as it happens, and runs that go on."""

import pytest
from pyspark.sql import functions as F
from test_training import BATCH, LEARNER, SEED, WORKERS, frame, planted, stored

from elastrain.plans import training as T
from elastrain.plans.run_log import RunLog, read_run_log
from elastrain.plans.scoring import to_arrays
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.sources.stores import load_weights
from elastrain.streaming.metrics import stream_update_counts

PARAMS = ExchangeParams(period=3, moving_rate=0.4, decay_rate=0.5, decay_step=6, server_factor=0.8, factor_decay_rate=0.5, factor_decay_step=4)
SOLVER = SolverParams(base_lr=0.3, max_iter=12, momentum=0.9, batch_size=BATCH, snapshot=4, test_interval=4)


class Killed(Exception):
    pass


def kill_at(monkeypatch, round_no):
    """A run whose driver dies after the tables of a round are written, before the round is closed."""
    whole = RunLog.close_round

    def close_round(self, number, *rest):
        if number == round_no:
            raise Killed
        whole(self, number, *rest)

    monkeypatch.setattr(RunLog, "close_round", close_round)


def lines(log):
    """What does not depend on the clock."""
    rows = log.where("kind <> 'step_ms'").select("worker", "update_no", "iter", "kind", F.round("value", 9).alias("value")).collect()
    return sorted(map(tuple, rows), key=str)


def same(one, other):
    assert one.updates == other.updates
    for got, want in zip(to_arrays(LEARNER, one.centre), to_arrays(LEARNER, other.centre)):
        assert got == pytest.approx(want, abs=1e-12)
    state = [sorted((r.worker, r.layer, r.chunk, tuple(r["values"]), tuple(r.velocity)) for r in t.workers.collect()) for t in (one, other)]
    for got, want in zip(*state):
        assert got[:3] == want[:3] and got[3] == pytest.approx(want[3]) and got[4] == pytest.approx(want[4])
    assert lines(one.log) == lines(other.log)


def check(monkeypatch, run, folder, whole_folder, after=2):
    with monkeypatch.context() as m:
        kill_at(m, after)
        with pytest.raises(Killed):
            run(folder)
    same(run(folder), run(whole_folder))


def test_elastic_goes_on_after_the_last_whole_round(spark, tmp_path, monkeypatch):
    x, y = planted(83)
    df = frame(spark, x, y)

    def run(folder):
        return T.train_elastic(df, ["id"], WORKERS, LEARNER, SOLVER, PARAMS, SEED, test=df, folder=folder)

    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    check(monkeypatch, run, one, other)
    for update in (4, 8, 12):
        tag = f"state_iter_{update}.weight"
        got, want = (to_arrays(LEARNER, load_weights(spark, f"{f}/snapshots", tag)) for f in (one, other))
        assert got[0] == pytest.approx(want[0])
    again = run(one)  # nothing is left to do
    assert again.updates == 4 * WORKERS and lines(again.log) == lines(read_run_log(spark, f"{one}/log"))
    with pytest.raises(ValueError, match="other settings"):
        T.train_elastic(df, ["id"], WORKERS, LEARNER, SOLVER, PARAMS, SEED + 1, folder=one)

    log = again.log.toPandas()
    update_centre, factor = [], []
    for u in range(4 * WORKERS):
        update_centre.append(0.4 * 0.5 ** (u // (6 * WORKERS // 3)))
        factor.append(0.8 * 0.5 ** (u // (4 * WORKERS // 3)))
    exchanges = log[log.kind == "exchange"].sort_values("update_no")
    assert list(exchanges["update_no"]) == list(range(1, 4 * WORKERS + 1))
    assert list(exchanges["value"]) == pytest.approx([a * b for a, b in zip(update_centre, factor)])
    for kind, values in (("decay", update_centre), ("factor_decay", factor)):
        fallen = log[log.kind == kind].sort_values("update_no")
        assert list(fallen["update_no"]) == [u + 1 for u in range(1, len(values)) if values[u] != values[u - 1]]
    counted = stream_update_counts(spark, f"{one}/log", str(tmp_path / "counts"), str(tmp_path / "progress")).collect()
    assert {r.worker for r in counted} == set(range(WORKERS)) and {r.updates for r in counted} == {4 * WORKERS}


def test_more_iterations_go_on_from_the_stored_rounds(spark, tmp_path):
    x, y = planted(60)
    df = frame(spark, x, y)

    def run(iterations, folder):
        solver = SolverParams(base_lr=0.3, max_iter=iterations, momentum=0.9, batch_size=BATCH)
        return T.train_elastic(df, ["id"], WORKERS, LEARNER, solver, PARAMS, SEED, folder=folder)

    run(6, str(tmp_path / "one"))
    same(run(12, str(tmp_path / "one")), run(12, str(tmp_path / "other")))


def test_adaptive_goes_on(spark, tmp_path, monkeypatch):
    _, _, df = stored(spark, tmp_path, 50, block_rows=6)
    solver = SolverParams(base_lr=0.05, max_iter=14, momentum=0.5, batch_size=BATCH, snapshot=5)

    def run(folder):
        return T.train_elastic_adaptive(df, WORKERS, LEARNER, solver, ExchangeParams(3, 0.3), 6, SEED, folder=folder)

    check(monkeypatch, run, str(tmp_path / "one"), str(tmp_path / "other"))


def test_delta_goes_on(spark, tmp_path, monkeypatch):
    x, y = planted(70)
    df = frame(spark, x, y)

    def run(folder):
        solver = SolverParams(base_lr=0.1, max_iter=24, momentum=0.9, batch_size=BATCH)
        return T.train_delta(df, ["id"], WORKERS, 2, LEARNER, solver, SEED, test=df, folder=folder)

    check(monkeypatch, run, str(tmp_path / "one"), str(tmp_path / "other"), after=1)
