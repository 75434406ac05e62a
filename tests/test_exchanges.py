"""The scan of a round's exchanges against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from elastrain.operators import exchanges as E
from elastrain.operators.weights import fold_exchanges

SCHEMA = "worker int, layer int, chunk int, values array<double>, a double, b double"


def made(n, blocks=2, width=3, away=(), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(w, 0, c, [float(v) for v in rng.normal(size=width)], float(rng.uniform(0, 1)), float(rng.uniform(-0.2, 1.2)))
            for w in range(n) if w not in away for c in range(blocks)]
    return rows, [(0, c, [float(v) for v in rng.normal(size=width)]) for c in range(blocks)]


def loop(rows, centre, due):
    """Rows of the scan, worker after worker."""
    now, out = {(layer, c): np.array(v) for layer, c, v in centre}, {}
    workers = {}
    for w, layer, c, v, a, b in rows:
        workers.setdefault(w, []).append(((layer, c), np.array(v), a, b))
    for w in range(max([*workers, *due]) + 1):
        for block, x, a, b in workers.get(w, []):
            out["met", *block, w] = (1 - a) * x + a * now[block]
            now[block] = (1 - b) * now[block] + b * x
        if w in due:
            out |= {("centre", *block, w): v.copy() for block, v in now.items()}
    return out


def scanned(spark, rows, centre, n, due=()):
    df = E.exchange_scan(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(centre, "layer int, chunk int, values array<double>"), n, due)
    return {tuple(r)[:4]: np.array(r["values"]) for r in df.collect()}


def agree(got, want):
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("run", [1, 3, 64])
def test_runs_of_any_length(spark, monkeypatch, run):
    monkeypatch.setattr(E, "RUN", run)
    away = (0, 3, 4, 5, 10)
    rows, centre = made(11, away=away, seed=run)
    agree(scanned(spark, rows, centre, 11, (2, 4, 7)), loop(rows, centre, {2, 4, 7, 10}))


def test_two_thousand_workers(spark):
    rows, centre = made(2000, blocks=1, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    rows = sorted(rows)
    got = {tuple(r)[:4]: np.array(r["values"]) for r in E.exchange_scan(
        df, spark.createDataFrame(centre, "layer int, chunk int, values array<double>"), 2000, (999,)).collect()}
    agree(got, loop(rows, centre, {999, 1999}))


def test_a_round_without_arrivals_leaves_the_centre(spark):
    rows, centre = made(3)
    df = spark.createDataFrame(rows, SCHEMA).where("false")
    for n in (2, 200):
        got = E.exchange_scan(df, spark.createDataFrame(centre, "layer int, chunk int, values array<double>"), n).collect()
        assert sorted((r["kind"], r["worker"], r["chunk"], r["values"]) for r in got) == [("centre", n - 1, c, v) for _, c, v in centre]


@pytest.mark.parametrize("n", [2, 130])
def test_other_shapes_are_errors(spark, n):
    rows, centre = made(n)
    centres = spark.createDataFrame(centre, "layer int, chunk int, values array<double>")
    wrong = spark.createDataFrame([*rows[:-1], (*rows[-1][:3], [1.0], 0.1, 0.1)], SCHEMA)
    strange = spark.createDataFrame([*rows, (1, 7, 0, [1.0], 0.1, 0.1)], SCHEMA)
    for df in (wrong, strange):
        with pytest.raises(Exception, match="Size mismatch"):
            E.exchange_scan(df, centres, n).collect()


def test_by_block(spark):
    rows, centre = made(5)
    got = fold_exchanges(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(centre, "layer int, chunk int, values array<double>"))
    want = loop(rows, centre, {4})
    for r in got.collect():
        assert r["centre"] == pytest.approx(list(want["centre", r["layer"], r["chunk"], 4]))
        assert [m["worker"] for m in r["met"]] == list(range(5))
        for m in r["met"]:
            assert m["values"] == pytest.approx(list(want["met", r["layer"], r["chunk"], m["worker"]]))
    assert got.where(F.size("met") != 5).count() == 0
