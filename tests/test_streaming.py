import pytest
from pyspark.sql import functions as F

from elastrain.operators.aggregates import period_loss
from elastrain.operators.weights import fold_exchanges
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.sources.stores import load_weights
from elastrain.streaming.centre import CentreStore, fold_batch, stream_centre
from elastrain.streaming.metrics import stream_log_metrics

PARAMS = ExchangeParams(period=2, moving_rate=0.5, decay_rate=0.5, decay_step=4)
SOLVER = SolverParams(base_lr=0.1, max_iter=1, snapshot=2, test_interval=3)
WORKERS = 2


def arrivals(spark, low, high):
    rows = [(s, layer, 0, [float(s * 7 % 5), float(s + layer)]) for s in range(low, high) for layer in (0, 1)]
    return spark.createDataFrame(rows, "seq long, layer int, chunk int, values array<double>")


def loop(n):
    centre = {0: [1.0, 1.0], 1: [1.0, 1.0]}
    versions = {}
    for s in range(n):
        b = 0.5 * 0.5 ** (s // 4)
        for layer, c in centre.items():
            x = [float(s * 7 % 5), float(s + layer)]
            centre[layer] = [(1 - b) * p + b * q for p, q in zip(c, x)]
        versions[s + 1] = {k: list(v) for k, v in centre.items()}
    return versions


def begin(spark, path):
    store = CentreStore(spark, path)
    store.start(spark.createDataFrame([(0, 0, [1.0, 1.0]), (1, 0, [1.0, 1.0])], "layer int, chunk int, values array<double>"))
    return store


def found(df):
    return {r["layer"]: r["values"] for r in df.collect()}


def test_stream_in_two_goes_equals_the_loop(spark, tmp_path):
    source, store = str(tmp_path / "in"), begin(spark, str(tmp_path / "centre"))
    tests = {}

    def on_test(update, centre):
        tests[update] = found(centre)

    for low, high in ((0, 5), (5, 9)):
        arrivals(spark, low, high).write.mode("append").parquet(source)
        stream_centre(spark, source, store, str(tmp_path / "progress"), PARAMS, SOLVER, WORKERS, on_test=on_test, snapshots=str(tmp_path / "snaps"))
    centre, updates = store.before()
    versions = loop(9)
    assert updates == 9
    for layer, values in found(centre).items():
        assert values == pytest.approx(versions[9][layer])
    assert sorted(tests) == [3, 6, 9]
    for u, seen in tests.items():
        for layer in (0, 1):
            assert seen[layer] == pytest.approx(versions[u][layer])
    saved = load_weights(spark, str(tmp_path / "snaps" / "batch=1"), "state_iter_6.weight")
    assert found(saved)[1] == pytest.approx(versions[6][1], abs=1e-5)


def test_replayed_batch_counts_once(spark, tmp_path):
    store = begin(spark, str(tmp_path / "centre"))
    for _ in range(2):
        centre, updates = store.before(0)
        after, numbered = fold_batch(arrivals(spark, 0, 4), centre, updates, PARAMS, WORKERS)
        store.put(after, updates + numbered.count(), 0)
    centre, updates = store.before()
    assert updates == 4 and found(centre)[0] == pytest.approx(loop(4)[4][0])


def test_stream_equals_the_batch_fold(spark, tmp_path):
    constant = ExchangeParams(period=2, moving_rate=0.3)
    source, store = str(tmp_path / "in"), begin(spark, str(tmp_path / "centre"))
    rows = arrivals(spark, 0, 6)
    rows.write.parquet(source)
    stream_centre(spark, source, store, str(tmp_path / "progress"), constant, SOLVER, WORKERS)
    start = store.before(0)[0]
    workers = rows.withColumn("worker", F.col("seq").cast("int")).withColumns({"a": F.lit(0.3), "b": F.lit(0.3)})
    batch = fold_exchanges(workers, start).select("layer", "chunk", F.col("centre").alias("values"))
    got, want = found(store.before()[0]), found(batch)
    for layer in (0, 1):
        assert got[layer] == pytest.approx(want[layer])


def test_last_arrival_wins_at_coefficient_one(spark, tmp_path):
    store = begin(spark, str(tmp_path / "centre"))
    after, _ = fold_batch(arrivals(spark, 0, 5), store.before()[0], 0, ExchangeParams(1, 1.0), WORKERS)
    assert found(after)[1] == [float(4 * 7 % 5), 5.0]


def test_log_metrics_grow_with_the_log(spark, tmp_path):
    def log(low, high):
        rows = [(w, i, float(i % 7), i) for w in (0, 1) for i in range(low, high)]
        return spark.createDataFrame(rows, "worker long, iter long, loss double, ms long")

    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for low, high in ((1, 8), (8, 13)):
        log(low, high).write.mode("append").parquet(source)
        got = stream_log_metrics(spark, source, out, progress, 5).orderBy("worker", "span").collect()
        want = period_loss(log(1, high), 5).orderBy("worker", "span").collect()
        assert got == want


def test_coefficient_above_one_equals_the_plain_fold(spark, tmp_path):
    params = ExchangeParams(period=2, moving_rate=0.9, server_factor=2.0)
    start = begin(spark, str(tmp_path / "centre")).before()[0]
    rows = arrivals(spark, 0, 5)
    after, _ = fold_batch(rows, start, 0, params, WORKERS)
    workers = rows.withColumn("worker", F.col("seq").cast("int")).withColumns({"a": F.lit(0.9), "b": F.lit(1.8)})
    want = found(fold_exchanges(workers, start).select("layer", "chunk", F.col("centre").alias("values")))
    for layer, values in found(after).items():
        assert values == pytest.approx(want[layer])


def test_an_arrival_in_part_is_an_error(spark, tmp_path):
    start = begin(spark, str(tmp_path / "centre")).before()[0]
    rows = arrivals(spark, 0, 3)
    for broken in (rows.where("NOT (seq = 1 AND layer = 1)"), rows.union(rows.where("seq = 2 AND layer = 0"))):
        with pytest.raises(ValueError, match="arrival"):
            fold_batch(broken, start, 0, PARAMS, WORKERS)


def test_updates_seen_in_the_middle_of_a_batch(spark, tmp_path):
    source, store = str(tmp_path / "in"), begin(spark, str(tmp_path / "centre"))
    arrivals(spark, 0, 7).write.parquet(source)
    tests = {}
    stream_centre(spark, source, store, str(tmp_path / "progress"), PARAMS, SOLVER, WORKERS, updates_only=True,
                  on_test=lambda update, centre: tests.update({update: found(centre)}))
    for update in (3, 6):
        assert tests[update][1] == [1.0 - sum(s * 7 % 5 for s in range(update)), 1.0 - sum(s + 1 for s in range(update))]
    assert found(store.before()[0])[1][1] == 1.0 - sum(s + 1 for s in range(7))


def test_a_batch_replayed_through_the_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), begin(spark, str(tmp_path / "centre"))
    arrivals(spark, 0, 6).write.parquet(source)
    for attempt in ("first", "again"):  # a fresh progress folder makes the stream hand out batch 0 again
        stream_centre(spark, source, store, str(tmp_path / attempt), PARAMS, SOLVER, WORKERS, snapshots=str(tmp_path / "snaps"))
        centre, updates = store.before()
        assert updates == 6 and found(centre)[0] == pytest.approx(loop(6)[6][0])
    saved = load_weights(spark, str(tmp_path / "snaps" / "batch=0"), "state_iter_4.weight")
    assert found(saved)[1] == pytest.approx(loop(6)[4][1], abs=1e-5)


def test_metrics_without_new_entries(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([(0, i, 1.0, i) for i in range(1, 8)], "worker long, iter long, loss double, ms long").write.parquet(source)
    first = stream_log_metrics(spark, source, out, progress, 5).orderBy("span").collect()
    assert stream_log_metrics(spark, source, out, progress, 5).orderBy("span").collect() == first and len(first) == 2


def test_an_arrival_split_over_micro_batches_counts_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), begin(spark, str(tmp_path / "centre"))
    rows, tests, seen = arrivals(spark, 0, 7), {}, []
    parts = [
        rows.where("seq < 3 OR (seq = 3 AND layer = 0)"),  # layer 1 of arrival 3 comes later
        rows.where("seq = 5"),  # before its turn
        rows.where("(seq = 3 AND layer = 1) OR seq = 4 OR (seq = 2 AND layer = 0)"),  # completes 3; a part of 2 again
        rows.where("seq = 6 OR seq = 5"),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream_centre(spark, source, store, str(tmp_path / "progress"), PARAMS, SOLVER, WORKERS,
                      on_test=lambda u, c: tests.update({u: found(c)}), snapshots=str(tmp_path / "snaps"))
        seen.append(store.before()[1])
    # The stored centre stays at the last update at which all blocks stood at the end of a micro-batch.
    assert seen == [0, 0, 6, 7]
    versions = loop(7)
    assert sorted(tests) == [3, 6]
    for update, centre in {**tests, 7: found(store.before()[0])}.items():
        for layer in (0, 1):
            assert centre[layer] == pytest.approx(versions[update][layer])
    assert found(load_weights(spark, str(tmp_path / "snaps" / "batch=2"), "state_iter_4.weight"))[1] == pytest.approx(versions[4][1], abs=1e-5)


def test_micro_batches_of_any_cut_and_order_give_one_centre(spark, tmp_path):
    rows = arrivals(spark, 0, 40).orderBy(F.xxhash64("seq", "layer"))
    want = loop(40)[40]
    for files in (1, 3):
        base = tmp_path / str(files)
        source, store = str(base / "in"), begin(spark, str(base / "centre"))
        rows.repartition(5).write.parquet(source)
        stream_centre(spark, source, store, str(base / "progress"), PARAMS, SOLVER, WORKERS, files_per_batch=files)
        centre, updates = store.before()
        assert updates == 40
        for layer in (0, 1):
            assert found(centre)[layer] == pytest.approx(want[layer])


def test_parts_before_their_turn_leave_memory():
    from elastrain.streaming.blocks import BlockCentre, Decay

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Map(dict):
        most = 0

        def getValue(self, key):  # noqa: N802
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value
            self.most = max(self.most, len(self))

        def removeKey(self, key):  # noqa: N802
            del self[key]

    import numpy as np
    import pandas as pd

    block = BlockCentre((Decay(0.5, 0.5, 4, -1), Decay(1.0, 1.0, 0, -1)), (3,), held=6)
    block.centre, block.early = Value(), Map()
    block.handleInitialState((0, 0), pd.DataFrame({"values": [[1.0, 1.0]], "updates": [0]}), None)
    order = [*range(8, 0, -1), 0]
    frames = [pd.DataFrame({"seq": [s], "values": [np.array([float(s * 7 % 5), float(s)])]}) for s in order]
    out = pd.concat(block.handleInputRows((0, 0), iter(frames), None))
    assert block.early.most >= 6 and not block.early
    got = {(r.kind, r.update_no): list(r.values_) for r in out.rename(columns={"values": "values_"}).itertuples()}
    want = loop(9)
    assert sorted(got) == [("due", 3), ("due", 6), ("due", 9), ("latest", 9)]
    assert all(v == pytest.approx(want[u][0]) for (_, u), v in got.items())
    with pytest.raises(ValueError, match="Size mismatch"):
        list(block.handleInputRows((0, 0), iter([pd.DataFrame({"seq": [9], "values": [np.zeros(3)]})]), None))
