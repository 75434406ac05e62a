import pytest
from pyspark.sql import functions as F

from elastrain.operators.weights import chunked
from elastrain.plans import apps
from elastrain.plans.learners import LinearSoftmax
from elastrain.plans.parameters import init_weights, layer_table
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.sources import files, shards, stores
from elastrain.sources.tables import from_rows, worker_table, zero_samples


@pytest.mark.parametrize("line", ["1\t2\t3\t4", "1\t2\t3\t4\t5\t6"])
def test_lines_of_another_width_are_an_error(spark, tmp_path, line):
    (tmp_path / "x.txt").write_text("1\t2\t3\t4\t0\n" + line + "\n")
    with pytest.raises(Exception, match="expected 5 columns"):
        files.scan_tsv_images(spark, str(tmp_path / "x.txt"), (1, 2, 2)).collect()


def test_binary_records(spark, tmp_path):
    path = tmp_path / "x.bin"
    path.write_bytes(bytes([3, 0, 255, 10, 20, 4, 1, 2, 3, 4]))
    rows = files.scan_binary_images(spark, str(path), (1, 2, 2)).orderBy("id").collect()
    assert [(r["label"], r["data"]) for r in rows] == [(3.0, [0.0, 255.0, 10.0, 20.0]), (4.0, [1.0, 2.0, 3.0, 4.0])]
    path.write_bytes(bytes([3, 0, 255, 10, 20, 4]))
    with pytest.raises(ValueError, match="whole number"):
        files.scan_binary_images(spark, str(path), (1, 2, 2))


def test_records_do_not_depend_on_the_tasks(spark, tmp_path):
    for folder, first, n in (("a", 0, 37), ("b", 100, 1), ("c", 50, 20)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.bin").write_bytes(b"".join(bytes([(first + i) % 10, i, 255 - i, 7, first]) for i in range(n)))
    (tmp_path / "b" / "empty.bin").write_bytes(b"")
    want = {f"{f}/x.bin:{i}": (float((first + i) % 10), [float(i), 255.0 - i, 7.0, float(first)])
            for f, first, n in (("a", 0, 37), ("b", 100, 1), ("c", 50, 20)) for i in range(n)}
    for task_bytes, tasks in ((1, 58), (35, 10), (2**27, 3)):
        df = files.scan_binary_images(spark, str(tmp_path), (1, 2, 2), task_bytes)
        assert df.rdd.getNumPartitions() == tasks
        assert {r["id"]: (r["label"], r["data"]) for r in df.collect()} == want and df.count() == len(want)
        assert "RDD" not in df._jdf.queryExecution().executedPlan().toString()
    labels = files.scan_binary_images(spark, str(tmp_path), (1, 2, 2), columns=("id", "label"))
    assert labels.columns == ["id", "label", "dim"] and {r["id"]: r["label"] for r in labels.collect()} == {k: v[0] for k, v in want.items()}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.bin").write_bytes(b"")
    assert files.scan_binary_images(spark, str(tmp_path / "none"), (1, 2, 2)).collect() == []


@pytest.fixture
def split_bytes(spark):
    """Sets the size at which files are split."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, split_bytes):
    for folder, n in (("a", 300), ("b", 1), ("c", 150)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.txt").write_text("".join(f"{i}\t{'9' * (i % 7 + 1)}\t{i % 3}\n" for i in range(n)))
    want = {f"{f}/x.txt:{i}": [float(i), float("9" * (i % 7 + 1))] for f, n in (("a", 300), ("b", 1), ("c", 150)) for i in range(n)}
    for size in ("64", "1000", "128m"):
        split_bytes(size)
        df = files.scan_tsv_images(spark, str(tmp_path / "in"), (1, 1, 2))
        assert {r["id"]: r["data"] for r in df.collect()} == want and df.count() == len(want)
    split_bytes("64")
    with pytest.raises(Exception, match="split in another way"):
        df.collect()
        files.scan_tsv_images(spark, str(tmp_path / "in"), (1, 1, 2))
        split_bytes("1000")
        df.select("id").collect()


def test_one_file_and_no_lines(spark, tmp_path):
    (tmp_path / "x.txt").write_text("1\t2\t0\n3\t4\t1\n")
    rows = files.scan_tsv_images(spark, str(tmp_path / "x.txt"), (1, 1, 2)).orderBy("id").collect()
    assert [(r["id"], r["data"], r["label"]) for r in rows] == [("x.txt:0", [1.0, 2.0], 0.0), ("x.txt:1", [3.0, 4.0], 1.0)]
    (tmp_path / "empty.txt").write_text("")
    assert files.scan_tsv_images(spark, str(tmp_path / "empty.txt"), (1, 1, 2)).collect() == []


def test_worker_table_has_a_partition_per_worker(spark):
    df = worker_table(spark, 5)
    assert df.rdd.getNumPartitions() == 5 and [r["worker"] for r in df.orderBy("worker").collect()] == list(range(5))


def test_rows_and_zero_samples(spark):
    df = from_rows(spark, [(1, [1.0], 2.0, [1, 1, 1])], 2)
    assert df.count() == 1 and df.is_cached
    df.unpersist()
    zeros = zero_samples(spark.range(3), (1, 2, 2)).collect()
    assert len(zeros) == 6 and all(r["data"] == [0.0] * 4 and r["label"] == 0.0 for r in zeros)


def test_shards_are_blocks_in_order(spark, tmp_path):
    rows = [(i, i % 2, [float(i), 300.0], float(i % 3), [1, 1, 2]) for i in range(25)]
    df = spark.createDataFrame(rows, "ord long, worker int, data array<double>, label float, dim array<int>")
    path = str(tmp_path / "s")
    shards.materialise_shards(df, "ord", path, block_rows=5)
    got = shards.read_shards(spark, path).orderBy("worker", "key").collect()
    assert [(r["worker"], r["key"]) for r in got] == [(w, f"{i:08d}") for w in (0, 1) for i in range(13 - w)]
    assert all(r["block"] == r["pos"] // 5 and r["data"] == [2.0 * r["pos"] + r["worker"], 44.0] for r in got)
    assert [r["key"] for r in shards.list_keys(spark, path).where("worker = 1").collect()] == [f"{i:08d}" for i in range(12)]
    plan = shards.read_shards(spark, path).where("worker = 1 AND block = 2").select("label")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(worker" in plan and "data" not in plan.split("ReadSchema")[1]


def test_a_tag_is_saved_once(spark, tmp_path):
    w = chunked(spark.createDataFrame([(0, [1.0, 2.0])], "layer int, values array<double>"))
    stores.save_weights(w, str(tmp_path), "a")
    with pytest.raises(Exception, match="exists"):
        stores.save_weights(w, str(tmp_path), "a")
    apps.copy_weights(spark, str(tmp_path), "a", str(tmp_path), "b")
    assert stores.load_weights(spark, str(tmp_path), "b").first()["values"] == [1.0, 2.0]


def test_named_weights_become_a_list(spark, tmp_path):
    nets = spark.createDataFrame([(0, "conv"), (1, "ip")], "layer_pos int, name string")
    named = spark.createDataFrame([("ip", 0, [1.0]), ("conv", 0, [2.0, 3.0]), ("conv", 1, [4.0])], "name string, blob_no int, values array<double>")
    apps.convert_named_weights(nets, named, str(tmp_path), "c")
    rows = stores.load_weights(spark, str(tmp_path), "c").orderBy("layer").collect()
    assert [r["values"] for r in rows] == [[2.0, 3.0], [4.0], [1.0]]


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pairs") / "p")
    value = F.pmod(F.col("id") * 37 + 11, F.lit(64)).cast("int")
    df = spark.range(120).select(
        F.pmod("id", F.lit(3)).cast("float").alias("label"),
        F.encode(F.concat(*[F.char(F.pmod(value * (k + 1), F.lit(64)) + 40) for k in range(12)]), "UTF-8").alias("data"))
    files.write_sequence_pairs(df, path)
    return path


DIMS = (3, 2, 2)


def test_large_image_jobs(spark, pairs):
    learner = LinearSoftmax(12, 3)
    solver = SolverParams(base_lr=1e-5, max_iter=6, batch_size=10)
    fixed = apps.large_images_fixed(spark, pairs, 2, learner, solver, ExchangeParams(3, 0.2), dims=DIMS)
    assert fixed.trained.updates == 4 and fixed.summary.first()["steps"] == 12
    adaptive = apps.large_images_adaptive(spark, pairs, 2, learner, solver, ExchangeParams(3, 0.2), dims=DIMS)
    assert adaptive.summary.first()["steps"] == 12


def test_class_subset_and_labels(spark, pairs, tmp_path):
    out = str(tmp_path / "subset")
    apps.class_subset(spark, pairs, out, 2, seed=1, dims=DIMS)
    rows = apps.print_labels(spark, out, DIMS).collect()
    assert len(rows) == 80 and {r["label"] for r in rows} == {0.0, 1.0} and {r["n"] for r in rows} == {12}


def test_image_jobs_from_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(apps, "DIGITS", DIMS)
    monkeypatch.setattr(apps, "COLOUR", DIMS)
    lines = ["\t".join([str((i * 7 + j * i) % 256) for j in range(12)] + [str(i % 3)]) for i in range(90)]
    for name in ("train.txt", "test.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    train, test = str(tmp_path / "train.txt"), str(tmp_path / "test.txt")
    learner = LinearSoftmax(12, 3)
    start = init_weights(layer_table(spark, learner.layers()), 1)
    solver = SolverParams(base_lr=0.01, max_iter=8, batch_size=10)
    digits = apps.digits_delta(spark, train, test, 2, learner, solver, start, k=2)
    assert digits.before.first()["n"] == digits.after.first()["n"] == 90 and digits.summary.first()["accuracy"] is not None
    small = SolverParams(base_lr=1e-6, max_iter=8, batch_size=10)
    colour = apps.colour_delta(spark, train, test, 2, learner, small, start, k=2)
    assert colour.after.first()["loss"] <= colour.before.first()["loss"]
    params = ExchangeParams(4, 0.2)
    saved = str(tmp_path / "saved")
    stored = apps.digits_elastic(spark, train, test, 2, learner, solver, params, saved)
    assert stored.after.first()["n"] == 90 and stores.load_weights(spark, saved, "final").count() == 2
    bytes_only = apps.colour_elastic(spark, train, 2, learner, small, params, str(tmp_path / "saved2"))
    assert bytes_only.trained.updates == 4
