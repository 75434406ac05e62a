"""Training runs over the given tables.

Language of the documents is the target, character trigrams of the whole text are the features; the
training itself is not SQL, so these queries are checked against plain numpy in the tests.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from elastrain.catalog.common import SEED, SQL_SHARDED, WORKERS, sharded
from elastrain.catalog.registry import query, table
from elastrain.functions.arrays import decode_u8
from elastrain.operators.aggregates import vector_sum
from elastrain.operators.batching import assign_workers
from elastrain.operators.samples import mirror
from elastrain.operators.weights import chunked
from elastrain.plans import training as T
from elastrain.plans.learners import LinearSoftmax, ReluNet
from elastrain.plans.parameters import init_weights as fill_weights
from elastrain.plans.rounds import worker_rows
from elastrain.plans.scoring import evaluate
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.session import bounded_batches, fresh_path, materialise
from elastrain.sources.shards import materialise_shards, read_shards, store_by_worker
from elastrain.sources.stores import load_weights, save_weights, worker_tag

# Classes of the documents table.
LANGUAGES = ["en", "fr", "de", "es"]
FEATURES = 256
ROUNDS = 4
#: Most rows of a mini-batch and of a shard: workers and steps follow the row count, a task's memory does not.
MOST_BATCH = 64
MOST_SHARD = 65536
BLOCK = 4096
LINEAR = LinearSoftmax(FEATURES, len(LANGUAGES))
RELU = ReluNet(FEATURES, 32, len(LANGUAGES))


@F.arrow_udf(ArrayType(FloatType()))
def trigram_shares(texts: pa.Array) -> pa.Array:
    """Share of each hashed character trigram in a whole text, times 16."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for row, text in enumerate(texts.to_pylist()):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
        if len(codes) > 2:
            grams = (codes[:-2] * np.uint32(7919) + codes[1:-1] * np.uint32(104729) + codes[2:]) >> np.uint32(3)
            out[row] = np.bincount(grams % FEATURES, minlength=FEATURES) * (16.0 / len(grams))
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * FEATURES
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))


def trigram_samples(spark, sf_dir):
    """documents as (id, data, label, dim): trigrams of the text against the language."""
    bounded_batches(spark)
    label = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("lang")) - 1
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), trigram_shares("text").alias("data"), label.cast("float").alias("label"),
        F.array(F.lit(1), F.lit(16), F.lit(16)).alias("dim"))


@dataclass
class Job:
    """Features written once, with their worker, and sizes that make an epoch of all rows in ROUNDS rounds."""

    rows: DataFrame
    workers: int
    batch: int
    steps: int

    def solver(self, **more):
        return SolverParams(base_lr=0.5, max_iter=ROUNDS * self.steps, momentum=0.9, weight_decay=0.0002, batch_size=self.batch, **more)

    def exchange(self):
        return ExchangeParams(period=self.steps, moving_rate=0.3, decay_rate=0.9, decay_step=2 * self.steps)


def prepared(spark, sf_dir):
    features = materialise(trigram_samples(spark, sf_dir), "features")
    workers = max(WORKERS, -(-features.count() // MOST_SHARD))
    rows = assign_workers(features, ["id"], workers, SEED)
    smallest = min(worker_rows(rows, workers).values())
    batch = min(MOST_BATCH, max(1, smallest // (4 * ROUNDS)))
    return Job(rows, workers, batch, max(1, smallest // (batch * ROUNDS)))


def _result(trained, rows, learner):
    """Updates, steps and losses of the run, and the accuracy over all documents."""
    run = T.training_report(trained.log).first()
    noted = [F.lit(run[name]).alias(name) for name in ("steps", "first_loss", "last_loss")]
    return evaluate(rows, trained.centre, learner).select(
        "n", F.lit(trained.updates).alias("updates"), *noted, "accuracy_1", "loss")


@query("train_elastic")
def train_elastic(spark, sf_dir):
    job = prepared(spark, sf_dir)
    trained = T.train_elastic(job.rows, ["id"], job.workers, LINEAR, job.solver(), job.exchange(), SEED)
    return _result(trained, job.rows, LINEAR)


@query("train_elastic_relu")
def train_elastic_relu(spark, sf_dir):
    """The same run with one hidden layer."""
    job = prepared(spark, sf_dir)
    trained = T.train_elastic(job.rows, ["id"], job.workers, RELU, job.solver(), job.exchange(), SEED)
    return _result(trained, job.rows, RELU)


def _shards(spark, sf_dir):
    job = prepared(spark, sf_dir)
    path = fresh_path(spark, "shards")
    stored = job.rows.withColumn("data", F.transform("data", lambda x: x * 64))
    materialise_shards(stored, "id", path, block_rows=BLOCK)
    pixels = read_shards(spark, path)
    return pixels.withColumn("data", F.transform("data", lambda x: x / 64)), job


@query("train_elastic_from_shards")
def train_elastic_from_shards(spark, sf_dir):
    """From one bucket for each worker, which the rounds read without a shuffle."""
    job = prepared(spark, sf_dir)
    scale = SampleTransform((1, 16, 16), scale=1 / 64)
    grown = job.rows.withColumn("data", F.transform("data", lambda x: x * 64))
    store = store_by_worker(grown, "id", fresh_path(spark, "store"), job.workers)
    trained = T.train_elastic_from_shards(store, job.workers, LINEAR, job.solver(), job.exchange(), BLOCK, SEED, transform=scale)
    held = store.read(spark).withColumn("data", decode_u8("data").cast("array<double>"))
    return _result(trained, scale.for_test().table(held), LINEAR)


@query("train_elastic_adaptive")
def train_elastic_adaptive(spark, sf_dir):
    shards, job = _shards(spark, sf_dir)
    trained = T.train_elastic_adaptive(shards, job.workers, LINEAR, job.solver(), job.exchange(), BLOCK, SEED)
    return _result(trained, shards, LINEAR)


@query("train_delta")
def train_delta(spark, sf_dir):
    job = prepared(spark, sf_dir)
    settings = SolverParams(base_lr=0.2, max_iter=ROUNDS * job.steps * job.workers, momentum=0.5, batch_size=job.batch)
    return _result(T.train_delta(job.rows, ["id"], job.workers, job.steps, LINEAR, settings, SEED), job.rows, LINEAR)


@query("warm_start")
def warm_start(spark, sf_dir):
    """A run that starts from the saved centre of an earlier one."""
    job = prepared(spark, sf_dir)
    path = fresh_path(spark, "weights")
    first = T.train_elastic(job.rows, ["id"], job.workers, LINEAR, job.solver(), job.exchange(), SEED)
    save_weights(first.centre, path, "start")
    again = T.train_elastic(
        job.rows, ["id"], job.workers, LINEAR, job.solver(), job.exchange(), SEED, weights=load_weights(spark, path, "start"))
    return _result(again, job.rows, LINEAR)


VECTORS = LinearSoftmax(64, 10)
MIX = 0.3


SQL_SHUFFLED_PICK = f"""row_number() OVER (PARTITION BY worker ORDER BY md5('{SEED}:' || {{t}} || ':' || id)) <= (SELECT min(n) FROM sizes)"""
SQL_STORED_PICK = """(row_number() OVER (PARTITION BY worker ORDER BY id) - 1 + {t} * (n - (SELECT min(n) FROM sizes))) % n < (SELECT min(n) FROM sizes)"""


SQL_ZERO_START = "SELECT c::int AS cls, j::int AS j, 0.0::double AS w FROM range(10) AS a(c), range(-1, {width}) AS b(j)"
SQL_MEAN_START = """SELECT label::int AS cls, j, avg(x)::float::double AS w FROM x0 WHERE j >= 0 GROUP BY label, j
  UNION ALL SELECT c::int, -1, 0.0::double FROM range(10) AS a(c)"""


def _sql_local_steps(steps, pick=SQL_SHUFFLED_PICK, data="data::double[]", start=SQL_ZERO_START, more=(), samples="sharded", width=64):
    """Every worker's weights after steps from the ``start`` weights, each on a batch as large as the smallest shard.

    ``pick`` says which rows of a shard step t takes, ``data`` their ``width`` values in that step, taken from the
    table ``samples`` that ``more`` defines.
    """
    ctes = [SQL_SHARDED, """sizes AS (SELECT worker, count(*) AS n FROM sharded GROUP BY worker)""", *more,
            *(f"x{t} AS (SELECT id, worker, label, unnest(range(-1, {width}))::int AS j, unnest(list_prepend(1.0::double, {data.format(t=t)})) AS x FROM {samples})"
              for t in range(steps)),
            f"w0 AS (SELECT worker, cls, j, w, 0.0::double AS v FROM sizes, ({start.format(width=width)}))"]
    for t in range(steps):
        ctes += [
            f"b{t} AS (SELECT id FROM (SELECT id, {pick.format(t=t)} AS taken FROM sharded JOIN sizes USING (worker)) WHERE taken)",
            f"s{t} AS (SELECT id, worker, label, cls, sum(x * w) AS s FROM x{t} JOIN b{t} USING (id) JOIN w{t} USING (worker, j) GROUP BY id, worker, label, cls)",
            f"p{t} AS (SELECT id, worker, label, cls, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM s{t})",
            f"""g{t} AS (SELECT x.worker, cls, j, sum((p - (cls = x.label)::int) * x) / (SELECT min(n) FROM sizes) AS g
  FROM p{t} JOIN x{t} AS x ON x.id = p{t}.id GROUP BY x.worker, cls, j)""",
            f"""u{t} AS (SELECT worker, cls, j, w, 0.9::double * v + 2.0::double * (CASE WHEN j < 0 THEN 2 ELSE 1 END)
  * (g + CASE WHEN j < 0 THEN 0 ELSE 0.004::double END * w) AS v FROM w{t} JOIN g{t} USING (worker, cls, j))""",
            f"w{t + 1} AS (SELECT worker, cls, j, w - v AS w, v FROM u{t})"]
    return "WITH " + ", ".join(ctes)


def _vector_run(spark, sf_dir):
    """The vectors with their worker, and two local steps per round on batches of the smallest shard."""
    rows = sharded(spark, sf_dir)
    batch = min(worker_rows(rows, WORKERS).values())
    return rows, {"base_lr": 2.0, "momentum": 0.9, "weight_decay": 0.004, "batch_size": batch}


def _dense_cells(centre, width=64):
    cells = centre.select("layer", F.posexplode("values").alias("i", "value"))
    bias = F.col("layer") == 1
    return cells.select(
        F.when(bias, F.col("i")).otherwise(F.floor(F.col("i") / width)).cast("int").alias("cls"),
        F.when(bias, F.lit(-1)).otherwise(F.pmod("i", F.lit(width))).cast("int").alias("j"),
        (F.round("value", 6) + 0.0).alias("value"))


@query("elastic_round", f"""
{_sql_local_steps(2)} SELECT cls, j, round(sum({MIX}::double * pow(1 - {MIX}::double, {WORKERS - 1} - worker) * w), 6) + 0.0 AS value
FROM w2 GROUP BY cls, j""")
def elastic_round(spark, sf_dir):
    """The centre after one round of elastic averaging: two epochs staged, two local steps, four exchanges."""
    rows, settings = _vector_run(spark, sf_dir)
    params = ExchangeParams(period=2, moving_rate=MIX)
    trained = T.train_elastic(rows, ["id"], WORKERS, VECTORS, SolverParams(max_iter=2, **settings), params, SEED)
    return _dense_cells(trained.centre)


SQL_MIRRORED = f"""list_transform(range(64), lambda i: CASE WHEN ('0x' || substr(md5('{SEED}:{{t}}:mirror:' || id), 1, 8))::bigint % 2 = 0
  THEN data[i - i % 4 + 3 - i % 4 + 1] ELSE data[i + 1] END::double)"""


@query("elastic_round_mirrored", f"""
{_sql_local_steps(2, data=SQL_MIRRORED)} SELECT cls, j, round(sum({MIX}::double * pow(1 - {MIX}::double, {WORKERS - 1} - worker) * w), 6) + 0.0 AS value
FROM w2 GROUP BY cls, j""")
def elastic_round_mirrored(spark, sf_dir):
    """The round over samples that each epoch flips anew, half of them, in rows of four values."""
    rows, settings = _vector_run(spark, sf_dir)
    params = ExchangeParams(period=2, moving_rate=MIX)
    trained = T.train_elastic(
        rows, ["id"], WORKERS, VECTORS, SolverParams(max_iter=2, **settings), params, SEED,
        transform=lambda df, epoch: mirror(df, 4, ["id"], SEED, epoch))
    return _dense_cells(trained.centre)


@query("delta_round", f"""
{_sql_local_steps(2)} SELECT cls, j, round(sum(w), 6) + 0.0 AS value FROM w2
WHERE worker IN (SELECT worker FROM sizes WHERE 12 * n // (SELECT sum(n) FROM sizes) // 2 >= 1) GROUP BY cls, j""")
def delta_round(spark, sf_dir):
    """The centre after each worker pushed the sum of two updates; the budget is one push for shares from 1/6 to 1/3."""
    rows, settings = _vector_run(spark, sf_dir)
    trained = T.train_delta(rows, ["id"], WORKERS, 2, VECTORS, SolverParams(max_iter=12, **settings), SEED)
    return _dense_cells(trained.centre)


@query("shards_round", f"""
{_sql_local_steps(2, SQL_STORED_PICK, "list_transform(data, lambda x: (trunc(x::double * 100)::int & 255) / 255.0::double)")}
SELECT cls, j, round(sum({MIX}::double * pow(1 - {MIX}::double, {WORKERS - 1} - worker) * w), 6) + 0.0 AS value
FROM w2 GROUP BY cls, j""")
def shards_round(spark, sf_dir):
    """The same round over stored bytes, read by worker without a shuffle: batches follow the key order and wrap around."""
    store, settings = _byte_store(spark, sf_dir)
    params = ExchangeParams(period=2, moving_rate=MIX)
    trained = T.train_elastic_from_shards(
        store, WORKERS, VECTORS, SolverParams(max_iter=2, **settings), params, BLOCK, SEED, transform=SampleTransform((1, 8, 8), scale=1 / 255))
    return _dense_cells(trained.centre)


def _byte_store(spark, sf_dir):
    """The vectors as bytes, a bucket for each worker."""
    rows, settings = _vector_run(spark, sf_dir)
    grown = rows.withColumn("data", F.transform("data", lambda x: x.cast("double") * 100))
    return store_by_worker(grown, "id", fresh_path(spark, "store"), WORKERS), settings


CROPPED = SampleTransform((1, 8, 8), crop=6, mirror=True, channel_means=(40.0,), scale=1 / 255, seed=SEED)
SMALL = LinearSoftmax(CROPPED.n_features, 10)

# Step t begins at place t * (smallest shard); a row is taken in the first pass that puts it there or later.
SQL_PASSES = """placed AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY id) - 1 AS pos, n, (SELECT min(n) FROM sizes) AS most
  FROM sharded JOIN sizes USING (worker)),
drawn AS (SELECT *, [('0x' || substr(md5(concat_ws(':', {seed}, (greatest(0, t * most - pos) + n - 1) // n, 'top', worker, pos)), 1, 8))::bigint % 3
   FOR t IN range({steps})] AS top, [('0x' || substr(md5(concat_ws(':', {seed}, (greatest(0, t * most - pos) + n - 1) // n, 'left', worker, pos)), 1, 8))::bigint % 3
   FOR t IN range({steps})] AS lft, [('0x' || substr(md5(concat_ws(':', {seed}, (greatest(0, t * most - pos) + n - 1) // n, 'mirror', worker, pos)), 1, 8))::bigint % 2
   FOR t IN range({steps})] AS side FROM placed)"""
SQL_WINDOW = """list_transform(range(36), lambda i: ((trunc(data[(top[{t} + 1] + i // 6) * 8 + lft[{t} + 1]
  + CASE WHEN side[{t} + 1] = 0 THEN 5 - i % 6 ELSE i % 6 END + 1]::double * 100)::int & 255) - 40) / 255.0::double)"""


@query("shards_round_cropped", f"""
{_sql_local_steps(3, SQL_STORED_PICK, SQL_WINDOW, more=(SQL_PASSES.format(seed=SEED, steps=3),), samples="drawn", width=36)}
SELECT cls, j, round(sum({MIX}::double * pow(1 - {MIX}::double, {WORKERS - 1} - worker) * w), 6) + 0.0 AS value
FROM w3 GROUP BY cls, j""")
def shards_round_cropped(spark, sf_dir):
    """Three steps from stored bytes that reach into second and third passes, each pass with windows and flips of its own."""
    store, settings = _byte_store(spark, sf_dir)
    params = ExchangeParams(period=3, moving_rate=MIX)
    trained = T.train_elastic_from_shards(store, WORKERS, SMALL, SolverParams(max_iter=3, **settings), params, BLOCK, SEED, transform=CROPPED)
    return _dense_cells(trained.centre, CROPPED.n_features)


@query("training_report", """
WITH log AS (SELECT user_id AS run, event_id AS iter, CASE WHEN event_type = 'error' THEN 'accuracy' ELSE 'loss' END AS kind,
                    value, epoch_us(ts) / 1e6::double AS elapsed_s FROM events)
SELECT run, round(max(elapsed_s) - min(elapsed_s), 3) AS seconds,
  arg_max(value, elapsed_s) FILTER (kind = 'accuracy') AS accuracy, arg_min(value, iter) FILTER (kind = 'loss') AS first_loss,
  arg_max(value, iter) FILTER (kind = 'loss') AS last_loss, (count(*) FILTER (kind = 'loss'))::bigint AS steps
FROM log GROUP BY run""")
def training_report(spark, sf_dir):
    """Each user's events as the log of one run: errors are test scores, the rest losses."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("event_id").alias("update_no"),
        F.when(F.col("event_type") == "error", "accuracy").otherwise("loss").alias("kind"), "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("elapsed_s"))
    return T.training_report(log).withColumn("seconds", F.round("seconds", 3))


@query("init_weights", f"""
WITH cells AS (SELECT vec_id::int AS layer, vec_id % 3 AS kind, unnest(range(len(embedding)))::bigint AS idx FROM embeddings),
draws AS (SELECT *, (('0x' || substr(md5('{SEED}:u:' || layer || ':' || idx), 1, 8))::bigint + 0.5::double) / 4294967296.0::double AS u,
  (('0x' || substr(md5('{SEED}:r:' || layer || ':' || idx), 1, 8))::bigint + 0.5::double) / 4294967296.0::double AS r,
  (('0x' || substr(md5('{SEED}:phi:' || layer || ':' || idx), 1, 8))::bigint + 0.5::double) / 4294967296.0::double AS phi FROM cells)
SELECT layer, idx, round(CASE kind WHEN 0 THEN 0.25::double WHEN 1 THEN sqrt(-2 * ln(r)) * cos(2 * pi() * phi) * 0.25
  ELSE (2 * u - 1) * sqrt(12.0::double) END, 6) + 0.0 AS value FROM draws""")
def init_weights(spark, sf_dir):
    """One layer per vector, as wide as the vector; the three fillers take turns."""
    turn = F.pmod("vec_id", F.lit(3))
    layers = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("layer"), F.size("embedding").cast("bigint").alias("size"), F.lit(0.25).alias("arg"),
        F.when(turn == 0, "constant").when(turn == 1, "gaussian").otherwise("xavier").alias("filler"))
    weights = fill_weights(layers, SEED, chunk=16)
    cells = weights.select("layer", "chunk", F.posexplode("values").alias("place", "value"))
    return cells.select(
        "layer", (F.col("chunk").cast("bigint") * 16 + F.col("place")).alias("idx"), (F.round("value", 6) + 0.0).alias("value"))


@query("warm_start_round", f"""
{_sql_local_steps(2, start=SQL_MEAN_START)} SELECT cls, j, round(sum({MIX}::double * pow(1 - {MIX}::double, {WORKERS - 1} - worker) * w)
  + pow(1 - {MIX}::double, {WORKERS}) * (SELECT max(w) FROM w0 WHERE w0.cls = w2.cls AND w0.j = w2.j), 6) + 0.0 AS value
FROM w2 GROUP BY cls, j""")
def warm_start_round(spark, sf_dir):
    """A round that starts from saved weights: every class begins as the mean vector of its label."""
    rows, settings = _vector_run(spark, sf_dir)
    means = rows.groupBy(F.col("label").cast("int").alias("cls")).agg(
        vector_sum(F.col("data")).alias("s"), F.count(F.lit(1)).alias("n"))
    cells = means.select("cls", F.posexplode("s").alias("j", "v"), "n").select(
        (F.col("cls") * 64 + F.col("j")).alias("i"), (F.col("v") / F.col("n")).alias("v"))
    first = cells.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select(
        F.lit(0).alias("layer"), F.transform("c", lambda c: c["v"]).alias("values"))
    zeros = spark.range(1).select(F.lit(1).alias("layer"), F.array_repeat(F.lit(0.0), 10).alias("values"))
    path = fresh_path(spark, "weights")
    save_weights(chunked(first.union(zeros)), path, "start")
    params = ExchangeParams(period=2, moving_rate=MIX)
    trained = T.train_elastic(
        rows, ["id"], WORKERS, VECTORS, SolverParams(max_iter=2, **settings), params, SEED, weights=load_weights(spark, path, "start"))
    return _dense_cells(trained.centre)


@query("worker_snapshot_in_round", f"""
{_sql_local_steps(1, SQL_STORED_PICK, "list_transform(data, lambda x: (trunc(x::double * 100)::int & 255) / 255.0::double)")}
SELECT cls, j, round(w::float::double, 6) + 0.0 AS value FROM w1 WHERE worker = 0""")
def worker_snapshot_in_round(spark, sf_dir):
    """Worker 0's weights, in single precision, saved after the first of the two steps of a round."""
    store, settings = _byte_store(spark, sf_dir)
    params = ExchangeParams(period=2, moving_rate=MIX)
    trained = T.train_elastic_from_shards(
        store, WORKERS, VECTORS, SolverParams(max_iter=2, snapshot=1, **settings), params, BLOCK, SEED, transform=SampleTransform((1, 8, 8), scale=1 / 255))
    return _dense_cells(load_weights(spark, trained.snapshots, worker_tag(1)))
