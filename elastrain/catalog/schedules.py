"""Schedule queries: every log entry or arrival of the tables gets its rate, and the due ones are found."""

from pyspark.sql import functions as F

from elastrain.catalog.common import SQL_LOG, events_log, samples
from elastrain.catalog.registry import query
from elastrain.functions import schedules as H
from elastrain.operators import sync_points
from elastrain.operators.adaptive_sync import adaptive_sync_points as find_sync_points
from elastrain.operators.numbering import number_by_value
from elastrain.plans.parameters import multiplied_rates
from elastrain.schema import ExchangeParams

PERIOD = 5
PARAMS = ExchangeParams(
    period=PERIOD, moving_rate=0.9, decay_rate=0.5, decay_step=10, decay_limit=3,
    server_factor=0.8, factor_decay_rate=0.25, factor_decay_step=50, factor_decay_limit=-1,
)
WORKERS = 4


def numbered_log(spark, sf_dir):
    """The loss log with the iteration number of each entry in its worker's log."""
    return number_by_value(events_log(spark, sf_dir), ["worker"], "entry", "iter")


def arrivals(spark, sf_dir):
    """All events as arrivals at one centre, numbered in event order from 1."""
    rows = events_log(spark, sf_dir).select("entry", "worker")
    return number_by_value(rows, [], "entry", "update_no")


SQL_UPDATES = """updates AS (
  SELECT event_id AS entry, user_id AS worker, row_number() OVER (ORDER BY event_id) AS update_no FROM events)"""


@query("lr_fixed_and_step", f"""
WITH {SQL_LOG} SELECT worker, iter, 0.001::double AS fixed_lr,
  round(0.05::double * pow(0.2::double, (iter - 1) // 20), 9) AS step_lr FROM log""")
def lr_fixed_and_step(spark, sf_dir):
    done = F.col("iter") - 1
    return numbered_log(spark, sf_dir).select(
        "worker", "iter", H.lr_at(done, 0.001).alias("fixed_lr"),
        F.round(H.lr_at(done, 0.05, "step", 0.2, 20), 9).alias("step_lr"))


@query("moving_rate", f"""
WITH {SQL_LOG} SELECT worker, iter, (iter - 1) // {PERIOD} AS exchange,
  0.9::double * pow(0.5::double, least(((iter - 1) // {PERIOD}) // 2, 3)) AS rate FROM log""")
def moving_rate(spark, sf_dir):
    exchange = F.floor((F.col("iter") - 1) / PERIOD)
    return numbered_log(spark, sf_dir).select(
        "worker", "iter", exchange.alias("exchange"), H.worker_rate(exchange, PARAMS).alias("rate"))


@query("centre_rate", f"""
WITH {SQL_UPDATES} SELECT update_no, 0.9::double * pow(0.5::double, least((update_no - 1) // 8, 3)) AS rate FROM updates""")
def centre_rate(spark, sf_dir):
    return arrivals(spark, sf_dir).select("update_no", H.centre_rate(F.col("update_no"), PARAMS, WORKERS).alias("rate"))


@query("server_factor", f"""
WITH {SQL_UPDATES} SELECT update_no, 0.8::double * pow(0.25::double, (update_no - 1) // 40) AS factor,
  round(0.9::double * pow(0.5::double, least((update_no - 1) // 8, 3)) * 0.8::double * pow(0.25::double, (update_no - 1) // 40), 12) AS coefficient
FROM updates""")
def server_factor(spark, sf_dir):
    factor = H.centre_factor(F.col("update_no"), PARAMS, WORKERS)
    rate = H.centre_rate(F.col("update_no"), PARAMS, WORKERS)
    return arrivals(spark, sf_dir).select(
        "update_no", factor.alias("factor"), F.round(rate * factor, 12).alias("coefficient"))


@query("exchange_rounds", f"""
SELECT user_id AS worker, count(*) AS iterations, floor(count(*) / {PERIOD}.0::double + 0.5)::bigint AS rounds
FROM events GROUP BY user_id""")
def exchange_rounds(spark, sf_dir):
    sizes = events_log(spark, sf_dir).groupBy("worker").agg(F.count(F.lit(1)).alias("iterations"))
    return sizes.withColumn("rounds", H.rounds_of(F.col("iterations"), PERIOD))


@query("centre_snapshots", f"""
WITH {SQL_UPDATES} SELECT entry, update_no, 'state_iter_' || update_no || '.weight' AS tag FROM updates WHERE update_no % 24 = 0""")
def centre_snapshots(spark, sf_dir):
    due = sync_points.snapshot_points(arrivals(spark, sf_dir), "update_no", 30, WORKERS, PERIOD)
    tag = F.concat(F.lit("state_iter_"), F.col("update_no").cast("string"), F.lit(".weight"))
    return due.select("entry", "update_no", tag.alias("tag"))


@query("worker_snapshots", f"""
WITH {SQL_LOG} SELECT worker, entry, iter FROM log WHERE iter % 15 = 0 AND worker = 0""")
def worker_snapshots(spark, sf_dir):
    due = sync_points.worker_snapshot_points(numbered_log(spark, sf_dir), "iter", 15)
    return due.select("worker", "entry", "iter")


@query("eval_points", f"WITH {SQL_UPDATES} SELECT entry, update_no FROM updates WHERE update_no % 100 = 0")
def eval_points(spark, sf_dir):
    return sync_points.eval_points(arrivals(spark, sf_dir), "update_no", 100).select("entry", "update_no")


@query("adaptive_sync_points", f"""
WITH RECURSIVE {SQL_LOG}, units AS (SELECT worker, iter, round(loss * 1e9)::bigint AS u FROM log),
heads AS (SELECT worker, max(iter) AS n, coalesce(sum(u) FILTER (iter <= {PERIOD}), 0)::bigint AS cut FROM units GROUP BY worker),
walk AS (
  SELECT worker, 0::bigint AS iter, 0::bigint AS acc, 0::bigint AS last_iter, 0::bigint AS exchange, false AS hit,
         0::bigint AS steps, 0::bigint AS total FROM heads
  UNION ALL
  SELECT worker, iter, CASE WHEN hit THEN 0 ELSE grown END, CASE WHEN hit THEN iter ELSE last_iter END,
         CASE WHEN hit THEN exchange + 1 ELSE exchange END, hit, iter - last_iter, grown
  FROM (SELECT w.worker, u.iter, w.acc + u.u AS grown, w.last_iter, w.exchange,
               u.iter = {PERIOD} OR (u.iter > {PERIOD} AND h.cut > 0 AND w.acc + u.u > h.cut) AS hit
        FROM walk w JOIN units u ON u.worker = w.worker AND u.iter = w.iter + 1 JOIN heads h ON h.worker = w.worker))
SELECT worker, exchange, iter, steps, total / 1e9::double AS loss_sum, false AS final FROM walk WHERE hit
UNION ALL
SELECT worker, exchange + 1, iter, steps, total / 1e9::double, true
FROM walk JOIN heads USING (worker) WHERE iter = n AND NOT hit""")
def adaptive_sync_points(spark, sf_dir):
    return find_sync_points(numbered_log(spark, sf_dir), PERIOD)


@query("param_multipliers", """
SELECT vec_id::int AS layer, vec_id % 2 = 1 AS bias, CASE WHEN vec_id % 2 = 1 THEN 0.1::double ELSE 0.05::double END AS lr,
       CASE WHEN vec_id % 2 = 1 THEN 0.0::double ELSE 0.0002::double END AS decay FROM embeddings""")
def param_multipliers(spark, sf_dir):
    """Each vector as a layer; odd ones are biases (twice the rate, no decay)."""
    layers = samples(spark, sf_dir).select(
        F.col("id").cast("int").alias("layer"), (F.pmod("id", F.lit(2)) == 1).alias("bias"))
    return multiplied_rates(layers, 0.05, 0.0002)

