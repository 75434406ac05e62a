"""Streaming queries: the given tables arrive as files and are processed to the end."""

from pyspark.sql import functions as F

from elastrain.catalog.common import SQL_LOG, samples
from elastrain.catalog.metrics import loss_log
from elastrain.catalog.registry import query
from elastrain.catalog.schedules import PARAMS, PERIOD, WORKERS
from elastrain.operators.numbering import number_by_value
from elastrain.operators.weights import chunked
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.session import fresh_path
from elastrain.streaming.centre import CentreStore, stream_centre
from elastrain.streaming.metrics import stream_log_metrics, stream_update_counts

SOLVER = SolverParams(base_lr=0.1, max_iter=1)


def run_stream(spark, sf_dir, params, updates_only=False):
    """Every vector is one arrival of a one-layer model; the centre starts at 1."""
    numbered = number_by_value(samples(spark, sf_dir), [], "id", "n")
    rows = numbered.select((F.col("n") - 1).alias("seq"), F.lit(0).alias("layer"), F.col("data").alias("values"))
    arrivals = chunked(rows, size=16, keep=("seq",))
    source, store = fresh_path(spark, "arrivals"), CentreStore(spark, fresh_path(spark, "centre"))
    arrivals.write.parquet(source)
    ones = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.lit(1.0))
    store.start(spark.range(4).select(F.lit(0).alias("layer"), F.col("id").cast("int").alias("chunk"), ones.alias("values")))
    stream_centre(spark, source, store, fresh_path(spark, "progress"), params, SOLVER, WORKERS, updates_only)
    centre, updates = store.before()
    cells = centre.select("layer", "chunk", F.posexplode("values").alias("place", "value"))
    return cells.select(
        (F.col("chunk").cast("bigint") * 16 + F.col("place")).alias("idx"), F.lit(updates).cast("bigint").alias("updates"),
        (F.round("value", 6) + 0.0).alias("value"))


SQL_ARRIVALS = """arrivals AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, count(*) OVER () AS total, embedding FROM embeddings)"""


@query("stream_centre", f"""
WITH {SQL_ARRIVALS}, shares AS (
  SELECT *, 0.05::double * pow(0.95::double, total - n) AS share FROM arrivals),
long AS (SELECT total, share, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x FROM shares)
SELECT idx, max(total) AS updates, round(sum(share * x) + pow(0.95::double, max(total)), 6) + 0.0 AS value FROM long GROUP BY idx""")
def stream_centre_query(spark, sf_dir):
    return run_stream(spark, sf_dir, ExchangeParams(period=PERIOD, moving_rate=0.05))


@query("stream_centre_decaying", f"""
WITH {SQL_ARRIVALS}, rates AS (
  SELECT *, 0.9::double * pow(0.5::double, least((n - 1) // 8, 3)) * 0.8::double * pow(0.25::double, (n - 1) // 40) AS b FROM arrivals),
shares AS (
  SELECT *, b * exp(coalesce(sum(ln(1 - b)) OVER (ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share,
    exp(sum(ln(1 - b)) OVER ()) AS kept FROM rates),
long AS (SELECT total, kept, share, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x FROM shares)
SELECT idx, max(total) AS updates, round(sum(share * x) + max(kept), 6) + 0.0 AS value FROM long GROUP BY idx""")
def stream_centre_decaying(spark, sf_dir):
    """Moving rate and server factor decay with the update count."""
    return run_stream(spark, sf_dir, PARAMS)


@query("stream_deltas", """
WITH long AS (SELECT unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x FROM embeddings)
SELECT idx, count(*) AS updates, round(1.0 - sum(x), 6) + 0.0 AS value FROM long GROUP BY idx""")
def stream_deltas(spark, sf_dir):
    return run_stream(spark, sf_dir, ExchangeParams(period=PERIOD, moving_rate=0.05), updates_only=True)


@query("stream_log_metrics", f"""
WITH {SQL_LOG} SELECT worker, (iter - 1) // {PERIOD} AS span, max(iter) AS iter, round(avg(loss), 6) AS loss,
  (sum((epoch_us(ts) // 1000) % 1000) // count(*))::bigint AS mean_ms, count(*) AS steps
FROM log GROUP BY worker, (iter - 1) // {PERIOD}""")
def stream_log_metrics_query(spark, sf_dir):
    source = fresh_path(spark, "log")
    loss_log(spark, sf_dir).select("worker", F.col("iter").cast("bigint").alias("iter"), "loss", "ms").write.parquet(source)
    found = stream_log_metrics(spark, source, fresh_path(spark, "metrics"), fresh_path(spark, "progress"), PERIOD)
    return found.withColumn("loss", F.round("loss", 6))


@query("stream_update_counts", f"""
WITH {SQL_LOG}, met AS (SELECT worker % 4 AS run, worker, max(iter // {PERIOD}) * 4 + worker % 4 AS update_no, max(iter) AS iter
  FROM log WHERE iter % {PERIOD} = 0 GROUP BY worker)
SELECT run::varchar AS run, worker, update_no::bigint AS update_no, iter, max(update_no) OVER (PARTITION BY run)::bigint AS updates FROM met""")
def stream_update_counts_query(spark, sf_dir):
    """Every period of a worker ends with an exchange; four runs share the workers."""
    source = fresh_path(spark, "lines")
    met = loss_log(spark, sf_dir).where(F.col("iter") % PERIOD == 0)
    run = F.col("worker") % 4
    met.select(
        run.cast("string").alias("run"), F.col("worker").cast("int").alias("worker"),
        (F.floor(F.col("iter") / PERIOD) * 4 + run).cast("bigint").alias("update_no"), F.col("iter").cast("bigint").alias("iter"),
        F.lit("exchange").alias("kind"), F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("elapsed_s"),
    ).write.parquet(source)
    found = stream_update_counts(spark, source, fresh_path(spark, "counts"), fresh_path(spark, "progress"))
    return found.withColumn("worker", F.col("worker").cast("bigint"))
