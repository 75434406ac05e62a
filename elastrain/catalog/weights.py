"""Weight-table queries.

The embeddings serve as weights: vector 2i is layer i of one list, vector 2i+1 layer i of another,
in chunks of 16 values.
"""

from pyspark.sql import functions as F

from elastrain.catalog.common import SEED, WORKERS, samples, sql_worker
from elastrain.catalog.registry import query, table
from elastrain.functions.hashing import hash_key
from elastrain.operators import weights as M
from elastrain.operators.aggregates import squared_norms
from elastrain.operators.batching import assign_workers
from elastrain.operators.numbering import number_by_hash

SIZE = 16


def parity_list(spark, sf_dir, parity):
    rows = table(spark, sf_dir, "embeddings").where(F.pmod("vec_id", F.lit(2)) == parity)
    layers = rows.select(F.expr("div(vec_id, 2)").alias("layer"), F.col("embedding").alias("values"))
    return M.chunked(layers, size=SIZE)


def whole_list(spark, sf_dir):
    """Every vector as a layer of one list."""
    rows = table(spark, sf_dir, "embeddings")
    return M.chunked(rows.select(F.col("vec_id").alias("layer"), F.col("embedding").alias("values")), size=SIZE)


def both(spark, sf_dir):
    return parity_list(spark, sf_dir, 0), parity_list(spark, sf_dir, 1)


def long_weights(df, keep=("layer",), values="values", name="value"):
    """(layer, idx, value) for comparison."""
    exploded = df.select(*keep, "chunk", F.posexplode(values).alias("place", name))
    return exploded.select(
        *keep, (F.col("chunk").cast("bigint") * SIZE + F.col("place")).alias("idx"), (F.round(name, 6) + 0.0).alias(name))


SQL_WEIGHTS = """a AS (
  SELECT (vec_id // 2)::int AS layer, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x
  FROM embeddings WHERE vec_id % 2 = 0),
b AS (
  SELECT (vec_id // 2)::int AS layer, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS y
  FROM embeddings WHERE vec_id % 2 = 1)"""


SQL_WHOLE = """w AS (
  SELECT vec_id::int AS layer, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x FROM embeddings)"""


def sql_whole(expr):
    return f"WITH {SQL_WHOLE} SELECT layer, idx, round({expr}, 6) + 0.0 AS value FROM w"


def sql_pair(expr):
    return f"WITH {SQL_WEIGHTS} SELECT layer, idx, round({expr}, 6) + 0.0 AS value FROM a JOIN b USING (layer, idx)"


@query("align_weights", f"""
WITH {SQL_WEIGHTS} SELECT layer, idx, round(x, 6) + 0.0 AS a, round(y, 6) + 0.0 AS b FROM a JOIN b USING (layer, idx)""")
def align_weights(spark, sf_dir):
    pairs = M.align_weights(*both(spark, sf_dir))
    zipped = pairs.select("layer", "chunk", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p"))
    return zipped.select(
        "layer", (F.col("chunk").cast("bigint") * SIZE + F.col("place")).alias("idx"),
        (F.round("p.a", 6) + 0.0).alias("a"), (F.round("p.b", 6) + 0.0).alias("b"))


@query("add_weights", sql_pair("x + y"))
def add_weights(spark, sf_dir):
    return long_weights(M.add_weights(*both(spark, sf_dir)))


@query("sub_weights", sql_pair("y - x"))
def sub_weights(spark, sf_dir):
    return long_weights(M.sub_weights(*both(spark, sf_dir)))


@query("scale_weights", sql_whole("0.25 * x"))
def scale_weights(spark, sf_dir):
    return long_weights(M.scale_weights(whole_list(spark, sf_dir), 0.25))


@query("zero_weights", sql_whole("0.0 * x"))
def zero_weights(spark, sf_dir):
    return long_weights(M.zero_weights(whole_list(spark, sf_dir)))


@query("slice_weights", f"""
WITH {SQL_WHOLE} SELECT layer, idx, round(x, 6) + 0.0 AS value FROM w WHERE idx BETWEEN 10 AND 37""")
def slice_weights(spark, sf_dir):
    cut = M.slice_weights(whole_list(spark, sf_dir), 10, 28, size=SIZE)
    return cut.withColumn("value", F.round("value", 6) + 0.0)


@query("patch_weights", sql_pair("CASE WHEN idx BETWEEN 10 AND 37 THEN y ELSE x END"))
def patch_weights(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return long_weights(M.patch_weights(a, M.slice_weights(b, 10, 28, size=SIZE), size=SIZE))


@query("layer_sizes", "SELECT vec_id::int AS layer, len(embedding)::bigint AS size FROM embeddings")
def layer_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.col("embedding").alias("values"))
    return M.layer_sizes(M.chunked(rows, size=SIZE))


@query("partition_weights", """
WITH sizes AS (SELECT l_suppkey AS layer, count(*) AS size FROM lineitem GROUP BY l_suppkey)
SELECT w::int AS worker, layer, w * size // 7 AS "offset", (w + 1) * size // 7 - w * size // 7 AS length
FROM sizes, range(7) AS r(w)""")
def partition_weights(spark, sf_dir):
    """Each supplier's line items as one layer, split over seven workers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("layer"))
    return M.partition_weights(lines.groupBy("layer").agg(F.count(F.lit(1)).alias("size")), 7)


@query("to_every_worker", f"""
WITH {SQL_WHOLE} SELECT n::int AS worker, layer, idx, round(x, 6) + 0.0 AS value FROM w, range({WORKERS}) AS r(n)""")
def to_every_worker(spark, sf_dir):
    return long_weights(M.to_every_worker(whole_list(spark, sf_dir), WORKERS), keep=("worker", "layer"))


@query("weights_by_layer_name", """
SELECT row_number() OVER (ORDER BY n_nationkey, c_custkey) - 1 AS idx, n_nationkey AS layer_pos, n_name AS name,
       c_custkey AS blob_no, c_acctbal AS value
FROM nation JOIN customer ON n_name = 'NATION_' || c_nationkey""")
def weights_by_layer_name(spark, sf_dir):
    """Customers as named blobs, nations as the layers that look them up by name."""
    layers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer_pos"), F.col("n_name").alias("name"))
    named = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"),
        F.col("c_custkey").alias("blob_no"), F.array("c_acctbal").alias("values"))
    found = M.weights_by_layer_name(layers, named)
    return found.select("idx", "layer_pos", "name", "blob_no", F.col("values")[0].alias("value"))


@query("elastic_exchange", f"""
WITH {SQL_WEIGHTS} SELECT layer, idx, round(0.9 * x + 0.1 * y, 6) + 0.0 AS worker_value,
       round(0.95 * y + 0.05 * x, 6) + 0.0 AS centre_value FROM a JOIN b USING (layer, idx)""")
def elastic_exchange(spark, sf_dir):
    met = M.elastic_exchange(*both(spark, sf_dir), rate=0.1, server_factor=0.5)
    pairs = met.select("layer", "chunk", F.posexplode(F.arrays_zip("worker_values", "centre_values")).alias("place", "p"))
    return pairs.select(
        "layer", (F.col("chunk").cast("bigint") * SIZE + F.col("place")).alias("idx"),
        (F.round("p.worker_values", 6) + 0.0).alias("worker_value"),
        (F.round("p.centre_values", 6) + 0.0).alias("centre_value"))


def arriving(spark, sf_dir):
    """Four workers hold a copy each of every layer, the copies being scaled apart by worker number."""
    a = M.to_every_worker(parity_list(spark, sf_dir, 0), WORKERS)
    return a.withColumn("values", F.transform("values", lambda x: x * (F.col("worker") + 1))).withColumns(
        {"a": F.lit(0.1), "b": F.lit(0.1) * F.pow(F.lit(0.5), F.col("worker"))})


def _sql_fold():
    ctes, centre = [], "y"
    for w in range(WORKERS):
        rate = 0.1 * 0.5**w
        ctes.append(f"m{w} AS (SELECT layer, idx, x, {centre} AS before, (1 - {rate}::double) * {centre} + {rate}::double * (x * {w + 1}) AS c{w} FROM "
                    + ("a JOIN b USING (layer, idx))" if w == 0 else f"m{w - 1})"))
        centre = f"c{w}"
    rows = " UNION ALL ".join(
        f"SELECT {w} AS worker, layer, idx, round(0.9::double * (x * {w + 1}) + 0.1::double * before, 6) + 0.0 AS worker_value FROM m{w}"
        for w in range(WORKERS))
    return f"WITH {SQL_WEIGHTS}, {', '.join(ctes)}", rows, f"SELECT layer, idx, round(c{WORKERS - 1}, 6) + 0.0 AS value FROM m{WORKERS - 1}"


@query("fold_exchanges_centre", "{0} {2}".format(*_sql_fold()))
def fold_exchanges_centre(spark, sf_dir):
    """The centre after four workers met it one after another at falling coefficients."""
    folded = M.fold_exchanges(arriving(spark, sf_dir), parity_list(spark, sf_dir, 1))
    return long_weights(folded, values="centre")


@query("fold_exchanges_workers", "{0} {1}".format(*_sql_fold()))
def fold_exchanges_workers(spark, sf_dir):
    """Each worker's weights after it met the centre left by the worker before."""
    folded = M.fold_exchanges(arriving(spark, sf_dir), parity_list(spark, sf_dir, 1))
    met = folded.select("layer", "chunk", F.explode("met").alias("m")).select("layer", "chunk", "m.worker", "m.values")
    return long_weights(met, keep=("worker", "layer"), name="worker_value")


@query("fold_arrivals", f"""
WITH numbered AS (
  SELECT label AS layer, embedding, count(*) OVER (PARTITION BY label) AS total,
         row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:arrival:' || vec_id)) AS n FROM embeddings),
long AS (
  SELECT layer, n, total, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS x FROM numbered)
SELECT layer, idx, round(sum(0.05::double * pow(0.95::double, total - n) * x) + pow(0.95::double, max(total)) * 1.0, 6) + 0.0 AS value
FROM long GROUP BY layer, idx""")
def fold_arrivals(spark, sf_dir):
    """All vectors of a label arrive at that label's centre, which starts at 1."""
    rows = samples(spark, sf_dir).select(
        F.col("label").cast("int").alias("layer"), F.col("data").alias("values"),
        hash_key(SEED, "arrival", F.col("id")).alias("key"))
    numbered = number_by_hash(rows, ["layer"], "key", "n", "total")
    arrivals = M.chunked(numbered, size=SIZE, keep=("n", "total"))
    ones = F.transform(F.sequence(F.lit(1), F.lit(SIZE)), lambda i: F.lit(1.0))
    centre = arrivals.select("layer", "chunk").distinct().withColumn("values", ones)
    return long_weights(M.fold_arrivals(arrivals, centre, 0.05))


@query("apply_deltas", f"""
WITH deltas AS (
  SELECT label AS layer, unnest(range(64))::bigint AS idx, unnest(embedding)::double AS d FROM embeddings)
SELECT layer, idx, round(1.0 - sum(d), 6) + 0.0 AS value FROM deltas GROUP BY layer, idx""")
def apply_deltas(spark, sf_dir):
    """All vectors of a label are pushed as updates of that label's centre, which starts at 1."""
    rows = samples(spark, sf_dir).select(F.col("label").cast("int").alias("layer"), F.col("data").alias("values"))
    deltas = M.chunked(rows, size=SIZE)
    ones = F.transform(F.sequence(F.lit(1), F.lit(SIZE)), lambda i: F.lit(1.0))
    centre = deltas.select("layer", "chunk").distinct().withColumn("values", ones)
    return long_weights(M.apply_deltas(centre, deltas))


@query("delta_norm", f"""
WITH parts AS (SELECT {sql_worker('vec_id')} AS file, embedding FROM embeddings)
SELECT file, sum(len(embedding))::bigint AS n,
       round(sum(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) + 0.0 AS sum_squares
FROM parts GROUP BY file""")
def delta_norm(spark, sf_dir):
    rows = assign_workers(samples(spark, sf_dir), ["id"], WORKERS, SEED).withColumnRenamed("worker", "file")
    return squared_norms(rows, "file", "data").withColumn("sum_squares", F.round("sum_squares", 6) + 0.0)
