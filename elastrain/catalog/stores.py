"""Round trips of the given tables through every file format."""

from pyspark.sql import functions as F

from elastrain.catalog.common import SEED, SQL_SHARDED, samples, sharded
from elastrain.catalog.registry import query, table
from elastrain.functions.arrays import decode_u8, encode_u8, quantised
from elastrain.operators.batching import assign_workers, shard_sizes
from elastrain.operators.weights import chunked
from elastrain.session import fresh_path
from elastrain.sources import files, shards, stores
from elastrain.sources.tables import worker_table, zero_samples

DIMS = (1, 8, 8)


def _checksum(column="data"):
    terms = F.transform(column, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 6) + 0.0


FILE_ROWS = 100
SQL_PLACE = f"""vec_id // {FILE_ROWS} AS file, row_number() OVER (PARTITION BY vec_id // {FILE_ROWS} ORDER BY vec_id) - 1 AS place"""


def _in_files(spark, sf_dir):
    """The samples, those of a file together and in order."""
    rows = samples(spark, sf_dir).withColumn("file", F.floor(F.col("id") / FILE_ROWS))
    return rows.repartition("file").sortWithinPartitions("file", "id")


def _place():
    """The number of a file's folder, and the place in the file, from an id."""
    return F.regexp_extract("id", "^file=([0-9]+)/", 1).cast("bigint").alias("file"), F.substring_index("id", ":", -1).cast("bigint").alias("place")


@query("scan_tsv_images", f"""
SELECT {SQL_PLACE}, label::double AS label, len(embedding)::int AS n,
       round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 6) + 0.0 AS checksum FROM embeddings""")
def scan_tsv_images(spark, sf_dir):
    path = fresh_path(spark, "tsv")
    files.write_tsv_images(_in_files(spark, sf_dir), path, by="file")
    df = files.scan_tsv_images(spark, path, DIMS)
    return df.select(*_place(), F.col("label").cast("double").alias("label"), F.size("data").alias("n"), _checksum().alias("checksum"))


@query("scan_binary_images", f"""
SELECT {SQL_PLACE}, (48 + label)::double AS label,
       list_sum(list_transform(embedding, lambda x, i: (70 + trunc(x::double * 30)) * i)) + 65 * 10 AS checksum FROM embeddings""")
def scan_binary_images(spark, sf_dir):
    """Vectors as printable bytes behind a label byte; the line end is the last byte of a record."""
    def char(code):
        return F.char(code.cast("int"))

    path = fresh_path(spark, "records")
    codes = F.transform("data", lambda x: char((x.cast("double") * 30).cast("int") + 70))
    lines = _in_files(spark, sf_dir).select(F.concat(char(F.col("label") + 48), F.array_join(codes, "")), "file")
    lines.write.partitionBy("file").text(path)
    df = files.scan_binary_images(spark, path, (1, 1, 65))
    return df.select(*_place(), F.col("label").cast("double").alias("label"), _checksum().alias("checksum"))


SQL_BYTES = """SELECT label::double AS label, len(embedding)::int AS n,
       list_sum(list_transform(embedding, lambda x, i: (trunc(x::double * 100)::int & 255) * i))::double AS checksum FROM embeddings"""


def _bytes(spark, sf_dir):
    scaled = F.transform("data", lambda x: x.cast("double") * 100)
    return samples(spark, sf_dir).withColumn("data", encode_u8(quantised(scaled)))


def _byte_rows(df):
    numbers = df.select(F.col("label").cast("double").alias("label"), decode_u8("data").alias("data"))
    return numbers.select("label", F.size("data").alias("n"), _checksum().alias("checksum"))


@query("sequence_pairs", SQL_BYTES)
def sequence_pairs(spark, sf_dir):
    path = fresh_path(spark, "pairs")
    files.write_sequence_pairs(_bytes(spark, sf_dir), path)
    return _byte_rows(files.scan_sequence_pairs(spark, path, DIMS))


@query("sequence_files", SQL_BYTES)
def sequence_files(spark, sf_dir):
    path = fresh_path(spark, "sequence")
    files.write_sequence_file(_bytes(spark, sf_dir), path)
    return _byte_rows(files.scan_sequence_file(spark, path, DIMS))


SQL_STORED = f"""{SQL_SHARDED}, stored AS (
  SELECT *, row_number() OVER (PARTITION BY worker ORDER BY id) - 1 AS pos FROM sharded)"""


@query("number_samples", f"""
WITH {SQL_STORED} SELECT id, worker, pos, printf('%08d', pos) AS key, pos // 100 AS "commit" FROM stored""")
def number_samples(spark, sf_dir):
    numbered = shards.number_samples(sharded(spark, sf_dir), "id", commit_rows=100)
    return numbered.select("id", "worker", "pos", "key", "commit")


def stored_shards(spark, sf_dir, block_rows=64):
    path = fresh_path(spark, "shards")
    scaled = F.transform("data", lambda x: x.cast("double") * 100)
    shards.materialise_shards(sharded(spark, sf_dir).withColumn("data", scaled), "id", path, block_rows=block_rows)
    return path


@query("materialise_shards", f"""
WITH {SQL_STORED} SELECT worker, pos // 64 AS block, printf('%08d', pos) AS key, label::double AS label,
  list_sum(list_transform(data, lambda x, i: (trunc(x::double * 100)::int & 255) * i))::double AS checksum FROM stored""")
def materialise_shards(spark, sf_dir):
    df = shards.read_shards(spark, stored_shards(spark, sf_dir))
    return df.select(
        "worker", F.col("block").cast("bigint").alias("block"), "key", F.col("label").cast("double").alias("label"),
        _checksum().alias("checksum"))


@query("list_keys", f"WITH {SQL_STORED} SELECT worker, printf('%08d', pos) AS key FROM stored")
def list_keys(spark, sf_dir):
    return shards.list_keys(spark, stored_shards(spark, sf_dir))


def _as_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("layer"), F.col("embedding").alias("values"))
    return chunked(rows, size=16)


@query("saved_weights", """
SELECT vec_id::int AS layer, unnest(range(64))::bigint AS idx, unnest(list_transform(embedding, lambda x: (x::double * 2)::float))::double AS value
FROM embeddings""")
def saved_weights(spark, sf_dir):
    """Two tags are saved, one is loaded."""
    path = fresh_path(spark, "weights")
    weights = _as_weights(spark, sf_dir)
    stores.save_weights(weights, path, stores.centre_tag(1))
    stores.save_weights(weights.withColumn("values", F.transform("values", lambda x: x * 2)), path, stores.centre_tag(2))
    loaded = stores.load_weights(spark, path, stores.centre_tag(2))
    cells = loaded.select("layer", "chunk", F.posexplode("values").alias("place", "value"))
    return cells.select("layer", (F.col("chunk").cast("bigint") * 16 + F.col("place")).alias("idx"), "value")


@query("training_log", """
SELECT event_type AS kind, user_id::int AS worker, event_id AS iter, value FROM events""")
def training_log(spark, sf_dir):
    """All events appended to a log in two goes and read back."""
    path = fresh_path(spark, "log")
    rows = table(spark, sf_dir, "events").select(
        F.lit("run-1").alias("run"), F.col("user_id").alias("worker"), F.col("event_id").alias("update_no"),
        F.col("event_id").alias("iter"), F.col("event_type").alias("kind"), "value", F.lit(0.0).alias("elapsed_s"))
    stores.write_training_log(rows.where("iter % 2 = 0"), path)
    stores.write_training_log(rows.where("iter % 2 != 0"), path)
    return stores.read_training_log(spark, path).select("kind", "worker", "iter", "value")


@query("worker_table", f"""
WITH sizes AS (SELECT ('0x' || substr(md5('{SEED}:shard:' || vec_id), 1, 8))::bigint % 1000 AS worker, count(*) AS n FROM embeddings GROUP BY 1)
SELECT w::int AS worker, coalesce(n, 0) AS n FROM range(1000) AS r(w) LEFT JOIN sizes ON worker = w""")
def worker_table_query(spark, sf_dir):
    """Shard sizes of a thousand workers, the empty ones included."""
    sizes = shard_sizes(assign_workers(samples(spark, sf_dir), ["id"], 1000, SEED))
    every = worker_table(spark, 1000).join(sizes, "worker", "left")
    return every.select("worker", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("zero_samples", """
SELECT vec_id AS id, source, 64::int AS n, 0.0::double AS total, 0.0::double AS label
FROM embeddings, (VALUES ('TRAIN'), ('TEST')) AS s(source)""")
def zero_samples_query(spark, sf_dir):
    """A placeholder for every sample of the table."""
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return zero_samples(samples(spark, sf_dir), DIMS).select(
        "id", "source", F.size("data").alias("n"), total.alias("total"), F.col("label").cast("double").alias("label"))


@query("stored_shard_sizes", f"WITH {SQL_SHARDED} SELECT worker, count(*) AS n FROM sharded GROUP BY worker")
def stored_shard_sizes(spark, sf_dir):
    """Rows of every store; the values are not read."""
    return shard_sizes(spark.read.parquet(stored_shards(spark, sf_dir)))
