"""Row-wise sample queries."""

from pyspark.sql import functions as F

from elastrain.catalog.common import SEED, samples, sharded, sql_values, sql_worker, values_of
from elastrain.catalog.registry import query, table
from elastrain.functions import arrays
from elastrain.operators import samples as S

CHANNEL_MEANS = [104.0, 117.0, 123.0, 110.0]
CHANNELS = (4, 4, 4)


@query("to_record", """
SELECT vec_id AS id, label::double AS label, len(embedding)::bigint AS n, 1 AS channels, 8 AS height, 8 AS width,
       round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 6) + 0.0 AS checksum
FROM embeddings""")
def to_record(spark, sf_dir):
    df = samples(spark, sf_dir)
    weighted = F.aggregate(
        F.transform("data", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return df.select(
        "id", F.col("label").cast("double").alias("label"), F.size("data").cast("bigint").alias("n"),
        F.col("dim")[0].alias("channels"), F.col("dim")[1].alias("height"), F.col("dim")[2].alias("width"),
        (F.round(weighted, 6) + 0.0).alias("checksum"),
    )


@query("filter_label_below", """
SELECT vec_id AS id, label::double AS label FROM embeddings WHERE label < 3""")
def filter_label_below(spark, sf_dir):
    return S.filter_label_below(samples(spark, sf_dir), 3).select("id", F.col("label").cast("double").alias("label"))


@query("scale_pixels", sql_values(
    "embeddings", "list_transform(embedding, lambda x: (x::double / 255.0::double)::float)", digits=None))
def scale_pixels(spark, sf_dir):
    return values_of(S.scale_pixels(samples(spark, sf_dir)), ["id"], digits=None)


def _centred(divisor):
    mean = f"list_sum(embedding::double[]) / ({divisor})"
    return sql_values(
        f"(SELECT vec_id, embedding, {mean} AS m FROM embeddings)", "list_transform(embedding, lambda x: x::double - m)")


@query("centre_per_record", _centred("len(embedding)"))
def centre_per_record(spark, sf_dir):
    return values_of(S.centre_per_record(samples(spark, sf_dir)), ["id"])


@query("centre_per_record_with_label", _centred("len(embedding) + 1"))
def centre_per_record_with_label(spark, sf_dir):
    return values_of(S.centre_per_record(samples(spark, sf_dir), include_label_in_divisor=True), ["id"])


@query("decode_u8", """
WITH points AS (SELECT doc_id, unicode(unnest(string_split(text, ''))) AS c FROM documents WHERE text <> ''),
sums AS (
  SELECT doc_id,
    sum(CASE WHEN c < 128 THEN 1 WHEN c < 2048 THEN 2 WHEN c < 65536 THEN 3 ELSE 4 END) AS n,
    sum(CASE WHEN c < 128 THEN c WHEN c < 2048 THEN 320 + (c >> 6) + (c & 63)
             WHEN c < 65536 THEN 480 + (c >> 12) + ((c >> 6) & 63) + (c & 63)
             ELSE 624 + (c >> 18) + ((c >> 12) & 63) + ((c >> 6) & 63) + (c & 63) END) AS total
  FROM points GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::bigint AS n, coalesce(total, 0)::bigint AS total FROM documents LEFT JOIN sums USING (doc_id)""")
def decode_u8(spark, sf_dir):
    """Whole texts as bytes, decoded to 0..255: count and sum per document."""
    docs = table(spark, sf_dir, "documents")
    numbers = docs.select("doc_id", arrays.decode_u8(F.encode("text", "UTF-8")).alias("data"))
    total = F.aggregate("data", F.lit(0).cast("bigint"), lambda a, x: a + x)
    empty = F.lit(0).cast("bigint")
    return numbers.select(
        "doc_id", F.coalesce(F.size("data").cast("bigint"), empty).alias("n"), F.coalesce(total, empty).alias("total"))


@query("quantise_u8", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       trunc(l_quantity)::int & 255 AS quantity, trunc(l_extendedprice)::int & 255 AS price,
       trunc(l_discount * -100)::int & 255 AS discount, trunc(l_tax * 12345.6)::int & 255 AS tax
FROM lineitem""")
def quantise_u8(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", F.lit(0).alias("label"),
        F.array("l_quantity", "l_extendedprice", F.col("l_discount") * -100, F.col("l_tax") * 12345.6).alias("data"),
    )
    names = ["quantity", "price", "discount", "tax"]
    return S.quantise_u8(rows).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        *[F.col("data")[i].alias(n) for i, n in enumerate(names)],
    )


@query("mean_image", """
SELECT (j - 1)::bigint AS j, round(avg(x), 6) + 0.0 AS value FROM (
  SELECT unnest(embedding)::double AS x, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings) GROUP BY j""")
def mean_image(spark, sf_dir):
    mean = S.mean_image(samples(spark, sf_dir))
    return values_of(mean.withColumnRenamed("mean", "data"), [])


@query("subtract_mean_image", """
WITH long AS (
  SELECT vec_id AS id, unnest(embedding)::double AS x, unnest(range(len(embedding)))::bigint AS j FROM embeddings),
mean AS (SELECT j, avg(x) AS m FROM long GROUP BY j)
SELECT id, j, round(x - m, 6) + 0.0 AS value FROM long JOIN mean USING (j)""")
def subtract_mean_image(spark, sf_dir):
    df = samples(spark, sf_dir)
    return values_of(S.subtract_mean_image(df, S.mean_image(df)), ["id"])


@query("subtract_channel_mean", sql_values(
    "embeddings",
    "list_transform(embedding, lambda x, i: x::double - list_extract([104.0, 117.0, 123.0, 110.0]::double[], (i - 1) // 16 + 1))"))
def subtract_channel_mean(spark, sf_dir):
    return values_of(S.subtract_channel_mean(samples(spark, sf_dir, CHANNELS), CHANNEL_MEANS, 16), ["id"])


def _window(top, left):
    inside = f"(i // 4) % 4 >= {top} AND (i // 4) % 4 < {top} + 2 AND i % 4 >= {left} AND i % 4 < {left} + 2"
    return f"list_transform(list_filter(range(64), lambda i: {inside}), lambda i: embedding[i + 1])"


@query("crop_centre", sql_values("embeddings", _window("1", "1"), digits=None))
def crop_centre(spark, sf_dir):
    return values_of(S.crop(samples(spark, sf_dir, CHANNELS), 2, 4, 4, "centre"), ["id"], digits=None)


def _draw(name, sides):
    return f"(('0x' || substr(md5('{SEED}:0:{name}:' || vec_id), 1, 8))::bigint % {sides})"


@query("crop_random", sql_values(
    f"(SELECT *, {_draw('top', 3)} AS t, {_draw('left', 3)} AS l FROM embeddings)", _window("t", "l"), digits=None))
def crop_random(spark, sf_dir):
    cut = S.crop(samples(spark, sf_dir, CHANNELS), 2, 4, 4, "random", ["id"], SEED)
    return values_of(cut, ["id"], digits=None)


@query("mirror", sql_values(
    f"(SELECT *, {_draw('mirror', 2)} = 0 AS heads FROM embeddings)",
    "list_transform(range(64), lambda i: CASE WHEN heads THEN embedding[i - i % 4 + 3 - i % 4 + 1] ELSE embedding[i + 1] END)",
    digits=None))
def mirror(spark, sf_dir):
    return values_of(S.mirror(samples(spark, sf_dir, CHANNELS), 4, ["id"], SEED, 0), ["id"], digits=None)


@query("label_and_width", """
SELECT vec_id AS id, label::double AS label, len(embedding)::int AS n FROM embeddings""")
def label_and_width(spark, sf_dir):
    return S.label_and_width(samples(spark, sf_dir), ["id"]).withColumn("label", F.col("label").cast("double"))


@query("worker_assignment", f"SELECT vec_id AS id, {sql_worker('vec_id')} AS worker FROM embeddings")
def worker_assignment(spark, sf_dir):
    return sharded(spark, sf_dir).select("id", "worker")
