import warnings

import pytest
from pyspark.sql import functions as F

from elastrain.functions.arrays import decode_u8, encode_u8
from elastrain.functions.scores import cross_entropy, hit_at
from elastrain.operators import samples as S

SCHEMA = "id long, data array<double>, label float, dim array<int>"


def frame(spark, *datas, dim=(1, 2, 2)):
    return spark.createDataFrame([(i, list(d), float(i), list(dim)) for i, d in enumerate(datas)], SCHEMA)


def data(df):
    return [r["data"] for r in df.orderBy("id").collect()]


def test_centring_constant_and_empty_samples(spark):
    df = frame(spark, [5.0, 5.0], [], [1.0, 3.0])
    assert data(S.centre_per_record(df)) == [[0.0, 0.0], [], [-1.0, 1.0]]
    assert data(S.centre_per_record(df, include_label_in_divisor=True))[2] == pytest.approx([1 - 4 / 3, 3 - 4 / 3])


def test_quantising_edges(spark):
    df = frame(spark, [-1.5, 255.9, 256.0, 300.2, 0.5, float("nan"), 1e12, -1e12])
    assert data(S.quantise_u8(df)) == [[255, 255, 0, 44, 0, 0, 255, 0]]


def test_quantising_scaled_data_warns(spark):
    with pytest.warns(UserWarning, match="zeros and ones"):
        S.quantise_u8(frame(spark, [0.1, 1.0]), warn=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        S.quantise_u8(frame(spark, [0.1, 2.0]), warn=True)


def test_bytes_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\x7f\xff")), (2, bytearray(b"")), (3, None)], "id long, b binary")
    rows = df.select("id", decode_u8("b").alias("n")).select("id", "n", encode_u8("n").alias("b")).orderBy("id").collect()
    assert [r["n"] for r in rows] == [[0, 127, 255], [], None]
    assert [r["b"] for r in rows] == [bytearray(b"\x00\x7f\xff"), bytearray(b""), None]


def test_crop_and_mirror(spark):
    df = frame(spark, [float(i) for i in range(18)], dim=(2, 3, 3))
    assert data(S.crop(df, 1, 3, 3, "centre")) == [[4, 13]]
    cut = S.crop(df, 2, 3, 3, "random", ["id"], seed=1).collect()[0]
    assert len(cut["data"]) == 8 and cut["dim"] == [2, 2, 2]
    assert cut["data"][4:] == [x + 9 for x in cut["data"][:4]]
    flipped = S.mirror(df, 3, ["id"], 1, 0, sides=1)
    assert data(flipped)[0][:6] == [2, 1, 0, 5, 4, 3]
    with pytest.raises(ValueError):
        S.crop(df, 4, 3, 3, "centre")


def test_mean_image_and_channel_means(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0], [3.0, 2.0, 1.0, 0.0])
    assert data(S.subtract_mean_image(df, S.mean_image(df))) == [[-1.0, 0.0, 1.0, 2.0], [1.0, 0.0, -1.0, -2.0]]
    assert data(S.subtract_channel_mean(df, [1.0, 2.0], 2))[0] == [0.0, 1.0, 1.0, 2.0]


def test_hits_with_ties_and_losses(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], 1.0), ([1.0, 1.0, 0.0], 2.0)], "s array<double>, y float")
    rows = df.select(hit_at(F.col("s"), F.col("y"), 1).alias("h1"), hit_at(F.col("s"), F.col("y"), 2).alias("h2"),
                     cross_entropy(F.col("s"), F.col("y")).alias("loss")).collect()
    assert [(r["h1"], r["h2"]) for r in rows] == [(1.0, 1.0), (0.0, 0.0)]
    assert rows[0]["loss"] == pytest.approx(0.8619948040582511)


@pytest.mark.parametrize("label", [3.0, -1.0, None])
def test_label_outside_the_classes_is_an_error(spark, label):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], label)], "s array<double>, y float")
    with pytest.raises(Exception, match="label outside"):
        df.select(hit_at(F.col("s"), F.col("y"), 1)).collect()
