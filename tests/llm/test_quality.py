import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from samples import awkward, empty, prose

from elastrain.llm import quality


def corpus(n, seed=4):
    draw, good = random.Random(seed), prose(n, seed=seed, words=60, vocabulary=5000)
    rows = []
    for i, t in enumerate(good):
        bad = draw.random() < 0.3
        rows.append((i, " ".join(w.upper() + "!!" for w in t.split()) if bad else t + ".", int(not bad)))
    return rows


def test_features_are_the_distinct_grams_of_the_whole_text():
    tokens = quality.Tokens()
    assert len(quality.features("", tokens)) == len(quality.features(" \n", tokens)) == 0
    assert len(quality.features("one", tokens)) == 2
    a, b = (quality.features(t, tokens) for t in ("one two one two", "one two one two one two"))
    assert set(a) == set(b)
    assert quality.shape("ABle,,12") == "~a,0" and quality.shape("ÉÉé!!") == "~a!"
    late = quality.features("x " * 50_000 + "end", tokens)
    assert set(quality.features("end", tokens)) <= set(late)


def test_ratios():
    ratios = quality.log_count_ratios([np.array([1, 2]), np.array([1, 2]), np.array([2, 3]), np.array([2])], np.array([1, 1, 0, 0]))
    assert ratios[1] == np.log((3 / 4) / (1 / 4)) and ratios[2] == 0 and ratios[3] == 0


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 30, 6)) for _ in range(60)]
    y, scale = (np.array([r.sum() for r in rows]) > 60).astype(int), np.zeros(quality.FEATURES)
    scale[:30] = draw.normal(size=30)
    w, bias = quality.dual_coordinate_descent(rows, scale, y, epochs=3000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 30] = 1
    signs, v = np.where(y > 0, 1, -1), np.append(w[:30], bias)
    upper = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())
    loss = lambda v: v @ v / 2 + (upper * np.maximum(0, 1 - signs * (x @ v))).sum()
    assert all(loss(v) <= loss(v + draw.normal(size=31) * s) + 1e-2 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_held_out_accuracy(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    learn = quality.learnable(labels)
    assert {r.doc_id for r in learn.collect()} == {i for i, _, _ in rows if crc32(str(i).encode()) % 3 != 1}
    model = quality.fit(docs, learn, sample=300)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, model).where("predicted = 1").count()
    again = quality.fit(docs.repartition(3), learn, sample=300)
    assert np.array_equal(again.weights, model.weights)


def test_awkward_tables(spark):
    df, rows = awkward(spark, prose(10))
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int")
    model = quality.fit(df, quality.learnable(none))
    assert {(r.score, r.predicted) for r in quality.score(df, model).collect()} == {(0.5, 1)}
    assert quality.score(df, model).count() == len(rows)
    one_class = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, quality int")
    assert quality.score(df, quality.fit(df, quality.learnable(one_class))).where("score IS NULL").count() == 0
    assert quality.score(empty(spark), model).count() == 0
