from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from samples import awkward, empty, prose

from elastrain.llm import exact_dedup
from elastrain.llm.exact_dedup import FuseFilter


def test_filters_never_miss_and_seldom_err():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 100, 5000, 100_000):
        keys = np.unique(draw.integers(0, 1 << 60, n, dtype=np.uint64))
        f = FuseFilter.build(keys)
        assert f.has(keys).all()
        strange = draw.integers(1 << 61, 1 << 62, 50_000, dtype=np.uint64)
        assert f.has(strange).mean() < 0.01
        assert len(f.table) < 1.4 * n + 400


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i is not None and i == keep))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_one_table(spark):
    texts = prose(60, words=3, vocabulary=6)
    df, rows = awkward(spark, texts)
    assert found(exact_dedup.deduplicated(df)) == expected(rows)
    assert exact_dedup.deduplicated(empty(spark)).count() == 0


def test_batch_against_snapshot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 7)
    df, rows = awkward(spark, prose(80, words=3, vocabulary=8))
    old = F.coalesce(F.col("doc_id"), F.lit(0)) < 40
    snapshot = exact_dedup.take_snapshot(df.where(old))
    assert snapshot.n_buckets > 1
    assert found(exact_dedup.exact_duplicates(df.where(~old), snapshot)) == expected(rows)
    inside = exact_dedup.with_digest(df.where(old)).select("digest").distinct()
    assert exact_dedup.screen(inside, snapshot).count() == inside.count()
    new = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert exact_dedup.screen(new, snapshot).count() < 100
    empty_batch = exact_dedup.exact_duplicates(df.where("false"), snapshot)
    assert empty_batch.count() == df.where(old).count()


def test_only_screened_digests_meet_the_buckets(spark, monkeypatch):
    from elastrain.llm import exact_dedup

    met, plain = [], exact_dedup.in_buckets

    def counted(hits, snapshot):
        met.append(hits.count())
        return plain(hits, snapshot)

    monkeypatch.setattr(exact_dedup, "in_buckets", counted)
    old = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id bigint, text string")
    new = spark.createDataFrame([(5000 + i, f"text {i + 1990}") for i in range(2000)], "doc_id bigint, text string")
    rows = exact_dedup.exact_duplicates(new, exact_dedup.take_snapshot(old)).collect()
    assert 10 <= met[0] <= 10 + 1990 / 256 * 4
    assert sum(r.group_size == 2 for r in rows) == 20
