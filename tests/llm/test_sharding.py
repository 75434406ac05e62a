import random
import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from samples import awkward, empty, prose

from elastrain.llm import sharding


def least_capacity(sizes, shards):
    """Smallest largest run over all contiguous cuts, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[j], *(max(best[i], ends[j] - ends[i]) for i in range(j))]) for j in range(len(ends))]
    return best[-1]


def check(rows, got, shards):
    sizes = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((i, sizes(t), crc(t)) for i, t in rows), key=str) == sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str)
    for _, members in groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard):
        slots = sorted(r.slot for r in members)
        assert slots == list(range(len(slots)))
    at = {}
    for r in got:
        assert at.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and 0 <= r.shard < shards
    totals = {}
    for _, t in rows:
        totals[t or ""] = totals.get(t or "", 0) + sizes(t)
    ordered = sorted(totals, key=lambda t: sha256(t.encode()).digest())
    shard_of = [at[sizes(t), crc(t)] for t in ordered]
    assert shard_of == sorted(shard_of)
    filled = [sum(totals[t] for t, s in zip(ordered, shard_of) if s == i) for i in range(shards)]
    assert max(filled) == least_capacity([totals[t] for t in ordered], shards)
    return filled


def test_table(spark):
    df, rows = awkward(spark, prose(120))
    df = df.selectExpr("*", "7 AS size", "'s' AS shard", "0 AS slot", "'d' AS digest")
    for shards in (1, 4, 16):
        check(rows, sharding.shard_documents(df, shards).collect(), shards)
    assert sharding.shard_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "one")], "doc_id bigint, text string")
    assert [r.slot for r in sharding.shard_documents(one).collect()] == [0]


def test_large_group_leaves_the_others_even(spark):
    texts = [*prose(200, seed=4, words=60), *["the same text " * 40] * 150]
    rows = list(enumerate(texts))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    filled = check(rows, got, 16)
    rest = sorted(filled)[:-1]
    largest = max(len(t.encode()) + 1 for t in texts[:200])
    assert min(rest) > 0 and max(rest) <= sum(rest) / 15 + 2 * largest


@pytest.mark.parametrize("split", [2, 3])
def test_search_refines_stretches(spark, monkeypatch, split):
    """With few stretches a round the search still ends at the exact capacity and exact cuts."""
    monkeypatch.setattr(sharding, "FIRST_SPLIT", 4)
    monkeypatch.setattr(sharding, "SPLIT", split)
    draw = random.Random(split)
    rows = list(enumerate("x" * draw.choice([1, 5, 40, 300]) + str(i) for i in range(60)))
    check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).collect(), 7)


def test_slots_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 8)
    rows = list(enumerate(prose(150, seed=9)))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3).collect()
    check(rows, got, 3)
