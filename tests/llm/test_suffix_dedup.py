import hashlib
import random
from collections import Counter

import pytest
from samples import awkward, empty, prose

from elastrain.llm import suffix_dedup
from elastrain.llm.suffix_sort import common_prefixes, repeated_starts, suffix_array


def brute(rows, length):
    counts = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        spans = suffix_dedup.merged([(p, p + length) for p in range(len(t) - length + 1) if counts[t[p : p + length]] > 1])
        edges = [0, *(x for s in spans for x in s), len(t)]
        kept = b"".join(t[lo:hi] for lo, hi in zip(edges[::2], edges[1::2]))
        out.append((i, len(t), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **how):
    rows = suffix_dedup.remove_repeats(df, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], hashlib.sha256(r.kept).hexdigest()) for r in rows), key=str)


def test_suffix_arrays():
    draw = random.Random(3)
    for _ in range(1500):
        symbols = [draw.randint(1, draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 40))]
        if draw.random() < 0.3:
            symbols = (symbols[:5] * 20)[: len(symbols)]
        symbols.append(0)
        order = suffix_array(symbols)
        assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        shared = common_prefixes(symbols, order)
        for r in range(1, len(order)):
            a, b = symbols[order[r - 1] :], symbols[order[r] :]
            assert shared[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_repeated_starts():
    texts = [b"abcabcx", b"ybcab"]
    want = [[i for i in range(len(t) - 2) if sum(u[j : j + 3] == t[i : i + 3] for u in texts for j in range(len(u))) > 1] for t in texts]
    assert repeated_starts(texts, 3) == want


@pytest.mark.parametrize("length, gram, together", [(40, 11, 400), (40, 40, 400), (33, 5, 3), (12, 1, 2)])
def test_against_brute_force(spark, monkeypatch, length, gram, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    monkeypatch.setattr(suffix_dedup, "BYTES_AT_ONCE", 100)
    draw = random.Random(9)
    parts = ["".join(draw.choice("abé") for _ in range(draw.randint(5, 60))) for _ in range(12)]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(150)] + ["ab" * n for n in (3, 30, 60)]
    df, rows = awkward(spark, texts, "long " * 300)
    assert found(df, length=length, gram=gram) == brute([(i, (t or "").encode()) for i, t in rows], length)


def test_nothing_to_remove(spark):
    df, rows = awkward(spark, prose(10))
    assert all(not spans or n >= 400 for _, n, spans, _ in found(df))
    assert found(empty(spark)) == []


def test_rows_without_id_whose_short_hashes_agree(spark):
    """A copied text and a text of its own, alike in 32 bits of hash: only the copied one loses anything."""
    from pyspark.sql import functions as F

    from elastrain.llm.suffix_dedup import remove_repeats

    digit = [F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{i}")), 512) for i in range(4)]
    texts = spark.range(250_000).select(F.concat(*digit).alias("text")).withColumn("h", F.hash(F.lit(-(1 << 63)), "text"))
    one, other = texts.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    docs = spark.createDataFrame([(None, one), (None, other), (1, one)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in remove_repeats(docs).collect())
    assert got == [("1", 0), ("None", 0), ("None", 512)]


def test_a_hot_anchor_is_not_split_into_strings(spark, monkeypatch):
    """Many copies of a passage, each changed in another place: pieces, not strings, are compared, and the result is exact."""
    draw = random.Random(15)
    base = [draw.choice("abcdefgh") * draw.randint(1, 3) + str(draw.randrange(1000)) for _ in range(60)]
    texts = []
    for k in range(60):
        words = list(base)
        words[draw.randrange(len(words))] = f"own{k}"
        texts.append(f"{k} {draw.random()} " + " ".join(words) + f" {draw.random()} {k}")
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 8)
    made, plain = [], suffix_dedup._cut

    def counted(stretched, *how):
        out = plain(stretched, *how)
        made.append((stretched.count(), out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "_cut", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert found(df, length=120, gram=30) == brute([(i, t.encode()) for i, t in enumerate(texts)], 120)
    assert made and sum(n for _, n in made) < 10 * made[0][0]
