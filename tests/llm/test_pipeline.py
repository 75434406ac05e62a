import hashlib

import corpus_pipeline
import pytest
from samples import empty

SF_DIR = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir=SF_DIR):
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    return seen


@pytest.fixture(scope="module")
def seen(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**9, docs.where("doc_id = 3").first().text, None, None, None), (10**9 + 1, None, "en", "s", 0), (10**9 + 2, "", "en", "s", 0), (None, "no id here.", "en", "s", 1)],
        docs.schema,
    )
    return stages(spark, docs.union(extra).union(docs.where("doc_id = 4")))


def test_each_stage_returns_documents(seen):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE",
    ]
    assert all(df.columns == seen[0].columns for df in seen[:-1])
    counts = [df.count() for df in seen]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 100


def test_no_two_equal_texts_stay(seen):
    rows = seen[2].collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in seen[1].collect()}
    last = {}
    for r in seen[1].collect():
        last[r.text or ""] = max(last.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert all(r.doc_id is None or r.doc_id == last[r.text or ""] for r in rows)


def test_near_copies_and_contaminated_go(seen):
    from itertools import combinations

    from test_decontaminate import brute as hits
    from test_near_copies import alike
    from test_simhash import brute_roots

    # The stage links texts whose sets of 5-word shingles have a similarity of 0.8 or more; the smallest id of a group stays.
    rows = [(r.doc_id, r.text) for r in seen[2].collect()]
    texts = {i: t for i, t in rows if i is not None}
    roots = brute_roots(texts, [(a, b) for a, b in combinations(texts, 2) if alike(texts[a], texts[b])])
    assert {r.doc_id for r in seen[3].collect()} - {None} == set(roots.values())
    spark = seen[0].sparkSession
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = hits([(r.doc_id, r.text) for r in seen[3].collect()], items, 13)
    assert {r.doc_id for r in seen[4].collect()} == {d for d, n, hit, _ in judged if not (hit and 20 * hit >= n)}


def test_ids_decode_to_the_texts(seen):
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen[4].collect()}
    assert {r.doc_id: r.decoded_sha256 for r in seen[5].collect()} == want


def test_empty_table(spark):
    assert all(df.count() == 0 for df in stages(spark, empty(spark)))
