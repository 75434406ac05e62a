import corpus_pipeline
import pytest

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
CLEAN = " ".join(f"clean{i}" for i in range(60))
NEAR = CLEAN.replace("clean30", "other")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def left(spark, stage, rows, sf_dir):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect()), key=str)


def test_contaminated_rows_go_and_rows_of_their_id_stay(spark, sf_dir):
    rows = [(None, f"x {ITEM}"), (None, "clean"), (None, None), (5, ITEM), (5, "clean"), (5, None), (6, ITEM), (7, "y")]
    want = [(None, "clean"), (None, None), (5, "clean"), (5, None), (7, "y")]
    assert left(spark, corpus_pipeline.drop_contaminated, rows, sf_dir) == sorted(want, key=str)


def test_one_of_near_copies_stays_whatever_the_ids(spark, sf_dir):
    drop = corpus_pipeline.drop_near_copies
    assert len(left(spark, drop, [(None, CLEAN), (None, NEAR), (None, "z")], sf_dir)) == 2
    assert len(left(spark, drop, [(4, CLEAN), (4, NEAR)], sf_dir)) == 1
    rows = [(None, CLEAN), (3, NEAR), (8, NEAR + " end"), (8, "a text of its own")]
    assert left(spark, drop, rows, sf_dir) == [(3, NEAR), (8, "a text of its own")]


def test_columns_named_like_the_stages_own_come_through(spark, sf_dir):
    rows = [(1, CLEAN, "d", "r", "k"), (2, NEAR, "D", "R", "K"), (3, CLEAN, "x", "y", "z"), (4, f"x {ITEM}", "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _digest string, _row string, _KEY string")
    for stage, kept in ((corpus_pipeline.drop_exact_copies, {2, 3, 4}), (corpus_pipeline.drop_near_copies, {1, 4}), (corpus_pipeline.drop_contaminated, {1, 2, 3})):
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [r for r in rows if r[0] in kept]
