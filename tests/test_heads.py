import math

import pytest

from elastrain.operators.aggregates import heads_report, mean_scores


@pytest.mark.parametrize("test_iter", [0, 2, 3, 7, 12])
def test_batches_are_taken_round_and_round(spark, test_iter):
    rows = [(float(i * i % 11), float(i), i // 4, 3) for i in range(14)]  # three full batches of four, two rows beyond
    df = spark.createDataFrame(rows, "loss double, hit double, batch long, batches long")
    found = {r.output: r for r in mean_scores(df, {"loss": 0.3, "hit": 0.0}, test_iter).collect()}
    taken = [i % 3 for i in range(test_iter or 3)]
    used = [r for b in taken for r in rows if r[2] == b]
    assert found["loss"].mean_score == pytest.approx(0.3 * sum(r[0] for r in used) / len(used))
    assert found["hit"].mean_score == pytest.approx(sum(r[1] for r in used) / len(used))
    assert {r.left_over for r in found.values()} == {sum(r[2] not in taken for r in rows)}


def test_no_full_batch_gives_nulls(spark):
    df = spark.createDataFrame([(1.0, 0, 0)], "loss double, batch long, batches long")
    for test_iter in (0, 5):
        row = mean_scores(df, {"loss": 1.0}, test_iter).first()
        assert row.mean_score is None and row.left_over == 1


def test_heads_are_weighted_and_summed(spark):
    rows = [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0], 2), ([0.0, 5.0, 0.0], [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "last array<double>, side array<double>, label int")
    found = {r["head"]: r for r in heads_report(df, {"side": 0.3, "last": 1.0}, "label", (1, 2)).collect()}

    def loss(scores, label):
        return math.log(sum(map(math.exp, scores))) - scores[label]

    want = {"last": sum(loss(r[0], r[2]) for r in rows) / 2, "side": 0.3 * sum(loss(r[1], r[2]) for r in rows) / 2}
    for head, value in want.items():
        assert found[head].loss == pytest.approx(value) and found[head].total_loss == pytest.approx(sum(want.values()))
    assert (found["last"].accuracy_1, found["last"].accuracy_2) == (0.5, 1.0)
    assert (found["side"].accuracy_1, found["side"].accuracy_2) == (0.5, 0.5)
    empty = heads_report(df.where("false"), {"side": 0.3}, "label").first()
    assert empty.n == 0 and empty.loss is None
