"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text is the set of its n-grams (words, and shapes of words), hashed into a fixed number of features.
Indicators are scaled by the features' class log-count ratios; a linear hinge-loss model over them is
fitted by dual coordinate descent. Scaling and weights fold into one vector, by which texts are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, bounded_batches, column, documents

FEATURES = 1 << 18
#: Most labelled rows that a model is fitted on: those with the smallest md5 of their id.
SAMPLE = 4000
EPOCHS, COST, SMOOTHING, STEEPNESS = 10, 1.0, 1.0, 2.0
CACHE_SIZE = 150_000

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-Z~]+"), re.compile(r"\d+")
_RUN = re.compile(r"(.)\1+", re.S)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Letters by case, digits, and marks as they are, each run once: 'ABle,,' is 'Aa,'."""
    return _RUN.sub(r"\1", _LOWER.sub("a", _UPPER.sub("~", _DIGIT.sub("0", word))))


class Tokens(dict):
    """(hash of the word, hash of its shape) by word; starts anew when full."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE_SIZE:
            self.clear()
        got = crc32(word.lower().encode()), crc32(shape(word).encode())
        if len(word) <= 40:
            self[word] = got
        return got


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind, np.uint64)
    for p in parts:
        h = (h ^ p) * _MUL
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(40)).astype(np.int64) % FEATURES


def features(text: str, tokens: Tokens) -> np.ndarray:
    """The distinct features of a whole text, ascending: 1- and 2-grams of words, 1- to 3-grams of shapes.

    In the shapes a word that repeats the one before it has a shape of its own.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    pairs = np.array([tokens[w] for w in words], np.uint64)
    word, form = pairs[:, 0], pairs[:, 1].copy()
    form[1:][word[1:] == word[:-1]] = 1
    grams = [_mix(1, word), _mix(2, word[:-1], word[1:]), _mix(3, form), _mix(4, form[:-1], form[1:]), _mix(5, form[:-2], form[1:-1], form[2:])]
    return np.unique(np.concatenate(grams))


@dataclass
class Model:
    """Weights with the ratios folded in, the ratios squared (for the length of a row), and the bias."""

    weights: np.ndarray
    norm: np.ndarray
    bias: float

    def margin(self, found: np.ndarray) -> float:
        size = float(np.sqrt(self.norm[found].sum()))
        return self.bias + (float(self.weights[found].sum()) / size if size else 0.0)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of smoothed share among positives over that among negatives; 0 where no row has the feature."""
    counts = np.stack([np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == side] or [np.zeros(0, np.int64)]), minlength=FEATURES) for side in (1, 0)]).astype(float)
    share = (counts + SMOOTHING) / (np.array([[max(1, (labels == side).sum())] for side in (1, 0)]) + 2 * SMOOTHING)
    return np.where(counts.sum(axis=0) > 1, np.log(share[0] / share[1]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST):
    """Weights and bias of min |w|^2/2 + sum_i C_i max(0, 1 - y_i w.x_i), rows scaled to length 1; classes weigh alike."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = np.array([(labels > 0).mean(), (labels <= 0).mean()])
    upper = cost * np.where(labels > 0, 0.5 / max(share[0], 1e-9), 0.5 / max(share[1], 1e-9))
    kept = [r[scale[r] != 0] for r in rows]
    values = [scale[r] / max(1e-12, np.linalg.norm(scale[r])) for r in kept]
    w, bias, alpha, order = np.zeros(FEATURES), 0.0, np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = kept[i], values[i]
            gradient = y[i] * (w[at] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (1.0 + (len(at) > 0)), 0.0), upper[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def learnable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, label) of rows that may be learned from: those not held out, with a label; one row per id."""
    rows = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return rows.where("doc_id IS NOT NULL AND label IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model of (doc_id, label) rows of ``labelled`` and their texts, on at most ``sample`` of them.

    The sample is spread over all ids by their md5; tasks make the features of its whole texts and one
    task fits the model, whose size is fixed. Without labelled texts the model is indifferent (all 0).
    """
    chosen = labelled.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` pairs of numbers

    def featurise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in parts:
            found = [features(t, tokens).astype(np.int32) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "found"])

    rows = arrow_map(texts.select("doc_id", "text", "label"), featurise, "doc_id bigint, label int, found array<int>").dropDuplicates(["doc_id"])

    def train(table):
        table = table.sort_by("doc_id")
        y = table.column("label").to_numpy()
        found = [np.asarray(x, np.int64) for x in table.column("found").to_pylist()]
        ratios = log_count_ratios(found, y)
        w, bias = dual_coordinate_descent(found, ratios, y)
        blob = lambda v: [v.astype(np.float32).tobytes()]
        return pa.table({"weights": blob(w * ratios), "norm": blob(ratios**2), "bias": [bias]})

    bounded_batches(docs.sparkSession)
    got = rows.groupBy(F.lit(1).alias("all")).applyInArrow(train, "weights binary, norm binary, bias double").collect()
    if not got:
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["weights"], np.float32), np.frombuffer(got[0]["norm"], np.float32), got[0]["bias"])


def _scored(texts: list[str | None], model: Model, tokens: Tokens) -> np.ndarray:
    margins = np.array([model.margin(features(t or "", tokens)) for t in texts])
    return 1 / (1 + np.exp(-STEEPNESS * np.clip(margins, -20, 20)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 up).

    The score reads the text alone. Null and empty texts get the score of the bias. Rows that repeat are
    each returned; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.norm, model.bias))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = Model(*sent.value), Tokens()
        for batch in parts:
            scores = _scored(column(batch, "text"), own, tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return arrow_map(documents(docs, id_col, text_col), run, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores 0.5 or more; null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.norm, model.bias))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = Model(*sent.value), Tokens()
        for batch in parts:
            yield batch.filter(pa.array(_scored(column(batch, text_col), own, tokens) >= 0.5))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
