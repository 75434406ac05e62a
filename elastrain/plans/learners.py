"""Models as plug-ins: a learner names its parameter blobs and turns a batch into loss and gradients.

Learners run inside tasks on one mini-batch or one Arrow batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np

from elastrain.plans.parameters import DECAY_MULT, LR_MULT
from elastrain.schema import LayerSpec, SolverParams

Params = list[np.ndarray]


@dataclass(frozen=True)
class Dense:
    """An inner-product layer: its weight and bias blobs, its input width, and whether ReLU follows."""

    weight: int
    bias: int
    width: int
    relu: bool = False


class Learner(Protocol):
    n_features: int
    n_classes: int

    def layers(self) -> list[LayerSpec]:
        """Parameter blobs in order."""

    def dense_layers(self) -> list[Dense]:
        """The layers in order, for scoring."""

    def scores(self, params: Params, x: np.ndarray) -> np.ndarray:
        """Class scores of each row of ``x``."""

    def loss_and_gradients(self, params: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
        """Mean loss of a batch and the gradient of every blob."""


def _blob(layer: int, name: str, size: int, kind: str, filler: str, **filler_args) -> LayerSpec:
    return LayerSpec(layer, name, size, LR_MULT[kind], DECAY_MULT[kind], filler, filler_args)


def softmax_errors(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each row and probability minus target."""
    labels = y.astype(np.int64)
    if labels.size and (labels.min() < 0 or labels.max() >= scores.shape[1]):
        raise ValueError("label outside the class range")
    shifted = scores - scores.max(axis=1, keepdims=True)
    powers = np.exp(shifted)
    totals = powers.sum(axis=1)
    rows = np.arange(len(labels))
    losses = np.log(totals) - shifted[rows, labels]
    errors = powers / totals[:, None]
    errors[rows, labels] -= 1.0
    return losses, errors


class LinearSoftmax:
    """One inner-product layer with bias under softmax loss."""

    def __init__(self, n_features: int, n_classes: int):
        self.n_features, self.n_classes = n_features, n_classes

    def layers(self) -> list[LayerSpec]:
        return [
            _blob(0, "ip.weight", self.n_classes * self.n_features, "weight", "constant", value=0.0),
            _blob(1, "ip.bias", self.n_classes, "bias", "constant", value=0.0),
        ]

    def dense_layers(self) -> list[Dense]:
        return [Dense(0, 1, self.n_features)]

    def scores(self, params, x):
        return x @ params[0].reshape(self.n_classes, self.n_features).T + params[1]

    def loss_and_gradients(self, params, x, y):
        losses, errors = softmax_errors(self.scores(params, x), y)
        errors /= len(y)
        return float(losses.mean()), [(errors.T @ x).ravel(), errors.sum(axis=0)]


class ReluNet:
    """Inner product, ReLU, inner product under softmax loss."""

    def __init__(self, n_features: int, n_hidden: int, n_classes: int):
        self.n_features, self.n_hidden, self.n_classes = n_features, n_hidden, n_classes

    def layers(self) -> list[LayerSpec]:
        return [
            _blob(0, "ip1.weight", self.n_hidden * self.n_features, "weight", "xavier", fan_in=self.n_features),
            _blob(1, "ip1.bias", self.n_hidden, "bias", "constant", value=0.0),
            _blob(2, "ip2.weight", self.n_classes * self.n_hidden, "weight", "gaussian", std=0.1),
            _blob(3, "ip2.bias", self.n_classes, "bias", "constant", value=0.0),
        ]

    def dense_layers(self) -> list[Dense]:
        return [Dense(0, 1, self.n_features, relu=True), Dense(2, 3, self.n_hidden)]

    def _hidden(self, params, x):
        return np.maximum(x @ params[0].reshape(self.n_hidden, self.n_features).T + params[1], 0.0)

    def scores(self, params, x):
        return self._hidden(params, x) @ params[2].reshape(self.n_classes, self.n_hidden).T + params[3]

    def loss_and_gradients(self, params, x, y):
        hidden = self._hidden(params, x)
        top = params[2].reshape(self.n_classes, self.n_hidden)
        losses, errors = softmax_errors(hidden @ top.T + params[3], y)
        errors /= len(y)
        back = (errors @ top) * (hidden > 0)
        return float(losses.mean()), [
            (back.T @ x).ravel(), back.sum(axis=0), (errors.T @ hidden).ravel(), errors.sum(axis=0)]


def learning_rate(solver: SolverParams, iteration: int) -> float:
    if solver.lr_policy == "fixed":
        return solver.base_lr
    return solver.base_lr * solver.gamma ** (iteration // solver.stepsize)


def mean_step(losses: tuple[float, Params] | None, n: int, more: tuple[float, Params], m: int) -> tuple[float, Params]:
    """Mean loss and gradients over n + m rows, from those of n rows (None: no rows yet) and of m more."""
    if losses is None:
        return more
    share = m / (n + m)
    for g, h in zip(losses[1], more[1]):
        g += (h - g) * share
    return losses[0] + (more[0] - losses[0]) * share, losses[1]


def local_step(learner: Learner, params: Params, velocity: Params, x: np.ndarray, y: np.ndarray,
               iteration: int, solver: SolverParams) -> tuple[float, Params]:
    """One solver step in place on a batch. Returns the loss and the update values."""
    loss, gradients = learner.loss_and_gradients(params, x, y)
    return loss, apply_gradients(learner, params, velocity, gradients, iteration, solver)


def apply_gradients(learner: Learner, params: Params, velocity: Params, gradients: Params, iteration: int, solver: SolverParams) -> Params:
    """Clip, decay, momentum, apply, in place. Returns the update values."""
    rate = learning_rate(solver, iteration)
    if solver.clip_gradients > 0:
        norm = float(np.sqrt(sum(float(g @ g) for g in gradients)))
        if norm > solver.clip_gradients:
            gradients = [g * (solver.clip_gradients / norm) for g in gradients]
    for spec, w, v, g in zip(learner.layers(), params, velocity, gradients):
        v *= solver.momentum
        v += rate * spec.lr_mult * (g + solver.weight_decay * spec.decay_mult * w)
        w -= v
    return velocity
