"""Keyed streaming state: one centre block, the updates it has had, and the parts that came before their turn.

Arrivals are numbered from 0 without gaps and every block applies its parts in that order, whatever micro-batch or
order they come in. So all blocks agree on what update n is without asking each other, and a part that comes
twice counts once. The state store makes a replayed micro-batch start from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from elastrain.functions.schedules import whole_steps
from elastrain.schema import ExchangeParams

#: kind: ``due`` for an update that a test or snapshot wants, ``latest`` for the last one of the micro-batch.
MOVED = "kind string, update_no bigint, layer int, chunk int, values array<double>"
#: Values of parts, and of results, that a task holds before it puts them into the state, or hands them on.
HELD = 1 << 20


@dataclass(frozen=True)
class Decay:
    """A rate that decays by a factor every ``step`` updates, at most ``limit`` times (negative: no limit)."""

    start: float
    rate: float
    step: int
    limit: int

    def at(self, update: int) -> float:
        if self.step <= 0:
            return self.start
        times = (update - 1) // self.step
        return self.start * self.rate ** (min(times, self.limit) if self.limit is not None and self.limit >= 0 else times)


def centre_decays(params: ExchangeParams, workers: int) -> tuple[Decay, Decay]:
    """The two rates whose product is the coefficient of an update."""
    rate_step, factor_step = (whole_steps(s, workers, params.period) for s in (params.decay_step, params.factor_decay_step))
    return (Decay(params.moving_rate, params.decay_rate, rate_step, params.decay_limit),
            Decay(params.server_factor, params.factor_decay_rate, factor_step, params.factor_decay_limit))


class BlockCentre(StatefulProcessor):
    """Moves one block of the centre by the parts that arrive for it."""

    def __init__(self, decays: tuple[Decay, Decay] | None, every: tuple[int, ...], held: int = HELD):
        """``decays`` None: arriving values are updates to subtract. Updates at multiples of ``every`` are due."""
        self.decays, self.every, self.held = decays, tuple(e for e in every if e > 0), held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centre = handle.getValueState("centre", "values binary, updates bigint")
        self.early = handle.getMapState("early", "seq bigint", "values binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        values, updates = np.asarray(initialState["values"].iloc[0], dtype=np.float64), int(initialState["updates"].iloc[0])
        self.centre.update((values.tobytes(), updates))

    def _moved(self, centre: np.ndarray, x: np.ndarray, update: int) -> np.ndarray:
        if self.decays is None:
            return centre - x
        b = self.decays[0].at(update) * self.decays[1].at(update)
        return (1 - b) * centre + b * x

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.centre.exists():
            raise ValueError(f"Size mismatch! The centre has no block {tuple(key)}")
        layer, chunk = (int(k) for k in key)
        stored, before = self.centre.get()
        centre, updates = np.frombuffer(stored, dtype=np.float64), before
        stored_early = {k[0] for k in self.early.keys()}
        waiting: dict[int, np.ndarray] = {}
        out: list[tuple] = []

        def frame():
            return pd.DataFrame(out, columns=["kind", "update_no", "layer", "chunk", "values"])

        for part in rows:
            for seq, x in zip(part["seq"].tolist(), part["values"]):
                if seq < updates or seq in waiting or seq in stored_early:
                    continue
                x = np.asarray(x, dtype=np.float64)
                if x.shape != centre.shape:
                    raise ValueError("Size mismatch!")
                waiting[seq] = x
                while updates in waiting or updates in stored_early:
                    if updates in waiting:
                        x = waiting.pop(updates)
                    else:
                        x = np.frombuffer(self.early.getValue((updates,))[0], dtype=np.float64)
                        self.early.removeKey((updates,))
                        stored_early.discard(updates)
                    updates += 1
                    centre = self._moved(centre, x, updates)
                    if any(updates % e == 0 for e in self.every):
                        out.append(("due", updates, layer, chunk, centre))
                        if len(out) * len(centre) >= self.held:
                            yield frame()
                            out = []
                if len(waiting) * len(centre) >= self.held:
                    self._keep(waiting, stored_early)
        self._keep(waiting, stored_early)
        if updates > before:
            self.centre.update((centre.tobytes(), updates))
            out.append(("latest", updates, layer, chunk, centre))
        if out:
            yield frame()

    def _keep(self, waiting: dict[int, np.ndarray], stored_early: set[int]) -> None:
        """Parts before their turn go into the state."""
        for seq, x in waiting.items():
            self.early.updateValue((seq,), (x.tobytes(),))
        stored_early.update(waiting)
        waiting.clear()

    def close(self) -> None:
        pass
