"""Schedules as column expressions over an update, exchange or iteration number."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_at(iteration: Column, base_lr: float, policy: str = "fixed", gamma: float = 1.0, stepsize: int = 1) -> Column:
    """Learning rate of an iteration counted from 0."""
    if policy == "fixed":
        return F.lit(float(base_lr))
    if policy == "step":
        return F.lit(float(base_lr)) * F.pow(F.lit(float(gamma)), F.floor(iteration / F.lit(stepsize)))
    raise ValueError(f"unknown lr policy {policy!r}")


def whole_steps(setting: int, workers: int, period: int) -> int:
    """A setting given in local iterations, in exchanges: integer division, so it may reach 0 (off)."""
    if setting <= 0:
        return 0
    steps = setting * workers // period
    if steps == 0:
        warnings.warn(f"step {setting} is shorter than one exchange period ({period}); it is off")
    return steps


def decays(done: Column, step: int, limit: int | None) -> Column:
    """How often a value has decayed after ``done`` exchanges."""
    if step <= 0:
        return F.lit(0).cast("bigint")
    times = F.floor(done / F.lit(step))
    return F.least(times, F.lit(limit).cast("bigint")) if limit is not None and limit >= 0 else times


def decayed(done: Column, start: float, rate: float, step: int, limit: int | None) -> Column:
    """``start`` times ``rate`` once per ``step`` finished exchanges, at most ``limit`` times.

    ``step`` <= 0 switches decay off; ``limit`` None or negative means no limit.
    """
    if step <= 0:
        return F.lit(float(start))
    return F.lit(float(start)) * F.pow(F.lit(float(rate)), decays(done, step, limit))


def worker_rate(exchange: Column, params) -> Column:
    """Moving rate a worker uses in its exchange number ``exchange`` (from 0)."""
    step = whole_steps(params.decay_step, 1, params.period)
    return decayed(exchange, params.moving_rate, params.decay_rate, step, params.decay_limit)


def centre_rate(update: Column, params, workers: int) -> Column:
    """Moving rate the centre uses in its update number ``update`` (from 1)."""
    step = whole_steps(params.decay_step, workers, params.period)
    return decayed(update - 1, params.moving_rate, params.decay_rate, step, params.decay_limit)


def centre_factor(update: Column, params, workers: int) -> Column:
    """Extra factor on the centre side in update number ``update`` (from 1)."""
    step = whole_steps(params.factor_decay_step, workers, params.period)
    return decayed(update - 1, params.server_factor, params.factor_decay_rate, step, params.factor_decay_limit)


def centre_segment(update: Column, params, workers: int) -> Column:
    """Which stretch of constant centre rates an update (from 1) belongs to."""
    rate_step, factor_step = (whole_steps(s, workers, params.period) for s in (params.decay_step, params.factor_decay_step))
    return F.struct(
        decays(update - 1, rate_step, params.decay_limit).alias("rate"),
        decays(update - 1, factor_step, params.factor_decay_limit).alias("factor"))


def rounds_of(iterations: Column, period: int) -> Column:
    """Exchanges per worker: iterations over period, halves up."""
    return F.floor(iterations / F.lit(period) + F.lit(0.5))


def is_due(number: Column, every: int) -> Column:
    """True at multiples of ``every``; 0 means never."""
    if every <= 0:
        return F.lit(False)
    return F.pmod(number, F.lit(every)) == 0
