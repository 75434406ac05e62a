"""Seeded keys: order, shard and coin of a row depend on its id only, never on where it is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ':'; plain values are literals, columns are rendered as text."""
    rendered = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *rendered))


def hash_number(key: Column) -> Column:
    """The first eight hex digits of a key as a number in [0, 2^32)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def shard_of(ids: list[Column], n_workers: int, seed: int) -> Column:
    """Worker number of a row: uniform over workers whatever the ids look like."""
    key = hash_key(seed, "shard", *ids)
    return F.pmod(hash_number(key), F.lit(n_workers)).cast("int")


def coin(ids: list[Column], seed: int, epoch: int, name: str, sides: int) -> Column:
    """A repeatable draw from 0..sides-1."""
    return F.pmod(hash_number(hash_key(seed, epoch, name, *ids)), F.lit(sides)).cast("int")


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
