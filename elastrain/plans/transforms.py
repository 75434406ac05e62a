"""What a sample goes through on its way into a step: mean, crop, mirror, scale.

Draws are columns that depend on (seed, pass over the shard, worker, position) only, so a retried task or another
cluster sees the same crops. The values are changed inside the Arrow step, a batch at a time: stored samples travel
as stored, and no transformed epoch is ever written.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.functions.hashing import coin
from elastrain.operators import samples as S


@dataclass(frozen=True)
class SampleTransform:
    """Subtract means, cut a window, flip, scale, in this order.

    ``dims`` is (channels, height, width) of the stored sample. In training the window and the flip are drawn; held-out
    samples (``for_test``) get the centre window and no flip. ``mean_image`` has the stored sample's size.
    """

    dims: tuple[int, int, int]
    crop: int = 0
    mirror: bool = False
    channel_means: tuple[float, ...] = ()
    mean_image: tuple[float, ...] = ()
    scale: float = 1.0
    drawn: bool = True
    seed: int = 0

    def __post_init__(self):
        channels, height, width = self.dims
        if self.crop > min(height, width):
            raise ValueError("crop is larger than the sample")
        if self.channel_means and len(self.channel_means) != channels:
            raise ValueError(f"{len(self.channel_means)} means for {channels} channels")
        if self.mean_image and len(self.mean_image) != channels * height * width:
            raise ValueError("the mean image has another size than the samples")

    @property
    def n_features(self) -> int:
        channels, height, width = self.dims
        return channels * self.crop**2 if self.crop else channels * height * width

    def for_test(self) -> SampleTransform:
        return replace(self, drawn=False, mirror=False)

    def draws(self, pass_no: Column, keys: list[Column]) -> Column:
        """[top, left, flip] of a sample in one pass."""
        _, height, width = self.dims
        size, coins = self.crop, lambda name, sides: coin(keys, self.seed, pass_no, name, sides)
        if size and self.drawn:
            top, left = coins("top", height - size + 1), coins("left", width - size + 1)
        else:
            top, left = F.lit((height - size) // 2 if size else 0), F.lit((width - size) // 2 if size else 0)
        flip = (coins("mirror", 2) == 0).cast("int") if self.mirror and self.drawn else F.lit(0)
        return F.array(top, left, flip)

    def apply(self, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Rows of stored values and their draws to rows of ``n_features`` values."""
        channels, height, width = self.dims
        if self.mean_image:
            x = x - np.asarray(self.mean_image)
        cube = x.reshape(len(x), channels, height, width)
        if self.channel_means:
            cube = cube - np.asarray(self.channel_means)[:, None, None]
        if self.crop:
            reach = np.arange(self.crop)
            rows, columns = draws[:, :1] + reach, draws[:, 1:2] + reach
            cube = cube[np.arange(len(x))[:, None, None, None], np.arange(channels)[:, None, None], rows[:, None, :, None], columns[:, None, None, :]]
        cube = np.where((draws[:, 2] == 1)[:, None, None, None], cube[..., ::-1], cube)
        return cube.reshape(len(x), -1) * self.scale

    def table(self, df: DataFrame) -> DataFrame:
        """Held-out samples (data as numbers) as the model sees them: column expressions, no draws."""
        channels, height, width = self.dims
        if self.mean_image:
            mean = F.array(*map(F.lit, self.mean_image))
            df = df.withColumn("data", F.zip_with("data", mean, lambda x, m: x - m))
        if self.channel_means:
            df = S.subtract_channel_mean(df, list(self.channel_means), height * width)
        if self.crop:
            df = S.crop(df, self.crop, height, width, "centre")
        return df.withColumn("data", F.transform("data", lambda x: x * F.lit(self.scale))) if self.scale != 1 else df
