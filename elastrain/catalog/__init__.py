"""Every registered query; importing the package fills the registry."""

from elastrain.catalog import batches, metrics, schedules, stores, streams, training, transforms, weights  # noqa: F401
from elastrain.catalog.registry import ORACLES, QUERIES  # noqa: F401
