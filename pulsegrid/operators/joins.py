"""Joins with configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Configuration of this many rows fits every executor many times over (a few MB).
CONFIG_ROWS = 100_000


def is_small(config: DataFrame, max_rows: int = CONFIG_ROWS) -> bool:
    """Whether there are at most ``max_rows`` rows; looks at no more than ``max_rows + 1``."""
    return config.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(config: DataFrame, max_rows: int = CONFIG_ROWS) -> DataFrame:
    """``config`` marked for broadcast if it is small, else as it is.

    The rows are counted, since size estimates of relations made from Python data or aggregates are
    useless, and a shuffled join on a key with a handful of values would put the large side into a
    handful of tasks. Beyond the limit Spark plans the join by its own estimates and splits skewed
    partitions at run time.
    """
    return F.broadcast(config) if is_small(config, max_rows) else config
