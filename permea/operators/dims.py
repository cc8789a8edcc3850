"""Dimension helpers: small tables with known bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def sized(df: DataFrame, name: str = "dim") -> DataFrame:
    """``df`` written once to the checkpoint folder and read back.

    The files' bytes are then in the plan's statistics, so Spark itself
    broadcasts the table while it is under its threshold and shuffles beyond it;
    later joins share one computation.
    """
    return materialize(df, name)


def constant_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast a table whose size is fixed by code (library, grid lists)."""
    return F.broadcast(df)
