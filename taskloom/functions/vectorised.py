"""Pandas UDFs made when they are first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship


def vectorised(schema: str) -> Callable:
    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*cols: Column | str) -> Column:
            ship(SparkSession.active())
            return F.pandas_udf(f, schema)(*cols)

        return call

    return wrap
