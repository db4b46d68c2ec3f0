"""Binding: a value that an expression uses many times is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row; written out, nested uses would grow as their product."""
    return F.transform(F.array(value), then)[0]
