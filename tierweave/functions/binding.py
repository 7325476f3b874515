"""Binding a computed value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once: deep compositions stay small for the optimizer and code generator."""
    return F.element_at(F.transform(F.array(value), body), 1)
