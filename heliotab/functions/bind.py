"""Binding of intermediate values inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A value that is merely named in an outer column can be inlined by the optimizer; inside a lambda it would then be
    computed once per array element. A lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
