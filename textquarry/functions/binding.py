"""Computing an expression once for several uses inside one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    The optimiser copies an expression to every place that names it; a lambda's variable
    is evaluated when it is bound.
    """
    return F.transform(F.array(value), use)[0]
