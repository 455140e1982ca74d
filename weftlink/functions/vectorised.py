"""Arrow UDFs that are declared at import and made when first used, since declaring one needs a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """As ``pandas_udf`` with a type in DDL."""
    def declare(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on(*columns: Column) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return on

    return declare
