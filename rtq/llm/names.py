"""Extra columns whose names clash with an operator's own."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


def guarded(*internal: str) -> Callable:
    """For operators that return their input rows: columns named like internal ones
    (a leading underscore, or one of ``internal``, in any case) are carried under free
    names and get their own names back.  Other tables' plans stay as they are."""
    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
            named = {x for x in (*args, *kwargs.values()) if isinstance(x, str)}
            clash = [c for c in rows.columns if c not in named and (c.startswith("_") or c.lower() in internal)]
            if not clash:
                return operator(rows, *args, **kwargs)
            prefix = "extra"
            while any(c.lower().startswith(prefix) for c in rows.columns):
                prefix += "x"
            away = {c: f"{prefix}{i}" for i, c in enumerate(clash)}
            out = operator(rows.withColumnsRenamed(away), *args, **kwargs)
            return out.withColumnsRenamed({new: old for old, new in away.items()})
        return run
    return wrap
