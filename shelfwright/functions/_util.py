from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def evaluate_once(df, name: str, expr: Column):
    """Add column ``name`` = ``expr`` so that it is computed once per row.

    The value comes out of a one-element ``explode`` (a Generate node): a
    later filter on it stays above that node instead of being pushed below
    with ``expr`` substituted (which would evaluate an expensive expression
    twice, once in the filter and once in the projection).
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))
