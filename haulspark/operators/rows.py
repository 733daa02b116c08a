"""Row selection on computed columns.

Catalyst pushes a filter below the projection that defines the column it
tests, substituting the column's full expression into the filter.  For a
cheap column that is what we want (it reaches the scan); for a column that
is the end of a long expression chain (a route's efficiency score, a
record's validation findings) it evaluates that chain twice, once inside the
filter with no subexpression sharing.  ``keep_rows`` selects rows with a
generator over the already computed value instead: the projection runs once
and the condition reads its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    """``df.filter(cond)`` for conditions on expensive computed columns."""
    marker = "__keep_row"
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias(marker)).drop(marker)
