"""Column handling shared by the operators.

Inputs may carry extra columns whose names clash with an operator's own (or
with each other, by case).  Operators therefore address input columns by
position: :func:`pick` reads the few they need, :func:`carry` renames the whole
input positionally while an operator works and :func:`restore` puts the names
back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _position(df: DataFrame, name: str) -> int:
    names = df.columns
    if name in names:
        return names.index(name)
    lowered = [n.lower() for n in names]
    if name.lower() in lowered:
        return lowered.index(name.lower())
    raise ValueError(f"column {name!r} is missing; the input has {names}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns: ``pick(df, key="doc_id")`` gives ``key``."""
    at = {out: _position(df, name) for out, name in wanted.items()}
    flat = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_in{i}").alias(out) for out, i in at.items()])


def carry(df: DataFrame, **wanted: str) -> DataFrame:
    """The whole input as ``_in0.._inN`` plus the wanted columns by new names."""
    at = {out: _position(df, name) for out, name in wanted.items()}
    flat = df.toDF(*[f"_in{i}" for i in range(len(df.columns))])
    return flat.select("*", *[F.col(f"_in{i}").alias(out) for out, i in at.items()])


def restore(carried: DataFrame, names: list[str], replace: dict[str, Column] | None = None) -> DataFrame:
    """The input's columns back under their names; ``replace`` swaps values."""
    swap = {}
    for name, value in (replace or {}).items():
        lowered = [n.lower() for n in names]
        swap[names.index(name) if name in names else lowered.index(name.lower())] = value
    return carried.select(*[swap.get(i, F.col(f"_in{i}")).alias(f"_out{i}") for i in range(len(names))]).toDF(*names)


def small_batches(df: DataFrame, rows: int = 1024) -> DataFrame:
    """Bound the rows (hence bytes) of the Arrow batches Python tasks hold."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def grown(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the columns of ``ddl`` behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
