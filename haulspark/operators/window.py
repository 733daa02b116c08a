"""Ordering, ranking, banding and chunking.

Nothing here puts a whole table into one window partition.  Global positions
and ranks come from a range-partitioned sort that is written once to the shared
folder with each row's partition and place; the driver sees one number per
partition (its rows), whose running sums are the partitions' offsets.  Ranks
run over the distinct values, so a value that a third of the rows share is one
row of the sort.  Percentiles come from ``percentile_approx`` (a mergeable
sketch), and top-k from ``orderBy().limit()`` which Spark plans as
TakeOrderedAndProject (a per-task top-k heap, then a merge of k rows per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_PLACE_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder (or at ``name``, if that is a path): computed
    once, and the same when a task runs again."""
    path = name if "/" in name else scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order: list[Column], weight: Column, kept=lambda split: split, name: str = "ranged") -> tuple[DataFrame, list[int]]:
    """``df`` with ``_part`` and ``_place`` of a global sort, written; and the sums of
    ``weight`` over all partitions before each one, and over all.  ``kept`` picks
    rows of the split table, in which rows equal in ``order`` are together."""
    at = F.monotonically_increasing_id()
    split = kept(df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_at", at)
    placed = written(split.select("*", F.shiftright("_at", _PLACE_BITS).alias("_part"),
                                   F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place")).drop("_at"), name)
    sums = {r["_part"]: r["w"] for r in placed.groupBy("_part").agg(F.sum(weight).alias("w")).collect()}
    before = [0]
    for part in range(max(sums, default=-1) + 1):
        before.append(before[-1] + sums.get(part, 0))
    return placed, before


def before_part(before: list[int]) -> Column:
    """Of the sums before each partition that of the row's ``_part``."""
    return F.element_at(F.lit(before).cast("array<bigint>"), (F.col("_part") + 1).cast("int"))


def global_index(df: DataFrame, order_cols: list, name: str = "row_index") -> DataFrame:
    """0-based position of each row in ``order_cols`` order; equal rows in any order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    placed, before = _ranged(df, order, F.lit(1))
    return placed.withColumn(name, before_part(before) + F.col("_place")).drop("_part", "_place")


def index_new(df: DataFrame, known: DataFrame | None, key: str, name: str = "ranged") -> tuple[DataFrame, list[int]]:
    """One row of ``df`` for each ``key`` that ``known`` lacks, written (``name`` as for
    :func:`written`) with ``_part`` and ``_place``, and the rows before each part: together
    the 0-based position in the order of the key.  Both tables are shuffled once, by
    ranges of the key: the split that sorts also brings equal keys together."""
    both = df.withColumn("_new", F.lit(True))
    if known is not None:
        both = both.unionByName(known.select(key, F.lit(False).alias("_new")), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_new"))
    return _ranged(both, [F.col(key)], F.lit(1),
                   lambda split: split.withColumn("_rn", first).filter("_rn = 1 AND _new").drop("_rn", "_new"), name)


def rank_by(df: DataFrame, order: list[tuple[str, bool]], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Rank of each row (1 + rows that come before it; ties share a rank) in the
    order of (column, descending) pairs, among the rows equal in ``within``;
    nulls last."""
    within = within or []
    keys = [*within, *(c for c, _ in order)]
    df = written(df, "rank")
    values = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    by = [F.col(c).asc_nulls_last() for c in within] + [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in order]
    placed, before = _ranged(values, by, F.col("_n"))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    ahead = placed.withColumn("_ahead", before_part(before) + F.coalesce(inside, F.lit(0)))

    def same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
        out = F.lit(True)
        for c in cols:
            out = out & a[c].eqNullSafe(b[f"_{c}"])
        return out

    def renamed(x: DataFrame, cols: list[str], *more: str) -> DataFrame:
        return x.select(*[F.col(c).alias(f"_{c}") for c in cols], *more)

    if within:
        first = renamed(ahead.groupBy(*within).agg(F.min("_ahead").alias("_first")), within, "_first")
        ahead = ahead.join(first, same(ahead, first, within)).withColumn("_ahead", F.col("_ahead") - F.col("_first"))
    found = renamed(ahead, keys, "_ahead")
    return df.join(found, same(df, found, keys)).select(*df.columns, (F.col("_ahead") + 1).cast("int").alias(name))


def chunk_ids(df: DataFrame, order_cols: list[str], size: int) -> DataFrame:
    """Chunk number floor(position / size) over an explicit order."""
    idx = global_index(df.select(*order_cols), order_cols, "_pos")
    return idx.select(*order_cols, F.floor(F.col("_pos") / size).cast("long").alias("chunk_id"))


def percentile_bands(df: DataFrame, col: str, accuracy: int = 1_000_000) -> DataFrame:
    """Three-point colour scale (min / median / max) and a data bar.

    ``band`` is 'low' below the median, 'mid' at it, 'high' above; ``bar`` is
    (x - min) / (max - min).  The three points are one mergeable aggregate.
    """
    stats = df.agg(F.min(col).alias("lo"), F.percentile_approx(col, 0.5, accuracy).alias("p50"),
                   F.max(col).alias("hi"))
    lo, p50, hi = (stats.select(x).scalar() for x in ("lo", "p50", "hi"))
    x = F.col(col)
    return df.withColumns({
        "band": F.when(x < p50, "low").when(x == p50, "mid").otherwise("high"),
        "bar": F.when(hi > lo, F.rint((x - lo) / (hi - lo) * 10000) / 10000).otherwise(F.lit(0.0)),
    })


def top_k(df: DataFrame, order_cols: list, k: int) -> DataFrame:
    """Top-k by an explicit total order (ties broken by the later keys)."""
    return df.orderBy(*order_cols).limit(k)


def head_with_remainder(df: DataFrame, order_cols: list, n: int, label_col: str) -> DataFrame:
    """First ``n`` rows plus one 'and N more' row carrying the remainder."""
    head = df.orderBy(*order_cols).limit(n).select(label_col, F.lit(False).alias("is_remainder"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    more = total.select(F.concat(F.lit("and "), (F.col("n") - n).cast("string"), F.lit(" more"))
                        .alias(label_col), F.lit(True).alias("is_remainder")).filter(F.col("n") > n)
    return head.unionByName(more)
