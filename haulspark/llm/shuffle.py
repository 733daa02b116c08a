"""Uniform shuffle into shards of exact size, by a hypergeometric matrix.

1. *Fix the partitions.*  Rows get a position ``(partition, index)`` once, and
   the narrow table is checkpointed, so a retried task sees the same positions.
2. *Draw the matrix.*  How many rows of partition p go to shard j is drawn on
   the driver from the multivariate hypergeometric law of a uniform assignment
   with the shard sizes fixed (counts at most one apart).  The driver sees one
   count for each partition and no rows.
3. *Permute locally.*  Rows are ranked within their partition by a keyed random
   number; the first row of the matrix's line go to shard 0, the next to
   shard 1, and so on.
4. *Exchange and permute again.*  A second keyed number orders the rows of a
   shard.  The order is split into blocks by the number's leading bits, so that
   no task holds a shard: a row's slot is the block's offset plus its rank in
   the block.  Slots are gapless from 0.

Main path: DataFrame functions only.  Nothing is keyed by content, so a source,
a document id or a text that holds a third of all rows is spread like any other.

Defined results: nulls, empty and equal texts and repeated rows are rows like
any other (each gets its own slot); an empty table gives an empty result; extra
columns are carried by :func:`assign` unless their names clash with the
result's, which then wins.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulspark.session import ensure_checkpoint_dir

BLOCK_ROWS = 2048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` without replacement.

    Inversion from the mode outwards, exact to double precision at any size
    (about one standard deviation of steps)."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    up = down = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u, a, b = rng.random() - up, mode, mode
    if u <= 0:
        return mode
    while a > lo or b < hi:
        if b < hi:
            up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > lo:
            down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode  # rounding left a remainder of the order of 1e-15


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each partition to each shard; columns sum to the shard sizes."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        line, left, rest = [], n, sum(room)
        for j in range(shards):
            rest -= room[j]
            k = hypergeometric(rng, room[j], rest, left)
            line.append(k)
            left -= k
        room = [r - k for r, k in zip(room, line)]
        matrix.append(line)
    return matrix


def _keyed(seed: int, turn: int, position: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), position)


def assign(rows: DataFrame, shards: int = 16, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` plus ``shard`` (int) and ``slot`` (long): a uniformly random
    permutation of the rows over shards whose sizes differ by one at most.

    The rows travel through the exchanges, so pass the columns that are needed
    at the other end."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    keep = [(i, c) for i, c in enumerate(rows.columns) if c.lower() not in ("shard", "slot")]
    flat = rows.toDF(*[f"_in{i}" for i in range(len(rows.columns))]).select(*[f"_in{i}" for i, _ in keep])
    placed = flat.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    # one row for each input partition: metadata, never data
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total = sum(r["n"] for r in counts)
    matrix = communication_matrix([r["n"] for r in counts], shards, seed)
    lines = spark.createDataFrame([(r["_part"], list(accumulate(m))) for r, m in zip(counts, matrix)],
                                  "_part long, _ends array<long>")
    first = Window.partitionBy("_part").orderBy(_keyed(seed, 1, F.col("_at")), "_at")
    local = placed.withColumn("_part", part).withColumn("_rank", F.row_number().over(first))
    sent = local.join(lines, "_part").withColumn(
        "shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank"))).cast("int"))
    # blocks of a shard: the leading bits of the second number
    bits = max(1, math.ceil(math.log2(max(2.0, total / shards / block_rows))))
    sent = sent.withColumn("_order", _keyed(seed, 2, F.col("_at"))).withColumn(
        "_block", F.shiftrightunsigned(F.col("_order"), 64 - bits))
    sent = sent.select(*[f"_in{i}" for i, _ in keep], "_at", "shard", "_order", "_block").checkpoint()
    sizes = sent.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    again = Window.partitionBy("shard", "_block").orderBy("_order", "_at")
    ranked = sent.withColumn("_rank", F.row_number().over(again))
    out = ranked.join(offsets, ["shard", "_block"]).withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long"))
    return out.select(*[F.col(f"_in{i}").alias(f"_out{i}") for i, _ in keep], "shard", "slot").toDF(
        *[c for _, c in keep], "shard", "slot")
