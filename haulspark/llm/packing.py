"""Best-fit packing of documents into sequences by a configuration linear program.

*Pieces.*  A document is its ids and an end id; one longer than ``capacity`` is
cut into full pieces, the rest coming first.

*Configuration LP.*  Only the histogram of piece lengths matters, at most
``capacity`` numbers whatever the data.  A configuration is a multiset of lengths
that fits into a sequence; the programme asks for amounts of configurations that
cover the histogram with least total.  Multiplicative weights solve it: each
length's price is its share of a sequence times exp(``eta`` x the rounds by which its
coverage lags), a knapsack dynamic programme over the prices gives the best configuration
for every capacity and, from the same table, the best one with a given length in
it; those near the optimum are the round's answers and get the amounts the lagging
lengths lack.  Prices divided by the knapsack's value are a feasible dual, so each
round bounds the optimum from below (:class:`Plan` ``.bound``).

*Rounding.*  Amounts become whole numbers by running sums (so their total is
kept), as far as pieces are left; what is left goes best fit decreasing into the
room left, again on the histogram.  Several shares of the amounts are rounded
(:data:`SHARES`; the rest keeps small pieces for the gaps) and the fewest sequences
kept.  Equal sequences stay one row with a number, so the plan has
a size bounded by the capacity, not by the data.

*Assignment.*  A piece's place among the pieces of its length (a count per
partition, running sums per length, and its place in its partition) looks up its
sequence and offset in the plan, which is broadcast: at most :data:`MAX_ROWS`
rows, checked.

Scale: one pass over the texts, whose pieces (numbers only) are checkpointed to
the shared folder; counts per length and partition are the only shuffle.  A
length that a third of all pieces have is counted per partition and never collected.

Defined results: a null text is empty: its end id alone; repeated rows and rows
with a null id are packed as documents of their own; very long texts are cut, no
id is lost; pieces of equal length are placed by partition and order in it; an
empty table gives an empty result; extra columns are ignored.  A special token's
string inside a text is its id, as the tokenizer library has it by default.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulspark.llm.frames import pick
from haulspark.session import ensure_checkpoint_dir

CAPACITY = 2048
ROUNDS = 120
ETA = 0.02
NEAR = 0.05  # answers of a round are this near to the knapsack's optimum
SHARES = (1.0, 0.9, 0.7, 0.4, 0.15)  # of the amounts that are rounded, the rest being packed best fit
MAX_ROWS = 4_000_000


# ---------------------------------------------------------------- the plan, from a histogram

def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best value, last length taken) for every room from 0; price[l] of a length
    l, 0 where there is none.  Of equal choices the longest length; 0: none fits better."""
    most = len(price) - 1
    value, taken = np.zeros(most + 1), np.zeros(most + 1, np.int64)
    for room in range(1, most + 1):
        with_last = value[:room] + price[room:0:-1]  # lengths room, room - 1, ..., 1
        i = int(with_last.argmax())
        if with_last[i] > value[room - 1]:
            value[room], taken[room] = with_last[i], room - i
        else:
            value[room] = value[room - 1]
    return value, taken


def _filled(taken: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if taken[room]:
            out.append(int(taken[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


@dataclass
class Plan:
    """Sequences by kind: the lengths in a sequence, in order, and how many such sequences there are."""

    kinds: list[tuple[tuple[int, ...], int]]
    bound: int  # no packing has fewer sequences

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)


def solve(counts: np.ndarray, rounds: int = ROUNDS, eta: float = ETA, near: float = NEAR) -> tuple[dict[tuple[int, ...], float], float]:
    """Amounts of configurations that cover counts[l] pieces of each length l, and
    the best lower bound of the programme seen."""
    capacity = len(counts) - 1
    lengths = np.nonzero(counts)[0]
    share = np.arange(capacity + 1) / capacity * (counts > 0)
    covered = np.zeros(capacity + 1)  # of each length's pieces, as a fraction
    amounts: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for t in range(1, rounds + 1):
        lag = np.where(counts > 0, t / rounds - covered, 0.0)
        price = share * np.exp(np.clip(eta * lag * rounds, -8, 8))
        value, taken = knapsack(price)
        bound = max(bound, float((price * counts).sum() / value[capacity]))
        rest: dict[int, list[int]] = {}
        for length in lengths[np.argsort(-(lag * price)[lengths], kind="stable")].tolist():
            if t / rounds <= covered[length]:
                continue
            if price[length] + value[capacity - length] < (1 - near) * value[capacity]:
                continue
            if length not in rest:
                rest[length] = _filled(taken, capacity - length)
            chosen = tuple(sorted([length, *rest[length]], reverse=True))
            amount = (t / rounds - covered[length]) * counts[length] / chosen.count(length)
            amounts[chosen] = amounts.get(chosen, 0.0) + amount
            for x in chosen:
                covered[x] += amount / counts[x]
    return amounts, bound


def _best_fit(left: np.ndarray, room: dict[int, list[list]], out: list) -> None:
    """Pieces left, longest first, into the tightest room; ``room`` has for each free space
    the kinds [lengths, number] with it."""
    capacity = len(left) - 1
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        free = length
        while todo:
            while free <= capacity and not room.get(free):
                free += 1
            if free > capacity:
                room.setdefault(capacity, []).append([(), -(-todo // (capacity // length))])
                free = capacity
            kind = room[free][-1]
            n = min(todo, kind[1])
            kind[1] -= n
            if not kind[1]:
                room[free].pop()
            todo -= n
            room.setdefault(free - length, []).append([(*kind[0], length), n])
            if free - length >= length:
                free = length
    out.extend((tuple(lengths), n) for kinds in room.values() for lengths, n in kinds if n and lengths)


def _rounded(counts: np.ndarray, amounts: dict[tuple[int, ...], float], share: float) -> list[tuple[tuple[int, ...], int]]:
    capacity = len(counts) - 1
    left = counts.copy()
    room: dict[int, list[list]] = {}
    running = 0.0
    for chosen, amount in sorted(amounts.items(), key=lambda x: (sum(x[0]), x[1], x[0]), reverse=True):
        n = math.floor(running + share * amount) - math.floor(running)
        running += share * amount
        if n:
            own, times = np.unique(chosen, return_counts=True)
            n = min(n, int((left[own] // times).min()))
        if n:
            left[own] -= n * times
            room.setdefault(capacity - sum(chosen), []).append([chosen, n])
    out: list[tuple[tuple[int, ...], int]] = []
    _best_fit(left, room, out)
    return out


def plan(counts: np.ndarray, rounds: int = ROUNDS) -> Plan:
    """Whole sequences for counts[l] pieces of every length l up to len(counts) - 1."""
    counts = np.asarray(counts, np.int64)
    capacity = len(counts) - 1
    total = int((counts * np.arange(capacity + 1)).sum())
    if not total:
        return Plan([], 0)
    amounts, bound = solve(counts, rounds)
    bound = max(-(-total // capacity), math.ceil(bound - 1e-6))
    best = None
    for share in SHARES:
        now = Plan(_rounded(counts, amounts, share), bound)
        if best is None or now.sequences < best.sequences:
            best = now
        if best.sequences == bound:
            break
    return best


# ---------------------------------------------------------------- pieces and their places

def encoder(ranks_path: str, pattern: str, special: dict[str, int]) -> Callable[[str], np.ndarray]:
    """Ids of a text: those of the tokenizers library for the same vocabulary (a test
    holds it), by the faster library; special tokens' strings are their ids."""
    import regex
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(text: str) -> np.ndarray:
        if cut is None or not any(s in text for s in special):
            return own.encode_to_numpy(text, disallowed_special=())
        parts = [np.array([special[x]], np.uint32) if i % 2 else own.encode_to_numpy(x, disallowed_special=())
                 for i, x in enumerate(cut.split(text))]
        return np.concatenate(parts)

    return encode


_ENCODERS: dict[tuple, Callable] = {}  # for the life of a Python worker


def _encoder(made: tuple) -> Callable:
    if made not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[made] = encoder(made[0], made[1], dict(made[2]))
    return _ENCODERS[made]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(start, capacity) for start in range(first, n, capacity)]


def _pieces(made: tuple, capacity: int, end_id: int, names: list[str]):
    """(id, text) -> a row for each piece, with its place among the partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(made)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, texts = b.column(0).slice(at, 1000), b.column(1).slice(at, 1000)
                rows = []
                for i, text in enumerate(texts):
                    tokens = np.concatenate([encode(text.as_py() or "").astype("<u4"), tail.astype("<u4")])
                    for k, (start, n) in enumerate(cut_points(len(tokens), capacity)):
                        rows.append((i, k, start, n, zlib.crc32(tokens[start:start + n].tobytes()), int(seen[n])))
                        seen[n] += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]),
                     pa.array([part] * len(rows), pa.int32())], names=names)

    return run


def _lookup(kinds: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (places before, first sequence, offset) of each run of its places, in order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((n, base, offset))
            offset += length
        base += n
    return {length: (np.cumsum([0, *(r[0] for r in own)])[:-1], np.array([r[1] for r in own], np.int64),
                     np.array([r[2] for r in own], np.int64)) for length, own in runs.items()}


def _placed(table, first_full: int, capacity: int, names: list[str]):
    """Pieces with their place among all of their length -> with sequence and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for b in batches:
            length = b.column("length").to_numpy()
            place = b.column("place").to_numpy()
            sequence, offset = first_full + place, np.zeros(len(place), np.int64)
            for n in np.unique(length).tolist():
                if n < capacity:
                    own = np.nonzero(length == n)[0]
                    before, base, at = runs[n]
                    i = np.searchsorted(before, place[own], side="right") - 1
                    sequence[own], offset[own] = base[i] + place[own] - before[i], at[i]
            cols = [b.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=names)

    return run


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end_id: int = 0, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece, and its place: among
    those of its length in partition ``part``.  Checkpointed."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = pick(docs, id=id_col, text=text_col)
    schema = StructType([texts.schema["id"], *StructType.fromDDL(
        "piece int, start long, length long, ids_crc32 long, at long, part int").fields])
    made = (ranks_path, pattern, tuple(sorted(special.items())))
    return texts.mapInArrow(_pieces(made, capacity, end_id, schema.names), schema).checkpoint()


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], end_id: int = 0, capacity: int = CAPACITY,
         rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = pieces(docs, ranks_path, pattern, special, end_id, capacity, id_col, text_col)
    parts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("length", "part", before.alias("before"), "n").checkpoint()
    counts = np.zeros(capacity + 1, np.int64)
    for row in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    counts[capacity] = 0  # full pieces are sequences of their own, after the others
    made = plan(counts, rounds)
    if sum(len(lengths) for lengths, _ in made.kinds) > MAX_ROWS:
        raise ValueError(f"the plan has more than {MAX_ROWS} rows")
    table = spark.sparkContext.broadcast(_lookup(made.kinds, capacity))
    flat = cut.join(offsets.select("length", "part", "before"), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("place"))
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = StructType([flat.schema["id"], *StructType.fromDDL(
        "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").fields])
    return flat.mapInArrow(_placed(table, made.sequences, capacity, names), schema).withColumnRenamed("id", id_col)
