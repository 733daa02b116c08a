"""Benchmark decontamination by greedy string tiling.

*Seeds.*  A document and a benchmark item that share a tile of at least
``min_match`` words share every window of ``min_match`` words in it.  The hashed
windows of the items are joined with those of every document; only document
words under a shared window can be in a tile.

*Tiling* (running Karp-Rabin): from a long search length downwards, windows of
unmarked words are hashed by a rolling hash, matches are verified word by word,
extended, and the longest ones that do not overlap earlier tiles are marked.
Tiles may come in any order, so a reordered passage is still covered.

*Verdict.*  Coverage is the share of the item's words under tiles; an item at or
above the threshold contaminates the document.  The words under shared windows
bound the coverage from above, so most pairs are dismissed without tiling.

Words are runs of letters, digits and underscores, in lower case.

Scale: the benchmark is the stated query set.  It is cut into blocks of at most
``block_windows`` windows; each block is broadcast (its size is bounded by that
number) and held against all documents in one scan, without a shuffle.  A
document's work is linear in its length plus the tiling of its shared windows.

Defined results: null or empty texts have no words and no result row; items with
fewer than ``min_match`` words cannot be tiled and are never reported; a
repeated item or document gives its own rows; empty tables give an empty result;
extra columns are ignored by :func:`contaminated` and carried by
:func:`remove_contaminated`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import carry, grown, pick, restore, small_batches

WORD = re.compile(r"\w+")
MIN_MATCH = 4
THRESHOLD = 0.5
FIRST_LENGTH = 20
BLOCK_WINDOWS = 1 << 20
WORDS_KEPT = 1 << 17
_BASE = 1_000_003
_MOD = (1 << 61) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash, remembered up to a limit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ words[k:k + m]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _longest(doc: list, item: list, free_doc: list, free_item: list, n: int) -> tuple[int, list]:
    """Matches of at least n unmarked words: (longest, [(length, doc, item)]).

    Karp-Rabin with a running hash; equal hashes are compared word by word."""

    def rolled(words, free):
        drop = pow(_BASE, n, _MOD)
        h = run = 0
        for i, w in enumerate(words):
            if not free[i]:
                h = run = 0
                continue
            h = (h * _BASE + w) % _MOD
            run += 1
            if run > n:
                h = (h - words[i - n] * drop) % _MOD
            if run >= n:
                yield i - n + 1, h

    table = defaultdict(list)
    for at, h in rolled(item, free_item):
        table[h].append(at)
    best, found = 0, []
    for at, h in rolled(doc, free_doc):
        for to in table.get(h, ()):
            # a match that goes on to the left is found from its start
            if at and to and free_doc[at - 1] and free_item[to - 1] and doc[at - 1] == item[to - 1]:
                continue
            k = 0
            while (at + k < len(doc) and to + k < len(item) and free_doc[at + k] and free_item[to + k]
                   and doc[at + k] == item[to + k]):
                k += 1
            if k >= n:
                found.append((k, at, to))
                best = max(best, k)
    return best, found


def tiles(doc: list, item: list, free_doc: list, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the tiles; ``free_doc`` is changed."""
    free_item = [True] * len(item)
    out, n = [], max(min_match, min(FIRST_LENGTH, len(item)))
    while True:
        best, found = _longest(doc, item, free_doc, free_item, n)
        if best > 2 * n:
            n = best
            continue
        queue = [(-k, at, to) for k, at, to in found]
        heapify(queue)
        while queue:
            k, at, to = heappop(queue)
            run = 0
            parts = []
            for i in range(-k + 1):
                if i < -k and free_doc[at + i] and free_item[to + i]:
                    run += 1
                elif run:
                    parts.append((-run, at + i - run, to + i - run))
                    run = 0
            if parts == [(k, at, to)]:
                free_doc[at:at - k] = [False] * -k
                free_item[to:to - k] = [False] * -k
                out.append((at, to, -k))
            else:  # cut by earlier tiles: what is left waits for its turn
                for part in parts:
                    if -part[0] >= n:
                        heappush(queue, part)
        if n == min_match:
            return out
        n = max(min_match, n // 2)


class _Block:
    """Benchmark items of one block, ready for lookups."""

    def __init__(self, items: list[tuple[int, list[int]]], min_match: int):
        self.items = items
        hashes, owner, place = [], [], []
        for k, (_, words) in enumerate(items):
            h = windows(np.array(words, np.uint64), min_match)
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def match(self, words: np.ndarray, min_match: int, threshold: float) -> Iterator[tuple[int, float, list]]:
        h = windows(words, min_match)
        at = np.nonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        if not len(at):
            return
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return
        times = hi - lo
        pos = np.repeat(at, times)
        row = np.repeat(lo, times) + np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times)
        owner, place = self.owner[row], self.place[row]
        order = np.argsort(owner, kind="stable")
        owner, place, pos = owner[order], place[order], pos[order]
        cuts = np.nonzero(np.r_[True, owner[1:] != owner[:-1], True])[0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            item_id, item = self.items[owner[a]]
            covered = np.zeros(len(item) + 1, np.int64)
            np.add.at(covered, place[a:b], 1)
            np.add.at(covered, np.minimum(place[a:b] + min_match, len(item)), -1)
            if (np.cumsum(covered)[:-1] > 0).sum() < threshold * len(item):
                continue
            # the document's words under shared windows, with gaps marked
            spots = np.unique(pos[a:b])
            keep = np.unique((spots[:, None] + np.arange(min_match)).ravel())
            doc, free, back, last = [], [], [], -2
            for w in keep.tolist():
                if w != last + 1 and doc:
                    doc.append(0)
                    free.append(False)
                    back.append(-1)
                doc.append(int(words[w]))
                free.append(True)
                back.append(w)
                last = w
            found = tiles(doc, item, free, min_match)
            share = sum(k for _, _, k in found) / len(item)
            if share >= threshold:
                yield item_id, share, sorted((back[x], to, k) for x, to, k in found)


def _benchmark_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = pick(benchmark, item_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(t.as_py()).view(np.int64).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.list_(pa.int64())), pa.array([len(w) for w in words], pa.int64())],
                names=["item_id", "words", "n"])

    return df.mapInArrow(run, grown(df.select("item_id"), "words array<bigint>, n long"))


def _blocks(benchmark: DataFrame, min_match: int, block_windows: int, id_col: str, text_col: str) -> Iterator[list]:
    """Items in blocks; the driver holds one block (bounded) at a time.

    An item longer than a block is cut nowhere: it makes a block of its own."""
    items = _benchmark_words(benchmark, id_col, text_col).filter(F.col("n") >= min_match)
    block, held = [], 0
    for r in items.toLocalIterator():
        if block and held + r["n"] > block_windows:
            yield block
            block, held = [], 0
        block.append((r["item_id"], [w & 0xFFFFFFFFFFFFFFFF for w in r["words"]]))
        held += r["n"]
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
                 block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each (document, item) at or above the threshold: doc_id,
    item_id, coverage, n_tiles, tiles (first word in the document, first word in
    the item, number of words)."""
    spark = docs.sparkSession
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))
    item_type = pick(benchmark, item_id=item_id_col).schema["item_id"].dataType
    schema = grown(df.select("doc_id"), f"item_id {item_type.simpleString()}, coverage double, n_tiles int, "
                   "tiles array<struct<doc_word:int,item_word:int,n_words:int>>")
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, min_match, block_windows, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _Block(shared.value, min_match)
            for b in batches:
                rows = []
                ids = b.column(0).to_pylist()
                for i, t in zip(ids, b.column(1)):
                    words = word_hashes(t.as_py())
                    for item, share, found in block.match(words, min_match, threshold):
                        rows.append({"doc_id": i, "item_id": item, "coverage": share, "n_tiles": len(found), "tiles": [
                            {"doc_word": x, "item_word": y, "n_words": k} for x, y, k in found]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(b.schema.field(0).type, schema))

        out = out.unionByName(df.mapInArrow(run, schema))
    return out


def _arrow(id_type: pa.DataType, schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
    fields[0] = pa.field(schema.fields[0].name, id_type)
    return pa.schema(fields)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, with the columns they came with.

    Decided by row, so repeated or null ids cannot take a clean row along."""
    names = docs.columns
    base = small_batches(carry(docs, text=text_col))
    spark = docs.sparkSession
    min_match, threshold = options.get("min_match", MIN_MATCH), options.get("threshold", THRESHOLD)
    blocks = _blocks(benchmark, min_match, options.get("block_windows", BLOCK_WINDOWS),
                     options.get("item_id_col", "item_id"), options.get("item_text_col", "text"))
    for items in blocks:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _Block(shared.value, min_match)
            for b in batches:
                clean = [next(block.match(word_hashes(t.as_py()), min_match, threshold), None) is None
                         for t in b.column(b.num_columns - 1)]
                yield b.filter(pa.array(clean, pa.bool_()))

        base = base.mapInArrow(run, base.schema)
    return restore(base, names)
