"""Alignment of two tokenizers' tokens over the same bytes, and pair statistics.

*Alignment.*  Both tokenizations of a text cover the same bytes.  Every token
points to its farthest-right overlapping token of the other side: the one that
holds its last byte.  A token of the second side that ends where one of the first
ends points to itself; it is the terminal token of its group.  Successors are doubled
(each token takes its successor's successor) for all texts of a block at once until nothing changes, so
a chain of length n takes log2(n) vector steps; the terminal token reached labels
the group.  Groups are thus the parts between byte offsets where both sides end.

*Pairs.*  All pairs of a group are linked.  How many documents hold an id pair
linked is counted over the corpus: a block emits each of its distinct pairs once
with its number of documents, the engine adds them up, and the block gets the
counts of its pairs back, by the block's number.  What a document needs then are its distinct pairs (as
places in the block's sorted list) with multiplicities, kept compressed.

*Scale.*  Blocks (:data:`BLOCK_BYTES` of text) are the unit of all shuffles: the
commonest pair has one row for each block.  Pair counts are joined, never
broadcast; adaptive execution splits the rows of a hot pair.  Blocks are written
to the shared folder once, so texts are tokenized once.  A group with very many
tokens on both sides is linked by its distinct ids.

Defined results: null and empty texts, and texts whose tokens' bytes on either side do not
join to a blank and the text, have no tokens: zeros and an empty digest;
special tokens' strings inside texts are plain text; very long texts are a block
of their own; repeated rows are documents of their own and count again; ties for
an id's highest count all count as best; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulspark.llm.frames import pick
from haulspark.session import ensure_checkpoint_dir

BLOCK_BYTES = 4 << 20
PRODUCT = 4096  # links of a group above which its distinct ids are paired
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Tokenizers:
    """The two tokenizers: ids of a text and the bytes of an id."""

    def __init__(self, ranks_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids on both sides; none if either side's bytes are not a blank and the text."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        raw = b" " + text.encode()
        b = self.second.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none
        a = self.first.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        if self.a_len[a].sum() != len(raw):  # a byte-level token stands for just the bytes it was made of
            return none
        return a, np.fromiter(b, np.int64, len(b))


def groups(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers (from 0, ascending) of the tokens of both sides, given the
    byte offsets where they end; both cover the same bytes."""
    n = len(a_end)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.zeros(int(a_end[-1]) + 1, np.int32)

    def ending_before(ended: np.ndarray, at: np.ndarray) -> np.ndarray:
        ends[:] = 0
        ends[ended] = 1
        return np.cumsum(ends, dtype=np.int32)[at - 1].astype(np.int64)

    to_b, to_a = ending_before(b_end, a_end), ending_before(a_end, b_end)
    own = np.arange(len(b_end)) + n
    terminal = a_end[to_a] == b_end
    after = np.concatenate([to_b + n, np.where(terminal, own, to_a)])
    while True:
        twice = after[after]
        if np.array_equal(twice, after):
            break
        after = twice
    number = np.cumsum(terminal) - 1
    label = number[after - n]
    return label[:n], label[n:]


def _links(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, of: np.ndarray):
    """(id pair, document, multiplicity) of all links; p and q tokens of each group.
    There is one multiplicity for each of the last rows, those before have 1."""
    a0, b0 = np.cumsum(p) - p, np.cumsum(q) - q
    product = p * q
    small = product <= PRODUCT
    size = product[small]
    total = int(size.sum())
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(q[small], size)
    i = np.repeat(a0[small], size) + within // wide
    j = np.repeat(b0[small], size) + within % wide
    pairs, docs, times = [a[i] << 32 | b[j]], [np.repeat(of[small], size)], [np.empty(0, np.int64)]
    for g in np.nonzero(~small)[0].tolist():
        x, nx = np.unique(a[a0[g]:a0[g] + p[g]], return_counts=True)
        y, ny = np.unique(b[b0[g]:b0[g] + q[g]], return_counts=True)
        pairs.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
        docs.append(np.full(len(x) * len(y), of[g]))
    return np.concatenate(pairs), np.concatenate(docs), np.concatenate(times)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers -> the distinct ones and where each begins."""
    starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, np.int64)
    return key[starts], starts


def _added(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of their multiplicities (see :func:`_links`)."""
    ones = len(key) - len(times)
    single = np.sort(key[:ones])
    keys, starts = _runs(single)
    sums = np.diff(np.r_[starts, len(single)])
    if len(times):
        keys, sums = np.r_[keys, key[ones:]], np.r_[sums, times]
        order = np.argsort(keys, kind="stable")
        keys, starts = _runs(keys[order])
        sums = np.add.reduceat(sums[order], starts)
    return keys, sums


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..most-1, left aligned with room for one more byte, and their number."""
    width = len(str(most - 1))
    text = np.array([str(i) for i in range(most)], f"S{width + 1}")
    return text.view(np.uint8).reshape(most, width + 1), np.char.str_len(text)


class _Text:
    """Digest texts ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        most = max(n_a, n_b)
        self.digits, self.length = _digits(most)

    def digests(self, a, b, ga, gb, a_cut, b_cut) -> list[str]:
        """Of each document, whose tokens end at a_cut and b_cut."""
        if not len(a):
            return [""] * len(a_cut)
        p, q = np.bincount(ga), np.bincount(gb)
        before_b, up_to_a = np.cumsum(q) - q, np.cumsum(p)
        place_a = np.arange(len(a)) + before_b[ga]
        place_b = np.arange(len(b)) + up_to_a[gb]
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[np.cumsum(p) - 1]] = ord("|")
        mark[place_b[np.cumsum(q) - 1]] = ord(";")
        rows = self.digits[ids]
        rows[np.arange(len(ids)), self.length[ids]] = mark
        data = rows[rows != 0].tobytes()
        ends = np.r_[0, np.cumsum(self.length[ids] + 1)][a_cut + b_cut]
        out, start = [], 0
        for end in ends.tolist():
            out.append(hashlib.sha256(data[start:end - 1]).hexdigest() if end > start else "")
            start = end
        return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, in as few bytes each as their greatest needs, compressed."""
    parts = []
    for x in arrays:
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        parts += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), x.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at:at + 4].decode().strip()), int.from_bytes(raw[at + 4:at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12).astype(np.int64))
        at += 12 + n * kind.itemsize
    return out


_TOOLS: dict[tuple, tuple[Tokenizers, _Text]] = {}  # for the life of a Python worker


def _tools(paths: tuple) -> tuple[Tokenizers, _Text]:
    if paths not in _TOOLS:
        _TOOLS.clear()
        own = Tokenizers(*paths)
        _TOOLS[paths] = own, _Text(len(own.a_bytes), len(own.b_bytes))
    return _TOOLS[paths]


def align(texts: list[str | None], paths: tuple) -> dict:
    """The block of these texts: a list for each measure and the digests, the sorted
    distinct pairs, the documents of each, and the packed links of the documents."""
    own, digest = _tools(paths)
    encoded = [own.encode(t or "") for t in texts]
    n_a = np.array([len(x) for x, _ in encoded], np.int64)
    n_b = np.array([len(y) for _, y in encoded], np.int64)
    a = np.concatenate([np.empty(0, np.int64), *(x for x, _ in encoded)])
    b = np.concatenate([np.empty(0, np.int64), *(y for _, y in encoded)])
    del encoded
    ga, gb = groups(np.cumsum(own.a_len[a]), np.cumsum(own.b_len[b]))
    a_cut, b_cut = np.cumsum(n_a), np.cumsum(n_b)
    sha = digest.digests(a, b, ga, gb, a_cut, b_cut)
    many = int(gb[-1]) + 1 if len(gb) else 0
    p, q = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    of = np.searchsorted(a_cut, np.cumsum(p) - p, side="right")  # a group's document
    n_groups = np.bincount(of, minlength=len(texts))
    n_links = np.zeros(len(texts), np.int64)
    np.add.at(n_links, of, p * q)
    pairs, docs, times = _links(a, b, p, q, of)
    del a, b, ga, gb
    place, distinct = pd.factorize(pairs)
    order = np.argsort(distinct)
    distinct = distinct[order]
    sorted_place = np.empty(len(order), np.int64)
    sorted_place[order] = np.arange(len(order))
    width = max(len(distinct), 1)
    key = docs * width + sorted_place[place]
    del pairs, docs, place
    key, times = _added(key, times)
    doc, place = key // width, key % width
    held = np.bincount(doc, minlength=len(texts))
    step = np.diff(place, prepend=0)
    fresh = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.empty(0, bool)
    step[fresh] = place[fresh]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "sha": sha, "pairs": distinct,
            "held_by": np.bincount(place, minlength=len(distinct)), "links": _packed(held, step, times)}


def _aligned(paths: tuple, schema: pa.Schema, block_bytes: int):
    """(id, text) -> one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        size = 0

        def block() -> pa.RecordBatch:
            got = align(texts, paths)
            many = [[list(got[m])] for m in MEASURES]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([list(ids)], schema.field("ids").type),
                 *(pa.array(m, pa.list_(pa.int64())) for m in many), pa.array([got["sha"]], pa.list_(pa.string())),
                 pa.array([_packed(np.diff(got["pairs"], prepend=0), got["held_by"])], pa.binary()),
                 pa.array([got["links"]], pa.binary())], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
        if texts:
            yield block()

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (block, place in its list, pair, documents)."""
    for b in batches:
        for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            steps, held = _unpacked(packed)
            pairs = np.cumsum(steps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), block)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(held)],
                names=["block", "place", "pair", "n"])


def _summed(schema: pa.Schema):
    """Blocks with their pairs' counts -> one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i] for n in b.schema.names}
                found = row["found"].values
                n = len(row["ids"].values)
                held, step, times = _unpacked(row["links"].as_py())
                doc = np.repeat(np.arange(n), held)
                total = np.zeros((2, n), np.int64)
                if len(doc):
                    place = np.cumsum(step)
                    first = np.cumsum(held) - held
                    before = np.r_[0, place][first[held > 0]]
                    place -= np.repeat(before, held[held > 0])
                    counts, best = np.empty(len(found), np.int64), np.empty(len(found), bool)
                    at = found.field("place").to_numpy()
                    counts[at] = found.field("count").to_numpy()
                    best[at] = found.field("best").to_numpy(zero_copy_only=False)
                    np.add.at(total[0], doc, times * best[place])
                    np.add.at(total[1], doc, times * counts[place])
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, *(row[m].values for m in MEASURES), pa.array(total[0]), pa.array(total[1]), row["sha"].values],
                    schema=schema)

    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many documents hold an id pair linked, and whether
    that is the highest count of its first id.  A pair is a * 2^32 + b."""
    rows = blocks.select("block", "pairs").mapInArrow(_pair_rows, "block long, place int, pair long, n long")
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair has
    its first id's highest count), count_sum (the pairs' counts over all links), groups_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    ensure_checkpoint_dir(docs.sparkSession)
    texts = pick(docs, id=id_col, text=text_col)
    id_type = texts.schema["id"].dataType
    kind = id_type.simpleString()
    ddl = f"block long, ids array<{kind}>, " + ", ".join(f"{m} array<long>" for m in MEASURES) + ", sha array<string>, pairs binary, links binary"
    schema = StructType.fromDDL(ddl)
    blocks = texts.mapInArrow(_aligned((ranks_path, pattern, model_path), to_arrow_schema(schema), block_bytes), schema).checkpoint()
    rows = blocks.select("block", "pairs").mapInArrow(_pair_rows, "block long, place int, pair long, n long")
    found = rows.join(pair_counts(blocks), "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "count", "best")).alias("found"))
    empty = F.array().cast("array<struct<place:int,count:bigint,best:boolean>>")
    full = blocks.drop("pairs").join(found, "block", "left").withColumn("found", F.coalesce("found", empty))
    out = StructType.fromDDL(f"id {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + ", n_best long, count_sum long, groups_sha256 string")
    return full.mapInArrow(_summed(to_arrow_schema(out)), out).withColumnRenamed("id", id_col)
