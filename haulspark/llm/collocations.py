"""Collocations: phrases whose words keep together, from n-gram count streams.

*Count streams.*  Texts are cut into pieces and words; for each order 1 to
``max_words`` a pass counts the n-grams.  A task numbers the words of a block of
text, sorts the blocks' n-grams as integers and emits each once with its count;
the engine adds the counts of equal n-grams before and after one shuffle.  An
n-gram below ``min_count`` can neither be a candidate nor stand inside one, so a
pass counts only n-grams whose two shorter ones reach it.  The pass knows them by
a bit table of fixed size (:data:`FILTER_BITS`): a wrong hit merely has an n-gram
counted that the exact count then drops, so results do not depend on its size.

*Lockstep joins.*  The stream of an order is read twice: in the order of its
leading words (prefix order) and of its trailing words (suffix order).  Sort-merge
joins run it against the shorter streams in the same order: for each cut, the
first part's count ``l`` from the prefix order and the rest's ``r`` from the suffix
order.  The counts of the phrases one word longer, on the left or on the right,
are the greatest of their prefix and suffix streams, and come by the same join.
A phrase inside a longer one is inside one that is a single word longer and at
least as frequent, so these suffice for :func:`mine`'s containment rule.

*Scale.*  A frequent n-gram is one row for each task before the shuffle.  Joins
are left to adaptive execution, which splits the rows of a hot leading or
trailing word; nothing that grows is broadcast.  The first ranks of a group are taken in
dealt groups first, so no task sees all candidates of a language.  The count
streams of candidates are checkpointed to the shared folder.

Defined results: a null text is empty, a null group is named ``und``; empty
texts have no words; a very long text is worked on in blocks cut between pieces;
repeated rows count again; ties go to the smallest cut, and in ranks to the
greater count, then to the smaller phrase in the order of UTF-8 bytes; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulspark.llm.frames import pick
from haulspark.session import ensure_checkpoint_dir

UNKNOWN_GROUP = "und"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLOCK_BYTES = 4 << 20  # of text that a task counts at a time
FILTER_BITS = 1 << 26  # of the table of frequent n-grams of an order, 8 MB
DEALT = 32  # parts of a group ranked apart
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes.maketrans(BREAKS + b"\t" + _UPPER, b"\n" * len(BREAKS) + b" " + _UPPER.lower())


class _Numbers(dict):
    """Word -> number from 0; -1 ends a piece, -2 is no word."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 2
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _word_hashes(group: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(group)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the n-grams with hash ``h`` and one word more."""
    return _mixed(h * _STEP + last)


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hashes may be in the table; the table has 64 bits to a number."""
    six, low, one = np.uint64(6), np.uint64(63), np.uint64(1)
    a, b = _bits(h, len(table) * 64)
    return ((table[a >> six] >> (a & low)) & (table[b >> six] >> (b & low)) & one).astype(bool)


def ngrams(group: bytes, data: bytes, order: int, known: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, int]:
    """(n-grams, their counts, number of words) of a block of one group's text.
    ``known`` holds the tables of the orders below; they may be fewer."""
    numbers = _Numbers()
    tokens = data.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    ids = ids[ids > -2]
    words = list(numbers)[2:]
    total = int(np.count_nonzero(ids >= 0))
    if not words:
        return [], np.empty(0, np.int64), 0
    if order == 1:
        return words, np.bincount(ids[ids >= 0], minlength=len(words)), total
    own = _word_hashes(group, words)
    rank, hashes = ids, own
    grams = np.arange(len(words), dtype=np.int64)[:, None]
    for n in range(1, order):
        if n <= len(known):
            good = _known(known[n - 1], hashes)
            rank = np.where((rank >= 0) & good[rank], rank, -1)
        both = (rank[:-1] >= 0) & (rank[1:] >= 0)
        last = ids[n:]
        keys = rank[:-1][both] * len(words) + last[both]
        if not len(keys):
            return [], np.empty(0, np.int64), total
        found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        rank = np.full(len(both), -1, np.int64)
        rank[both] = inverse
        grams = np.c_[grams[found // len(words)], found % len(words)]
        hashes = _longer(hashes[found // len(words)], own[found % len(words)])
    columns = [map(words.__getitem__, grams[:, i].tolist()) for i in range(order)]
    return [b" ".join(g) for g in zip(*columns)], counts, total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Blocks of (group, text); texts are joined and cut between pieces only."""
    held: dict[bytes, list[bytes]] = {}
    size = 0

    def out():
        for group, texts in held.items():
            yield group, b"\n".join(texts)
        held.clear()

    for b in batches:
        for group, text in zip(b.column(0), b.column(1)):
            group, text = group.as_py(), text.as_py()
            while len(text) > BLOCK_BYTES:
                cut = max(text.rfind(c.to_bytes(), 0, BLOCK_BYTES) for c in BREAKS)
                if cut < 0:  # a piece longer than a block stays whole
                    ends = [e for c in BREAKS if (e := text.find(c.to_bytes(), BLOCK_BYTES)) >= 0]
                    if not ends:
                        break
                    cut = min(ends)
                yield group, text[:cut]
                text = text[cut + 1:]
            held.setdefault(group, []).append(text)
            size += len(text)
            if size > BLOCK_BYTES:
                yield from out()
                size = 0
    yield from out()


def _counted(texts: DataFrame, order: int, known: list) -> DataFrame:
    """(grp, phrase, f) of an order; order 1 has each group's number of words as
    the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(k.value, np.uint64) for k in known]
        for group, data in _blocks(batches):
            grams, counts, total = ngrams(group, data, order, tables)
            if order == 1:
                grams, counts = [*grams, b""], np.r_[counts, total]
            for at in range(0, len(grams), 50_000):
                part = grams[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(part), pa.binary()), pa.array(part, pa.binary()),
                     pa.array(counts[at:at + 50_000], pa.int64())], names=["grp", "phrase", "n"])

    rows = texts.mapInArrow(run, "grp binary, phrase binary, n long")
    return rows.groupBy("grp", "phrase").agg(F.sum("n").alias("f"))


def _table(stream: DataFrame, bits: int):
    """The broadcast bit table of a stream; the driver sees its set words, at most ``bits`` / 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[np.ndarray] = []
            for group, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _word_hashes(group, phrase.split(b" "))
                h = own[:1]
                for n in range(1, len(own)):
                    h = _longer(h, own[n:n + 1])
                at.append(h)
            if not at:
                continue
            places = np.unique(np.concatenate(_bits(np.concatenate(at), bits)))
            slot, first = np.unique(places >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    rows = stream.select("grp", "phrase").mapInArrow(run, "slot long, mask long")
    found = rows.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("slot").to_numpy()] = found.column("mask").to_numpy()
    return stream.sparkSession.sparkContext.broadcast(table.tobytes())


def count_streams(docs: DataFrame, max_words: int = 3, min_count: int = 10, group_col: str = "lang", text_col: str = "text",
                  filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each order a stream (grp, phrase, f) of the n-grams found ``min_count``
    times or more; the first also has each group's number of words as phrase ''."""
    ensure_checkpoint_dir(docs.sparkSession)
    texts = pick(docs, grp=group_col, text=text_col).select(
        F.coalesce("grp", F.lit(UNKNOWN_GROUP)).cast("binary").alias("grp"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    streams: list[DataFrame] = []
    known: list = []
    for order in range(1, max_words + 1):
        if streams:
            known.append(_table(streams[-1].filter(F.length("phrase") > 0), filter_bits))
        counted = _counted(texts, order, known)
        streams.append(counted.filter((F.col("f") >= min_count) | (F.length("phrase") == 0)).checkpoint())
    for k in known:
        k.unpersist()
    return [s.select(F.col("grp").cast("string").alias("grp"), F.col("phrase").cast("string").alias("phrase"), "f") for s in streams]


def score(a, l, r):
    """floor(10^6 a^2 / (l r)), exact up to counts of 10^15."""
    a, l, r = (c.cast("decimal(15,0)") for c in (a, l, r))
    top = (a * a).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, l * r)


def scored(streams: list[DataFrame], share: int = 50) -> DataFrame:
    """Every candidate (grp, phrase, words, a, l, r, score, contained): the counts of
    its lowest-scoring cut, and whether a longer candidate with ``share`` percent of
    its count has it inside."""
    out = None
    for order in range(2, len(streams) + 1):
        own = streams[order - 1].select("grp", "phrase", F.col("f").alias("a"))
        for k in range(1, order):
            first = streams[k - 1].select("grp", F.col("phrase").alias("first"), F.col("f").alias("l")).filter("first <> ''")
            rest = streams[order - k - 1].select("grp", F.col("phrase").alias("rest"), F.col("f").alias("r")).filter("rest <> ''")
            # prefix order, then suffix order
            own = own.withColumn("first", F.substring_index("phrase", " ", k)).join(first.hint("merge"), ["grp", "first"])
            own = own.withColumn("rest", F.substring_index("phrase", " ", k - order)).join(rest.hint("merge"), ["grp", "rest"])
            cut = F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.lit(k).alias("k"), "l", "r")
            own = own.withColumn(f"cut{k}", cut).drop("first", "rest", "l", "r")
        cuts = [F.col(f"cut{k}") for k in range(1, order)]
        least = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        own = own.withColumn("cut", least)
        if order < len(streams):
            longer = streams[order]
            ends = longer.select("grp", F.substring_index("phrase", " ", order).alias("phrase"), "f").unionByName(
                longer.select("grp", F.substring_index("phrase", " ", -order).alias("phrase"), "f"))
            most = ends.groupBy("grp", "phrase").agg(F.max("f").alias("longest"))
            own = own.join(most.hint("merge"), ["grp", "phrase"], "left")
        else:
            own = own.withColumn("longest", F.lit(None).cast("long"))
        part = own.select("grp", "phrase", F.lit(order).alias("words"), "a", "cut.l", "cut.r", "cut.score",
                          F.coalesce(100 * F.col("longest") >= share * F.col("a"), F.lit(False)).alias("contained"))
        out = part if out is None else out.unionByName(part)
    return out


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000,
         group_col: str = "lang", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The first ``top`` collocations of every group: grp, rank, phrase, a, l, r, n, score."""
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    streams = count_streams(docs, max_words, min_count, group_col, text_col, filter_bits)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = scored(streams, share).filter("NOT contained").withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    some = kept.withColumn("at", F.row_number().over(Window.partitionBy("grp", "dealt").orderBy(*best))).filter(F.col("at") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*best))).filter(F.col("rank") <= top)
    n = streams[0].filter("phrase = ''").select("grp", F.col("f").alias("n"))
    return first.join(n, "grp").select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
