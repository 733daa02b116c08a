"""SimHash near-duplicates by Golay-code fuzzy hashing.

*Fingerprint.*  64 bits; a bit is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included.

*Keys.*  The fingerprint is cut into three segments of 22, 21 and 21 bits.  The
binary Golay code (23, 12) is perfect: each 23-bit word lies within 3 bits of
exactly one codeword.  K(w) is the set of codewords nearest to w and to its
one-bit neighbours (one or about six).  Words at distance 2 have a common
neighbour, so their K sets meet; words at distance 1 have each other's
codeword in K.  Four errors leave two cases (segment errors a <= b <= c):

* a = 0, b <= 2: one segment equal, another within 2 bits.  Key: the equal
  segment and each member of the other's K (six ordered pairs of segments).
* a = b = 1: two segments with exactly one error each, so both parities
  differ.  Key: the two codewords, and parity.  The side with even parity in the
  first of the two segments emits K x K with the other side's parities, the odd
  side its own two codewords.

Nothing else is possible within four errors, so no link is lost; keys have 25
to 34 bits, so chance meetings stay few.  A smaller bound is also covered.

*Join and verify.*  Distinct fingerprints are sorted by key; the members of a
key are compared in numpy and each key returns a spanning star for each linked
set, not its pairs.  A key with over BLOCK members is cut into blocks, and each
pair of blocks becomes a task of its own, so no group is held whole.

Defined results: a null or empty text or one of blanks has fingerprint zero and
is linked like any other; a text with fewer words than a shingle is one shingle;
repeated rows get a row each; a null document id never names a component (a
component of null ids only has a null name); an empty table gives an empty
result; extra columns are ignored by :func:`clusters` and carried by
:func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.components import connected_components
from haulspark.llm.frames import carry, grown, pick, restore, small_batches
from haulspark.session import ensure_checkpoint_dir

SEED = 42
BLOCK = 4096
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (shift, bits)
GOLAY_POLYNOMIAL = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
CHUNK = 1 << 16


# ---------------------------------------------------------------- fingerprint

def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text; shingles are hashed in chunks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in pairs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp a signed long."""
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return df.mapInArrow(run, grown(df.select("doc_id"), "fp long"))


# ----------------------------------------------------------------------- keys

def golay_table() -> np.ndarray:
    """Index of the nearest codeword of every 23-bit word."""
    index = np.arange(4096, dtype=np.int64)
    words = index << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    code = words | rest
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(one[i] | one[j] for i in range(23) for j in range(i)),
              *(one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j))]
    table = np.empty(1 << 23, np.int16)
    for e in errors:
        table[code ^ e] = index
    return table


_TABLE: list[np.ndarray] = []


def _nearest(words: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(golay_table())
    return _TABLE[0][words].astype(np.int64)


def _sets(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """K of each word: (row, codeword) lists without repeats, rows ascending."""
    flips = np.array([0, *(1 << i for i in range(bits))], np.int64)
    near = np.sort(_nearest(words[:, None] ^ flips), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(fresh)[0], near[fresh]


def _parity(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.astype(np.uint64)).astype(np.int64) & 1


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64)."""
    seg = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    sets = [_sets(w, n) for w, (_, n) in zip(seg, SEGMENTS)]
    rows, keys = [], []
    tag = 0
    for a in range(3):
        for b in range(3):
            if a != b:
                r, c = sets[b]
                rows.append(r)
                keys.append(np.int64(tag) << 40 | seg[a][r] << 12 | c)
                tag += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        pi, pj = _parity(seg[i]), _parity(seg[j])
        odd = np.nonzero(pi == 1)[0]
        rows.append(odd)
        keys.append(np.int64(tag) << 40 | pj[odd] << 24 | _nearest(seg[i][odd]) << 12 | _nearest(seg[j][odd]))
        ri, ci = sets[i]
        rj, cj = sets[j]
        per_j = np.bincount(rj, minlength=len(fps))
        first_j = np.cumsum(per_j) - per_j
        even = pi[ri] == 0
        ri, ci = ri[even], ci[even]
        times = per_j[ri]
        r, c = np.repeat(ri, times), np.repeat(ci, times)
        step = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
        rows.append(r)
        keys.append(np.int64(tag) << 40 | (1 - pj[r]) << 24 | c << 12 | cj[first_j[r] + step])
        tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 8192):
            part = fps[at:at + 8192]
            rows, keys = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "fp"])


# ------------------------------------------------------------ join and verify

def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for edges a-b over 0..n-1."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def _linked(keys: np.ndarray, fps: np.ndarray, max_bits: int, between: np.ndarray | None = None) -> np.ndarray:
    """Rows sorted by key -> for each row the first row of its linked set.

    ``between``: compare only rows whose values in it differ."""
    n = len(keys)
    root = np.arange(n)
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    rows = np.arange(n)
    found_a, found_b, held = [], [], 0
    for d in range(1, n):
        rows = rows[rows + d < ends[rows]]
        if not len(rows):
            break
        other = rows + d
        near = np.bitwise_count(fps[rows] ^ fps[other]) <= max_bits
        if between is not None:
            near &= between[rows] != between[other]
        found_a.append(rows[near])
        found_b.append(other[near])
        held += int(near.sum())
        if held > 1 << 20:  # fold what is held into stars
            root = _stars(n, np.concatenate([rows_all := np.arange(n), *found_a]), np.concatenate([root, *found_b]))
            found_a, found_b, held = [], [], 0
    return _stars(n, np.concatenate([np.arange(n), *found_a]), np.concatenate([root, *found_b]))


def _links(max_bits: int, block: int):
    """Rows (key, fp) sorted by key -> edges (a, b, -1) and, for keys with over
    ``block`` members, the members (key, fp, block number)."""

    def out(a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())],
                                          names=["a", "b", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.empty(0, np.int64)
        large, seen = None, 0  # the key that is passed on in blocks, and how many of its rows were

        def solve(k: np.ndarray, f: np.ndarray):
            if len(k) < 2:
                return None
            root = _linked(k, f.view(np.uint64), max_bits)
            at = np.nonzero(root != np.arange(len(k)))[0]
            pairs = np.unique(np.stack([f[at], f[root[at]]], axis=1), axis=0) if len(at) else np.empty((0, 2), np.int64)
            return out(pairs[:, 0], pairs[:, 1], np.full(len(pairs), -1)) if len(pairs) else None

        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            f = b.column(1).to_numpy(zero_copy_only=False)
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            if large is not None:
                m = int(np.searchsorted(keys, large, "right"))
                yield out(keys[:m], fps[:m], (seen + np.arange(m)) // block)
                seen += m
                keys, fps = keys[m:], fps[m:]
                if not len(keys):
                    continue
                large = None
            last = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            ready_k, ready_f = keys[:last], fps[:last]
            if len(keys) - last > block:
                large, seen = keys[-1], len(keys) - last
                yield out(keys[last:], fps[last:], np.arange(seen) // block)
                keys, fps = keys[:0], fps[:0]
            else:
                keys, fps = keys[last:], fps[last:]
            if len(ready_k):
                runs = np.nonzero(np.r_[True, ready_k[1:] != ready_k[:-1]])[0]
                sizes = np.diff(np.r_[runs, len(ready_k)])
                if (sizes > block).any():  # a whole large key in one batch
                    wide = np.repeat(sizes > block, sizes)
                    place = np.arange(len(ready_k)) - np.repeat(runs, sizes)
                    yield out(ready_k[wide], ready_f[wide], place[wide] // block)
                    ready_k, ready_f, sizes = ready_k[~wide], ready_f[~wide], sizes[sizes <= block]
                several = np.repeat(sizes > 1, sizes)
                if (got := solve(ready_k[several], ready_f[several])) is not None:
                    yield got
        if (got := solve(keys, fps)) is not None:
            yield got

    return run


def _block_pairs(blocks: DataFrame, max_bits: int) -> DataFrame:
    """Links within keys that came in blocks: one group for each pair of blocks."""
    import pandas as pd

    count = blocks.groupBy("a").agg((F.max("block") + 1).alias("n"))
    each = blocks.join(count, "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = each.select("a", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "b")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates()
        f = pdf["b"].to_numpy()
        two = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        root = _linked(np.zeros(len(f), np.int64), f.view(np.uint64), max_bits, pdf["block"].to_numpy() if two else None)
        at = np.nonzero(root != np.arange(len(f)))[0]
        return pd.DataFrame({"a": f[at], "b": f[root[at]]})

    return dealt.groupBy("a", "lo", "hi").applyInPandas(solve, "a long, b long")


def link(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> edges (a, b) that connect exactly
    what pairs within ``max_bits`` (4 at most) connect."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    ensure_checkpoint_dir(fps.sparkSession)
    keys = fps.select("fp").mapInArrow(_key_rows, "key long, fp long")
    dealt = keys.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_links(max_bits, block), "a long, b long, block int").checkpoint()
    edges = found.filter("block < 0").select("a", "b")
    large = found.filter("block >= 0")
    return edges if large.isEmpty() else edges.unionByName(_block_pairs(large, max_bits))


def _roots(prints: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id), one row per fingerprint."""
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(link(named, max_bits, block))
    joined = named.join(labels, named["fp"] == labels["node"]).select("fp", "least", "root")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = joined.select("fp", "root").join(of_root, "root").select("fp", "root", "component_id")
    return named.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def clusters(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, block: int = BLOCK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable), root."""
    ensure_checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # a table of its own, so that both sides of the join are dealt anew and a hot fingerprint can be split
    roots = _roots(prints, max_bits, block).checkpoint()
    return prints.join(roots, "fp").select(
        "doc_id", hexed.alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, block: int = BLOCK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with the columns it came with: the one
    with the least id; of rows that repeat this id, any one."""
    ensure_checkpoint_dir(docs.sparkSession)
    names = docs.columns
    prints = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    roots = _roots(prints, max_bits, block).checkpoint()
    twice = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select(
        F.col("doc_id").alias("key")).checkpoint()
    # the id tells a row unless it is null or repeated
    best = prints.join(roots, "fp").filter("doc_id = component_id").select(F.col("doc_id").alias("key"))
    base = carry(docs, key=id_col, text=text_col)
    if twice.isEmpty():
        return restore(base.join(best, "key", "left_semi"), names)
    once = base.join(best.join(twice, "key", "left_anti"), "key", "left_semi")
    same = base.withColumnRenamed("key", "own").join(twice, F.expr("own IS NOT DISTINCT FROM key"), "left_semi")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, "fp"])

    tagged = same.mapInArrow(add, grown(same, "fp long"))
    again = tagged.join(roots, "fp").filter("own IS NOT DISTINCT FROM component_id").dropDuplicates(["root"])
    cols = [f"_in{i}" for i in range(len(names))]
    return restore(once.select(*cols).unionByName(again.select(*cols)), names)
