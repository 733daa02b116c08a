"""Collocations, token alignment and packing against brute force, and the odd inputs."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from haulspark.llm import alignment, collocations, packing, queries

SF = "/root/testdata/sf0.001"
RANKS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
SPECIAL = queries.END_OF_TEXT


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hf(plain_specials: bool) -> Tokenizer:
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain_specials
    return t


# ------------------------------------------------------------------ 11 collocations

def duck_phrases(rows, **limits):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [list(r) for r in rows])
    return sorted(con.execute(queries.op11_sql("t", **limits)).fetchall(), key=repr)


@pytest.mark.parametrize("max_words,min_count,top", [(2, 2, 50), (3, 3, 2000), (4, 2, 40)])
def test_phrases_equal_sql(spark, max_words, min_count, top):
    rnd = random.Random(max_words)
    words = ["a", "B", "the", "of", "é", "Zug", "日本", "x-y"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " "]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice(seps) for _ in range(rnd.randint(0, 120))))
            for _ in range(60)] + [("en", None), (None, ""), ("en", " \t."), ("fr", "one")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = rows_of(collocations.mine(df, max_words=max_words, min_count=min_count, top=top, filter_bits=1 << 10))
    assert got == duck_phrases(rows, max_words=max_words, min_count=min_count, top=top) and got


def test_phrase_filter_size_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide, narrow = (rows_of(collocations.mine(docs, filter_bits=b)) for b in (1 << 22, 1 << 6))
    assert wide == narrow and wide


def test_phrases_of_blocks_equal_those_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    text = "one two three. " * 40 + "four five " * 60 + ", six"
    blocks = list(collocations._blocks(iter([collocations.pa.RecordBatch.from_arrays(
        [collocations.pa.array([b"en", b"en"]), collocations.pa.array([text.encode(), b"seven eight"])], names=["grp", "text"])])))
    assert len(blocks) > 5
    for order in (1, 2, 3):
        parts, whole = Counter(), Counter()
        for group, data in blocks:
            grams, counts, _ = collocations.ngrams(group, data, order, [])
            parts.update(dict(zip(grams, counts.tolist())))
        for data in (text.encode(), b"seven eight"):
            grams, counts, _ = collocations.ngrams(b"en", data, order, [])
            whole.update(dict(zip(grams, counts.tolist())))
        assert parts == whole


def test_phrase_scores_are_exact(spark):
    rows = [(10**15 - 1, 10**15 - 1, 10**15 - 1), (999_999_999_989, 10**12, 10**12), (10, 333, 7), (11, 11, 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(df.a, df.l, df.r)).collect()]
    assert got == [1_000_000 * a * a // (left * r) for a, left, r in rows]


def test_phrases_odd_inputs(spark, docs, empty):
    assert collocations.mine(empty).count() == 0
    got = rows_of(collocations.mine(docs, min_count=2))
    assert got == duck_phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], min_count=2)


# ------------------------------------------------------------------ 12 alignment

def brute_alignment(rows):
    """One token, one pair at a time."""
    a_tok, b_tok = hf(True), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {}
    start = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in start]
    for b in start:
        back[chr(b)] = b
    for i, b in enumerate(rest):
        back[chr(256 + i)] = b
    links, out = [], []
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(back[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode())
                 for i in b_tok.encode(text)]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        groups, i, j, ea, eb = [], 0, 0, 0, 0
        while i < len(a):
            ga, gb = [a[i][0]], [b[j][0]]
            ea, eb, i, j = ea + len(a[i][1]), eb + len(b[j][1]), i + 1, j + 1
            while ea != eb:
                if ea < eb:
                    ga.append(a[i][0])
                    ea, i = ea + len(a[i][1]), i + 1
                else:
                    gb.append(b[j][0])
                    eb, j = eb + len(b[j][1]), j + 1
            groups.append((ga, gb))
        own = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        sha = hashlib.sha256(";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups).encode()).hexdigest() if groups else ""
        links.append(own)
        out.append((doc, len(a), len(b), len(groups), sum(own.values()), sha))
    counts = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((d, na, nb, g, n, sum(k for p, k in own.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in own.items()), sha)
                   for (d, na, nb, g, n, sha), own in zip(out, links)), key=repr)


def aligned(df, **more):
    return rows_of(alignment.aligned(df, RANKS, P.PATTERN, PIECES, **more))


def test_alignment_of_documents_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned(docs.repartition(3), block_bytes=50_000) == brute_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_odd_inputs(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(alignment, "PRODUCT", 4)  # groups above are linked by distinct ids
    texts = ["plain", " leading", "▁odd", "<|endoftext|> and <s> </s> <0x41>", "a\nb\t c", "日本語のテキスト", "🙂🙃 emoji", "\u0000nul", "x" * 5000,
             "=" * 3001 + " " * 777, "ﬁ ligature", "é é", "ــــــــ", "한국어", "\r\n\r\n", "٣٤٥", " ", "a" * 33 + "b", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "plain"), (None, "plain"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pair", "2 AS block", "'x' AS Pairs")
    assert aligned(df.repartition(2)) == brute_alignment(rows)
    assert aligned(empty) == []
    assert aligned(docs, block_bytes=3000) == brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pointer_jumping_labels_the_groups():
    rng = np.random.default_rng(5)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        ends = [np.unique(np.r_[rng.integers(1, total + 1, rng.integers(0, 40)), total]) for _ in range(2)]
        both = np.intersect1d(*ends)
        for got, own in zip(alignment.groups(*ends), ends):
            assert got.tolist() == np.searchsorted(both, own).tolist()


# ------------------------------------------------------------------ 13 packing

def test_fast_encoder_equals_the_library():
    t = hf(False)
    encode = packing.encoder(RANKS, P.PATTERN, SPECIAL)
    step = [chr(c) for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = ["", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b  \n", "<|endof", *(f"a{c}b 1{c}2 {c}{c} !{c}? \n{c}\t{c} " for c in step)]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == want.ids


def held(packed, rows, capacity):
    """Checks whole results; gives the number of sequences."""
    t = hf(False)
    want = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (start, n) in enumerate(packing.cut_points(len(ids), capacity)):
            assert n == capacity or k == 0
            want.append((doc, k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_documents_are_packed_whole(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs.repartition(4), RANKS, P.PATTERN, SPECIAL, capacity=capacity, rounds=40).collect()
    n = held(got, [(r.doc_id, r.text) for r in docs.collect()], capacity)
    assert n <= 1.002 * -(-sum(r.length for r in got) // capacity) + 1


def test_packing_odd_inputs(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert held(packing.pack(docs, RANKS, P.PATTERN, SPECIAL).collect(), rows, 2048)
    assert packing.pack(empty, RANKS, P.PATTERN, SPECIAL).count() == 0
    same = [(i, "all alike") for i in range(300)]
    df = spark.createDataFrame(same, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS part", "3 AS offset")
    assert held(packing.pack(df.repartition(7), RANKS, P.PATTERN, SPECIAL, capacity=10).collect(), same, 10) == 100


def best_fit_decreasing(counts):
    capacity, room, n = len(counts) - 1, [], 0
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(room) if r >= length]
            if fit:
                i = min(fit, key=room.__getitem__)
                room[i] -= length
            else:
                room.append(capacity - length)
    return len(room)


def fewest(lengths, capacity):
    """Exact, by search."""
    best = [len(lengths)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for r in sorted(set(room)):
            if r >= lengths[i]:
                rest = list(room)
                rest.remove(r)
                go(i + 1, [*rest, r - lengths[i]])
        go(i + 1, [*room, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_plans_cover_the_histogram_and_are_near_the_bound():
    rng = np.random.default_rng(3)
    for t in range(25):
        capacity = int(rng.integers(10, 40))
        lengths = sorted(rng.integers(1, capacity, 9).tolist(), reverse=True)
        counts = np.bincount(lengths, minlength=capacity + 1)
        made = packing.plan(counts, 60)
        used = np.zeros(capacity + 1, int)
        for kind, n in made.kinds:
            assert sum(kind) <= capacity
            for x in kind:
                used[x] += n
        assert used.tolist() == counts.tolist()
        assert made.bound <= fewest(lengths, capacity) <= made.sequences <= fewest(lengths, capacity) + 1


@pytest.mark.parametrize("low,high", [(26, 45), (40, 63), (1, 100)])
def test_plans_are_no_worse_than_plain_best_fit(low, high):
    counts = np.bincount(np.random.default_rng(low).integers(low, high, 1500), minlength=129)
    made = packing.plan(counts, 120)
    assert made.bound <= made.sequences <= best_fit_decreasing(counts) + 1


def test_the_plan_does_not_grow_with_the_data():
    counts = np.bincount(np.random.default_rng(1).integers(1, 128, 4000), minlength=129)
    rows = [sum(len(k) for k, _ in packing.plan(counts * times, 60).kinds) for times in (1, 10**3, 10**6, 10**9)]
    assert rows[3] < 3 * rows[1]
