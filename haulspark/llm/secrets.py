"""Secret scan: candidates by pattern, false positives removed by a random forest.

*Candidates* are runs of key characters: values assigned to a name, and any run
of at least MIN_LENGTH characters.  Patterns only propose; the forest decides.

*Features* (:data:`FEATURES`): length, entropy, class shares, character
transitions (mean log-probability of neighbouring characters under the corpus's
own transition counts, and switches between letters, digits and case),
dictionary coverage (share of the characters covered by short words of the
corpus), path (separators inside, or next to the candidate) and neighbouring
words (names that announce a secret or a harmless identifier, and an assignment
sign).

*Training.*  A Spark ML random forest on labelled findings (doc_id, start,
is_secret), at most MAX_TRAINING of each label (a documented bound; everything
else covers all data).  Corpus statistics are counted over all documents.

*Labels without a reviewer.*  :func:`weak_labels` labels findings from strict
vendor formats (secret) and from their harmless look-alikes (not secret).

Scale: candidates come out of one pass; the transition table has 65,536 entries
at most and the dictionary holds words that at least DICTIONARY_SHARE of the
documents contain (so its size is bounded by the words of a document divided by
that share); both are broadcast.  No shuffle depends on a key of the data except
the counts, which are combined before it.

Defined results: null and empty texts have no candidates; repeated rows give
their own findings; an empty table gives an empty result; given labels of one kind
only are an error, and where the weak labels are of one kind all findings are
returned without a score; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import grown, pick, small_batches
from haulspark.session import ensure_checkpoint_dir

MIN_LENGTH = 16
MAX_TRAINING = 20_000
DICTIONARY_SHARE = 0.002
DICTIONARY_WORD = (2, 8)  # letters of a dictionary word
SEED = 42

# Names that announce a secret, or a harmless identifier.
ANNOUNCE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth",
            "authorization", "bearer", "credential", "private", "key")
HARMLESS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "hash", "digest", "uuid", "guid", "id", "etag", "version",
            "example", "sample", "test", "placeholder", "dummy", "revision", "integrity", "nonce")

# Vendor formats (public key formats).
FORMATS = (
    ("aws_access_key", r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("slack_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_RUN = r"[A-Za-z0-9+/_=.\-]"
# A name that announces a secret (after a character that is no letter or digit, or at a
# camelCase boundary), a sign, and the value: up to the closing quote, or if there is none
# up to a blank, quote or bracket.
_NAMED = re.compile(rf"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:{'|'.join(sorted(map(re.escape, ANNOUNCE), key=len, reverse=True))})"
                    r"[\"']?\s*(?::=|=>|[:=])\s*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|[\"']?([^\s\"'`,;<>(){}\[\]]{6,}))")
_LONG = re.compile(rf"(?<!{_RUN})[\"']?({_RUN}{{{MIN_LENGTH},}})(?!{_RUN})")
_PIECES = re.compile(r"[A-Za-z]+|[0-9]+")
_LETTERS = re.compile(rf"[^\W\d_]{{{DICTIONARY_WORD[0]},{DICTIONARY_WORD[1]}}}(?![^\W\d_])")
_NEAR = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_KINDS = [(name, re.compile(pattern)) for name, pattern in FORMATS]

FEATURES = ("length", "entropy", "digit_share", "upper_share", "class_switches", "transition_score", "dictionary_coverage",
            "separators", "in_path", "after_sign", "near_announce", "near_harmless", "word_distance")


def candidates(text: str) -> list[tuple[int, str]]:
    """(start, value) of every candidate, each run once."""
    out, ends = {}, []
    for m in _NAMED.finditer(text):
        value = m.group(m.lastindex)
        if m.lastindex == 3:
            value = value.rstrip(".-=:!?")
        if len(value) >= 6:
            out[m.start(m.lastindex)] = value
            ends.append((m.start(m.lastindex), m.start(m.lastindex) + len(value)))
    for m in _LONG.finditer(text):
        value = m.group(1)
        start = m.start(1)
        sign = value.find("=")
        if 0 < sign < len(value) - MIN_LENGTH:  # name=value without blanks
            start, value = start + sign + 1, value[sign + 1:]
        value = value.rstrip(".-")
        i = bisect.bisect_right(ends, (start, math.inf)) - 1
        apart = (i < 0 or start >= ends[i][1]) and (i + 1 == len(ends) or start + len(value) <= ends[i + 1][0])
        if len(value) >= MIN_LENGTH and apart:  # an announced value is the finding there
            out[start] = value
    return sorted(out.items())


def kind(value: str) -> str:
    for name, pattern in _KINDS:
        if pattern.fullmatch(value):
            return name
    return "other"


def transition_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n): neighbouring byte pairs over all texts (65,536 at most)."""
    df = small_batches(pick(docs, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for t in b.column(0):
                raw = np.frombuffer((t.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
                if len(raw) > 1:
                    total += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    return df.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE, text_col: str = "text") -> DataFrame:
    """(word): short words that at least ``share`` of the documents contain.

    Each task counts its documents' words in bounded batches."""
    df = small_batches(pick(docs, text=text_col))
    n = df.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])

        for b in batches:
            for t in b.column(0):
                seen.update(set(_LETTERS.findall((t.as_py() or "").lower())))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    counted = df.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= max(2, math.ceil(share * n))).select("word")


class Scorer:
    """Features of a candidate in its text."""

    def __init__(self, pairs: list[tuple[int, int]], words: list[str]):
        table = np.ones((256, 256))
        for pair, n in pairs:
            table[pair >> 8, pair & 255] += n
        self.log = np.log(table / table.sum(1, keepdims=True))
        self.words = set(words)
        self.longest = DICTIONARY_WORD[1]

    def coverage(self, value: str) -> float:
        """Share of the letters that words of the dictionary cover, greedily."""
        covered, letters = 0, 0
        for m in _PIECES.finditer(value.lower()):
            run = m.group()
            letters += len(run)
            at = 0
            while at < len(run):
                for size in range(min(self.longest, len(run) - at), 2, -1):
                    if run[at:at + size] in self.words:
                        covered += size
                        at += size
                        break
                else:
                    at += 1
        return covered / letters if letters else 0.0

    def features(self, text: str, start: int, value: str) -> list[float]:
        raw = np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        share = np.array(list(Counter(value).values())) / len(value)
        classes = np.array([1 if c.isdigit() else 2 if c.isupper() else 3 if c.isalpha() else 4 for c in value])
        before, after = text[max(0, start - 60):start], text[start + len(value):start + len(value) + 40]
        names = [w.lower() for w in _NEAR.findall(before)][-3:]
        tail = [w.lower() for w in _NEAR.findall(after)][:2]
        near = names + tail
        told = [i for i, w in enumerate(reversed(names)) if any(w == x or w.endswith(("_" + x, "-" + x)) for x in ANNOUNCE)]
        return [
            float(len(value)), float(-(share * np.log2(share)).sum()),
            float((classes == 1).mean()), float((classes == 2).mean()),
            float((classes[1:] != classes[:-1]).mean()) if len(value) > 1 else 0.0,
            float(self.log[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0,
            self.coverage(value), float(sum(c in "/.-_" for c in value)),
            float("/" in value or before[-1:] in "/\\" and before != "" or "://" in before[-12:]),
            float(bool(re.search(r"[:=][\s\"']*$", before))),
            float(bool(told)), float(any(w in HARMLESS for w in near)), float(told[0] if told else 9),
        ]


def findings(docs: DataFrame, share: float = DICTIONARY_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate: doc_id, start, value, kind and the features."""
    spark = docs.sparkSession
    pairs = [(r["pair"], r["n"]) for r in transition_counts(docs, text_col).collect()]
    words = [r["word"] for r in dictionary(docs, share, text_col).collect()]
    shared = spark.sparkContext.broadcast((pairs, words))
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))
    schema = grown(df.select("doc_id"), "start int, value string, kind string, " + ", ".join(f"{f} double" for f in FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                for start, value in candidates(text):
                    rows.append((start, value, kind(value), *scorer.features(text, start, value)))
                    at.append(i)
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()),
                     pa.array(cols[2], pa.string()), *(pa.array(c, pa.float64()) for c in cols[3:])], names=schema.names)

    return df.mapInArrow(run, schema)


def weak_labels(found: DataFrame) -> DataFrame:
    """(doc_id, start, is_secret) for the findings that need no reviewer: vendor
    formats and random values assigned to an announcing name are secrets; runs of
    dictionary words, paths, and values that a harmless name announces are not."""
    secret = (F.col("kind") != "other") | (
        (F.col("near_announce") == 1) & (F.col("after_sign") == 1) & (F.col("digit_share") > 0.15)
        & (F.col("dictionary_coverage") < 0.5) & (F.col("near_harmless") == 0))
    harmless = (F.col("kind") == "other") & (F.col("near_announce") == 0) & (
        (F.col("digit_share") == 0) | (F.col("in_path") == 1) | (F.col("near_harmless") == 1) | (F.col("dictionary_coverage") > 0.6))
    label = F.when(secret, 1).when(harmless, 0)
    return found.select("doc_id", "start", label.alias("is_secret")).filter("is_secret IS NOT NULL")


def train(found: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, trees: int = 20, depth: int = 6, seed: int = SEED):
    """A Spark ML random forest, or None if one label is missing.

    At most ``max_training`` findings of each label, chosen by a hash of the
    finding, so the choice does not depend on partitions."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = found.join(labels.dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
    order = F.xxhash64(F.lit(seed), "doc_id", "start")
    sample = None
    for value in (0, 1):
        some = labelled.filter(F.col("is_secret") == value).orderBy(order, "doc_id", "start").limit(max_training)
        sample = some if sample is None else sample.unionByName(some)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        sample.withColumn("label", F.col("is_secret").cast("double"))).select("features", "label").checkpoint()
    if ready.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ready)


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, max_training: int = MAX_TRAINING,
         share: float = DICTIONARY_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each finding that the forest keeps: doc_id, start, n_chars,
    kind, value_sha256, score.  ``labels``: labelled findings (doc_id, start,
    is_secret 0/1); None: weak labels.  The value itself is not returned."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ensure_checkpoint_dir(docs.sparkSession)
    found = findings(docs, share, id_col, text_col).checkpoint()
    model = train(found, weak_labels(found) if labels is None else labels, max_training)
    plain = found.select("doc_id", "start", F.length("value").alias("n_chars"), "kind",
                         F.sha2("value", 256).alias("value_sha256"), *FEATURES)
    if model is None:
        if labels is not None and not found.isEmpty():
            raise ValueError("labels of both kinds are needed")
        return plain.select("doc_id", "start", "n_chars", "kind", "value_sha256", F.lit(None).cast("double").alias("score"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(plain))
    return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).filter(F.col("score") >= threshold).select(
        "doc_id", "start", "n_chars", "kind", "value_sha256", "score")
