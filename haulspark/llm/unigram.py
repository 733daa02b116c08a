"""Token counts of a unigram tokenizer by count-only Viterbi.

Aho-Corasick enumerates every vocabulary piece that ends at each position; the
dynamic programme keeps, for each position, only the best score and its number
of pieces, so no segmentation is ever built.  Ties follow the tokenizer
library's unigram model: candidates for a position come with the earliest start
(the longest piece) first and only a strictly better score replaces one; scores
are 64-bit floats added left to right.  A character that no piece covers alone
costs the lowest vocabulary score less 10; a run of such characters is one
unknown token.

Texts are cut at blanks first (the Metaspace rule: each blank becomes the first
character of the next piece, a text without a leading blank gets one), and the
counts of frequent pieces are remembered.

The pieces and scores come from a public vocabulary; nothing is trained.

Scale: documents are independent, one pass over the input, no shuffle.  The
vocabulary (under a megabyte) is broadcast; the memory of pieces is limited.

Defined results: a null or empty text has no tokens; repeated rows get a row
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from haulspark.llm.frames import grown, pick, small_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 500_000


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public sentencepiece vocabulary, without its
    control, unknown and byte pieces; ids are the positions in this list."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.matcher = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.matcher.add_word(piece, (len(piece), score))
        if scores:
            self.matcher.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.empty = not scores
        self.words: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of tokens of one cut piece."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count, unknown_end = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0
        unknown = self.unknown

        def unknown_at(end: int) -> None:
            """Consider the character before ``end`` as unknown."""
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                # a run of unknown characters is fused into one token
                count[end] = count[end - 1] + (not unknown_end[end - 1])
                unknown_end[end] = True

        single = False
        for last, (length, value) in (() if self.empty else self.matcher.iter(text)):
            end = last + 1
            while done < end:  # close positions that no piece ends at
                if done and not single:
                    unknown_at(done)
                done, single = done + 1, False
            start = end - length
            single = single or length == 1
            score = value + best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end], unknown_end[end] = score, count[start] + 1, False
        while done <= n:
            if done and not single:
                unknown_at(done)
            done, single = done + 1, False
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        words = words[1:] if text[0] == " " else words
        kept, total = self.words, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.viterbi(SPACE + w)
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                if len(w) <= 64:
                    kept[w] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}  # for the life of a Python worker


def _counter(raw: str) -> Counter:
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter([(p, s) for p, s in json.loads(raw)])
    return _COUNTERS[key]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (long), n_chars (long) of every document."""
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))
    raw = df.sparkSession.sparkContext.broadcast(json.dumps(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(raw.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([own.count(t) for t in texts], pa.int64()),
                 pa.array([len(t or "") for t in texts], pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    return df.mapInArrow(run, grown(df.select("doc_id"), "n_tokens long, n_chars long"))
