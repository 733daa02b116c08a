"""Byte-level BPE: a lazily determinised transducer, and a streaming decoder.

*Encoding.*  A token sequence is the BPE encoding of its bytes exactly if every
pair of neighbours is (merging two adjacent tokens' bytes gives the same two
tokens).  This makes a finite-state transducer: a configuration is (last token,
bytes read since, a prefix of some token); when these bytes are a token that may
follow the last one, the token ends here.  Its subset construction is built
lazily, state by state and byte by byte, and kept for the life of a Python
worker.  Each position has exactly one token that can end there, so the
encoding is read back along these tokens.  A token is out as soon as all live
configurations agree on it, after at most a few token lengths of lookahead.

Texts are cut by the tokenizer's pattern first; frequent pieces are remembered.

*Decoding* joins token bytes and runs an incremental UTF-8 state machine over
them, so characters split between tokens come out when they are complete.

Scale: documents are independent, one pass over the input and no shuffle.  The
rank file (under a megabyte) is read where the job is planned and broadcast; all
caches have fixed limits and start anew when full.

Defined results: a null or empty text has no tokens; special-token strings are
ordinary text; ties and repeated rows give a row each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import array
import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import grown, pick, small_batches

PIECES_KEPT = 300_000
STATES_KEPT = 240_000
LONG_TEXT = 1 << 20
NEVER = 1 << 40
NODE = 24  # bits of a tree node
TREE = (1 << NODE) - 1
REPLACEMENT = "�"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks), default=1)
        self.whole = {i for t, i in self.ranks.items() if _is_whole(t)}
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self._restart()

    # -- transducer -------------------------------------------------------

    def _plant(self) -> None:
        """The tree of token prefixes; only encoders need it."""
        self.token_at, self.inner, self.depth = [-1], bytearray(1), [0]
        for token, i in self.ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                down = self.child.get(node << 8 | byte)
                if down is None:
                    down = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = down
            self.token_at[node] = i

    def _restart(self) -> None:
        # a configuration is (last token + 1) << NODE | tree node; a state is a tuple of them
        self.states: list[tuple] = [(0,)]
        self.number = {(0,): 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next state << 32 | token

    def _edges(self, i: int) -> tuple[list, list] | None:
        """How a token's first and last part grow while its bytes are merged by
        rank, as (part, rank of its merge, rank of the merge that takes it up);
        None if merging does not give the token back."""
        if i in self.edges:
            return self.edges[i]
        token = self.tokens[i]
        parts = [token[k:k + 1] for k in range(len(token))]
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
            if rank == NEVER:
                self.edges[i] = None
                return None
            if at == 0:
                left.append((parts[0] + parts[1], rank))
            if at == len(parts) - 2:
                right.append((parts[-2] + parts[-1], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        spans = [[(x, born, chain[k + 1][1] if k + 1 < len(chain) else NEVER) for k, (x, born) in enumerate(chain)]
                 for chain in (left, right)]
        self.edges[i] = spans[0], spans[1]
        return self.edges[i]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether ``token`` may come after ``last`` (-1: at the start): no merge
        across the border comes before the merges that build the two tokens."""
        after = self._edges(token)
        if last < 0 or after is None:
            return after is not None
        ok = self.pairs.get(last << 32 | token)
        if ok is None:
            if len(self.pairs) > STATES_KEPT:
                self.pairs.clear()
            rank_of = self.ranks.get
            ok = True
            for x, born_x, gone_x in self._edges(last)[1]:
                for y, born_y, gone_y in after[0]:
                    if born_x < gone_y and born_y < gone_x:
                        rank = rank_of(x + y)
                        if rank is not None and rank < gone_x and rank <= gone_y:
                            ok = False
            self.pairs[last << 32 | token] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        """Next state << 32 | id of the token that ends with this byte."""
        if not self.child:
            self._plant()
        live, ended = [], -1
        for config in self.states[state]:
            node = self.child.get((config & TREE) << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                live.append(config & ~TREE | node)
            if ended < 0 <= self.token_at[node] and self._may_follow((config >> NODE) - 1, self.token_at[node]):
                ended = self.token_at[node]
        if ended < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = (*live, (ended + 1) << NODE)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = n << 32 | ended
        return n << 32 | ended

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of one piece that arrives in chunks."""
        known, move, state = self.moves.get, self._move, 0
        ends: list[int] = []  # the token that ends after each pending byte
        look = 8 * self.longest
        for chunk in chunks:
            for at in range(0, len(chunk), look):
                for byte in chunk[at:at + look]:
                    got = known(state << 8 | byte)
                    if got is None:
                        got = move(state, byte)
                    state = got >> 32
                    ends.append(got & 0xFFFFFFFF)
                if len(ends) >= look:
                    cut, out = self._agreed(ends, state)
                    yield from out
                    del ends[:cut]
        yield from self._path(ends, len(ends))
        if len(self.states) > STATES_KEPT or len(self.moves) > 3 * STATES_KEPT:
            self._restart()

    def _path(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.tokens[ends[at - 1]])
        return out[::-1]

    def _agreed(self, ends: list[int], state: int) -> tuple[int, list[int]]:
        """The bytes and tokens on which all live configurations agree."""
        common: set[int] | None = None
        for config in self.states[state]:
            at, seen = len(ends) - self.depth[config & TREE], {0}
            while at > 0:
                seen.add(at)
                at -= len(self.tokens[ends[at - 1]])
            common = seen if common is None else common & seen
        cut = max(common or {0})
        return cut, self._path(ends, cut)

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else list(self.transduce([data]))
        return array.array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= LONG_TEXT:
            return self._join(self.pattern.findall(text))
        found = (m.group() for m in self.pattern.finditer(text))
        out = []
        while some := list(islice(found, 1 << 16)):
            out.append(self._join(some))
        return b"".join(out)

    def _join(self, pieces: list[str]) -> bytes:
        kept, out = self.pieces, []
        for p in pieces:
            ids = kept.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(kept) >= PIECES_KEPT:
                    kept.clear()
                if len(p) <= 64:
                    kept[p] = ids
            out.append(ids)
        return b"".join(out)

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        table = self.tokens
        return b"".join([table[i] for i in array.array("I", ids)])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, token by token."""
        machine = Utf8Machine()
        for i in ids:
            token = self.tokens[i]
            if machine.clear and i in self.whole:
                yield token.decode("utf-8")
            elif text := machine.feed(token):
                yield text
        if text := machine.finish():
            yield text


class Utf8Machine:
    """Incremental UTF-8: bytes in, complete characters out.

    The state is (bytes still due, bounds of the next one, bytes held).  An
    ill-formed sequence gives one replacement character for its maximal valid
    beginning, and the offending byte starts anew."""

    def __init__(self):
        self.due, self.low, self.high, self.held, self.valid = 0, 0x80, 0xBF, bytearray(), True

    @property
    def clear(self) -> bool:
        return self.due == 0

    def _bad(self) -> str:
        self.valid, self.due, self.low, self.high = False, 0, 0x80, 0xBF
        self.held.clear()
        return REPLACEMENT

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode("utf-8"))
                        self.held.clear()
                    continue
                out.append(self._bad())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append(self._bad())
        return "".join(out)

    def finish(self) -> str:
        return self._bad() if self.due else ""


def _is_whole(token: bytes) -> bool:
    m = Utf8Machine()
    m.feed(token)
    return m.valid and m.clear


_CODECS: dict[str, Codec] = {}  # for the life of a Python worker


def codec(raw: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _ranks(df: DataFrame, ranks_path: str):
    """The rank file as a broadcast variable (public vocabularies: about 1 MB)."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(own: Codec, texts: pa.Array) -> list[pa.Array]:
    ids = [own.encode(t.as_py()) for t in texts]
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]


def _decoded(own: Codec, packed: pa.Array) -> list[pa.Array]:
    out, valid = [], []
    for x in packed:
        ids = array.array("I", x.as_py() or b"")
        out.append(b"".join([own.tokens[i] for i in ids]))
        # only tokens that end inside a character need the machine
        ok = own.whole.issuperset(ids)
        if not ok:
            m = Utf8Machine()
            for i in ids:
                if not (m.clear and i in own.whole):
                    m.feed(own.tokens[i])
            m.finish()
            ok = m.valid
        valid.append(ok)
    return [pa.array(out, pa.binary()), pa.array(valid, pa.bool_())]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (long), ids (binary: little-endian unsigned 32-bit)."""
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))
    raw = _ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_encoded(own, b.column(1))], names=["doc_id", "n_tokens", "ids"])

    return df.mapInArrow(run, grown(df.select("doc_id"), "n_tokens long, ids binary"))


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` plus ``decoded`` (binary) and ``valid_utf8``; null ids decode to nothing."""
    raw = _ranks(tokens, ranks_path)
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *_decoded(own, b.column(at))],
                                             names=[*b.schema.names, "decoded", "valid_utf8"])

    return tokens.mapInArrow(run, grown(tokens, "decoded binary, valid_utf8 boolean"))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8.

    Encodes, then decodes the ids, in one Python task instead of two."""
    df = small_batches(pick(docs, doc_id=id_col, text=text_col))
    raw = _ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for b in batches:
            ids = _encoded(own, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *ids, *_decoded(own, ids[1])],
                                             names=["doc_id", "n_tokens", "ids", "decoded", "valid_utf8"])

    done = df.mapInArrow(run, grown(df.select("doc_id"), "n_tokens long, ids binary, decoded binary, valid_utf8 boolean"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "valid_utf8")
