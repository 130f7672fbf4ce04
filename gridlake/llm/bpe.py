"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes if each token merges to itself and each neighbouring
pair merges to itself.  That makes encoding a regular relation: a nondeterministic transducer walks the
trie of the vocabulary, may end a token at any node that holds one, and starts the next at the root if the pair is allowed.  Its
states are determinised as they are met: a state is the set of live hypotheses (tokens not yet emitted,
last token, trie node), and tokens on which all hypotheses agree are emitted.  A hypothesis lives no longer than the longest
token, so the lookahead is bounded.  At the end of the input exactly one hypothesis is at the root.

Texts are split by the vocabulary's pattern first, and each match is encoded alone.  Tables are caches with a
fixed size; a full one is started anew.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridlake.llm.common import input_columns

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ROWS_AT_ONCE = 256

Hypothesis = tuple[tuple[int, ...], int, int]


def splitter(pattern: str) -> regex.Pattern:
    """White space by the Unicode property, as in the pattern's own dialect."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Transducer:
    """Encoder of single pieces of bytes."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000) -> None:
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.limit = limit
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                after = self.child[node].get(byte)
                if after is None:
                    after = len(self.child)
                    self.child[node][byte] = after
                    self.child.append({})
                    self.token.append(-1)
                node = after
            self.token[node] = token
        self.whole: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        start: tuple[Hypothesis, ...] = (((), -1, 0),)
        self.states: list[tuple[Hypothesis, ...]] = [start]
        self.numbers = {start: 0}
        self.moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]

    def merged(self, data: bytes) -> list[int]:
        """Merge by rank, lowest first, leftmost first.  Only run on one token's bytes, to fill the tables."""
        return self._merge(data, 1)

    def _merge(self, data: bytes, until: int) -> list[int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token; a single byte is its own halves."""
        found = self.halves.get(token)
        if found is None:
            data = self.bytes[token]
            found = self.halves[token] = (token, token) if len(data) == 1 else tuple(self._merge(data, 2))
        return found

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives these two tokens again.

        Going back through their merges, latest first, no two parts that touch at the border may have a merge that comes before the next one undone.
        """
        ranks, data, undone = self.ranks, self.bytes, 1 << 30
        while True:
            joint = ranks.get(data[left] + data[right])
            if joint is not None and joint < undone:
                return False
            inner_left = (self.halves.get(left) or self._halves(left))[1]
            inner_right = (self.halves.get(right) or self._halves(right))[0]
            if inner_left == left and inner_right == right:
                return True
            # of equal rank the left one is merged first, so the right one is undone first
            if inner_right == right or (left > right and inner_left != left):
                undone, left = left, inner_left
            else:
                undone, right = right + 1, inner_right

    def allowed(self, last: int, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(self.bytes[token]) == [token]
        if not ok or last < 0:
            return ok
        ok = self.pairs.get((last, token))
        if ok is None:
            if len(self.pairs) >= 4 * self.limit:
                self.pairs.clear()
            ok = self.pairs[last, token] = self._stay_apart(last, token)
        return ok

    def _move(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        new: list[Hypothesis] = []
        for waiting, last, node in self.states[state]:
            after = self.child[node].get(byte)
            if after is None:
                continue
            token = self.token[after]
            if self.child[after]:
                new.append((waiting, last, after))
            if token >= 0 and self.allowed(last, token):
                new.append(((*waiting, token), token, 0))
        common = new[0][0]
        for waiting, _, _ in new[1:]:
            k = 0
            while k < len(common) and k < len(waiting) and common[k] == waiting[k]:
                k += 1
            common = common[:k]
        key = tuple(sorted((waiting[len(common) :], last, node) for waiting, last, node in new))
        number = self.numbers.get(key)
        if number is None:
            full = len(self.states) >= self.limit
            if full:
                self.forget()
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            if full:  # the state that this move starts from is forgotten
                return common, number
        self.moves[state][byte] = found = (common, number)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece.  A piece that is a token is that token, even if no merges lead to it."""
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        out: list[int] = []
        state = 0
        for byte in piece:
            emitted, state = self.moves[state].get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        (waiting,) = [w for w, _, node in self.states[state] if node == 0]
        out += waiting
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Pieces(dict):
    """Piece of text to its ids as 32-bit integers."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.transducer.limit:
            self.clear()
        self[piece] = ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        return ids


class Utf8Stream:
    """Decodes tokens one after the other; bytes of an unfinished character are the state.

    Bytes that no character can continue become U+FFFD, one for each longest valid start.
    """

    def __init__(self, token_bytes: dict[int, bytes], limit: int = 300_000) -> None:
        self.token_bytes = token_bytes
        self.limit = limit
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def bounds(lead: int) -> tuple[int, int, int]:
        """Bytes that follow a lead byte, and the range of the first of them; (-1, 0, 0) if it leads nothing."""
        if lead < 0x80:
            return 0, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 2, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 3, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return -1, 0, 0

    @classmethod
    def advance(cls, pending: bytes, data: bytes) -> tuple[str, bytes]:
        data, out, i = pending + data, [], 0
        while i < len(data):
            more, low, high = cls.bounds(data[i])
            k = 1
            while k <= more and i + k < len(data) and low <= data[i + k] <= high:
                low, high = 0x80, 0xBF
                k += 1
            if k == more + 1:
                out.append(data[i : i + k].decode())
            elif i + k == len(data) and more > 0:
                return "".join(out), data[i:]
            else:
                out.append("�")
            i += k
        return "".join(out), b""

    def step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        found = self.moves.get((pending, token))
        if found is None:
            if len(self.moves) >= self.limit:
                self.moves.clear()
            found = self.moves[pending, token] = self.advance(pending, self.token_bytes[token])
        return found

    def decode(self, tokens: array) -> str:
        out, pending, moves = [], b"", self.moves
        for token in tokens:
            found = moves.get((pending, token)) or self.step(pending, token)
            out.append(found[0])
            pending = found[1]
        return "".join(out) + "�" * bool(pending)


@lru_cache(maxsize=2)
def _tables(path: str, pattern: str) -> tuple[regex.Pattern, Pieces, Utf8Stream]:
    transducer = Transducer(read_ranks(path))
    return splitter(pattern), Pieces(transducer), Utf8Stream(transducer.bytes)


def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and, if asked for, ``decoded``, the text read back from the ids.

    A null or empty text has no tokens and decodes to an empty text.  Special tokens aren't used.  Rows that repeat give repeated results.  A very long
    text is encoded whole; the tables stay within their limits.  An empty table gives an empty result; further columns of any name are ignored.
    """
    d = input_columns(docs, doc_id=id_col, text=text_col)
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, stream = _tables(vocabulary, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids = [b"".join(map(pieces.__getitem__, split.findall(t))) if t else b"" for t in batch.column(1).to_pylist()]
                cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([stream.decode(array("I", x)) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", *["decoded"] * decode])

    return d.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary{', decoded string' * decode}")


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``decoded`` for rows of little-endian unsigned 32-bit ids; null ids decode to an empty text."""
    d = input_columns(encoded, doc_id=id_col, ids=ids_col)
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _tables(vocabulary, pattern)[2]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stream.decode(array("I", x or b"")) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return d.mapInArrow(run, f"doc_id {id_type}, decoded string")
