"""Best-fit packing by patterns and non-negative least squares.

Texts become token ids; texts over ``capacity`` tokens are cut into pieces.  The histogram of piece lengths (at most
``capacity`` numbers) is all that comes to the driver.  There, patterns of one to four documents that fill a sequence
are enumerated over length classes and their repeat counts are fitted to the histogram by non-negative least squares and rounded.
A pattern is refined to exact lengths before it is used, so that its sequences are full to the last token; what finds no exact
partners is packed best-fit, longest first.  The plan says how many sequences hold which lengths; its size depends on
``capacity``, not on the number of documents.

Each piece has a number among the pieces of its length (number within its partition plus the count in earlier
partitions, which meet it by a shuffle), and the plan maps length and number to a sequence and an offset.  No length is ever
sorted or gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridlake.llm.common import input_columns, materialize, texts

CAPACITY = 2048
CLASSES = 128
MOST = 4
#: Bytes that a worker's word table may take, by an estimate of what a word and its ids need beside their own bytes.
KNOWN_BYTES = 64 << 20
PER_WORD = 200
#: Text is cut into words by the megabyte, so a long text never is one list of words.
SLICE = 1 << 20
ROWS_AT_ONCE = 512
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Symbols that end a word and never join the letter or digit before them.
_TAIL = b"!#$%&()*+,./:;<=>?@[]_{|}~-"
#: Lower-case letters of ASCII and Latin-1.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level models write a byte as its Latin-1 character, and those without a visible one as U+0100 and so on in order.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTE_CHARS = {b: 0x100 + k for k, b in enumerate(_HIDDEN)}


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while len(data) - at > size:
        space = _SPACE.search(data, at + size)
        if not space:
            break
        yield data[at : space.start()]
        at = space.end()
    yield data[at:] if at else data


class WordIds(dict):
    """Ids of texts as 32-bit integers, by a table from word (a run of anything but ASCII space) to ids, emptied when it takes ``KNOWN_BYTES``.

    The tokenizer (byte-level BPE over words) lower-cases, drops white space and never joins across it, nor a letter with a symbol, so a text's ids are those of its
    words.  A word goes to the tokenizer's model as it is where normalising and splitting would leave it so.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.size = 0

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            ids = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        elif _PLAIN.fullmatch(word):
            ids = array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        elif at := _stem(word):
            ids = self[word[:at]] + self[word[at:]]
        else:
            ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self.size += len(word) + len(ids) + PER_WORD
        if self.size > KNOWN_BYTES:
            self.clear()
            self.size = 0
        self[word] = ids
        return ids

    def encode(self, data: bytes | None) -> bytes:
        # a combining mark may join a lower-case letter where it doesn't join the capital
        return b"".join(ids for part in slices(data or b"") for ids in map(self.__getitem__, (part if b"\xcc" in part else part.lower()).split()))


def _stem(word: bytes) -> int:
    """Where the symbols at a word's end start, if the word can be split there; else 0.

    Before them must be a letter or digit that stays one in lower case: ASCII, or two bytes up to U+024F but U+0130.
    """
    at = len(word.rstrip(_TAIL))
    last = word[max(at - 2, 0) : at]
    if at == len(word) or not at:
        return 0
    return at if last[-1:].isalnum() or (len(last) == 2 and 0xC3 <= last[0] <= 0xC9 and last != b"\xc4\xb0" and last.decode().isalpha()) else 0


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, ``part`` and ``nth`` (number among the part's pieces of this length), and ``ids`` if asked for.

    Ids end with one 0.  A null or empty text is that 0 alone.  Rows that repeat are packed each for itself.  A very long text is tokenized slice by
    slice and gives as many pieces as it needs.  An empty table gives an empty result; further columns of any name are ignored.
    """
    d = input_columns(docs, doc_id=id_col, text=text_col)
    id_type = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = word_ids(tokenizer), Counter(), TaskContext.get().partitionId()
        for whole in batches:
            for first in range(0, max(whole.num_rows, 1), ROWS_AT_ONCE):
                batch, rows, index = whole.slice(first, ROWS_AT_ONCE), [], []
                for k, data in enumerate(texts(batch)):
                    ids = words.encode(data) + bytes(4)
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((piece, at // 4, length, zlib.crc32(cut), part, seen[length], *[np.frombuffer(cut, "<i4")] * with_ids))
                        seen[length] += 1
                        index.append(k)
                cols = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=names)

    return d.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long{', ids array<int>' * with_ids}")


def patterns(classes: int, width: int, most: int = MOST) -> list[tuple[int, ...]]:
    """Class patterns of 1 to ``most`` documents, shortest class first.

    A length is on average ``(width - 1) / 2`` below its class's upper end; so much more the classes of documents that fill a sequence add up to.
    """
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, slots: int) -> None:
        if slots == 1:
            if left <= classes:
                found.append((*head, left))
            return
        for x in range(head[-1] if head else 1, left // slots + 1):
            grow((*head, x), left - x, slots - 1)

    for k in range(1, most + 1):
        grow((), classes + round(k * (width - 1) / (2 * width)), k)
    return found


def nnls(found: list[tuple[int, ...]], b: np.ndarray) -> np.ndarray:
    """Non-negative least squares of repeat counts against class counts ``b`` by an active set: the pattern that helps most enters, those that turn negative leave."""
    none, most = len(b), max(map(len, found))
    slots = np.array([(*(c - 1 for c in p), *[none] * (most - len(p))) for p in found]).T
    x, used = np.zeros(len(found)), []
    scale = max(1.0, float(np.abs(b).max()))

    def columns() -> np.ndarray:
        a = np.zeros((none + 1, len(used)))
        for row in slots:
            np.add.at(a, (row[used], np.arange(len(used))), 1.0)
        return a[:none]

    for _ in range(8 * none):
        residual = np.append(b - columns() @ x[used] if used else b, 0.0)
        gain = residual[slots].sum(axis=0)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-6 * scale:
            break
        used.append(best)
        while used:
            a = columns()
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(used)), a.T @ b)
            if (z > 0).all():
                break
            old, low = x[used], z <= 0
            x[used] = old + np.min(old[low] / np.maximum(old[low] - z[low], 1e-300)) * (z - old)
            keep = [k for k in used if x[k] > 1e-9 * scale]
            if len(keep) == len(used):
                keep.remove(min(keep, key=lambda k: x[k]))
            x[[k for k in used if k not in keep]] = 0
            used = keep
        x[used] = z if used else 0
    return x


@dataclass
class Plan:
    """Arrays over (length, first number): the sequence of that first number, and the offset there.  ``sequences`` in all, ``by_patterns`` of them from fitted patterns."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    by_patterns: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | number, side="right") - 1
        return self.sequence[at] + number - (self.key[at] & ((1 << 48) - 1)), self.offset[at]


Groups = list[tuple[tuple[int, ...], int]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack the histogram (length to count).  Runs on the driver; time and size are bounded by ``capacity``."""
    width = -(-capacity // CLASSES)
    classes = -(-capacity // width)
    left = np.zeros(classes * width + 1, dtype=np.int64)
    for n, c in histogram.items():
        left[n] = c
    found = patterns(classes, width)
    repeats = np.rint(nnls(found, left[1:].reshape(classes, width).sum(axis=1).astype(float))).astype(np.int64)
    # few documents first: they have the fewest ways to be full
    best = [group for k in sorted(np.flatnonzero(repeats), key=lambda k: (len(found[k]), -repeats[k])) for group in _refine(left, found[k], int(repeats[k]), width, capacity)]
    by_patterns = sum(n for _, n in best)
    best += _best_fit(left, capacity)

    keys, sequences, offsets, base = [], [], [], 0
    number: Counter = Counter()
    for lengths, n in best:
        offset = 0
        for length in lengths:
            keys.append((length << 48) | number[length])
            sequences.append(base)
            offsets.append(offset)
            number[length] += n
            offset += length
        base += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return Plan(np.array(keys, dtype=np.int64)[order], np.array(sequences, dtype=np.int64)[order], np.array(offsets, dtype=np.int64)[order], base, by_patterns)


def _refine(left: np.ndarray, pattern: tuple[int, ...], n: int, width: int, capacity: int) -> Groups:
    """Up to ``n`` sequences of a class pattern with exact lengths that add up to ``capacity``, taken from ``left`` (counts by length).

    Of four documents the longest has the length of its class of which most are left.  Of the next two, all pairs of lengths of their classes are tried;
    the last has the length that fills the sequence.  The choice with the largest supply is used while it lasts, then the next.
    """
    *long, _ = pattern[::-1]
    first, free = long[:-2], long[-2:]
    groups: Groups = []
    while n > 0:
        head = [(c - 1) * width + 1 + int(np.argmax(left[(c - 1) * width + 1 : c * width + 1])) for c in first]
        total, supply = np.array([sum(head)]), np.array([n])
        for c in free:
            span = np.arange((c - 1) * width + 1, c * width + 1)
            total, supply = np.add.outer(total, span).ravel(), np.minimum.outer(supply, left[span]).ravel()
        last = capacity - total
        fits = (last >= 1) & (last < len(left))
        supply = np.where(fits, np.minimum(supply, left[np.where(fits, last, 0)]), 0)
        while supply[at := int(np.argmax(supply))]:
            lengths = [*head, *((c - 1) * width + 1 + int(i) for c, i in zip(free, np.unravel_index(at, [width] * len(free)))), int(last[at])]
            count = min(n, *(int(left[x]) // times for x, times in Counter(lengths).items()))
            if count:
                break
            supply[at] = 0  # one length is wanted twice and there is one
        else:
            break
        for x in lengths:
            left[x] -= count
        groups.append((tuple(lengths), count))
        n -= count
    return groups


def _best_fit(left: np.ndarray, capacity: int) -> Groups:
    """Sequences as (lengths, number of such sequences) for the counts by length in ``left``: longest first, each into the smallest gap that takes it."""
    gaps: dict[int, Groups] = defaultdict(list)
    room = np.zeros(capacity + 1, dtype=bool)

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        gaps[gap].append((lengths, n))
        room[gap] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = length + int(np.argmax(room[length:]))
            if not room[gap]:
                each = min(capacity // length, n)
                put((length,) * each, n // each)
                n %= each
                continue
            lengths, c = gaps[gap].pop()
            room[gap] = bool(gaps[gap])
            step = min(n, c)
            if step < c:
                put(lengths, c - step)
            put((*lengths, length), step)
            n -= step

    return [group for gap in sorted(gaps) for group in gaps[gap]]


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` with ``sequence_id`` and ``offset``: every piece once, sequences gapless from 0 and at most ``capacity`` long.

    Null and empty texts are pieces of one token.  An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer=tokenizer, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    per_part = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    found = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    joined = cut.join(offsets.hint("merge"), ["part", "length"])  # as many rows as parts times lengths: never broadcast
    head = [c for c in cut.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = found.place(np.asarray(batch.column("length")), np.asarray(batch.column("number")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in head), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*head, "sequence_id", "offset"])

    shape = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in head)
    return joined.select(*head, (F.col("nth") + F.col("earlier")).alias("number")).mapInArrow(run, f"{shape}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack(..., with_ids=True)``: sequence_id, ids, and where each document starts.  A group has at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("flatten(transform(parts, p -> p.ids))").alias("ids"), F.expr("transform(parts, p -> p.offset)").alias("starts"), F.expr("transform(parts, p -> p.doc_id)").alias("doc_ids"))
