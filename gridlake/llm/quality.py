"""Quality rules: base rules on counts of words and lines, then a hashed n-gram log-likelihood ratio.

Every document's byte 4-grams are hashed into ``BUCKETS`` bins.  Two multinomials are fitted over these bins: one
to the raw corpus (all documents) and one to a trusted target (documents labelled good).  A document's score is
the sum of log(trusted / raw) over its n-grams divided by their number.  Documents under a fixed threshold go.

Bounds: the model is 2 x ``BUCKETS`` counts whatever the input.  The raw counts cover every document, the trusted ones every document labelled good; these
meet their labels by a shuffle, for which a bitmap of ``BITS`` bits spares most other texts.  The threshold is the exact quantile of all trusted scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import input_columns, materialize, shuffled, texts, windows_of_bytes

BUCKETS = 1 << 16
#: Bits of the map of labelled ids, in blocks of Spark's bitmaps.
BITS = 1 << 22
BLOCK = 1 << 15
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def base_rules(data: bytes | None) -> tuple[int, int, int, int, int, bool]:
    """Counts of one text and whether it fails the base rules.  A null text has no words and fails."""
    data = data or b""
    words = data.split()
    bare = data.translate(None, SPACES)
    word_chars = len(bare.decode("utf-8", "replace"))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    repeat = _repeated_words(words)
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeat, len(words) < 20 or 100 * repeat > 30 * len(words))


def _repeated_words(words: list[bytes]) -> int:
    """Words inside some window of ``WINDOW`` words whose sequence occurs twice or more in this text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype="<u4").tobytes()
    width = 4 * WINDOW
    first: dict[bytes, int] = {}
    cover = None
    for i in range(n):
        at = first.setdefault(codes[4 * i : 4 * i + width], i)
        if at != i:
            if cover is None:
                cover = np.zeros(len(words) + 1, dtype=np.int64)
            for j in (at, i):
                cover[j] += 1
                cover[j + WINDOW] -= 1
    return 0 if cover is None else int((np.cumsum(cover) > 0).sum())


def buckets(data: bytes | None) -> np.ndarray:
    """Hash bin of each byte 4-gram."""
    grams = windows_of_bytes(data or b"", 4)
    return ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Log ratios by bin and the threshold under which a document goes."""

    ratios: np.ndarray
    threshold: float

    def score(self, data: bytes | None) -> float:
        """Length-normalised ratio; 0 for a text with no 4-gram."""
        bins = buckets(data)
        return float(self.ratios[bins].sum() / len(bins)) if len(bins) else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        waiting: list[np.ndarray] = []
        size = 0
        for data in texts(batch):
            waiting.append(buckets(data))
            size += len(waiting[-1])
            if size > 1 << 21:
                counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                waiting, size = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["bin", "n"])


def _counted(docs: DataFrame) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for row in docs.select("text").mapInArrow(_count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[row.bin] = row.n
    return counts


def _labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of those rows of ``docs`` (id, text) whose id is in ``ids``."""
    ids = ids.select(F.col("id").cast(docs.schema["id"].dataType).alias("id"))
    bit = F.pmod(F.xxhash64("id"), F.lit(BITS)) + 1
    blocks = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    held = np.zeros((BITS // BLOCK, BLOCK // 8), dtype=np.uint8)
    for row in blocks.collect():  # at most BITS / BLOCK rows
        held[row.block - 1] = np.frombuffer(row.bits, dtype=np.uint8)
    held = held.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1, pa.bool_())).select([0, 1])

    some = docs.where("id is not null").select("id", "text", bit.alias("bit")).mapInArrow(run, docs.schema)
    return some.join(shuffled(ids), "id", "left_semi").select("text")


def _ranked(keys: DataFrame, rank: int) -> int:
    """The ``rank``-th smallest ``key`` (a long, from 1), by 16 bits a round."""
    for shift in (48, 32, 16, 0):
        found = sorted(tuple(r) for r in keys.groupBy(F.shiftright("key", shift).alias("top")).count().collect())  # at most 65,536 rows
        for top, n in found:
            if rank <= n:
                break
            rank -= n
        keys = keys.where(F.shiftright("key", shift) == top)
    return top


def _key(scores: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order; also turns them back."""
    bits = scores.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", reject: float = 0.001, margin: float = 0.1) -> Model:
    """Fit both multinomials and the threshold, on all documents and all labels.

    The threshold is the ``reject`` quantile of the trusted rows' scores less ``margin`` nats a gram.  Rows of ``labels`` with a null id or a quality other than 0 or 1 are
    not used; an id that is labelled both ways counts as untrusted.  Without trusted rows all ratios are 0 and
    no document is rejected by score.
    """
    d = input_columns(docs, id=id_col, text=text_col)
    rated = input_columns(labels, id=id_col, quality=quality_col).where("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    good = materialize(_labelled(d, rated.where("quality = 1")), "trusted")
    trusted = _counted(good)
    if not trusted.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    raw = _counted(d)
    ratios = np.log((trusted + 0.5) / (trusted.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    model = Model(ratios, -np.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(np.array([model.score(x) for x in texts(batch)], dtype=float) + 0.0), pa.int64())], names=["key"])

    keys = materialize(good.mapInArrow(score, "key long"), "scores")
    least = _ranked(keys, max(1, int(np.ceil(reject * keys.count()))))
    return Model(ratios, float(_key(np.array([least], dtype=np.int64).view(float)).view(float)[0]) - margin)


def _judge(model: Model, batch: pa.RecordBatch, text: str) -> list[tuple]:
    out = []
    for data in texts(batch, text):
        base, score = base_rules(data), model.score(data)
        out.append((*base, score, not base[-1] and score >= model.threshold))
    return out


def rate(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base counts, ``base_failed``, ``llr`` and ``kept``.

    A null or empty text has zero counts, fails the base rules and isn't kept.  Repeated rows are rated alike, very long texts whole.  An empty
    table gives an empty result; further columns of any name are ignored.
    """
    d = input_columns(docs, **{"doc_id": id_col, "text": text_col})
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _judge(model, batch, "text")
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    return d.mapInArrow(run, f"doc_id {id_type}, {FEATURES}, llr double, kept boolean")


def keep(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, of any name; no shuffle.

    Null and empty texts go, as they fail the base rules; rows that repeat stay or go alike; very long texts are judged whole.  An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([r[-1] for r in _judge(model, batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
