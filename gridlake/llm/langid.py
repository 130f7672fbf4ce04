"""Language identification by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent n-grams (1 to 3 letters, words padded by a space), by rank.  A document's
own most frequent n-grams are ranked the same way; its distance to a language is the sum over them of how far
each is out of place, ``PROFILE`` for one that isn't in the profile.  The nearest language wins.

N-grams are numbers: three code points of 21 bits.  Texts are turned into arrays of them and counted by sorting, so no table of words or n-grams
grows.  Profiles count all n-grams of all documents to learn from, and hold languages x ``PROFILE`` of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import input_columns

PROFILE = 400
UNKNOWN = "und"
#: N-grams that are counted together while learning.
TOGETHER = 1 << 20
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text, repeats included, as numbers: within lower-cased words, padded by one space on either side.

    A number of one code point, two or three can't be mistaken for another length, as the first is never 0.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    is_letter = letters()[points]
    after = np.concatenate(([False], is_letter[:-1]))
    kept = np.where(is_letter, points, SPACE)[is_letter | after]  # a run of other characters is one space
    if not len(kept) or not is_letter.any():
        return np.empty(0, dtype=np.int64)
    s = np.concatenate(([SPACE], kept, np.full(int(is_letter[-1]), SPACE)))
    pairs = (s[:-1] << 21) | s[1:]
    triples = (pairs[:-1] << 21) | s[2:]
    return np.concatenate((s[s != SPACE], pairs, triples[s[1:-1] != SPACE]))


def spelt(gram: int) -> str:
    return "".join(chr(x) for x in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if x)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[np.ndarray]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def counted(lang: str) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        del sizes[lang]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = grams(text)
            waiting[lang].append(found)
            sizes[lang] += len(found)
            if sum(sizes.values()) > TOGETHER:  # however many languages there are
                yield counted(max(sizes, key=sizes.__getitem__))
    for lang in list(waiting):
        yield counted(lang)


def profiles(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): each language's ``size`` most frequent n-grams, place from 0, ties by number.  Rows with a null text or language teach nothing."""
    d = input_columns(docs, lang=lang_col, text=text_col).where("text is not null and lang is not null")
    counted = d.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < size).select("lang", "gram", "place")


class Ranker:
    """Distances of texts to each language."""

    def __init__(self, places: dict[str, dict[int, int]], size: int = PROFILE) -> None:
        self.languages = sorted(places)
        self.size = size
        self.known = np.array(sorted({g for p in places.values() for g in p}), dtype=np.int64)
        # the last column is for an n-gram that is in no profile
        self.places = np.full((len(self.languages), len(self.known) + 1), -1, dtype=np.int64)
        for k, lang in enumerate(self.languages):
            own = np.array(list(places[lang]), dtype=np.int64)
            self.places[k, np.searchsorted(self.known, own)] = list(places[lang].values())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and 1 less its distance as a share of the largest there is; equal distances go to the first language by name."""
        found = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        own, n = np.unique(found, return_counts=True)
        own = own[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        places = self.places[:, at]
        far = np.where(places < 0, self.size, np.abs(places - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best] / (self.size * len(own)))


def identify(docs: DataFrame, learned: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``lang_pred``, ``score`` (0 to 1).  ``und`` and 0 for a null text, one without letters, or without profiles.

    Rows that repeat give repeated results, very long texts count whole, an empty table gives an empty result, and further columns are ignored.
    ``learned`` is the result of ``profiles``; it comes to the driver, languages x ``size`` rows.
    """
    d = input_columns(docs, doc_id=id_col, text=text_col)
    id_type = d.schema["doc_id"].dataType.simpleString()
    places: dict[str, dict[int, int]] = defaultdict(dict)
    for row in learned.collect():
        places[row.lang][row.gram] = row.place
    ranker = Ranker(dict(places), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranker.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return d.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def held_out(id_col: str) -> Column:
    """A fixed quarter of the ids, by checksum; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_and_identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out (and have an id), predict all: doc_id, ``held_out``, ``lang_pred``, ``score``."""
    learned = profiles(docs.where(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull()), lang_col=lang_col, text_col=text_col)
    return identify(docs, learned, id_col=id_col, text_col=text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
