"""Substring removal: word sequences of ``WINDOW`` = 35 words or more that start anywhere else too.

The corpus is its own reference.  It is cut into shards, a suffix automaton is built for each shard, and
the shard's texts are streamed through it: their matching statistics give, at each word, the longest sequence ending there
that occurs twice.  Spans of ``WINDOW`` words or more go.

Sending each automaton to each document would cost shards times documents.  Instead both are dealt by minimizer:
each window of 35 words is named by the smallest hash among its ``GRAM``-word grams, so equal windows have one
name.  A region is a run of consecutive windows of one name (some 50 words).  A shard is a name's distinct regions, with the
number of their occurrences, so copies cost one row:

* a name with one occurrence has no repeated window and is dropped after a count, unless the region may repeat itself;
* a name whose regions are all equal is wholly repeated and needs no text;
* any other name's distinct regions are fetched once and go through its automaton;
* a name with over ``shard`` distinct regions is not put into one task: its windows are
  counted by 128-bit hash instead, pre-aggregated, which gives the same spans.

Every step is linear in the input; nothing is collected or broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import WORD, input_columns, materialize, texts

WINDOW = 35
GRAM = 8
KNOWN_WORDS = 400_000
#: Distinct regions that one automaton takes at most.
SHARD = 16
#: The columns that name a row.
ROW = ["row", "row_again"]
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word to 64-bit hash; forgotten when it holds ``KNOWN_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Cutter:
    """Cuts a text's windows into regions."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.power = _powers(_P, n)
        self.inverse = _powers(pow(_P, -1, 1 << 64), n)

    def regions(self, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """First window, number of windows, name, content hash, and whether it may repeat itself, for each region; None for under ``WINDOW`` words."""
        n = len(words)
        if n < WINDOW:
            return None
        if n >= len(self.power):
            self.grow(2 * n)
        w = np.array(list(map(self.hashes.__getitem__, words)), dtype=np.uint64)
        grams = np.zeros(n - GRAM + 1, dtype=np.uint64)
        for j in range(GRAM):
            grams = grams * np.uint64(_P) + w[j : n - GRAM + 1 + j]
        grams = low = _mixed(grams)
        span, wide = 1, WINDOW - GRAM + 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        turns = np.flatnonzero(low[1:] != low[:-1]) + 1
        start = np.concatenate(([0], turns))
        stop = np.concatenate((turns, [len(low)]))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w * self.power[:n], dtype=np.uint64, out=sums[1:])
        content = (sums[stop + WINDOW - 1] - sums[start]) * self.inverse[start]
        content = _mixed(content + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        itself = np.zeros(len(start), dtype=bool)
        if len(np.unique(grams)) < len(grams):  # a region that holds a window twice holds its name's gram twice
            for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist())):
                itself[k] = np.count_nonzero(grams[a : b + wide - 1] == low[a]) > 1
        return start.astype(np.int32), (stop - start).astype(np.int32), low[start].view(np.int64), content.view(np.int64), itself


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = Cutter()
    names = [*ROW, "start", "windows", "name", "content", "itself"]
    empty = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, bool)]
    for batch in batches:
        parts = [empty]
        for row, again, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)):
            found = cutter.regions(data.split()) if data else None
            if found:
                parts.append([np.full(len(found[0]), row, dtype=np.int64), np.full(len(found[0]), again, dtype=np.int64), *found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with how often each state's sequences occur."""

    def __init__(self, sequences: Iterable[tuple[list, int]]) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = list(sequences)
        for words, _ in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.times = [0] * len(self.step)
        for words, times in sequences:
            state = 0
            for word in words:
                state = self.step[state][word]
                self.times[state] += times
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[state]] += self.times[state]

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, source: int, word, target: int) -> int:
        """The state for the shorter sequences of ``target`` that come from ``source`` over ``word``."""
        if self.length[target] == self.length[source] + 1:
            return target
        twin = self._state(self.length[source] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = twin
        while source != -1 and self.step[source].get(word) == target:
            self.step[source][word] = twin
            source = self.link[source]
        return twin

    def _extend(self, last: int, word) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        while last != -1 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._split(last, word, self.step[last][word])
        return new

    def repeated(self, words: list) -> list[int]:
        """Matching statistics of a sequence that is in the automaton: at each word, the longest sequence ending there that occurs twice."""
        out, state = [], 0
        for at, word in enumerate(words, 1):
            state = self.step[state][word]
            found, long = state, at
            while found and self.times[found] < 2:
                found = self.link[found]
                long = self.length[found]
            out.append(long if found else 0)
        return out


def maximal_spans(lengths: list[int], least: int = WINDOW) -> list[tuple[int, int]]:
    """Union of the spans of ``least`` words or more, as word positions."""
    spans: list[list[int]] = []
    for at, long in enumerate(lengths, 1):
        if long >= least:
            if spans and at - long <= spans[-1][1]:
                spans[-1] = [min(spans[-1][0], at - long), at]
            else:
                spans.append([at - long, at])
    return [tuple(s) for s in spans]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, content, times, words), a name's rows together: the repeated spans of each region."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    done: list[tuple] = []

    def packed() -> pa.RecordBatch:
        cols = list(zip(*done)) or [()] * 4
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["name", "content", "first", "last"])

    for name, shard in groupby(rows(), key=lambda r: r[0]):
        regions = {content: (words.split(b" "), times) for _, content, times, words in shard}
        automaton = SuffixAutomaton(regions.values())
        for content, (words, _) in regions.items():
            done += [(name, content, a, b) for a, b in maximal_spans(automaton.repeated(words))]
        if len(done) > 5000:
            yield packed()
    yield packed()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (packed text, wanted regions): one row for each region with its words."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = unpack.decompress(data).split()
            out += [(w["name"], w["content"], w["times"], w["regions"], b" ".join(words[w["start"] : w["start"] + w["windows"] + WINDOW - 1])) for w in wanted]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["name", "content", "times", "regions", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for name, content, times, words in zip(*(c.to_pylist() for c in batch.columns)):
            split = words.split(b" ")
            for at in range(len(split) - WINDOW + 1):
                key = hashlib.blake2b(b" ".join(split[at : at + WINDOW]), digest_size=16).digest()
                out.append((name, content, times, at, key))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary())], names=["name", "content", "times", "first", "key"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the text before it is shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack.compress(x or b"") for x in texts(batch)], pa.binary())], names=[*ROW, "packed"])


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The two columns ``ROW``: a name of 128 bits by id and text; rows that agree in both have one result, so they may share a name."""
    return [F.xxhash64(F.lit(name), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias(name) for name in ROW]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(row, row_again, spans): for each row (``row_key``) with repeated windows, the word spans [first, last) to remove."""
    source = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    regions = materialize(source.mapInArrow(_cut, "row long, row_again long, start int, windows int, name long, content long, itself boolean"), "regions")
    counted = regions.groupBy("name").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.max("itself").alias("itself"))
    # sides of later joins are written first: each then has a shuffle of its own, and a name or region with many copies can be split there
    repeated = materialize(counted.where("n > 1 or itself").select("name", F.expr("low <> high or itself").alias("mixed")), "names")
    found = materialize(regions.drop("itself").join(repeated, "name"), "repeated")

    distinct = found.where("mixed").groupBy("name", "content").agg(F.count("*").alias("times"), F.min(F.struct(*ROW, "start", "windows")).alias("at"))
    distinct = materialize(distinct, "distinct")
    sizes = distinct.groupBy("name").agg(F.count("*").alias("regions"))
    wanted = distinct.join(sizes, "name").select("at.row", "at.row_again", F.struct("name", "content", "times", "regions", "at.start", "at.windows").alias("want")).groupBy(*ROW).agg(F.collect_list("want").alias("wanted"))
    # rows that agree in id and text share a key: their regions are read from each, and taken once below
    packed = source.mapInArrow(_pack, "row long, row_again long, packed binary")
    content = materialize(packed.join(wanted, ROW).select("packed", "wanted").mapInArrow(_fetch, "name long, content long, times long, regions long, words binary"), "content")

    small = content.where(F.col("regions") <= shard).select("name", "content", "times", "words").repartition("name").sortWithinPartitions("name")
    spans = small.mapInArrow(_solve, "name long, content long, first int, last int")
    crowd = content.where(F.col("regions") > shard).select("name", "content", "times", "words").dropDuplicates(["name", "content"]).mapInArrow(_windows, "name long, content long, times long, first int, key binary")
    twice = materialize(crowd.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"), "windows")
    spans = spans.unionByName(crowd.join(twice, "key").select("name", "content", "first", (F.col("first") + WINDOW).alias("last")))
    by_region = materialize(spans.groupBy("name", "content").agg(F.collect_set(F.struct("first", "last")).alias("parts")), "spans")

    whole = found.where("not mixed").select(*ROW, F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("last"))).alias("parts"))
    partly = found.where("mixed").join(by_region, ["name", "content"]).select(*ROW, F.expr("transform(parts, p -> struct(p.first + start as first, p.last + start as last))").alias("parts"))
    return whole.unionByName(partly).select(*ROW, F.explode("parts").alias("span")).groupBy(*ROW).agg(F.collect_set("span").alias("spans"))


def _gone(spans: list[dict] | None) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return [tuple(m) for m in merged]


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, ``removed`` (word spans) and ``kept`` (kept words, joined by one space).

    A null text has no words and ``kept`` is empty.  Rows that repeat are occurrences of their own: all lose their windows.
    A text under 35 words loses nothing.  Very long texts are cut whole, in memory of their own length.  An empty table gives an empty result; further columns of any name are ignored.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, shard=shard)
    d = input_columns(docs, doc_id=id_col, text=text_col)
    d = d.select("doc_id", *row_key("doc_id", "text"), "text")
    id_type = d.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([packer.compress(x or b"") for x in texts(batch)], pa.binary())], names=["doc_id", *ROW, "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            counts, removed, gone_all, kept = [], [], [], []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = unpack.decompress(data).split()
                counts.append(len(words))
                gone = _gone(spans)
                for a, b in reversed(gone):
                    del words[a:b]
                removed.append(sum(b - a for a, b in gone))
                gone_all.append([{"first": a, "last": b} for a, b in gone])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone_all, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    joined = d.mapInArrow(pack, f"doc_id {id_type}, row long, row_again long, packed binary").join(spans, ROW, "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, removed array<struct<first int, last int>>, kept string")


def cut_text(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of ``gone`` and the white space after them; the rest stays as it is."""
    data = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(data)]
    out, end = [], 0
    for a, b in gone:
        out.append(data[end : at[a][0]])
        end = at[b][0] if b < len(at) else len(data)
    return b"".join([*out, data[end:]]).decode()


def strip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, shard: int = SHARD) -> DataFrame:
    """``docs`` with the repeated spans cut from their texts and ``chars_col`` (if given) set to the new length; no row goes.

    Null texts stay null, texts under 35 words stay as they are, rows that repeat all lose their windows.  An empty table stays empty, and columns of any name are kept.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, shard=shard)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(id_col, text_col))
    joined = held.join(spans, ROW, "left").select("doc", "spans")
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            kinds, columns = [doc.type.field(k) for k in range(doc.type.num_fields)], doc.flatten()
            new = [cut_text(t, _gone(s)) if s else t for t, s in zip(columns[at].to_pylist(), batch.column(1).to_pylist())]
            columns[at] = pa.array(new, kinds[at].type)
            if length_at is not None:
                columns[length_at] = pa.array([None if t is None else len(t) for t in new], kinds[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=[k.name for k in kinds])

    return joined.mapInArrow(run, docs.schema)
