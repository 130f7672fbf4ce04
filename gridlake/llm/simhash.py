"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes one bit from each bit position of its shingles' XXH64 values, by majority.  Fingerprints
are split into two 32-bit segments.  Two fingerprints that differ in at most ``RADIUS`` = 2 bits differ in at most
one bit in some segment, so each fingerprint looks up, in each segment's table, its own segment and those one
bit away; complete distances are then verified.

Only distinct fingerprints are compared, so copies cost one row.  A table bucket with over ``bucket`` fingerprints is
left out of the lookups; instead its members look up every fingerprint within two bits, 2,081 keys each, which is exact and linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import input_columns, materialize, shuffled, texts
from gridlake.llm.graph import components

RADIUS = 2
SHINGLE = 3


def shingle_values(data: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 value of each shingle in order; none for a text without words, or null."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")


def majority(values: np.ndarray) -> np.uint64:
    ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0]


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash; 0 for a text without words, or null."""
    values = shingle_values(data, width)
    return int(majority(values)) if len(values) else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, body): ``fp`` as a signed 64-bit integer, ``body`` a hash of the text that tells rows with one id apart."""
    d = input_columns(docs, doc_id=id_col, text=text_col).withColumn("body", F.xxhash64("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], names=["doc_id", "fp", "body"])

    return d.mapInArrow(run, f"doc_id {id_type}, fp long, body long")


#: First bit and width of the pieces of a 32-bit segment.
PIECES = ((0, 11), (11, 11), (22, 10))


def _keyed(segments: DataFrame) -> DataFrame:
    """A row of (fp, seg, part, other) for each piece of the other segment."""
    pieces = ", ".join(f"{k}, shiftright(other, {first}) & {(1 << width) - 1}L" for k, (first, width) in enumerate(PIECES))
    return segments.select("*", F.expr(f"stack({len(PIECES)}, {pieces}) as (nth, piece)")).drop("other")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints at ``RADIUS`` or fewer differing bits, from a table of distinct ``fp``; a pair may come more than once."""
    high, low = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
    table = _keyed(fps.select("fp", F.expr(f"stack(2, 0, {high}, {low}, 1, {low}, {high}) as (seg, part, other)")))
    # a bit that is 0 here and 1 there is flipped here only, so each pair is met once in a segment and piece
    masks = F.expr("filter(transform(sequence(0, 32), i -> if(i = 32, 0L, shiftleft(1L, i))), m -> (part & m) = 0L)")
    probes = table.withColumn("mask", F.explode(masks)).select("seg", F.col("fp").alias("a"), F.expr("part | mask").alias("part"), "nth", "piece", (F.col("mask") == 0).alias("same"))
    pairs = probes.join(shuffled(table.withColumnRenamed("fp", "b")), ["seg", "part", "nth", "piece"])
    return pairs.where(f"bit_count(a ^ b) <= {RADIUS} and a <> b and (not same or a < b)").select("a", "b")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable), ``body``, ``root``.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows that repeat give repeated rows.  A null id
    never is the smallest; a component of null ids only has a null id.  ``root`` tells components apart.  ``more``: further pairs (a, b) of fingerprints to link.
    Very long texts are fingerprinted whole.  An empty table gives an empty result; further columns of any name are ignored.
    """
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    smallest = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = links(smallest.select("fp"))
    roots = components(linked if more is None else linked.unionByName(more))
    found = smallest.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(shuffled(by_root), "root").select("fp", "root", "component_id")
    return marked.join(shuffled(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "body", "root")


def thin(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and among rows of one id that of the smallest text hash.

    Null and empty texts are one component.  Rows that repeat in id and text leave one.  An empty table stays empty, and columns of any name are kept.
    """
    marked = materialize(group(docs, id_col=id_col, text_col=text_col, more=more).select("doc_id", "body", "root"), "grouped")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    chosen = marked.groupBy("root").agg(F.min(first).alias("at")).select(F.col("at.doc_id").alias("id"), F.col("at.body").alias("body"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("doc_body"))
    match = F.expr("doc_id <=> id and doc_body = body")
    kept = held.join(shuffled(chosen), match, "left_semi")
    # rows that agree in id and text fall into one component; only then can a component keep more than one row
    twice = marked.groupBy("doc_id", "body").count().where("count > 1").select(F.col("doc_id").alias("id"), "body")
    if not twice.isEmpty():
        again = kept.join(shuffled(twice), match, "left_semi").groupBy("doc_id", "doc_body").agg(F.first("doc").alias("doc"))
        kept = kept.join(shuffled(twice), match, "left_anti").select("doc").unionByName(again.select("doc"))
    return kept.select("doc.*")
