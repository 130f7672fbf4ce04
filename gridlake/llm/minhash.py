"""Near copies by prefixes of ordered sets, verified by the exact Jaccard similarity of sets of 5-word shingles.

Shingles have one order for all texts: rare ones first, by counts of all shingles in ``BINS`` bins.  Two sets at similarity ``least`` or more
share a shingle among the first n - ceil(least * n) + 1 of either (n: its size), so no pair is left to chance.  Whatever the counts are, any order is right; rare
first keeps common passages out of the prefixes, as long as their counts stand out from what else falls into their bins.

Before exact sets are compared, parities bound the similarity: each set has about a bit for each shingle, turned by the shingles that fall there, and where two sets'
bits differ a shingle is in one of them only.  So most pairs that share a passage but aren't near are left without carrying their sets, and no near pair is.

Texts with equal shingle sets cost one row.  Of the sets that share a prefix shingle, in an order of its own by hash, each is first compared with the
``REACH`` before it: all pairs of up to ``REACH`` + 1 sets.  Where more share it, the sets outside their largest component are then compared with all of other
components, by parities in blocks of about ``BLOCK`` sets, so no link between components is left out.  A pair costs a row only if the bound lets it pass.  The
comparisons of bits, not the rows, still grow with the sets outside times the sets that share the shingle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import input_columns, materialize, shuffled, texts
from gridlake.llm.graph import components
from gridlake.llm.simhash import SHINGLE, majority, shingle_values

#: Bins, and those of a page, in which tasks hand them on.
BINS, SPAN = 1 << 24, 1 << 16
REACH = 6
BLOCK = 512
LEAST = 0.8
#: Bits of the filter of texts whose sets are asked for: a multiple of ``PAGE``, the bits of one of Spark's bitmaps.
FILTER, PAGE = 1 << 25, 1 << 15


def shingles(data: bytes, values: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text's 5-word shingles, sorted; ``values`` are those of its 3-word shingles.

    Five words are the three they begin with and the three they end with.  A text of under five words is one shingle.
    """
    if len(values) < 3:
        return np.array([xxhash.xxh64_intdigest(b" ".join(data.lower().split()), 5)], dtype=np.uint64)
    first, last = values[:-2], values[2:]
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + (last ^ (last >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, data in zip(batch.column(0).to_pylist(), texts(batch)):
            values = shingle_values(data, SHINGLE)
            rows.append((body, majority(values).view(np.int64), shingles(data, values).view(np.int64)))
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.list_(pa.int64()))], names=["body", "fp", "found"])


def _at(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(65 - BINS.bit_length())).astype(np.int64)


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BINS, dtype=np.int32)
    for batch in batches:
        for data in texts(batch):
            values = shingle_values(data, SHINGLE)
            if len(values):
                np.add.at(counts, _at(shingles(data, values)), 1)
    for page, held in enumerate(counts.reshape(-1, SPAN)):
        if most := int(held.max()):
            packed = zlib.compress(held.astype(np.min_scalar_type(most)).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([packed], pa.binary())], names=["page", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of whole pages, on a scale of 16 steps for each doubling."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, packed in zip(*(c.to_pylist() for c in batch.columns)):
            raw = zlib.decompress(packed)
            total.setdefault(page, np.zeros(SPAN, dtype=np.int64))
            total[page] += np.frombuffer(raw, dtype=f"u{len(raw) // SPAN}")
    for page, held in total.items():
        level = np.minimum(np.round(16 * np.log2(1 + held)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["page", "level"])


def commonness(texts_only: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each bin, as levels."""
    counts = np.zeros((BINS // SPAN, SPAN), dtype=np.uint8)
    pages = texts_only.mapInArrow(_bins, "page int, counts binary").repartition("page").mapInArrow(_levels, "page int, level binary")
    for row in pages.collect():  # a byte for each of BINS bins at most
        counts[row.page] = np.frombuffer(row.level, dtype=np.uint8)
    return counts.ravel()


def prefix(found: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which sets at similarity ``least`` share one."""
    n = len(found)
    order = np.lexsort((found, counts[_at(found)]))
    return found[order[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def parity(found: np.ndarray) -> np.ndarray:
    """Bits that each shingle turns once, as 64-bit integers: a power of two of them that has a bit for each shingle at least."""
    bits = 64 << ((len(found) - 1) >> 6).bit_length()
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _possible(least: float) -> str:
    """Whether sets of sizes ``nx`` and ``ny`` with parities ``px`` and ``py`` can reach the similarity; the longer parity is folded to the shorter."""
    fold = "if(size({0}) > w, {0}[i] ^ {0}[i + w], {0}[i])"
    turned = f"aggregate(sequence(0, w - 1), 0, (s, i) -> s + bit_count({fold.format('px')} ^ {fold.format('py')}))".replace("w", "least(size(px), size(py))")
    return f"greatest(size(px), size(py)) <= 2 * least(size(px), size(py)) and {turned} <= {(1 - least) / (1 + least)!r} * (nx + ny) + 1e-6"


def _among(d: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``d`` with a body of ``asked``, and few others: by a bitmap of ``FILTER`` bits, so that other texts aren't shuffled."""
    at = asked.select(F.expr(f"1 + (body & {FILTER - 1}L)").alias("at"))
    pages = at.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    marked = np.zeros((FILTER // PAGE, PAGE // 8), dtype=np.uint8)
    for row in pages.collect():  # at most FILTER bits
        marked[row.page - 1] = np.frombuffer(row.bits, dtype=np.uint8)
    marked = marked.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(0).to_numpy() & (FILTER - 1)
            yield batch.filter(pa.array((marked[bit >> 3] >> (bit & 7)) & 1).cast(pa.bool_()))

    return d.mapInArrow(run, "body long, text string").join(shuffled(asked), "body", "left_semi")


def _near(least: float, x: str, y: str) -> str:
    """Whether sets of sizes ``n``, whose first common shingle is at places ``pos``, can reach the similarity."""
    return f"least({x}.n, {y}.n) >= {least} * greatest({x}.n, {y}.n) - 1e-6 and 1 + least({x}.n - {x}.pos, {y}.n - {y}.pos) - 1 >= {least / (1 + least)!r} * ({x}.n + {y}.n) - 1e-6"


def _apart(least: float):
    """Pairs of a block's ``end`` sets with its other sets, of different roots, whose sizes, places and parities let them reach the similarity."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        body, root, n, pos = (block.column(c).to_numpy() for c in ("body", "root", "n", "pos"))
        end, lists = block.column("end").to_numpy(), block.column("parity").combine_chunks()
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        words = np.diff(starts)

        def folded(rows: np.ndarray, width: int, to: int) -> np.ndarray:
            bits = flat[starts[rows][:, None] + np.arange(width)]
            return bits if width == to else bits[:, :to] ^ bits[:, to:]

        found = [np.empty((0, 2), dtype=np.int64)]
        for width in np.unique(words[end]).tolist():
            first = np.flatnonzero(end & (words == width))
            for other in (width // 2, width, 2 * width):
                second = np.flatnonzero(~end & (words == other))
                if not len(second):
                    continue
                to = min(width, other)
                theirs = folded(second, other, to)
                for i, own in zip(first.tolist(), folded(first, width, to)):
                    both = n[i] + n[second]
                    met = (root[i] != root[second]) & (np.minimum(n[i], n[second]) >= least * np.maximum(n[i], n[second]) - 1e-6)
                    met &= np.minimum(n[i] - pos[i], n[second] - pos[second]) >= least / (1 + least) * both - 1e-6
                    met &= np.bitwise_count(own ^ theirs).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * both + 1e-6
                    hit = body[second[met]]
                    found.append(np.stack((np.minimum(body[i], hit), np.maximum(body[i], hit)), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})

    return run


def links(docs: DataFrame, *, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Pairs (a, b) of different SimHash fingerprints of texts whose shingle sets have a Jaccard similarity of ``least`` or more.

    They connect all texts that such similarities connect; a pair that others connect may be left out.
    Null texts and texts without words are in no pair.  An empty table gives an empty result.
    """
    d = input_columns(docs, text=text_col).select(F.xxhash64("text").alias("body"), "text")
    counts = commonness(d.select("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, data in zip(batch.column(0).to_pylist(), texts(batch)):
                values = shingle_values(data, SHINGLE)
                if len(values):
                    found = shingles(data, values)
                    key = np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)
                    rows.append((body, majority(values).view(np.int64), key, len(found), prefix(found, counts, least).view(np.int64), parity(found)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])], names=["body", "fp", "key", "n", "first", "parity"])

    sketched = materialize(d.mapInArrow(sketch, "body long, fp long, key long, n long, first array<long>, parity array<long>"), "sketches")
    one = sketched.groupBy("key").agg(F.min(F.struct("body", "fp", "n", "first", "parity")).alias("one"))
    one = materialize(one.select("key", "one.*"), "sketched-sets")
    equal = sketched.select("key", F.col("fp").alias("a")).distinct().join(shuffled(one.select("key", F.col("fp").alias("b"))), "key").where("a <> b").select("a", "b")

    placed = one.select("body", "n", F.posexplode("first").alias("pos", "part"))
    together, order = Window.partitionBy("part"), Window.partitionBy("part").orderBy(F.xxhash64("body", "part"), "body")
    before = F.array_compact(F.array(*[F.lag(F.struct("body", "n", "pos"), k).over(order) for k in range(1, REACH + 1)]))
    shared = materialize(placed.withColumns({"near": before, "held": F.count("*").over(together)}).where("held > 1"), "shared")

    def possible(met: DataFrame) -> DataFrame:
        met = materialize(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "met")
        x, y = (one.select(F.col("body").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "xy")
        return met.join(shuffled(x), "x").join(shuffled(y), "y").where(_possible(least)).select("x", "y")

    def verified(met: DataFrame) -> DataFrame:
        met = materialize(met, "possible")
        asked = met.select(F.col("x").alias("body")).unionByName(met.select(F.col("y").alias("body"))).distinct()
        sets = materialize(_among(d, asked).dropDuplicates(["body"]).mapInArrow(_sets, "body long, fp long, found array<long>"), "sets")
        x, y = (sets.select(F.col("body").alias(c), F.col("fp").alias(fp), F.col("found").alias(f"of_{c}")) for c, fp in (("x", "a"), ("y", "b")))
        both = met.join(shuffled(x), "x").join(shuffled(y), "y").select("x", "y", "a", "b", (F.size("of_x") + F.size("of_y")).alias("n"), F.size(F.array_intersect("of_x", "of_y")).alias("shared"))
        return materialize(both.where(F.col("shared") / (F.col("n") - F.col("shared")) >= least).select("x", "y", "a", "b"), "similar")

    row = F.struct("body", "n", "pos")
    met = shared.select(row.alias("r"), F.explode("near").alias("q")).where(_near(least, "r", "q")).select(F.col("r.body").alias("x"), F.col("q.body").alias("y"))
    similar = verified(possible(met))
    crowded = shared.where(F.col("held") > REACH + 1).select("part", "body", "n", "pos", "held")
    if not crowded.isEmpty():
        roots = components(similar.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "body")
        rooted = materialize(crowded.join(shuffled(roots), "body", "left").withColumn("root", F.coalesce("root", "body")), "rooted")
        sizes = rooted.groupBy("part", "root").agg(F.count("*").alias("of"))
        most = sizes.groupBy("part").agg(F.max_by("root", F.struct("of", "root")).alias("most"), F.max("of").alias("of"), F.count("*").alias("apart")).where("apart > 1").drop("apart")
        split = rooted.join(shuffled(most), "part").join(shuffled(one.select("body", "parity")), "body")
        cut = lambda rows: F.ceil(rows / BLOCK).cast("int")
        split = split.withColumns({"all": cut(F.col("held")), "ends": cut(F.col("held") - F.col("of")), "h": F.xxhash64("part", "body")})
        split = materialize(split.select("part", "body", "root", "n", "pos", "parity", "all", "ends", "h", (F.col("root") != F.col("most")).alias("outside")), "split")
        # a pair of two components has one end at least outside the largest: each block of those meets each block of all
        held = ["part", "body", "root", "n", "pos", "parity"]
        ends = split.where("outside").select(*held, F.lit(True).alias("end"), F.expr("int(pmod(h, ends))").alias("i"), F.explode(F.expr("sequence(0, all - 1)")).alias("j"))
        rest = split.select(*held, F.lit(False).alias("end"), F.explode(F.expr("sequence(0, ends - 1)")).alias("i"), F.expr("int(pmod(h, all))").alias("j"))
        pairs = ends.unionByName(rest).groupBy("part", "i", "j").applyInArrow(_apart(least), "x long, y long")
        similar = similar.unionByName(verified(pairs.distinct()))
    return similar.where("a <> b").select("a", "b").unionByName(equal)
