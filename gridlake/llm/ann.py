"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are turned by several learned rotations (iterative quantisation) and the signs give bits.  They are split into substrings of about
log2(rows) bits, each with an index: a table (substring number, value) -> row, met by the queries through one equi-join.  A query
probes, in each table, every value within ``reach`` bits of its own, so by pigeonhole every row is found whose tables' bits differ in
fewer than tables * (reach + 1) places, and others with a chance that falls with their distance.  What is fetched is verified in the join by the
Hamming distance of the first ``BITS`` bits, then ranked by cosine on the original vectors.  A pair that an earlier of the tables within these bits fetches too is left to
that one, so a query and its near copies meet once and not in every table.

Rotations are learned from at most ``sample`` rows.  The number of tables, the reach and the radius are learned from the true neighbours of at most
``TRIED`` of them among all rows, one pass that is linear in the rows: the cheapest choice that holds ``HOLD`` of these neighbours.

Equal vectors are one row of the index and one query, with the ids of the first k + 1 rows, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import materialize, shuffled

BITS = 512
CODE = [f"c{i}" for i in range(BITS // 64)]
#: Most substrings, and most bits that a probe differs in at first.
TABLES = 96
REACH = 3
SAMPLE = 4096
TRIED = 128
#: Shares of the tried rows' true neighbours that the tables and the radius are to hold.
HOLD = 0.96
HOLD_RADIUS = 0.99
#: What a fetched row and a query's share of a table's index cost, in probes, when tables and reach are chosen.
FETCH_COST = 4
TABLE_COST = 20


@dataclass(frozen=True)
class Index:
    """Learned rotations (dimension x bits), bits of a substring, number of tables, reach in a substring and radius over ``BITS`` bits."""

    turns: np.ndarray
    width: int
    tables: int = TABLES
    reach: int = REACH
    radius: int = BITS

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.turns) > 0

    def values(self, bits: np.ndarray) -> np.ndarray:
        """Substrings as integers: one column for each table."""
        return bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width) @ (1 << np.arange(self.width))

    def masks(self) -> list[int]:
        """All differences of ``reach`` bits or fewer."""
        return [sum(1 << i for i in flipped) for n in range(self.reach + 1) for flipped in combinations(range(self.width), n)]

    def first(self) -> str:
        """Whether no table before ``s`` fetches a pair with codes ``CODE`` and q``CODE``, of the tables whose bits the codes hold."""
        tests = []
        for k in range(min(self.tables, BITS // self.width)):
            bits, apart = ((1 << self.width) - 1) << k * self.width, []
            for i, c in enumerate(CODE):
                if part := bits >> 64 * i & (1 << 64) - 1:
                    part -= part >> 63 << 64  # as a signed integer
                    apart.append(f"bit_count(({c} ^ q{c}) & {f'{part}L' if part > -(1 << 63) else 'shiftleft(1L, 63)'})")
            tests.append(f"(s <= {k} or {' + '.join(apart)} > {self.reach})")
        return " and ".join(tests)

    def pigeonhole(self) -> int:
        """Every row whose tables' bits differ in at most so many places is found."""
        return self.tables * (self.reach + 1) - 1


def codes(bits: np.ndarray) -> np.ndarray:
    """The first ``BITS`` bits as 64-bit integers."""
    return np.packbits(bits[:, :BITS], axis=1, bitorder="little").view("<i8")


def _rotation(x: np.ndarray, seed: int, rounds: int = 8) -> np.ndarray:
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ v).T
    return r


def learn(x: np.ndarray, rows: int) -> Index:
    """Rotations that bring unit vectors near the corners of a cube, and substrings as wide as the index of ``rows`` rows asks."""
    width = max(4, int(rows).bit_length())
    need = max(BITS, TABLES * width)
    turns = np.concatenate([_rotation(x, seed) for seed in range(-(-need // x.shape[1]))], axis=1)[:, :need]
    return Index(turns, width)


def choose(index: Index, asked: np.ndarray, near: np.ndarray, rows: int) -> Index:
    """The cheapest tables and reach that hold ``HOLD`` of the pairs (asked[i], near[i]) of true neighbours, and the radius that holds ``HOLD_RADIUS``."""
    if not len(asked):
        return index
    a, b = index.bits(asked), index.bits(near)
    apart = (a != b)[:, : index.tables * index.width].reshape(len(a), index.tables, index.width).sum(axis=2)
    least = np.minimum.accumulate(apart, axis=1)  # over the first tables
    options = []
    for reach in range(min(REACH, index.width) + 1):
        held = np.flatnonzero((least <= reach).mean(axis=0) >= HOLD)
        if len(held):
            tables, ball = int(held[0]) + 1, sum(comb(index.width, n) for n in range(reach + 1))
            options.append((tables * (ball * (1 + FETCH_COST * rows / 2**index.width) + TABLE_COST), tables, reach))
    _, tables, reach = min(options, default=(0, index.tables, index.reach))
    radius = int(np.quantile((a != b)[:, :BITS].sum(axis=1), HOLD_RADIUS, method="higher"))
    return replace(index, tables=tables, reach=reach, radius=radius)


def usable(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector of finite numbers that isn't zero, as floats if they are, else as doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return v.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(double(x)) = double('infinity')) and exists(v, x -> x <> 0)")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keyed(rows: DataFrame) -> DataFrame:
    """With a 128-bit name of the vector."""
    return rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit("g"), "v"))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(h, g, v, ids): each vector once, with the smallest k + 1 ids that have it."""
    first = Window.partitionBy("h", "g").orderBy("id")
    named = _keyed(rows).groupBy("h", "g", "v", "id").agg(F.lit(0)).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return named.groupBy("h", "g").agg(F.first("v").alias("v"), F.collect_list("id").alias("ids"))


def _neighbours(rows: DataFrame, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked vector, true neighbour): the k nearest other vectors of each, among all rows."""
    d = asked.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(0), d)
            cosine = asked @ _unit(v).T
            cosine[cosine > 1 - 1e-12] = -2  # the vector itself
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(asked)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cosine[at, best.ravel()]), batch.column(0).take(pa.array(best.ravel()))], names=["a", "cosine", "v"])

    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "v")
    near = rows.select("v").mapInArrow(run, f"a long, cosine double, v {rows.schema['v'].dataType.simpleString()}").where("cosine > -2").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("a", "v").collect()  # at most TRIED * k
    return asked[[r.a for r in near]], _unit(np.array([r.v for r in near]).reshape(-1, d))


def _coded(rows: DataFrame, index: Index, d: int) -> DataFrame:
    """(h, g, ``CODE``, value): codes, and the substrings as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = index.bits(_unit(_matrix(batch.column(2), d)))
            values = index.values(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * index.tables, pa.int32()), pa.array(values.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in np.ascontiguousarray(codes(bits).T)), lists], names=["h", "g", *CODE, "value"])

    made = rows.select("h", "g", "v").mapInArrow(run, f"h long, g long, {', '.join(f'{c} long' for c in CODE)}, value array<int>")
    return made.withColumns({c: F.coalesce(c, F.lit(0)) for c in CODE})  # not nullable, which keeps the join's code short


def fetched(rows: DataFrame, asked: DataFrame, index: Index, d: int, *, verify: bool = True) -> DataFrame:
    """(qh, qg, h, g): what the probes of ``asked`` fetch from the index of ``rows``; within the radius if ``verify``.  A pair comes once if a table within the codes' bits fetches it, else from each table."""
    entries = _coded(rows, index, d).select("h", "g", *CODE, F.posexplode("value").alias("s", "value"))
    probes = _coded(asked, index, d).select(F.col("h").alias("qh"), F.col("g").alias("qg"), *[F.col(c).alias(f"q{c}") for c in CODE], F.posexplode("value").alias("s", "value"))
    probes = probes.withColumn("mask", F.explode(F.lit(index.masks()))).withColumn("value", F.expr("value ^ mask")).drop("mask")
    found = probes.join(shuffled(entries), ["s", "value"])
    if verify:
        found = found.where(" + ".join(f"bit_count({c} ^ q{c})" for c in CODE) + f" <= {index.radius}")
    found = found.where(index.first())
    return found.select("qh", "qg", "h", "g")


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by cosine, ties to the smaller id.

    ``queries`` has the columns of ``vectors``.  A row with the query's id is the query's own.  Rows that repeat an id count once, with the
    nearest; a query id that repeats is asked with the smallest of its vectors.  Null, zero and non-finite vectors, null ids, and vectors whose length isn't the most
    frequent one take no part.  A query that finds fewer than k rows is asked again without the radius, then with a wider reach until it finds k or the reach holds
    the whole substring, so with fewer than k other rows all are returned.  An empty table gives an empty result.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col=id_col, vector_col=vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = lengths[0].d
    rows = materialize(_distinct(rows.where(F.size("v") == d), k), "vectors")
    asked = usable(queries, id_col=id_col, vector_col=vector_col).where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(_keyed(asked), "asked")
    total = rows.count()
    learned = _unit(np.array([r.v for r in rows.orderBy(F.xxhash64("h"), "g").limit(sample).collect()]))  # bounded by a parameter
    index = choose(learn(learned, total), *_neighbours(rows, learned[:TRIED], k), total)

    def ranked(asked: DataFrame, index: Index, verify: bool) -> DataFrame:
        pairs = fetched(rows, asked, index, d, verify=verify).repartition("h", "g").dropDuplicates()  # one shuffle for both this and the join
        both = pairs.join(shuffled(rows), ["h", "g"]).join(shuffled(asked.select(F.col("h").alias("qh"), F.col("g").alias("qg"), F.col("v").alias("qv"))), ["qh", "qg"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = _matrix(batch.column(3), d), _matrix(batch.column(4), d)
                score = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["qh", "qg", "ids", "score"])

        scored = both.select("qh", "qg", "ids", "qv", "v").mapInArrow(run, "qh long, qg long, ids array<long>, score double")
        return scored.select("qh", "qg", F.explode("ids").alias("vec_id"), "score").groupBy("qh", "qg", "vec_id").agg(F.max("score").alias("score"))

    def best(asked: DataFrame, index: Index, verify: bool) -> DataFrame:
        near = Window.partitionBy("qh", "qg").orderBy(F.desc("score"), "vec_id")
        some = ranked(asked.dropDuplicates(["h", "g"]), index, verify).withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
        named = some.withColumnsRenamed({"qh": "h", "qg": "g"}).join(shuffled(asked.select("h", "g", F.col("id").alias("query_id"))), ["h", "g"]).where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found, verify = materialize(best(asked, index, True), "nearest"), True
    while True:
        enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        short = materialize(asked.join(shuffled(enough), "id", "left_anti"), "short")
        if (not verify and index.reach >= index.width) or short.isEmpty():
            return found
        index = index if verify else replace(index, reach=index.reach + 1)
        verify = False
        again = best(short, index, False)
        found = materialize(found.join(shuffled(short.select(F.col("id").alias("query_id"))), "query_id", "left_anti").unionByName(again), "nearest")
