"""Compositions over grids: joins by coordinate, derived tables, rebuilds, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.geometry import Geometry
from gridlake.operators import log as wl
from gridlake.schema import Schema


def match(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of two grids that share coordinates.  Tables stored with equal geometry are partitioned alike."""
    return left.join(right, on, how)


def by_value(blocks: DataFrame, condition: Column) -> DataFrame:
    return blocks.where(condition)


def summary(blocks: DataFrame, chunks: DataFrame, geometry: Geometry, **aggregates: Column) -> DataFrame:
    """One row per chunk with blocks: the aggregates, and the chunk version they were made from."""
    made = geometry.addressed(blocks).groupBy(*geometry.chunks).agg(*[v.alias(k) for k, v in aggregates.items()])
    return made.join(chunks.select(*geometry.chunks, F.col("version").alias("source_version")), geometry.chunks)


def refresh(old: DataFrame, changes: DataFrame, blocks: DataFrame, chunks: DataFrame, geometry: Geometry, **aggregates: Column) -> DataFrame:
    """A summary brought up to date: only chunks with a change above their source version are made again."""
    latest = changes.groupBy(*geometry.chunks).agg(F.max("rev").alias("_rev"))
    touched = latest.join(old.select(*geometry.chunks, "source_version"), geometry.chunks, "left")
    touched = touched.where(F.coalesce(F.col("source_version") < F.col("_rev"), F.lit(True))).select(*geometry.chunks)
    again = geometry.addressed(blocks).join(touched, geometry.chunks, "left_semi")
    made = summary(again.drop(*geometry.chunks), chunks, geometry, **aggregates)
    return old.join(touched, geometry.chunks, "left_anti").select(*made.columns).unionByName(made)


def running_total(rows: DataFrame, order: str, step: str, name: str, span: int = 1 << 16) -> DataFrame:
    """Sum of ``step`` up to each row of an integer order: within ranges of ``span``, plus the total of earlier ranges.

    The one ordered window over all ranges has one row per range.
    """
    ranged = rows.withColumn("_range", F.expr(f"{order} div {span}L"))
    totals = ranged.groupBy("_range").agg(F.sum(step).alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    return ranged.join(before, "_range").select(order, (F.sum(step).over(inside) + F.col("_before")).alias(name))


def rebuild_at_time(log: DataFrame, schema: Schema, geometry: Geometry, at_ms: int) -> DataFrame:
    """The state at a time.  Times may go back, so the cut is the first revision that is later; one number comes to the driver."""
    cut = log.where(F.col("commit_time_ms") > at_ms).agg(F.min("rev")).first()[0]
    return wl.fold(log, schema, geometry, upto=None if cut is None else cut - 1)


def timelapse(log: DataFrame, schema: Schema, geometry: Geometry, frames: list[int]) -> DataFrame:
    """Present blocks at each of the given revisions: (frame, coordinates, columns).

    Every write is valid from its revision to the block's next one; a frame takes the write valid at it.  The
    frames are a literal list, so a write is repeated only for the frames it is seen in.
    """
    history = wl.history(log, schema, geometry)
    following = F.lead("rev").over(Window.partitionBy(*geometry.blocks).orderBy("rev"))
    spans = history.withColumn("_until", following).where(F.col("after").isNotNull())
    seen = F.filter(F.array(*[F.lit(f).cast("long") for f in frames]), lambda f: (f >= F.col("rev")) & (F.col("_until").isNull() | (f < F.col("_until"))))
    return spans.withColumn("frame", F.explode(seen)).select("frame", *geometry.blocks, "after.*")


def replay(snapshot: DataFrame, versions: DataFrame, journal: DataFrame, schema: Schema, geometry: Geometry) -> DataFrame:
    """A snapshot's blocks with later journal entries applied: an entry counts only above its chunk's snapshot version."""
    columns = [c.name for c in schema.columns]
    newer = journal.join(versions.select(*geometry.chunks, "version"), geometry.chunks, "left").where(F.col("version").isNull() | (F.col("rev") > F.col("version")))
    last = newer.groupBy(*geometry.blocks).agg(F.max(F.struct("rev", "after")).alias("at")).select(*geometry.blocks, "at.after")
    kept = snapshot.join(last.select(*geometry.blocks), geometry.blocks, "left_anti").select(*geometry.blocks, *columns)
    return kept.unionByName(last.where("after is not null").select(*geometry.blocks, "after.*"))


def deduplicate(events: DataFrame, also: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Each (epoch, rev) once, and each block of it once."""
    return events.dropDuplicates(["epoch", "rev", *also])
