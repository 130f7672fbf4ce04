"""Grids over the driver's tables, as DataFrames and as SQL for a second engine."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.geometry import Geometry
from gridlake.operators import log as wl
from gridlake.schema import Schema, parse_schema

GEOMETRY = Geometry((16, 16), (8, 8))
SCHEMA = parse_schema("kind u3, value f64", "owner u8 DEFAULT 0")
VOLUME = Geometry((16, 16, 4), (8, 8, 8))
LINES = parse_schema("qty u8, discount f64, flag text(1)")
META_BASE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Events:
    """The events table as a write log of a two-dimensional grid: purchases name only ``value``, views only ``kind``, errors delete."""

    def __init__(self, spark: SparkSession, sf_dir: str, side: int = 16) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.geometry = Geometry((side, side), (8, 8))
        self.schema: Schema = SCHEMA

    @cached_property
    def log(self) -> DataFrame:
        e = table(self.spark, self.sf_dir, "events")
        kind = "case event_type when 'click' then 0 when 'signup' then 2 when 'view' then 3 end"
        names = "case event_type when 'purchase' then array('value') when 'view' then array('kind') end"
        return e.select(
            (F.col("event_id") + 1).alias("rev"),
            F.expr("unix_millis(cast(ts as timestamp))").alias("commit_time_ms"),
            F.col("user_id").alias("user"),
            (F.col("user_id") % 64 - 32).alias("x"),
            (F.get_json_object("props", "$.k").cast("long") - 50).alias("y"),
            F.expr("if(event_type = 'error', 'D', 'S')").alias("op"),
            F.expr(names).alias("names"),
            F.expr(kind).cast("tinyint").alias("kind"),
            F.expr("if(event_type in ('click', 'signup', 'purchase'), value, null)").alias("value"),
        )

    @cached_property
    def live(self) -> DataFrame:
        return wl.fold(self.log, self.schema, self.geometry)

    @cached_property
    def history(self) -> DataFrame:
        return wl.history(self.log, self.schema, self.geometry)

    @cached_property
    def identities(self) -> DataFrame:
        return wl.identities(self.log, self.schema, self.geometry)

    @cached_property
    def meta(self) -> DataFrame:
        """Metadata writes: one for each chunk of the log, and for three chunks without blocks."""
        own = self.geometry.addressed(self.log).select("cx", "cy").distinct()
        more = self.spark.createDataFrame([(10, 10), (11, 10), (12, 10)], "cx long, cy long")
        return own.unionByName(more).select(
            F.expr(f"{META_BASE}L + (cx + 50) * 100 + cy + 50").alias("rev"),
            F.lit(0).cast("long").alias("commit_time_ms"),
            "cx",
            "cy",
            F.lit(None).cast("array<string>").alias("names"),
            F.expr("cast((cx * 31 + cy * 17) & 15 as smallint)").alias("owner"),
        )


class Lines:
    """The line items as upserts: of a two-dimensional grid, or of a volume with the line number as third axis."""

    def __init__(self, spark: SparkSession, sf_dir: str, dims: int = 2) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.geometry = GEOMETRY if dims == 2 else VOLUME
        self.schema = LINES

    @cached_property
    def log(self) -> DataFrame:
        """(order, line) orders the writes of a cell; both go into one revision.  Of rows that tie, the one with the largest values writes."""
        t = table(self.spark, self.sf_dir, "lineitem")
        axes = {"x": "l_partkey", "y": "l_suppkey", "z": "cast(l_linenumber as bigint)"}
        keys = [F.expr("l_orderkey * 16 + l_linenumber").alias("rev"), *[F.expr(axes[b]).alias(b) for b in self.geometry.blocks]]
        row = F.struct(F.col("l_quantity").cast("smallint").alias("qty"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
        rows = t.groupBy(*keys).agg(F.max(row).alias("row"))
        return rows.select("rev", F.lit(0).cast("long").alias("commit_time_ms"), *self.geometry.blocks, F.lit("S").alias("op"), F.lit(None).cast("array<string>").alias("names"), "row.*")

    @cached_property
    def live(self) -> DataFrame:
        return wl.fold(self.log, self.schema, self.geometry)


def fdiv(value: str, by: int) -> str:
    return f"({value} // {by} - CASE WHEN {value} % {by} < 0 THEN 1 ELSE 0 END)"


def fmod(value: str, by: int) -> str:
    return f"(({value} % {by} + {by}) % {by})"


#: The same views as common table expressions: log, hist (states before and after each write), live, ident, meta, ident_meta, lines, volume.
def cte(side: int = 16) -> str:
    return f"""
WITH log AS (
  SELECT event_id + 1 AS rev, epoch_us(ts) // 1000 AS commit_time_ms, user_id AS "user", user_id % 64 - 32 AS x,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) - 50 AS y, CASE WHEN event_type = 'error' THEN 'D' ELSE 'S' END AS op,
    CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS BIGINT) AS kind,
    CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN value END AS value
  FROM events),
seg AS (
  SELECT *, max(CASE WHEN op = 'D' THEN rev END) OVER w AS dl,
    max(CASE WHEN kind IS NOT NULL AND op = 'S' THEN rev END) OVER w AS kr, last_value(CASE WHEN op = 'S' THEN kind END IGNORE NULLS) OVER w AS kv,
    max(CASE WHEN value IS NOT NULL AND op = 'S' THEN rev END) OVER w AS vr, last_value(CASE WHEN op = 'S' THEN value END IGNORE NULLS) OVER w AS vv
  FROM log WINDOW w AS (PARTITION BY x, y ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (
  SELECT rev, commit_time_ms, "user", x, y, op, op = 'S' AS here,
    CASE WHEN op = 'S' THEN CASE WHEN kr > coalesce(dl, -1) THEN kv ELSE 0 END END AS kind,
    CASE WHEN op = 'S' THEN CASE WHEN vr > coalesce(dl, -1) THEN vv ELSE 0.0 END END AS value FROM seg),
chain AS (
  SELECT *, coalesce(lag(here) OVER w, false) AS was, lag(kind) OVER w AS kind0, lag(value) OVER w AS value0
  FROM st WINDOW w AS (PARTITION BY x, y ORDER BY rev)),
hist AS (
  SELECT *, CASE WHEN here THEN NOT was OR kind <> kind0 OR value <> value0 ELSE was END AS effective,
    {fdiv("x", side)} AS cx, {fdiv("y", side)} AS cy, {fmod("x", side)} + {side} * {fmod("y", side)} AS idx FROM chain),
live AS (
  SELECT x, y, kind, value, rev, cx, cy, idx FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist) WHERE k = 1 AND here),
ident AS (
  SELECT cx, cy, max(rev) AS version, arg_max(commit_time_ms, rev) AS commit_time_ms,
    CAST(sum(CASE WHEN NOT was THEN 1 WHEN NOT here THEN -1 ELSE 0 END) AS BIGINT) AS blocks FROM hist WHERE effective GROUP BY cx, cy),
meta AS (
  SELECT {META_BASE} + (cx + 50) * 100 + cy + 50 AS rev, cx, cy, (cx * 31 + cy * 17) & 15 AS owner
  FROM (SELECT DISTINCT cx, cy FROM hist UNION ALL VALUES (10, 10), (11, 10), (12, 10)) AS t(cx, cy)),
lines AS (
  SELECT x, y, qty, discount, flag, {fdiv("x", 16)} AS cx, {fdiv("y", 16)} AS cy, {fmod("x", 16)} + 16 * {fmod("y", 16)} AS idx FROM (
    SELECT l_partkey AS x, l_suppkey AS y, CAST(l_quantity AS BIGINT) AS qty, l_discount AS discount, l_returnflag AS flag,
      row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_discount DESC, l_returnflag DESC) AS k FROM lineitem) WHERE k = 1),
volume AS (
  SELECT x, y, z, qty, discount, flag, {fdiv("x", 16)} AS cx, {fdiv("y", 16)} AS cy, {fdiv("z", 4)} AS cz FROM (
    SELECT l_partkey AS x, l_suppkey AS y, CAST(l_linenumber AS BIGINT) AS z, CAST(l_quantity AS BIGINT) AS qty, l_discount AS discount, l_returnflag AS flag,
      row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_linenumber ORDER BY l_orderkey DESC, l_quantity DESC, l_discount DESC, l_returnflag DESC) AS k FROM lineitem) WHERE k = 1)
"""
