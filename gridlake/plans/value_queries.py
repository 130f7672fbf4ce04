"""Expressions and schema conversions over the grids of ``views``: each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions import expressions as ex
from gridlake.operators import log as wl
from gridlake.plans.views import SCHEMA, Events, Lines, cte, table
from gridlake.schema import Column, Type, parse_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = cte() + sql
        return f

    return add


def value(text: str, **more):
    return ex.scalar(text, SCHEMA, **more)


def where(text: str, **more):
    return ex.condition(text, SCHEMA, **more)


@query("SELECT x, y, CAST(-x AS BIGINT) AS negated, x * 1000003 + y - kind AS mixed, x // 7 AS quotient, x % 7 AS rest, CAST(CAST(x AS HUGEINT) * 9223372036854775807 * 3 AS VARCHAR) AS wide FROM live")
def e07_integer_arithmetic(spark, sf_dir):
    """Exact integers: negation, products beyond 64 bits, division that truncates, remainders with the dividend's sign."""
    live = Events(spark, sf_dir).live
    made = {"negated": "-POS_X", "mixed": "POS_X * 1000003 + POS_Y - kind", "quotient": "POS_X / 7", "rest": "POS_X % 7"}
    return live.select("x", "y", *[value(t).cast("long").alias(k) for k, t in made.items()], value("POS_X * 9223372036854775807 * 3").cast("string").alias("wide"))


@query("SELECT x, y, CASE WHEN kind = 1 THEN CASE WHEN value - 50 = 0 THEN 'NaN'::DOUBLE WHEN value > 50 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (value - 50) / (kind - 1.0::DOUBLE) END AS ratio, CASE WHEN kind = 0 THEN 'NaN'::DOUBLE ELSE (value - 50) % CAST(kind AS DOUBLE) END AS rest, value * 0.5::DOUBLE + kind AS mixed FROM live")
def e10_float_arithmetic(spark, sf_dir):
    """Floats by IEEE 754: division by zero is an infinity or NaN, remainder by zero NaN."""
    live = Events(spark, sf_dir).live
    made = {"ratio": "(value - 50) / (kind - 1.0)", "rest": "(value - 50) % (kind * 1.0)", "mixed": "value * 0.5 + kind"}
    return live.select("x", "y", *[value(t).alias(k) for k, t in made.items()])


@query("SELECT x, y, least(x, y, kind) AS low, greatest(x, y, 3) AS high, least(value, CAST(x AS DOUBLE) * 3) AS low_float, 'NaN'::DOUBLE AS with_nan FROM live")
def e13_least_greatest(spark, sf_dir):
    live = Events(spark, sf_dir).live
    return live.select("x", "y", value("LEAST(POS_X, POS_Y, kind)").cast("long").alias("low"), value("GREATEST(POS_X, POS_Y, 3, NULL)").cast("long").alias("high"), value("LEAST(value, POS_X * 3.0)").alias("low_float"), value("LEAST(value, nan, 1)").alias("with_nan"))


@query("SELECT k.x, k.y, coalesce(l.kind, 9) AS kind, l.x IS NOT NULL AS here, l.kind IS NULL AS missing FROM (SELECT x, y FROM range(-32, 32) a(x), range(0, 3) b(y)) k LEFT JOIN live l ON l.x = k.x AND l.y = k.y")
def e14_absent_blocks(spark, sf_dir):
    """COALESCE, EXISTS and IS NULL on blocks that may be absent."""
    live = Events(spark, sf_dir).live.select("x", "y", "kind", "value", F.lit(True).alias("here"))
    keys = spark.range(-32, 32).select(F.col("id").alias("x")).select("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("y"))
    rows = keys.join(live, ["x", "y"], "left").withColumn("here", F.coalesce("here", F.lit(False)))
    there = F.col("here")
    return rows.select("x", "y", value("COALESCE(kind, 9)", exists=there).cast("long").alias("kind"), where("EXISTS", exists=there).alias("here"), where("kind IS NULL", exists=there).alias("missing"))


@query("SELECT x, y, value > x AS above, value = floor(value) AS whole, CAST(value * 1e16 AS HUGEINT) > CAST(x AS HUGEINT) * 100000000000000000 AS far, kind <> 2 AS other FROM live")
def e15_exact_compare(spark, sf_dir):
    """Integers against floats without rounding."""
    live = Events(spark, sf_dir).live
    whole = ex.order_int_float(F.floor("value").cast(ex.WIDE), F.col("value")) == 0
    return live.select("x", "y", where("value > POS_X").alias("above"), whole.alias("whole"), where("value * 1e16 > POS_X * 100000000000000000").alias("far"), where("kind <> 2").alias("other"))


@query("SELECT x, y FROM live WHERE (kind IN (0, 2) OR NOT value BETWEEN 10 AND 60) AND x <> 0 AND NOT (y < -20 AND kind = 3)")
def e23_conditions(spark, sf_dir):
    """Logic, IN and BETWEEN as a filter; comparisons of a column with a value reach the scan."""
    live = Events(spark, sf_dir).live
    return live.where(where("(kind IN (0, 2) OR NOT value BETWEEN 10 AND 60) AND POS_X <> 0 AND NOT (POS_Y < -20 AND kind = $1)", parameters=[3])).select("x", "y")


@query("SELECT x, y, CASE WHEN x <> 0 AND 64 // (CASE WHEN x = 0 THEN 1 ELSE x END) > 2 THEN true ELSE false END AS safe FROM live")
def e23_short_circuit(spark, sf_dir):
    """An operand that would raise isn't evaluated where the first one decides."""
    return Events(spark, sf_dir).live.select("x", "y", where("POS_X <> 0 AND 64 / POS_X > 2").alias("safe"))


@query("SELECT x, y, (kind * 3 + 1) % 8 AS kind, value + kind AS value FROM live")
def e26_assignments(spark, sf_dir):
    """All assigned values come from the row as it was."""
    made = ex.assignments("kind = (kind * 3 + 1) % 8, value = value + kind", SCHEMA)
    return Events(spark, sf_dir).live.withColumns(made).select("x", "y", F.col("kind").cast("long").alias("kind"), "value")


@query("SELECT flag, CAST(count(*) AS BIGINT) AS n FROM lines WHERE flag >= 'N' AND flag <> 'é' GROUP BY flag")
def e17_text_compare(spark, sf_dir):
    g = Lines(spark, sf_dir)
    found = g.live.where(ex.condition("flag >= 'N' AND flag <> $1", g.schema, parameters=["é"]))
    return found.groupBy("flag").agg(F.count("*").alias("n"))


@query("SELECT x, y, least(kind, 1) AS clamped, CASE WHEN kind <= 1 THEN kind ELSE 0 END AS defaulted, kind AS widened, kind <= 1 AS fits FROM live")
def d06_integer_conversions(spark, sf_dir):
    """u3 to u1 by CLAMP and by DEFAULT, u3 to u16 by widening."""
    rows = Events(spark, sf_dir).live.select("x", "y", "kind", "value")
    clamped, defaulted, widened = (SCHEMA.retype("kind", Type.parse(t), p) for t, p in (("u1", "CLAMP"), ("u1", "DEFAULT"), ("u16", "")))
    out = rows.withColumn("fits", Type.parse("u1").fits(F.col("kind")))
    for name, schema in (("clamped", clamped), ("defaulted", defaulted), ("widened", widened)):
        done = schema.translate(rows, 1).select("x", "y", F.col("kind").cast("long").alias(name))
        out = out.join(done, ["x", "y"])
    return out.select("x", "y", "clamped", "defaulted", "widened", "fits")


@query("SELECT doc_id, CASE WHEN strlen(text) <= 7 THEN text WHEN strlen(left(text, 7)) <= 7 THEN left(text, 7) WHEN strlen(left(text, 6)) <= 7 THEN left(text, 6) WHEN strlen(left(text, 5)) <= 7 THEN left(text, 5) WHEN strlen(left(text, 4)) <= 7 THEN left(text, 4) WHEN strlen(left(text, 3)) <= 7 THEN left(text, 3) WHEN strlen(left(text, 2)) <= 7 THEN left(text, 2) ELSE left(text, 1) END AS cut, strlen(text) <= 700 AS fits FROM documents")
def d08_truncate_text(spark, sf_dir):
    """Text is cut to a number of bytes, before the character that crosses the bound."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", Type.parse("text(7)").truncate(F.col("text")).alias("cut"), Type.parse("text(700)").fits(F.col("text")).alias("fits"))


@query("SELECT x, y, kind AS holds FROM live WHERE kind > 1 ORDER BY cx, cy, idx LIMIT 1")
def d09_narrowing_scan(spark, sf_dir):
    """The first block, in coordinate order, that doesn't fit a narrower type."""
    e = Events(spark, sf_dir)
    rows = e.geometry.addressed(e.live).withColumn("idx", e.geometry.local_index())
    found = SCHEMA.misfits(rows.select("x", "y", "cx", "cy", "idx", "kind"), "kind", Type.parse("u1"), ["cx", "cy", "idx", "x", "y"])
    return found.select("x", "y", F.col("holds").cast("long").alias("holds"))


@query("SELECT x, y, kind AS sort, least(greatest(CAST(round(value) AS BIGINT) % 1000, -128), 127) AS depth, CAST(7 AS BIGINT) AS light FROM live")
def d16_translate(spark, sf_dir):
    """Rows of version 1 read under version 6: renamed, added, retyped and dropped columns in one projection."""
    rows = Events(spark, sf_dir).live.select("x", "y", "kind", (F.round("value").cast("long") % 1000).cast("int").alias("depth"))
    schema = parse_schema("kind u3, depth i32")
    schema = schema.rename("kind", "sort").add(Column(0, "light", Type.parse("u4"), default=7, has_default=True)).retype("depth", Type.parse("i8"), "CLAMP")
    schema = schema.add(Column(0, "tag", Type.parse("text(4)"), nullable=True)).drop("tag")
    return schema.translate(rows, 1).select("x", "y", *[F.col(c).cast("long").alias(c) for c in ("sort", "depth", "light")])


@query("SELECT x, y, value AS good FROM live WHERE kind BETWEEN 0 AND 7 AND value = value")
def w10_value_validation(spark, sf_dir):
    """Values that the column types hold."""
    live = Events(spark, sf_dir).live
    return live.where(SCHEMA.column("kind").type.fits(F.col("kind")) & F.col("value").isNotNull()).select("x", "y", F.col("value").alias("good"))


GRANTS = "(VALUES ('a', '*', 1), ('a', 'world', 2), ('b', 'world', 3), ('b', 'sky', 1), ('c', '*', 3)) g(name, target, level)"


@query(f"SELECT g.name, g.target, CAST(max(h.level) AS INTEGER) AS level FROM {GRANTS} JOIN {GRANTS.replace(') g(', ') h(')} ON g.name = h.name AND (h.target = g.target OR h.target = '*') GROUP BY g.name, g.target")
def a03_effective_rights(spark, sf_dir):
    """A user's right on a table: the higher of the table's entry and the one for all tables."""
    from gridlake.sources import rights

    grants = spark.createDataFrame([("a", "*", 1), ("a", "world", 2), ("b", "world", 3), ("b", "sky", 1), ("c", "*", 3)], "name string, target string, level int")
    return rights.effective(grants)
