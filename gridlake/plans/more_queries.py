"""Cursors, counts, schema history, conflicts and catalog folds: each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import area as areas
from gridlake.operators import log as wl
from gridlake.plans.views import SCHEMA, Events, cte
from gridlake.schema import Type, parse_column, parse_schema
from gridlake.sources import rights
from gridlake.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SNAPSHOT = 500


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = cte() + sql
        return f

    return add


@query("SELECT r.radius, count(*) AS cells FROM range(0, 9) r(radius), range(-8, 9) a(x), range(-8, 9) b(y) WHERE x * x + y * y <= radius * radius GROUP BY r.radius")
def r09_requested_cells(spark, sf_dir):
    """How many chunks a ball asks for, empty ones counted."""
    rows = [(r, sum(1 for _ in areas.cells(areas.Ball((0, 0), r)))) for r in range(9)]
    return spark.createDataFrame(rows, "radius long, cells long")


@query("SELECT a.cx, b.cy, c.cz FROM range(-5, 2) a(cx), range(1, 8) b(cy), range(-3, 4) c(cz) WHERE (cx + 2) * (cx + 2) + (cy - 4) * (cy - 4) + cz * cz <= 9")
def k01_area_cells(spark, sf_dir):
    """All chunks of a ball, made in parallel: a row per first coordinate, the others exploded."""
    ball = areas.Ball((-2, 4, 0), 3)
    (a, b), (c, d), (e, f) = ball.bounds()
    cells = spark.range(a, b + 1).select(F.col("id").alias("cx")).select("cx", F.explode(F.sequence(F.lit(c).cast("long"), F.lit(d).cast("long"))).alias("cy"))
    cells = cells.select("cx", "cy", F.explode(F.sequence(F.lit(e).cast("long"), F.lit(f).cast("long"))).alias("cz"))
    return cells.where(ball.inside(["cx", "cy", "cz"]))


@query("SELECT x, y, rev, value0 AS before_value, kind0 AS before_kind FROM hist WHERE effective AND was AND rev > 700")
def f03_before_images(spark, sf_dir):
    e = Events(spark, sf_dir)
    found = feed.changes(e.log, e.schema, e.geometry, after=700).where("before is not null")
    return found.select("x", "y", "rev", F.col("before.value").alias("before_value"), F.col("before.kind").cast("long").alias("before_kind"))


@query("SELECT rev, x, y, op FROM hist WHERE NOT effective")
def f04_suppressed(spark, sf_dir):
    """Writes that are in no event."""
    e = Events(spark, sf_dir)
    return e.history.where(~F.col("effective")).select("rev", "x", "y", "op")


@query("SELECT rev, count(*) AS blocks, max(commit_time_ms) AS commit_time_ms FROM hist WHERE effective AND rev > 300 GROUP BY rev")
def f12_resume(spark, sf_dir):
    """Events strictly after a position, up to the log's last commit: one per commit."""
    e = Events(spark, sf_dir)
    events = feed.events(feed.changes(e.log, e.schema, e.geometry, after=300), e.geometry)
    return events.select("rev", F.size("blocks").cast("long").alias("blocks"), "commit_time_ms")


@query(f"SELECT t.cx, t.cy, coalesce(i.version > {SNAPSHOT}, false) AS changed FROM (SELECT cx, cy FROM range(-4, 5) a(cx), range(-5, 6) b(cy)) t LEFT JOIN ident i USING (cx, cy)")
def l05_changed_since(spark, sf_dir):
    e = Events(spark, sf_dir)
    touched = spark.range(-4, 5).select(F.col("id").alias("cx")).select("cx", F.explode(F.sequence(F.lit(-5).cast("long"), F.lit(5).cast("long"))).alias("cy"))
    return wl.changed_since(touched, e.identities, e.geometry, SNAPSHOT).select("cx", "cy", "changed")


@query(f"SELECT d.x, d.y, 'S' AS op, CASE WHEN l.x IS NULL THEN true ELSE NOT (d.kind = l.kind AND d.value = l.value) END AS conflict, CAST(7 AS BIGINT) AS kind FROM (SELECT x, y, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist WHERE rev <= {SNAPSHOT}) WHERE k = 1 AND here) d LEFT JOIN live l ON l.x = d.x AND l.y = d.y")
def l08_row_conflicts(spark, sf_dir):
    """A delta made at a revision against the live state: a row conflicts if it isn't as it was seen."""
    e = Events(spark, sf_dir)
    seen = wl.fold(e.log, e.schema, e.geometry, upto=SNAPSHOT)
    delta = seen.select("x", "y", F.lit("S").alias("op"), F.lit(7).cast("tinyint").alias("kind"), "value")
    return wl.rebase(seen, delta, e.live, e.schema, e.geometry).select("x", "y", "op", "conflict", F.col("kind").cast("long").alias("kind"))


@query("SELECT l.x, l.y, l.value - m.low AS above FROM live l JOIN (SELECT cx, cy, min(value) AS low FROM live GROUP BY cx, cy) m USING (cx, cy)")
def w12_chunk_transform(spark, sf_dir):
    """Every block relative to its chunk's lowest value."""
    e = Events(spark, sf_dir)
    return wl.transform_chunks(e.live, e.geometry, low=F.min("value")).select("x", "y", (F.col("value") - F.col("low")).alias("above"))


@query("SELECT x, y, kind FROM live WHERE kind > 1")
def d10_narrowing_guard(spark, sf_dir):
    """Writes that a pending narrowing refuses."""
    return Events(spark, sf_dir).live.where(~Type.parse("u1").fits(F.col("kind"))).select("x", "y", F.col("kind").cast("long").alias("kind"))


@query("SELECT * FROM (VALUES (1, 1, 'kind', 'u3'), (1, 2, 'value', 'f64'), (2, 1, 'kind', 'u3'), (2, 2, 'value', 'f64'), (2, 4, 'tag', 'text(4)'), (3, 1, 'sort', 'u3'), (3, 2, 'value', 'f64'), (3, 4, 'tag', 'text(4)'), (4, 1, 'sort', 'u3'), (4, 4, 'tag', 'text(4)'), (5, 1, 'sort', 'u16'), (5, 4, 'tag', 'text(4)')) t(version, id, name, type)")
def d15_schema_history(spark, sf_dir):
    """The columns at every schema version, undone from the last."""
    s = SCHEMA.add(parse_column("tag text(4) NULL")).rename("kind", "sort").drop("value").retype("sort", Type.parse("u16"))
    rows = [(v, c.id, c.name, str(c.type)) for v in range(1, s.version + 1) for c in s.at(v).columns]
    return spark.createDataFrame(rows, "version int, id int, name string, type string")


@query("SELECT x, y, kind AS sort, value, CASE WHEN rev <= 400 THEN 5 ELSE 6 END AS level FROM live")
def d02_added_column(spark, sf_dir):
    """Rows written before and after a column was added, read together."""
    live = Events(spark, sf_dir).live
    new = SCHEMA.rename("kind", "sort").add(parse_column("level u4 DEFAULT 5"))
    old_rows = live.where("rev <= 400").drop("rev")
    new_rows = live.where("rev > 400").select("x", "y", F.col("kind").alias("sort"), "value", F.lit(6).cast("tinyint").alias("level"))
    both = new.translate(old_rows, 1).unionByName(new.translate(new_rows, new.version))
    return both.select("x", "y", F.col("sort").cast("long").alias("sort"), "value", F.col("level").cast("int").alias("level"))


@query("SELECT * FROM (VALUES ('a', '*', 3), ('a', 'world', 2), ('b', 'world', 1)) t(name, target, level)")
def a02_grants(spark, sf_dir):
    """Entries after grants and revokes in order: a grant never lowers, a revoke cuts one entry."""
    steps = [("g", "a", "*", ["ADMIN"]), ("g", "a", "world", ["READ", "WRITE"]), ("g", "a", "world", ["READ"]), ("g", "b", "world", ["ADMIN"]), ("r", "b", "world", ["WRITE"]), ("g", "b", "sky", ["READ"]), ("r", "b", "sky", ["READ", "ADMIN"])]
    users: dict[str, dict[str, int]] = {}
    for verb, user, target, names in steps:
        users[user] = (rights.grant if verb == "g" else rights.revoke)(users.get(user, {}), target, names)
    return spark.createDataFrame([(u, t, v) for u, r in users.items() for t, v in r.items()], "name string, target string, level int")


@query("SELECT x, y, kind, 4 AS tags FROM live WHERE kind <> 0 OR value <> 0.0")
def w10_initial_values(spark, sf_dir):
    """Blocks that differ from what an empty set would make: default, else null, else zero."""
    live = Events(spark, sf_dir).live
    same = F.lit(True)
    for c in SCHEMA.columns:
        same = same & wl.same(F.col(c.name), c.initial_col(), c)
    tagged = parse_schema("a u8, tag u4 DEFAULT 4").column("tag")
    return live.where(~same).select("x", "y", F.col("kind").cast("long").alias("kind"), tagged.initial_col().cast("int").alias("tags"))
