"""Reads, writes, history and patterns over the grids of ``views``: each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake import patterns
from gridlake.operators import area
from gridlake.operators import log as wl
from gridlake.plans.views import META_BASE, Events, Lines, cte, table
from gridlake.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str, side: int = 16) -> Callable[[Query], Query]:
    """Registers a query with its SQL over the views' common table expressions; ``side`` is the SQL's chunk side."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = cte(side) + sql
        return f

    return add


def big(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


SNAPSHOT = 500


@query("SELECT k.x, k.y, l.kind, l.value, l.x IS NOT NULL AS here FROM (SELECT x, y FROM range(-32, 32) a(x), range(-3, 4) b(y)) k LEFT JOIN live l ON l.x = k.x AND l.y = k.y")
def r01_point_lookup(spark, sf_dir):
    """Many points at once: wanted coordinates against live blocks; an absent block gives a row of nulls."""
    e = Events(spark, sf_dir)
    keys = spark.range(-32, 32).select(F.col("id").alias("x")).select("x", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("y"))
    found = e.live.select("x", "y", *big("kind"), "value", F.lit(True).alias("here"))
    return keys.join(found, ["x", "y"], "left").select("x", "y", "kind", "value", F.coalesce("here", F.lit(False)).alias("here"))


@query("SELECT k.x, k.y, i.version AS chunk_version, CAST(1 AS BIGINT) AS schema_version, l.kind FROM (SELECT x, CAST(5 AS BIGINT) AS y FROM range(-40, 40) a(x)) k LEFT JOIN live l ON l.x = k.x AND l.y = k.y LEFT JOIN ident i ON i.cx = CASE WHEN k.x < -32 THEN -3 WHEN k.x < -16 THEN -2 WHEN k.x < 0 THEN -1 WHEN k.x < 16 THEN 0 WHEN k.x < 32 THEN 1 ELSE 2 END AND i.cy = 0")
def r02_lookup_with_version(spark, sf_dir):
    """Points with their chunk's version and the schema version; a block that is absent may still have a version."""
    e = Events(spark, sf_dir)
    keys = e.geometry.addressed(spark.range(-40, 40).select(F.col("id").alias("x"), F.lit(5).cast("long").alias("y")))
    versions = e.identities.select("cx", "cy", F.col("version").alias("chunk_version"))
    found = keys.join(e.live.select("x", "y", *big("kind")), ["x", "y"], "left").join(versions, ["cx", "cy"], "left")
    return found.select("x", "y", "chunk_version", F.lit(e.schema.version).cast("long").alias("schema_version"), "kind")


@query("SELECT idx, kind, value FROM live WHERE cx = 0 AND cy = 0")
def r03_chunk_read(spark, sf_dir):
    """One chunk's form: its present blocks by position."""
    e = Events(spark, sf_dir)
    one = e.geometry.addressed(e.live).where("cx = 0 and cy = 0")
    form = wl.chunk_forms(one.drop("cx", "cy"), e.schema, e.geometry)
    return form.select(F.explode("cells").alias("c")).select(F.col("c.index").alias("idx"), F.col("c.kind").cast("long").alias("kind"), "c.value")


@query("SELECT cx, cy, x, y, qty, discount, flag FROM lines WHERE cx BETWEEN 1 AND 9 AND cy BETWEEN 0 AND 4")
def r04_box_area(spark, sf_dir):
    """All blocks of the chunks in a box."""
    g = Lines(spark, sf_dir)
    found = area.select(g.geometry.addressed(g.live, large=True), area.Box((1, 0), (9, 4)), g.geometry)
    return found.select("cx", "cy", "x", "y", *big("qty"), "discount", "flag")


@query("SELECT cx, cy, x, y, kind, value FROM live WHERE cx * cx + cy * cy <= 4")
def r05_ball_area(spark, sf_dir):
    """All blocks of the chunks within two chunks of the origin."""
    e = Events(spark, sf_dir)
    found = area.select(e.geometry.addressed(e.live, large=True), area.Ball((0, 0), 2), e.geometry)
    return found.select("cx", "cy", "x", "y", *big("kind"), "value")


@query("SELECT cx, cy, cz, x, y, z, qty FROM volume WHERE (cx - 3) * (cx - 3) + (cy - 1) * (cy - 1) + cz * cz <= 9")
def r05_ball_volume(spark, sf_dir):
    g = Lines(spark, sf_dir, dims=3)
    found = area.select(g.geometry.addressed(g.live, large=True), area.Ball((3, 1, 0), 3), g.geometry)
    return found.select("cx", "cy", "cz", "x", "y", "z", *big("qty"))


@query("SELECT count(*) AS n FROM live WHERE cx BETWEEN -9 AND 9")
def r05_ball_wide(spark, sf_dir):
    """A radius whose square needs more than 64 bits."""
    e = Events(spark, sf_dir)
    found = area.select(e.geometry.addressed(e.live), area.Ball((2**62, 0), 2**62 + 9), e.geometry)
    low = area.select(e.geometry.addressed(e.live), area.Ball((-(2**62), 0), 2**62 + 9), e.geometry)
    return found.select("x", "y").unionByName(low.select("x", "y")).distinct().agg(F.count("*").alias("n"))


@query("SELECT cx, cy, idx, value FROM live WHERE cx BETWEEN -1 AND 0 AND cy BETWEEN -1 AND 0")
def r06_area_projection(spark, sf_dir):
    e = Events(spark, sf_dir)
    found = area.select(e.geometry.addressed(e.live.drop("kind", "rev")), area.Box((-1, -1), (0, 0)), e.geometry)
    return found.select("cx", "cy", e.geometry.local_index().alias("idx"), "value")


@query("SELECT cx, cy, blocks, version FROM ident WHERE blocks > 0 AND cx * cx + cy * cy <= 4 AND (cx, cy) IN (SELECT cx, cy FROM (SELECT a.cx, b.cy FROM range(-2, 3) a(cx), range(-2, 3) b(cy) WHERE a.cx * a.cx + b.cy * b.cy <= 4 AND (a.cx > -1 OR (a.cx = -1 AND b.cy > 0)) ORDER BY 1, 2 LIMIT 6))")
def r07_area_page(spark, sf_dir):
    """Six requested cells of a ball after (-1, 0): empty cells count, populated chunks are returned."""
    e = Events(spark, sf_dir)
    populated = e.identities.where("populated")
    found = area.page(populated, area.Ball((0, 0), 2), e.geometry, limit=6, after=(-1, 0))
    return found.chunks.select("cx", "cy", "blocks", "version")


@query("SELECT cx, cy, n FROM (SELECT cx, cy, n, sum(n * 17 + 24) OVER (ORDER BY cx, cy) AS total FROM (SELECT cx, cy, count(*) AS n FROM live GROUP BY cx, cy) WHERE cx BETWEEN -2 AND 1 AND cy BETWEEN -4 AND 3) WHERE total <= 12000")
def r08_area_budget(spark, sf_dir):
    """A page ends before the chunk that would go over the byte budget."""
    e = Events(spark, sf_dir)
    counts = e.geometry.addressed(e.live).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    found = area.page(counts, area.Box((-2, -4), (1, 3)), e.geometry)
    return area.budgeted(found.chunks, e.geometry, F.col("n") * 17 + 24, 12000).select("cx", "cy", "n")


@query("SELECT cx, cy, version FROM ident WHERE blocks > 0 AND (cx > -1 OR (cx = -1 AND cy > -2)) ORDER BY cx, cy LIMIT 11")
def r10_identity_scan(spark, sf_dir):
    """A page of ten identities after (-1, -2), and one more row that says there is more."""
    e = Events(spark, sf_dir)
    return wl.scan(e.identities, e.geometry, after=(-1, -2), limit=10).select("cx", "cy", "version")


@query("SELECT cx, cy, version, blocks > 0 AS populated FROM ident WHERE version > 300 ORDER BY cx, cy LIMIT 1025", side=2)
def r11_incremental_scan(spark, sf_dir):
    """Identities with a version above a revision, emptied chunks included."""
    e = Events(spark, sf_dir, side=2)
    return wl.scan(e.identities, e.geometry, since=300, limit=1024).select("cx", "cy", "version", "populated")


@query("SELECT i.cx, i.cy, i.version, l.idx, l.value FROM ident i LEFT JOIN live l USING (cx, cy) WHERE i.version > 300", side=2)
def r12_scan_with_data(spark, sf_dir):
    """Changed identities with their blocks; a deletion has a row without data."""
    e = Events(spark, sf_dir, side=2)
    changed = e.identities.where("version > 300").select("cx", "cy", "version")
    blocks = e.geometry.addressed(e.live).select("cx", "cy", e.geometry.local_index().alias("idx"), "value")
    return changed.join(blocks, ["cx", "cy"], "left").select("cx", "cy", "version", "idx", "value")


@query("SELECT max(version) AS revision, CAST(2 AS BIGINT) AS dims, CAST(sum(CASE WHEN blocks > 0 THEN 0 ELSE 1 END) AS BIGINT) AS tombstones, CAST(0 AS BIGINT) AS retained_deletion_floor FROM ident", side=2)
def r13_table_stats(spark, sf_dir):
    e = Events(spark, sf_dir, side=2)
    return wl.stats(e.identities, e.geometry)


@query("SELECT coalesce(i.cx, m.cx) AS cx, coalesce(i.cy, m.cy) AS cy, greatest(coalesce(i.version, 0), m.rev) AS version, coalesce(i.blocks, 0) > 0 OR m.owner <> 0 AS populated FROM meta m LEFT JOIN ident i ON i.cx = m.cx AND i.cy = m.cy")
def r16_populated(spark, sf_dir):
    """A chunk is populated by a block or by metadata that isn't the baseline; chunks without blocks count too."""
    e = Events(spark, sf_dir)
    return wl.identities(e.log, e.schema, e.geometry, meta=e.meta).select("cx", "cy", "version", "populated")


@query(f"SELECT x, y, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist WHERE rev <= {SNAPSHOT}) WHERE k = 1 AND here")
def r17_snapshot_read(spark, sf_dir):
    """The state at a revision."""
    e = Events(spark, sf_dir)
    return wl.fold(e.log, e.schema, e.geometry, upto=SNAPSHOT).select("x", "y", *big("kind"), "value")


@query("SELECT x, y, kind, value, rev FROM live")
def w01_upsert_state(spark, sf_dir):
    """The live state: partial sets keep other columns, a set after a delete starts from initial values."""
    return Events(spark, sf_dir).live.select("x", "y", *big("kind"), "value", "rev")


@query("SELECT rev, x, y, effective FROM hist")
def w02_noop_writes(spark, sf_dir):
    """Whether each write changed anything: identical sets and deletes of absent blocks don't."""
    return Events(spark, sf_dir).history.select("rev", "x", "y", "effective")


@query("SELECT x, y, rev FROM hist WHERE op = 'D' AND effective")
def w03_deletes(spark, sf_dir):
    return Events(spark, sf_dir).history.where("op = 'D' and effective").select("x", "y", "rev")


@query("SELECT r.x, r.y, r.want AS if_version, i.version AS current, coalesce(i.version = r.want, false) AS ok FROM (SELECT x, y, CASE WHEN rev % 2 = 0 THEN rev ELSE (SELECT max(version) FROM ident j WHERE j.cx = l.cx AND j.cy = l.cy) END AS want, cx, cy FROM live l) r LEFT JOIN ident i USING (cx, cy)")
def w04_compare_and_set(spark, sf_dir):
    """Conditional writes: a block's write goes ahead only if its chunk's version is still the given one."""
    e = Events(spark, sf_dir)
    versions = e.identities
    wanted = e.geometry.addressed(e.live).join(versions.select("cx", "cy", "version"), ["cx", "cy"])
    requests = wanted.select("x", "y", "cx", "cy", F.expr("if(rev % 2 = 0, rev, version)").alias("if_version"))
    return wl.check_versions(requests, versions, e.geometry).select("x", "y", "if_version", "current", "ok")


@query("SELECT r.cx, r.cy FROM (SELECT cx, cy FROM range(-4, 5) a(cx), range(-5, 6) b(cy)) r WHERE NOT EXISTS (SELECT 1 FROM ident i WHERE i.cx = r.cx AND i.cy = r.cy AND i.blocks > 0)")
def w05_put_if_absent(spark, sf_dir):
    """Chunk writes that IF ABSENT lets through."""
    e = Events(spark, sf_dir)
    requests = spark.range(-4, 5).select(F.col("id").alias("cx")).select("cx", F.explode(F.sequence(F.lit(-5).cast("long"), F.lit(5).cast("long"))).alias("cy"))
    return wl.absent_only(requests, e.identities, e.geometry)


@query("SELECT x, y, kind, value FROM live WHERE NOT (cx = 0 AND cy BETWEEN -1 AND 0) UNION ALL SELECT x + 16, y, CAST((kind + 1) % 8 AS BIGINT), value FROM live WHERE cx = -1 AND cy = 0")
def w06_replace_chunk(spark, sf_dir):
    """Two chunks replaced as a whole: one by a neighbour's shifted blocks, the other by nothing."""
    e = Events(spark, sf_dir)
    blocks = e.live.select("x", "y", "kind", "value")
    form = e.geometry.addressed(blocks).where("cx = -1 and cy = 0").select((F.col("x") + 16).alias("x"), "y", ((F.col("kind") + 1) % 8).cast("tinyint").alias("kind"), "value")
    written = spark.createDataFrame([(0, 0), (0, -1)], "cx long, cy long")
    return wl.replace_chunks(blocks, form, written, e.geometry).select("x", "y", *big("kind"), "value")


@query("SELECT x, y, kind, value FROM live WHERE NOT (cx = 0 AND cy = 0) UNION ALL SELECT n.x, n.y, n.kind, coalesce(o.value, 0.0) FROM (SELECT x + 16 AS x, y, kind FROM live WHERE cx = -1 AND cy = 0) n LEFT JOIN live o ON o.x = n.x AND o.y = n.y")
def w07_merge_chunk(spark, sf_dir):
    """A projected chunk write: presence and ``kind`` replaced, ``value`` kept where a block goes on, initial where it is new."""
    e = Events(spark, sf_dir)
    blocks = e.live.select("x", "y", "kind", "value")
    form = e.geometry.addressed(blocks).where("cx = -1 and cy = 0").select((F.col("x") + 16).alias("x"), "y", "kind")
    written = spark.createDataFrame([(0, 0)], "cx long, cy long")
    return wl.merge_chunks(blocks, form, written, e.schema, e.geometry, ["kind"]).select("x", "y", *big("kind"), "value")


@query("SELECT cx, cy, owner, owner <> 0 AS differs FROM meta")
def w08_meta_state(spark, sf_dir):
    """Chunk metadata and whether it differs from the baseline."""
    e = Events(spark, sf_dir)
    return wl.meta_state(e.meta, e.schema, e.geometry).select("cx", "cy", *big("owner"), "differs")


@query("SELECT cx, cy, CAST(sum(octet_length(encode(flag)) + 12) AS BIGINT) AS var_bytes FROM lines GROUP BY cx, cy")
def w11_variable_bytes(spark, sf_dir):
    g = Lines(spark, sf_dir)
    return wl.var_bytes(g.live, g.schema, g.geometry)


@query("SELECT cx, cy, version, commit_time_ms FROM ident WHERE blocks = 0", side=2)
def w15_tombstones(spark, sf_dir):
    """Chunks whose last block was deleted, with the version and time of that."""
    return Events(spark, sf_dir, side=2).identities.where("not populated").select("cx", "cy", "version", "commit_time_ms")


@query("SELECT cx, cy, version, blocks > 0 AS populated FROM ident WHERE blocks > 0 OR version > 400", side=2)
def w16_compact_tombstones(spark, sf_dir):
    """Identities after tombstones before revision 401 were forgotten."""
    e = Events(spark, sf_dir, side=2)
    return wl.identities(e.log, e.schema, e.geometry, floor=400).select("cx", "cy", "version", "populated")


@query(f"SELECT cx, cy, version FROM ident i WHERE version > {SNAPSHOT} AND cx * cx + cy * cy <= 4")
def t06_commit_conflicts(spark, sf_dir):
    """Chunks of a transaction's read set that changed after its snapshot."""
    e = Events(spark, sf_dir)
    touched = area.select(e.identities, area.Ball((0, 0), 2), e.geometry)
    return wl.conflicts(touched, e.identities, e.geometry, SNAPSHOT).select("cx", "cy", "version")


@query(f"SELECT s.x, s.y, CASE WHEN s.x % 3 = 0 THEN 7 ELSE s.kind END AS kind, s.value FROM (SELECT x, y, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist WHERE rev <= {SNAPSHOT}) WHERE k = 1 AND here) s WHERE s.y % 5 <> 0")
def t03_read_your_writes(spark, sf_dir):
    """A snapshot with a transaction's own writes over it."""
    e = Events(spark, sf_dir)
    snapshot = wl.fold(e.log, e.schema, e.geometry, upto=SNAPSHOT).select("x", "y", "kind", "value")
    private = snapshot.where("x % 3 = 0 or y % 5 = 0").select("x", "y", F.lit(7).cast("tinyint").alias("kind"), "value", F.expr("if(y % 5 = 0, 'D', 'S')").alias("op"))
    return wl.overlay(snapshot, private, e.geometry).select("x", "y", *big("kind"), "value")


CHANGES = "SELECT rev, commit_time_ms, \"user\", cx, cy, x, y, was AS had, kind0 AS kind_before, value0 AS value_before, here AS has, kind AS kind_after, value AS value_after FROM hist WHERE effective"


def _flat(changes: DataFrame) -> DataFrame:
    return changes.select(
        "rev", "commit_time_ms", "user", "cx", "cy", "x", "y", F.col("before").isNotNull().alias("had"), F.col("before.kind").cast("long").alias("kind_before"), F.col("before.value").alias("value_before"),
        F.col("after").isNotNull().alias("has"), F.col("after.kind").cast("long").alias("kind_after"), F.col("after.value").alias("value_after"),
    )


@query(CHANGES)
def f02_changes(spark, sf_dir):
    """Every committed change with the block's row before and after."""
    e = Events(spark, sf_dir)
    return _flat(feed.changes(e.log, e.schema, e.geometry))


@query(CHANGES + " AND rev > 250 AND cx BETWEEN -1 AND 1 AND cy BETWEEN -2 AND 0")
def f05_area_changes(spark, sf_dir):
    """The changes after a position, clipped to an area of chunks."""
    e = Events(spark, sf_dir)
    return _flat(feed.changes(e.log, e.schema, e.geometry, after=250, area=area.Box((-1, -2), (1, 0))))


@query("SELECT rev, x, y, value0 AS value_before, value AS value_after FROM hist WHERE effective")
def f06_column_changes(spark, sf_dir):
    e = Events(spark, sf_dir)
    found = feed.changes(e.log, e.schema, e.geometry, columns=["value"])
    return found.select("rev", "x", "y", F.col("before.value").alias("value_before"), F.col("after.value").alias("value_after"))


@query("SELECT rev, x, y, here AS has, kind AS kind_after FROM hist WHERE effective")
def f07_no_before(spark, sf_dir):
    e = Events(spark, sf_dir)
    found = feed.changes(e.log, e.schema, e.geometry, before=False)
    return found.select("rev", "x", "y", F.col("after").isNotNull().alias("has"), F.col("after.kind").cast("long").alias("kind_after"))


@query("SELECT c.rev, c.cx, c.cy, CAST(count(s.idx) AS BIGINT) AS blocks, CAST(coalesce(sum(s.idx * (s.kind + 1)), 0) AS BIGINT) AS content FROM (SELECT DISTINCT rev, cx, cy FROM hist WHERE effective) c LEFT JOIN LATERAL (SELECT idx, kind FROM (SELECT idx, kind, here, row_number() OVER (PARTITION BY idx ORDER BY rev DESC) AS k FROM hist h WHERE h.cx = c.cx AND h.cy = c.cy AND h.rev <= c.rev) WHERE k = 1 AND here) s ON true GROUP BY c.rev, c.cx, c.cy")
def f08_chunk_forms(spark, sf_dir):
    """Each touched chunk's whole form after each commit, here summed up, for all chunks."""
    e = Events(spark, sf_dir)
    forms = feed.chunk_forms_at_commits(e.log, e.schema, e.geometry)
    content = F.expr("aggregate(cells, 0L, (s, c) -> s + c.index * (c.row.kind + 1))")
    return forms.select("rev", "cx", "cy", F.size("cells").cast("long").alias("blocks"), content.alias("content"))


@query("SELECT min(rev) AS rev, CASE WHEN rev >= 700 THEN 3 WHEN rev >= 300 THEN 2 ELSE 1 END AS schema_version FROM hist WHERE effective GROUP BY 2")
def f09_schema_events(spark, sf_dir):
    """The first change under each schema version; its column description goes before it."""
    e = Events(spark, sf_dir)
    return feed.schema_events(feed.changes(e.log, e.schema, e.geometry), [(0, 1), (300, 2), (700, 3)])


@query("SELECT CAST(max(rev) AS BIGINT) AS frontier, CAST(count(*) AS BIGINT) AS changes FROM hist WHERE effective")
def f10_progress(spark, sf_dir):
    e = Events(spark, sf_dir)
    return feed.changes(e.log, e.schema, e.geometry).agg(F.max("rev").alias("frontier"), F.count("*").alias("changes"))


@query("SELECT l.x, l.y, l.qty, p.p_size AS size, p.p_name AS name FROM lines l JOIN part p ON p.p_partkey = l.x")
def p01_coordinate_join(spark, sf_dir):
    """Rows of two tables matched by coordinate."""
    g = Lines(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    return patterns.match(g.live, parts, ["x"]).select("x", "y", *big("qty"), "size", "name")


@query("SELECT flag, discount, x, y FROM lines WHERE discount >= 0.09 AND qty = 50")
def p02_lookup_by_value(spark, sf_dir):
    g = Lines(spark, sf_dir)
    return patterns.by_value(g.live, (F.col("discount") >= 0.09) & (F.col("qty") == 50)).select("flag", "discount", "x", "y")


@query("SELECT l.cx, l.cy, CAST(max(l.kind) AS BIGINT) AS top_kind, max(l.value) AS top_value, max(i.version) AS source_version FROM live l JOIN ident i USING (cx, cy) GROUP BY l.cx, l.cy")
def p03_chunk_summary(spark, sf_dir):
    """Per chunk, the highest values and the version they come from."""
    e = Events(spark, sf_dir)
    found = patterns.summary(e.live, e.identities, e.geometry, top_kind=F.max("kind"), top_value=F.max("value"))
    return found.select("cx", "cy", *big("top_kind"), "top_value", "source_version")


@query("SELECT l.cx, l.cy, max(l.value) AS top_value, max(i.version) AS source_version FROM live l JOIN ident i USING (cx, cy) GROUP BY l.cx, l.cy")
def p04_incremental_summary(spark, sf_dir):
    """A summary of revision 500 brought up to date from the changes after it: the same as one made anew."""
    e = Events(spark, sf_dir)
    old_ident = wl.identities(e.log, e.schema, e.geometry, upto=SNAPSHOT)
    old = patterns.summary(wl.fold(e.log, e.schema, e.geometry, upto=SNAPSHOT), old_ident, e.geometry, top_value=F.max("value"))
    later = feed.changes(e.log, e.schema, e.geometry, after=SNAPSHOT)
    return patterns.refresh(old, later, e.live, e.identities, e.geometry, top_value=F.max("value")).select("cx", "cy", "top_value", "source_version")


@query("SELECT flag, CAST(count(*) AS BIGINT) AS n, CAST(sum(qty) AS BIGINT) AS total FROM lines GROUP BY flag")
def p05_group_by(spark, sf_dir):
    g = Lines(spark, sf_dir)
    return g.live.groupBy("flag").agg(F.count("*").alias("n"), F.sum("qty").alias("total"))


@query("SELECT rev, CAST(sum(CASE WHEN NOT was THEN 1 WHEN NOT here THEN -1 ELSE 0 END) OVER (ORDER BY rev) AS BIGINT) AS blocks FROM hist WHERE effective")
def p05_running_total(spark, sf_dir):
    """Number of present blocks after each commit, from the changes; summed by range first, so no task orders the whole log."""
    e = Events(spark, sf_dir)
    step = F.expr("case when before is null then 1 when after is null then -1 else 0 end")
    return patterns.running_total(feed.changes(e.log, e.schema, e.geometry).select("rev", step.cast("long").alias("step")), "rev", "step", "blocks")


@query("SELECT x, y, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist WHERE rev < (SELECT min(rev) FROM log WHERE commit_time_ms > (SELECT commit_time_ms FROM log WHERE rev = 600))) WHERE k = 1 AND here")
def p06_rebuild_at_time(spark, sf_dir):
    """The state at a time: all revisions before the first that is later."""
    e = Events(spark, sf_dir)
    at = e.log.where("rev = 600").first()["commit_time_ms"]
    return patterns.rebuild_at_time(e.log, e.schema, e.geometry, at).select("x", "y", *big("kind"), "value")


@query("SELECT f.frame, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(s.kind) AS BIGINT) AS kinds FROM (VALUES (200), (400), (800)) f(frame) JOIN LATERAL (SELECT kind FROM (SELECT kind, here, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM hist WHERE rev <= f.frame) WHERE k = 1 AND here) s ON true GROUP BY f.frame")
def p07_timelapse(spark, sf_dir):
    """The state at several revisions, in one pass over the log."""
    e = Events(spark, sf_dir)
    frames = patterns.timelapse(e.log, e.schema, e.geometry, [200, 400, 800])
    return frames.groupBy("frame").agg(F.count("*").alias("blocks"), F.sum("kind").alias("kinds")).select(F.col("frame").cast("int").alias("frame"), "blocks", "kinds")


@query("SELECT x, y, kind, value FROM live")
def p08_snapshot_and_journal(spark, sf_dir):
    """A snapshot and the journal after it give the live state; entries the snapshot holds are skipped."""
    e = Events(spark, sf_dir)
    snapshot = wl.fold(e.log, e.schema, e.geometry, upto=SNAPSHOT)
    versions = wl.identities(e.log, e.schema, e.geometry, upto=SNAPSHOT)
    journal = feed.changes(e.log, e.schema, e.geometry, after=SNAPSHOT // 2)
    return patterns.replay(snapshot, versions, journal, e.schema, e.geometry).select("x", "y", *big("kind"), "value")


@query("SELECT rev, x, y FROM hist WHERE effective")
def p09_idempotent_consumer(spark, sf_dir):
    """Deliveries that repeat count once."""
    e = Events(spark, sf_dir)
    found = feed.changes(e.log, e.schema, e.geometry)
    twice = found.unionByName(found.where("rev > 700")).withColumn("epoch", F.lit("e"))
    return patterns.deduplicate(twice, [*e.geometry.blocks]).select("rev", "x", "y")


@query(f"SELECT m.owner, CAST(count(*) AS BIGINT) AS blocks, CAST(min(m.rev) AS BIGINT) - {META_BASE} AS first FROM live l JOIN meta m USING (cx, cy) WHERE m.owner >= 4 GROUP BY m.owner")
def e03_chunk_column(spark, sf_dir):
    """Blocks joined with their chunk's metadata."""
    e = Events(spark, sf_dir)
    m = wl.meta_state(e.meta, e.schema, e.geometry).select("cx", "cy", "owner", "rev")
    found = e.geometry.addressed(e.live.drop("rev")).join(m, ["cx", "cy"]).where("owner >= 4")
    return found.groupBy(F.col("owner").cast("long").alias("owner")).agg(F.count("*").alias("blocks"), (F.min("rev") - META_BASE).alias("first"))
