"""Stored tables: the events table committed to a store in four revisions, then read, altered, swapped, restored and followed.

Each query works on a copy that it restores from a backup of the filled store, so no query sees another's writes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators import area as areas
from gridlake.plans.statements import Session
from gridlake.plans.views import fdiv, table
from gridlake.sources.store import Store, Transaction

COMMITS = 4
QUERIES: dict = {}
SQL: dict[str, str] = {}
_FILLED: dict[tuple[str, str], str] = {}

#: Batches (the last write of each block in a quarter of the events), their history, live blocks and chunk versions.
CTE = f"""
WITH e AS (
  SELECT event_id, event_id * {COMMITS} // (SELECT max(event_id) + 1 FROM events) + 1 AS rev, user_id % 64 - 32 AS x, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) - 50 AS y,
    CASE WHEN event_type = 'error' THEN 'D' ELSE 'S' END AS op, CAST(CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS BIGINT) AS kind,
    CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN coalesce(value, 0.0) ELSE 0.0 END AS value FROM events),
b AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY rev, x, y ORDER BY event_id DESC) AS k FROM e) WHERE k = 1),
c AS (
  SELECT *, coalesce(lag(op) OVER w, 'D') = 'S' AS was, lag(kind) OVER w AS kind0, lag(value) OVER w AS value0 FROM b WINDOW w AS (PARTITION BY x, y ORDER BY rev)),
h AS (SELECT *, CASE WHEN op = 'D' THEN was ELSE NOT was OR kind <> kind0 OR value <> value0 END AS effective, {fdiv("x", 16)} AS cx, {fdiv("y", 16)} AS cy FROM c),
live AS (SELECT x, y, kind, value, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM h) WHERE k = 1 AND op = 'S'),
half AS (SELECT x, y, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rev DESC) AS k FROM h WHERE rev <= 2) WHERE k = 1 AND op = 'S'),
versions AS (SELECT cx, cy, max(rev) AS version FROM h WHERE effective GROUP BY cx, cy)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = CTE + sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: in ``spark.checkpoint.dir``; where that is unset, temporary in local mode and else beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        root = tempfile.mkdtemp(prefix="gridlake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}".rstrip("/") + f"/grids-{uuid.uuid4().hex}"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rev, x, y, op, kind, value): what each commit writes."""
    e = table(spark, sf_dir, "events")
    total = (e.agg(F.max("event_id").alias("m")).first().m or 0) + 1
    row = F.struct(
        F.expr("if(event_type = 'error', 'D', 'S')").alias("op"),
        F.expr("case event_type when 'signup' then 2 when 'view' then 3 else 0 end").cast("tinyint").alias("kind"),
        F.expr("if(event_type in ('click', 'signup', 'purchase'), coalesce(value, 0D), 0D)").alias("value"),
    )
    at = [F.expr(f"event_id * {COMMITS} div {total} + 1").alias("rev"), F.expr("user_id % 64 - 32").alias("x"), (F.get_json_object("props", "$.k").cast("long") - 50).alias("y")]
    return e.groupBy(*at).agg(F.max_by(row, "event_id").alias("row")).select("rev", "x", "y", "row.*")


def backups(spark: SparkSession, sf_dir: str) -> str:
    """A folder with backups of the filled store: ``half`` after two commits, ``full`` after all.  Made once for a session and an input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILLED:
        root = shared_folder(spark)
        store = Store(spark, f"{root}/store")
        run = Session(store).run
        run("CREATE TABLE land (kind u3, value f64) CHUNK 16 x 16 LARGE 8 x 8")
        rows = batches(spark, sf_dir)
        for n in range(1, COMMITS + 1):
            store.table("land").write(rows.where(F.col("rev") == n).drop("rev"))
            if n == 2:
                run(f"BACKUP TO '{root}/half'")
        run(f"BACKUP TO '{root}/full'")
        _FILLED[key] = root
    return _FILLED[key]


def opened(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A store of its own with the table ``land`` of each backup, under the backup's name."""
    root = backups(spark, sf_dir)
    session = Session(Store(spark, shared_folder(spark)))
    for name in names:
        session.run(f"RESTORE TABLE land FROM '{root}/{name}' AS {name}")
    return session


def cells(rows: DataFrame) -> DataFrame:
    return rows.select("x", "y", F.col("kind").cast("long").alias("kind"), "value")


@query("SELECT l.cx, l.cy, v.version, count(*) AS n, CAST(sum(l.kind) AS BIGINT) AS kinds FROM live l JOIN versions v USING (cx, cy) WHERE l.cx BETWEEN -1 AND 1 AND l.cy BETWEEN -2 AND 1 GROUP BY ALL")
def s01_stored_area(spark, sf_dir):
    """An area of a stored table, pruned by its partitions: populated chunks with version and blocks."""
    found = opened(spark, sf_dir, "full").run("GET AREA -1 -2 TO 1 1 FROM full")
    return found.select("cx", "cy", "version", F.size("cells").cast("long").alias("n"), F.expr("aggregate(cells, 0L, (s, c) -> s + c.kind)").alias("kinds"))


@query("SELECT x, y, kind, value FROM half")
def s02_stored_snapshot(spark, sf_dir):
    """A stored table as it was after its second commit."""
    return cells(opened(spark, sf_dir, "full").store.table("full").blocks(upto=2))


@query("SELECT rev, x, y, CASE WHEN was THEN kind0 END AS kind0, CASE WHEN op = 'S' THEN kind END AS kind, CASE WHEN op = 'S' THEN value END AS value FROM h WHERE effective AND rev > 2")
def s03_stored_changes(spark, sf_dir):
    """All that changed after a position of the log, from stored segments."""
    session = opened(spark, sf_dir, "full")
    found = session.run(f"WATCH full AFTER '{session.run('DESCRIBE full')['epoch']}' 2")["changes"]
    return found.select("rev", "x", "y", F.col("before.kind").cast("long").alias("kind0"), F.col("after.kind").cast("long").alias("kind"), F.col("after.value").alias("value"))


@query("SELECT x, y, CASE WHEN x >= 0 THEN kind + 10 ELSE kind END AS kind, value, CASE WHEN x >= 0 AND y >= 0 THEN 'far' ELSE 'none' END AS note FROM live")
def s04_stored_schema_change(spark, sf_dir):
    """Columns are widened and added over old segments; a write under the new schema names some of them."""
    session = opened(spark, sf_dir, "full")
    session.run("ALTER TABLE full ALTER COLUMN kind TYPE u8")
    session.run("ALTER TABLE full ADD COLUMN note text(8) DEFAULT 'none'")
    land = session.store.table("full")
    land.write(land.blocks().where("x >= 0").select("x", "y", (F.col("kind") + 10).alias("kind")))
    land.write(land.blocks().where("x >= 0 and y >= 0").select("x", "y", F.lit("far").alias("note")))
    return land.blocks().select("x", "y", F.col("kind").cast("long").alias("kind"), "value", "note")


@query("SELECT x, y, kind, value FROM live WHERE NOT (cx = 0 AND cy = 0) UNION ALL VALUES (5000, 5000, 1, 2.5::DOUBLE), (9000, 9000, 2, 0.5::DOUBLE)")
def s05_stored_transaction(spark, sf_dir):
    """A transaction empties one chunk and sets a block while another writer commits elsewhere; it commits as one revision."""
    land = opened(spark, sf_dir, "full").store.table("full")
    txn = Transaction(land)
    txn.write(txn.blocks(areas.Box((0, 0), (0, 0))).select("x", "y").withColumn("op", F.lit("D")))
    txn.write(spark.createDataFrame([(5000, 5000, 1, 2.5)], "x long, y long, kind int, value double"))
    land.write(spark.createDataFrame([(9000, 9000, 2, 0.5)], "x long, y long, kind int, value double"))
    txn.commit()
    return cells(land.blocks())


@query("SELECT 'full' AS name, 2 AS revision, 2 AS parent, (SELECT count(*) FROM half) AS blocks UNION ALL SELECT 'half', 4, 4, (SELECT count(*) FROM live)")
def s06_stored_catalog(spark, sf_dir):
    """Two backups restored, their names swapped, then listed and described."""
    session = opened(spark, sf_dir, "half", "full")
    session.run("SWAP TABLES half, full")
    found = []
    for name in session.run("SHOW TABLES"):
        d = session.run(f"DESCRIBE {name}")
        found.append((name, d["revision"], d["lineage"][1], session.store.table(name).blocks().count()))
    return spark.createDataFrame(found, "name string, revision int, parent int, blocks long")


@query("SELECT rev, x, y, CASE WHEN op = 'S' THEN kind END AS kind FROM h WHERE effective AND rev = 4 AND cx BETWEEN -1 AND 0 AND cy BETWEEN -2 AND 2")
def s07_stored_slot(spark, sf_dir):
    """A slot on an area gets what is committed after it was made; what it acknowledged doesn't come again."""
    session = opened(spark, sf_dir, "half")
    session.run("CREATE SLOT 's' ON half AREA -1 -2 TO 0 2")
    rows = batches(spark, sf_dir)
    for n in (3, 4):
        session.store.table("half").write(rows.where(F.col("rev") == n).drop("rev"))
        if n == 3:
            session.run("WATCH half SLOT 's'")
            session.run("ACK 3 SLOT 's'")
    found = session.run("WATCH half SLOT 's'")["changes"]
    return found.select("rev", "x", "y", F.col("after.kind").cast("long").alias("kind"))


@query("SELECT cx, cy, version, cx IN (SELECT cx FROM live l WHERE l.cx = v.cx AND l.cy = v.cy) AS populated FROM versions v WHERE version > 2")
def s08_stored_scan(spark, sf_dir):
    """All chunks with a version above a revision, tombstones too, page by page."""
    session, after, found = opened(spark, sf_dir, "full"), "", None
    while True:
        page = session.run(f"SCAN CHUNKS FROM full SINCE 2 LIMIT 1000{after}")
        found = page["chunks"] if found is None else found.unionByName(page["chunks"])
        if not page["more"]:
            return found.select("cx", "cy", "version", "populated")
        last = page["chunks"].orderBy(F.desc("cx"), F.desc("cy")).first()
        after = f" AFTER {last.cx} {last.cy}"
