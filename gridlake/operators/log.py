"""The write log and what follows from it: current state, history, versions, tombstones.

A log row is one write of a block: ``rev``, ``commit_time_ms``, ``user``, the block's coordinates, ``op`` ('S' sets, 'D' deletes),
``names`` (the columns a set names; null means all) and the columns.  ``rev`` orders the log; one revision writes a
block at most once.

* ``fold`` gives the state at a revision.  It is one aggregation of maxima, so hot blocks are combined before the shuffle.
* ``history`` gives the state before and after each write, and whether the write changed anything.  It needs order within a
  block; a block's log is cut into ranges of ``span`` revisions that start from the fold of the ranges before, so that
  a block with any share of the log is spread over tasks.
* Versions count only writes that changed something.
"""

from __future__ import annotations

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.geometry import Geometry
from gridlake.schema import Column, Schema

SPAN = 1 << 20


def named(column: Column) -> Col:
    """Whether a log row sets the column."""
    return (F.col("op") == "S") & (F.col("names").isNull() | F.array_contains("names", column.name))


def same(a: Col, b: Col, column: Column) -> Col:
    """Equality of stored values: nulls are equal, floats by their bits, so that -0.0 and 0.0 differ and NaN equals itself."""
    if column.type.family == "float":
        a, b = F.hex(_bits(a)), F.hex(_bits(b))
    return a.eqNullSafe(b)


def _bits(value: Col) -> Col:
    # text of a float tells -0.0 from 0.0, and round-trips
    return value.cast("string")


def _last(column: Column) -> Col:
    """Latest set of a column, as (rev, value): the value may be null."""
    return F.max(F.when(named(column), F.struct(F.col("rev").alias("r"), F.col(f"`{column.name}`").alias("v"))))


def _lasts(columns) -> list[Col]:
    """``_last`` of all columns as two aggregates each, revision and value: fixed-width values then stay in a hash aggregate, which a struct doesn't."""
    out = []
    for c in columns:
        at = F.when(named(c), F.col("rev"))
        out += [F.max(at).alias(f"_r{c.id}"), F.max_by(F.col(f"`{c.name}`"), at).alias(f"_v{c.id}")]
    return out


def _paired(found: DataFrame, columns) -> DataFrame:
    """The aggregates of ``_lasts`` as (rev, value)."""
    pairs = {f"_l{c.id}": F.when(F.col(f"_r{c.id}").isNotNull(), F.struct(F.col(f"_r{c.id}").alias("r"), F.col(f"_v{c.id}").alias("v"))) for c in columns}
    return found.withColumns(pairs).drop(*[f"_{k}{c.id}" for c in columns for k in "rv"]) if pairs else found


def _state(schema: Schema, deleted: Col) -> list[Col]:
    """Column values from ``_last`` results: those set since the last delete, else the initial value."""
    since = F.coalesce(deleted, F.lit(-1).cast("long"))
    return [F.when(F.col(f"_l{c.id}.r") > since, F.col(f"_l{c.id}.v")).otherwise(c.initial_col()).alias(c.name) for c in schema.columns]


def fold(log: DataFrame, schema: Schema, geometry: Geometry, *, upto: int | None = None) -> DataFrame:
    """Blocks present at revision ``upto`` (default: the last): coordinates, columns, ``rev`` of the last write."""
    if upto is not None:
        log = log.where(F.col("rev") <= upto)
    found = log.groupBy(*geometry.blocks).agg(
        F.max(F.when(F.col("op") == "D", F.col("rev"))).alias("_deleted"),
        F.max(F.when(F.col("op") == "S", F.col("rev"))).alias("_set"),
        *_lasts(schema.columns),
    )
    found = _paired(found, schema.columns)
    there = found.where(F.col("_set") > F.coalesce("_deleted", F.lit(-1)))
    return there.select(*geometry.blocks, *_state(schema, F.col("_deleted")), F.col("_set").alias("rev"))


def history(log: DataFrame, schema: Schema, geometry: Geometry, *, span: int = SPAN) -> DataFrame:
    """Log rows with ``before`` and ``after`` (structs of the columns; null if absent) and ``effective``."""
    keys, columns = geometry.blocks, schema.columns
    log = log.withColumn("_range", F.floor(F.col("rev") / F.lit(span)).cast("long") if span > 1 << 52 else F.expr(f"rev div {span}L"))
    per = log.groupBy(*keys, "_range").agg(
        F.max(F.when(F.col("op") == "D", F.col("rev"))).alias("_deleted"),
        F.max(F.when(F.col("op") == "S", F.col("rev"))).alias("_set"),
        *_lasts(columns),
    )
    per = _paired(per, columns)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_range", *[F.max(c).over(earlier).alias(c) for c in ("_deleted", "_set", *[f"_l{c.id}" for c in columns])])
    carried = carried.where(F.col("_set") > F.coalesce("_deleted", F.lit(-1)))
    start = carried.select(*keys, "_range", F.expr(f"_range * {span}L - 1").alias("rev"), F.lit("S").alias("op"), *_state(schema, F.col("_deleted")))
    rows = log.withColumn("_given", F.lit(True)).unionByName(start.withColumn("_given", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_range").orderBy("rev")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select("*", F.max(F.when(F.col("op") == "D", F.col("rev"))).over(so_far).alias("_deleted"), *[_last(c).over(so_far).alias(f"_l{c.id}") for c in columns])
    after = F.when(F.col("op") == "S", F.struct(*_state(schema, F.col("_deleted"))))
    chained = marked.withColumn("after", after).withColumn("before", F.lag("after").over(w))
    unchanged = F.col("before").isNotNull() & F.col("after").isNotNull()
    for c in columns:
        unchanged = unchanged & same(F.col(f"before.{c.name}"), F.col(f"after.{c.name}"), c)
    effective = ~(unchanged | (F.col("before").isNull() & F.col("after").isNull()))
    own = [c for c in log.columns if c != "_range"]
    return chained.withColumn("effective", effective).where("_given").select(*own, "before", "after", "effective")


def meta_state(meta: DataFrame, schema: Schema, geometry: Geometry, *, upto: int | None = None) -> DataFrame:
    """Chunk metadata at a revision: chunk coordinates, columns, ``rev`` and ``differs`` (from the baseline row).

    A metadata log row has ``rev``, ``commit_time_ms``, chunk coordinates, ``names`` and the chunk columns.
    """
    if upto is not None:
        meta = meta.where(F.col("rev") <= upto)
    meta = meta.withColumn("op", F.lit("S"))
    found = meta.groupBy(*geometry.chunks).agg(F.max("rev").alias("_rev"), F.max_by("commit_time_ms", "rev").alias("_time"), *_lasts(schema.chunk_columns))
    values = [F.when(F.col(f"_r{c.id}").isNotNull(), F.col(f"_v{c.id}")).otherwise(c.initial_col()).alias(c.name) for c in schema.chunk_columns]
    rows = found.select(*geometry.chunks, F.col("_rev").alias("rev"), F.col("_time").alias("commit_time_ms"), *values)
    baseline = F.lit(True)
    for c in schema.chunk_columns:
        baseline = baseline & same(F.col(c.name), c.initial_col(), c)
    return rows.withColumn("differs", ~baseline)


def identities(log: DataFrame, schema: Schema, geometry: Geometry, *, meta: DataFrame | None = None, upto: int | None = None, floor: int = 0, span: int = SPAN) -> DataFrame:
    """Chunks ever written: coordinates, ``version``, ``commit_time_ms``, ``blocks`` present, ``populated``.

    A chunk is populated if a block is present or its metadata differs from the baseline; otherwise it is a tombstone.  Tombstones
    with a version up to ``floor`` were forgotten.  Writes that changed nothing don't count.
    """
    if upto is not None:
        log = log.where(F.col("rev") <= upto)
    done = geometry.addressed(history(log, schema, geometry, span=span).where("effective").select("rev", "commit_time_ms", *geometry.blocks, "before", "after"))
    change = F.when(F.col("before").isNull(), 1).when(F.col("after").isNull(), -1).otherwise(0).cast("long")
    found = done.groupBy(*geometry.chunks).agg(F.max("rev").alias("version"), F.max_by("commit_time_ms", "rev").alias("commit_time_ms"), F.sum(change).alias("blocks"))
    found = found.withColumn("differs", F.lit(False))
    if meta is not None:
        m = meta_state(meta, schema, geometry, upto=upto).select(*geometry.chunks, F.col("rev").alias("version"), "commit_time_ms", F.lit(0).cast("long").alias("blocks"), "differs")
        both = found.unionByName(m).groupBy(*geometry.chunks)
        found = both.agg(F.max("version").alias("version"), F.max_by("commit_time_ms", "version").alias("commit_time_ms"), F.sum("blocks").alias("blocks"), F.max("differs").alias("differs"))
    rows = found.select(*geometry.chunks, "version", "commit_time_ms", "blocks", ((F.col("blocks") > 0) | F.col("differs")).alias("populated"))
    return rows.where(F.col("populated") | (F.col("version") > floor)) if floor else rows


def chunk_forms(blocks: DataFrame, schema: Schema, geometry: Geometry, columns: list[str] | None = None) -> DataFrame:
    """One row per chunk with present blocks: ``cells``, an array of (index, columns) by position.  A chunk holds at most its volume."""
    at = geometry.addressed(blocks)
    picked = [schema.column(c).name for c in columns] if columns else [c.name for c in schema.columns]
    cell = F.struct(geometry.local_index().alias("index"), *picked)
    return at.groupBy(*geometry.chunks).agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def scan(chunks: DataFrame, geometry: Geometry, *, after: tuple[int, ...] | None = None, limit: int = 1024, since: int | None = None, floor: int = 0) -> DataFrame:
    """One page of identities in coordinate order, one row more than ``limit`` if there is more.

    ``since`` selects versions above a revision, tombstones included; one below the deletion floor is refused.
    """
    from gridlake.schema import GridError, invalid

    if not 1 <= limit <= 1024:
        raise invalid("LIMIT must be from 1 to 1024")
    if since is not None:
        if since < floor:
            raise GridError("RESYNC_REQUIRED", f"reason=history_lost floor={floor}")
        chunks = chunks.where(F.col("version") > since)
    else:
        chunks = chunks.where("populated")
    if after is not None:
        row = F.struct(*[F.col(c) for c in geometry.chunks])
        chunks = chunks.where(row > F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(after, geometry.chunks)]))
    return chunks.orderBy(*geometry.chunks).limit(limit + 1)


def stats(chunks: DataFrame, geometry: Geometry, floor: int = 0) -> DataFrame:
    """Last revision, axes, tombstones and the deletion floor, in one row."""
    return chunks.agg(
        F.max("version").alias("revision"),
        F.lit(geometry.dims).cast("long").alias("dims"),
        F.sum(F.when(F.col("populated"), 0).otherwise(1)).cast("long").alias("tombstones"),
        F.lit(floor).cast("long").alias("retained_deletion_floor"),
    )


def replace_chunks(blocks: DataFrame, form: DataFrame, written: DataFrame, geometry: Geometry) -> DataFrame:
    """Blocks after whole chunks were replaced: ``form`` holds the new blocks, ``written`` the replaced chunks' coordinates."""
    kept = geometry.addressed(blocks).join(written.select(*geometry.chunks).distinct(), geometry.chunks, "left_anti")
    return kept.select(*blocks.columns).unionByName(form.select(*blocks.columns))


def merge_chunks(blocks: DataFrame, form: DataFrame, written: DataFrame, schema: Schema, geometry: Geometry, columns: list[str]) -> DataFrame:
    """Blocks after a projected write: presence and named columns are replaced; blocks that go on keep the others, new ones get initial values."""
    names = [schema.column(c).name for c in columns]
    old = geometry.addressed(blocks).join(written.select(*geometry.chunks).distinct(), geometry.chunks, "left_semi").select(*geometry.blocks, F.lit(True).alias("_old"), *[F.col(c.name).alias(f"_o_{c.name}") for c in schema.columns])
    joined = form.select(*geometry.blocks, *names).join(old, geometry.blocks, "left")
    rows = joined.select(*geometry.blocks, *[F.col(c.name) if c.name in names else F.when(F.col("_old"), F.col(f"_o_{c.name}")).otherwise(c.initial_col()).alias(c.name) for c in schema.columns])
    kept = geometry.addressed(blocks).join(written.select(*geometry.chunks).distinct(), geometry.chunks, "left_anti").select(*geometry.blocks, *[c.name for c in schema.columns])
    return kept.unionByName(rows)


def var_bytes(blocks: DataFrame, schema: Schema, geometry: Geometry, columns: list[Column] | None = None) -> DataFrame:
    """Bytes of text and bytes values per chunk: 12 and the length for each value that isn't null."""
    size = F.lit(0).cast("long")
    for c in columns or schema.columns:
        if c.type.kind in ("text", "bytes"):
            size = size + F.when(F.col(c.name).isNull(), 0).otherwise(F.octet_length(F.col(c.name)) + 12)
    return geometry.addressed(blocks).groupBy(*geometry.chunks).agg(F.sum(size).cast("long").alias("var_bytes"))


def check_versions(requests: DataFrame, chunks: DataFrame, geometry: Geometry) -> DataFrame:
    """Conditional writes against chunk versions: requests (block or chunk coordinates, ``if_version``) with ``current`` and ``ok``.

    A chunk never written has no version, and no number equals it.
    """
    if not set(geometry.chunks) <= set(requests.columns):
        requests = geometry.addressed(requests)
    joined = requests.join(chunks.select(*geometry.chunks, F.col("version").alias("current")), geometry.chunks, "left")
    return joined.withColumn("ok", F.coalesce(F.col("current") == F.col("if_version"), F.lit(False)))


def absent_only(requests: DataFrame, chunks: DataFrame, geometry: Geometry) -> DataFrame:
    """Chunk writes under IF ABSENT that go ahead: those whose chunk isn't populated; a tombstone doesn't stop them."""
    return requests.join(chunks.where("populated").select(*geometry.chunks), geometry.chunks, "left_anti")


def conflicts(touched: DataFrame, chunks: DataFrame, geometry: Geometry, snapshot: int) -> DataFrame:
    """Chunks read or written by a transaction that have a version above its snapshot."""
    return touched.select(*geometry.chunks).distinct().join(chunks.where(F.col("version") > snapshot).select(*geometry.chunks, "version"), geometry.chunks)


def overlay(snapshot: DataFrame, private: DataFrame, geometry: Geometry) -> DataFrame:
    """A transaction's view: its snapshot's blocks, with private rows instead where it wrote (``op`` 'S' or 'D')."""
    untouched = snapshot.join(private.select(*geometry.blocks), geometry.blocks, "left_anti")
    return untouched.unionByName(private.where("op = 'S'").select(*snapshot.columns))


def changed_since(touched: DataFrame, chunks: DataFrame, geometry: Geometry, snapshot: int) -> DataFrame:
    """Chunks with ``changed``: whether their version is above a snapshot; one never written hasn't changed."""
    joined = touched.join(chunks.select(*geometry.chunks, "version"), geometry.chunks, "left")
    return joined.withColumn("changed", F.coalesce(F.col("version") > snapshot, F.lit(False)))


def rebase(preimage: DataFrame, delta: DataFrame, current: DataFrame, schema: Schema, geometry: Geometry) -> DataFrame:
    """Row-level conflicts: a delta ('S' with full rows, or 'D') applies to the current blocks if its rows are as they were.

    ``preimage`` holds the blocks that were seen (absent ones aren't there).  A row that was changed and changed back doesn't conflict.  Result: coordinates,
    ``op``, ``conflict`` and the columns to write.
    """
    keys, columns = geometry.blocks, [c.name for c in schema.columns]
    side = lambda df, name: df.select(*keys, F.struct(*columns).alias(name))
    joined = delta.join(side(preimage, "_was"), keys, "left").join(side(current, "_now"), keys, "left")
    unchanged = F.col("_was").isNull() & F.col("_now").isNull()
    both = F.col("_was").isNotNull() & F.col("_now").isNotNull()
    for c in schema.columns:
        both = both & same(F.col(f"_was.{c.name}"), F.col(f"_now.{c.name}"), c)
    return joined.select(*keys, "op", (~(unchanged | F.coalesce(both, F.lit(False)))).alias("conflict"), *columns)


def transform_chunks(blocks: DataFrame, geometry: Geometry, **made: Col) -> DataFrame:
    """Read-modify-write of whole chunks: columns made from each chunk's own aggregates, given as window-free Columns over the chunk.

    The aggregates are computed once per chunk and joined back, so a chunk isn't gathered in one task.
    """
    at = geometry.addressed(blocks)
    totals = at.groupBy(*geometry.chunks).agg(*[v.alias(k) for k, v in made.items()])
    return at.join(totals, geometry.chunks)
