"""Stored tables: Parquet segments under manifests that are swapped atomically.

A table directory holds numbered manifests and immutable segments.  A commit writes a segment, then the next manifest; the
manifest's name is taken by a rename that fails if it exists, so of two writers one loses and reads again.  The catalog
(names, rights, migrations, slots) is a second chain of the same kind, which makes exchanging two names one step.
Segments are partitioned by large chunk, so an area read lists only what it may need.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.geometry import Geometry
from gridlake.operators import area as areas
from gridlake.operators import log as wl
from gridlake.schema import TABLE_NAME, Change, Column, GridError, Schema, Type, invalid
from gridlake.sources import rights
from gridlake.streaming import feed

MAX_READ_CHUNKS, MAX_WRITTEN_CHUNKS = 8192, 1024
#: How long a transaction may stay open.
MAX_SECONDS = 300.0
VAR_MAX_CHUNK_BYTES = 1 << 20
OPTIONS = {"var_max_chunk_bytes": VAR_MAX_CHUNK_BYTES, "feed_buffer_bytes": 64 << 20, "slot_max_bytes": 1 << 30}


class Files:
    """The few file operations that manifests need, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        at = self.path(root)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(at).toString()

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole under a name that must be free."""
        hidden = self.path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self.path(f"{self.root}/{name}")
        self.fs.mkdirs(target.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, target, none)
            return True
        except Exception as error:  # the name was taken meanwhile
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" not in str(error):
                raise
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def copy(self, source: str, target: str) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        to = self.path(target)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(f"{self.root}/{source}"), to.getFileSystem(conf), to, False, conf)


class Chain:
    """Numbered JSON documents; the last one counts."""

    def __init__(self, files: Files, folder: str) -> None:
        self.files, self.folder = files, folder

    def last(self) -> tuple[int, dict | None]:
        names = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        return (int(names[-1][:-5]), json.loads(self.files.read(f"{self.folder}/{names[-1]}"))) if names else (0, None)

    def push(self, number: int, document: dict) -> bool:
        return self.files.publish(f"{self.folder}/{number:020d}.json", json.dumps(document))


def _plain(value: Any) -> Any:
    return {"hex": value.hex()} if isinstance(value, bytes) else {"float": repr(value)} if isinstance(value, float) else value


def _value(value: Any) -> Any:
    return value if not isinstance(value, dict) else bytes.fromhex(value["hex"]) if "hex" in value else float(value["float"])


def dump_column(c: Column) -> dict:
    return asdict(c) | {"type": str(c.type), "default": _plain(c.default)}


def load_column(d: dict) -> Column:
    return Column(**(d | {"type": Type.parse(d["type"]), "default": _value(d["default"])}))


def dump_schema(s: Schema) -> dict:
    history = [{**asdict(c), "column": dump_column(c.column), "type": str(c.type) if c.type else None} for c in s.history]
    return {"columns": [dump_column(c) for c in s.columns], "chunk_columns": [dump_column(c) for c in s.chunk_columns], "version": s.version, "next_id": s.next_id, "history": history}


def load_schema(d: dict) -> Schema:
    history = tuple(Change(**(c | {"column": load_column(c["column"]), "type": Type.parse(c["type"]) if c["type"] else None})) for c in d["history"])
    return Schema(tuple(map(load_column, d["columns"])), tuple(map(load_column, d["chunk_columns"])), d["version"], d["next_id"], history)


@dataclass(frozen=True)
class Manifest:
    epoch: str
    schema: Schema
    geometry: Geometry
    revision: int = 0
    floor: int = 0
    time_ms: int = 0
    options: dict = field(default_factory=dict)
    segments: tuple[dict, ...] = ()  # path, domain, schema_version, rev
    versions: tuple[tuple[int, int], ...] = ((0, 1),)  # from which revision a schema version holds
    lineage: tuple[str, int] | None = None

    def dump(self) -> dict:
        return {**{k: getattr(self, k) for k in ("epoch", "revision", "floor", "time_ms", "options", "segments", "versions", "lineage")}, "schema": dump_schema(self.schema), "chunk": self.geometry.chunk, "large": self.geometry.large}

    @classmethod
    def load(cls, d: dict) -> Manifest:
        d = dict(d)
        geometry = Geometry(tuple(d.pop("chunk")), tuple(d.pop("large")))
        return cls(**(d | {"schema": load_schema(d["schema"]), "geometry": geometry, "segments": tuple(d["segments"]), "versions": tuple(map(tuple, d["versions"])), "lineage": tuple(d["lineage"]) if d["lineage"] else None}))


class Table:
    """One stored table."""

    def __init__(self, store: Store, folder: str) -> None:
        self.store, self.spark, self.folder = store, store.spark, folder
        self.chain = Chain(store.files, f"{folder}/manifest")

    @property
    def manifest(self) -> Manifest:
        return Manifest.load(self.chain.last()[1])

    def _push(self, change) -> Manifest:
        """Apply a change to the last manifest, again if another writer was first."""
        while True:
            number, last = self.chain.last()
            new = change(Manifest.load(last))
            if self.chain.push(number + 1, new.dump()):
                return new

    # reads -----------------------------------------------------------------------------------------------------

    def _rows(self, domain: str, manifest: Manifest | None = None) -> DataFrame:
        m = manifest or self.manifest
        geometry, schema = m.geometry, m.schema
        out = None
        by_version: dict[int, list[str]] = {}
        for s in m.segments:
            if s["domain"] == domain:
                by_version.setdefault(s["schema_version"], []).append(f"{self.store.files.root}/{self.folder}/{s['path']}")
        for version, paths in sorted(by_version.items()):
            shape = self._shape(schema.at(version), geometry, domain)
            part = schema.translate(self.spark.read.schema(shape).option("basePath", f"{self.store.files.root}/{self.folder}").parquet(*paths).drop("segment"), version, domain)
            names = [c.name for c in schema.at(version).part(domain)]
            if version < schema.version:
                # a set names columns as they were called then
                ids = {c.id: c.name for c in schema.part(domain)}
                now = F.create_map(*[F.lit(x) for c in schema.at(version).part(domain) for x in (c.name, ids.get(c.id, ""))]) if names else None
                part = part.withColumn("names", F.when(F.col("names").isNotNull(), F.transform("names", lambda n: now[n])))
                old = {c.id for c in schema.at(version).part(domain)}
                added = [c.name for c in schema.part(domain) if c.id not in old]
                if added:  # a full set of then didn't name columns of now: they keep their initial value
                    everything = [c.name for c in schema.part(domain) if c.id in old]
                    part = part.withColumn("names", F.coalesce("names", F.array(*map(F.lit, everything)).cast("array<string>")))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], self._shape(schema, geometry, domain)).drop("segment")

    @staticmethod
    def _shape(schema: Schema, geometry: Geometry, domain: str) -> str:
        address = [*(geometry.blocks if domain == "block" else []), *geometry.chunks]
        fixed = ["rev bigint", "commit_time_ms bigint", "user string", "op string", "names array<string>", *(f"{a} bigint" for a in address)]
        return ", ".join([*fixed, *(f"`{c.name}` {c.type.spark}" for c in schema.part(domain)), *(f"{x} bigint" for x in geometry.larges), "segment string"])

    def log(self) -> DataFrame:
        """All block writes, in the current schema; a scan on ``lx``, ``ly`` is pruned."""
        return self._rows("block")

    @staticmethod
    def _within(rows: DataFrame, m: Manifest, area: areas.Area | None, only: DataFrame | None, first: int | None = None) -> DataFrame:
        """Rows of an area, of the chunks that ``only`` holds, and of those from a first coordinate on; all name the partition columns."""
        if first is not None:
            rows = rows.where(f"{m.geometry.larges[0]} >= {first // m.geometry.large[0]} and {m.geometry.chunks[0]} >= {first}")
        if area is not None:
            rows = areas.select(rows, area, m.geometry)
        if only is not None:
            wanted = m.geometry.sharded(only.select(*m.geometry.chunks).distinct())
            rows = rows.join(wanted, [*m.geometry.larges, *m.geometry.chunks], "left_semi")
        return rows

    def blocks(self, upto: int | None = None, area: areas.Area | None = None, *, only: DataFrame | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Present blocks, of the table or of a manifest that was read before."""
        m = manifest or self.manifest
        return wl.fold(self._within(self._rows("block", m), m, area, only), m.schema, m.geometry, upto=upto)

    def meta(self, upto: int | None = None) -> DataFrame:
        m = self.manifest
        return wl.meta_state(self._rows("chunk", m), m.schema, m.geometry, upto=upto)

    def identities(self, upto: int | None = None, area: areas.Area | None = None, *, only: DataFrame | None = None, manifest: Manifest | None = None, first: int | None = None) -> DataFrame:
        m = manifest or self.manifest
        rows, meta = (self._within(self._rows(domain, m), m, area, only, first) for domain in ("block", "chunk"))
        return wl.identities(rows.drop(*m.geometry.chunks, *m.geometry.larges), m.schema, m.geometry, meta=meta, upto=upto, floor=m.floor)

    def area(self, area: areas.Area, columns: list[str] | None = None, *, limit: int | None = None, after: tuple[int, ...] | None = None) -> areas.Page | DataFrame:
        """Populated chunks of an area with ``version`` and ``cells``; a page of it if limit or after is given."""
        m = self.manifest
        if limit is None and after is None:
            areas.admit(area)
        cells = wl.chunk_forms(self.blocks(area=area, manifest=m), m.schema, m.geometry, columns)
        chunks = self.identities(area=area, manifest=m).where("populated").join(cells, m.geometry.chunks, "left")
        if limit is None and after is None:
            return chunks.orderBy(*m.geometry.chunks)
        return areas.page(chunks, area, m.geometry, limit=limit or areas.MAX_AREA_CHUNKS, after=after)

    def scan(self, *, manifest: Manifest | None = None, **options) -> DataFrame:
        m = manifest or self.manifest
        first = options["after"][0] if options.get("after") else None  # a page reads nothing before its start
        return wl.scan(self.identities(manifest=m, first=first), m.geometry, floor=m.floor, **options)

    def stats(self) -> dict:
        m = self.manifest
        row = wl.stats(self.identities(manifest=m), m.geometry, m.floor).first()
        return {"epoch": m.epoch, "revision": m.revision, "dims": m.geometry.dims, "tombstones": row["tombstones"] or 0, "retained_deletion_floor": m.floor}

    def describe(self) -> dict:
        m = self.manifest
        column = lambda c: {"name": c.name, "type": str(c.type), "nullable": c.nullable, "required": c.required, **({"default": c.default} if c.has_default else {})}
        return {
            "version": m.schema.version, "columns": [column(c) for c in m.schema.columns], "chunk_columns": [column(c) for c in m.schema.chunk_columns], "chunk": m.geometry.chunk,
            "large": m.geometry.large, "dims": m.geometry.dims, "options": OPTIONS | m.options, "epoch": m.epoch, "revision": m.revision, "lineage": m.lineage,
        }

    def changes(self, **filters) -> DataFrame:
        m = self.manifest
        return feed.changes(self._rows("block", m).drop(*m.geometry.chunks, *m.geometry.larges), m.schema, m.geometry, **filters)

    # writes ----------------------------------------------------------------------------------------------------

    def _checked(self, rows: DataFrame, schema: Schema, geometry: Geometry, domain: str) -> DataFrame:
        """Rows in stored types; a value that its column doesn't hold raises when the segment is written."""
        keys = geometry.blocks if domain == "block" else geometry.chunks
        given = set(rows.columns) - {"op", "names", *keys}
        for name in given:
            schema.column(name, domain)
        rows = rows if "op" in rows.columns else rows.withColumn("op", F.lit("S"))
        if "names" not in rows.columns:
            all_given = given == {c.name for c in schema.part(domain)}
            rows = rows.withColumn("names", F.lit(None).cast("array<string>") if all_given else F.array(*[F.lit(n) for n in sorted(given)]).cast("array<string>"))
        out = []
        for c in schema.part(domain):
            if c.name not in given:
                out.append(F.lit(None).cast(c.type.spark).alias(c.name))
                continue
            value = F.col(f"`{c.name}`")
            bad = F.raise_error(F.lit(f"OUT_OF_RANGE column {c.name} doesn't hold the value")).cast(c.type.spark)
            null = F.raise_error(F.lit(f"INVALID_ARGUMENT column {c.name} can't be NULL")).cast(c.type.spark)
            exact = F.length(value) == c.type.size if c.type.kind == "bits" else c.type.fits(value)
            stored = F.when(wl.named(c) & value.isNull(), F.lit(None).cast(c.type.spark) if c.nullable else null).when(exact, value.cast(c.type.spark)).otherwise(bad)
            out.append(F.when(wl.named(c), stored).alias(c.name))
        return rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "op", "names", *out)

    def write(self, rows: DataFrame, *, user: str = "", domain: str = "block", expect: int | None = None) -> int:
        """Commit rows as one revision: block coordinates, columns, and optionally ``op`` ('S' or 'D') and ``names``.

        ``expect`` is the revision that must still be the last.  A batch may write a block once.  Returns the revision; a batch that changes
        nothing takes none and returns the last one.
        """
        m = self.manifest
        if expect is not None and m.revision != expect:
            raise GridError("CONFLICT", "another writer was first")
        geometry, schema = m.geometry, m.schema
        checked = self._checked(rows, schema, geometry, domain)
        address = geometry.addressed(checked) if domain == "block" else checked
        name = f"data/segment={uuid.uuid4().hex}"
        target = f"{self.store.files.root}/{self.folder}/{name}"
        stamped = geometry.sharded(address).withColumns({"user": F.lit(user), "rev": F.lit(0).cast("long"), "commit_time_ms": F.lit(0).cast("long")})
        if not self._effect(checked, m, domain):
            return m.revision
        if domain == "block":
            self._within_bytes(checked, m)
        revision = m.revision + 1
        now = max(int(time.time() * 1000), m.time_ms)
        # rows carry their revision; a writer that comes second writes them again under the next one
        stamped = stamped.withColumns({"rev": F.lit(revision).cast("long"), "commit_time_ms": F.lit(now).cast("long")})
        # a large chunk's rows go to one file, or to several where they are many
        stamped.hint("rebalance", *[F.col(x) for x in geometry.larges]).write.partitionBy(*geometry.larges).parquet(target)
        segment = {"path": name, "domain": domain, "schema_version": schema.version, "rev": revision}
        number, last = self.chain.last()
        new = replace(m, revision=revision, time_ms=now, segments=(*m.segments, segment))
        if Manifest.load(last) != m or not self.chain.push(number + 1, new.dump()):
            self.store.files.delete(f"{self.folder}/{name}")
            if expect is not None:
                raise GridError("CONFLICT", "another writer was first")
            return self.write(rows, user=user, domain=domain)
        return revision

    def _effect(self, checked: DataFrame, m: Manifest, domain: str) -> bool:
        """Whether rows change anything, found from the log of their own blocks (or chunks) alone.

        A new block, or a chunk's first metadata, must be given its REQUIRED columns that have no default.
        """
        geometry, part = m.geometry, m.schema.part(domain)
        keys = geometry.blocks if domain == "block" else geometry.chunks
        wanted = geometry.sharded(geometry.addressed(checked) if domain == "block" else checked).select(*geometry.larges, *keys)
        log = self._rows(domain, m).join(wanted, [*geometry.larges, *keys], "left_semi")
        state = (wl.fold if domain == "block" else wl.meta_state)(log, m.schema, geometry)
        joined = checked.join(state.select(*keys, F.struct(F.lit(True).alias("_here"), *[f"`{c.name}`" for c in part]).alias("_now")), keys, "left")
        new, sets, differs = F.col("_now").isNull(), F.col("op") == "S", F.lit(False)
        for c in part:
            differs = differs | (wl.named(c) & ~wl.same(F.col(f"`{c.name}`"), F.col(f"_now.`{c.name}`"), c))
        needed = [c for c in part if c.required and not c.has_default]
        short = [F.max(sets & new & ~wl.named(c)).alias(f"short{k}") for k, c in enumerate(needed)]
        row = joined.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*keys).alias("keys"), F.max(F.when(sets, new | differs).otherwise(~new)).alias("effect"), *short).first()
        if row.rows != row.keys:
            raise invalid("a batch writes a block twice")
        for k, c in enumerate(needed):
            if row[f"short{k}"]:
                raise invalid(f"column {c.name} is required")
        return bool(row.effect)

    def _within_bytes(self, checked: DataFrame, m: Manifest) -> None:
        """The written chunks' texts and bytes must stay within the table's budget; a chunk that was over it may shrink."""
        part = [c for c in m.schema.columns if c.type.kind in ("text", "bytes")]
        if not part:
            return
        geometry, most = m.geometry, (OPTIONS | m.options)["var_max_chunk_bytes"]
        touched = geometry.addressed(checked).select(*geometry.chunks).distinct()
        before = self.blocks(only=touched, manifest=m).select(*geometry.blocks, *[c.name for c in m.schema.columns])
        old = before.select(*geometry.blocks, F.struct(F.lit(True).alias("_here"), *[f"`{c.name}`" for c in part]).alias("_old"))
        joined = old.join(checked, geometry.blocks, "full").where("op is null or op = 'S'")
        kept = [F.when(wl.named(c), F.col(f"`{c.name}`")).when(F.col("_old").isNotNull(), F.col(f"_old.`{c.name}`")).otherwise(c.initial_col()).alias(c.name) for c in part]
        after = wl.var_bytes(joined.select(*geometry.blocks, *kept), m.schema, geometry, part)
        was = wl.var_bytes(before, m.schema, geometry, part).withColumnRenamed("var_bytes", "was")
        over = after.where(F.col("var_bytes") > most).join(was, geometry.chunks, "left").where("was is null or var_bytes > was").first()
        if over:
            raise GridError("OUT_OF_RANGE", f"chunk ({', '.join(str(over[c]) for c in geometry.chunks)}) would hold {over.var_bytes} bytes of {most}")

    def chunk_writes(self, form: DataFrame, chunks: DataFrame, here: DataFrame, m: Manifest, columns: list[str] | None = None) -> DataFrame:
        """The writes that make ``chunks``, of which ``here`` holds the present blocks, into what ``form`` holds."""
        geometry = m.geometry
        if not geometry.addressed(form.select(*geometry.blocks)).join(chunks, geometry.chunks, "left_anti").limit(1).isEmpty():
            raise invalid("the form has blocks of another chunk")
        names = columns or [c.name for c in m.schema.columns]
        gone = here.join(form.select(*geometry.blocks), geometry.blocks, "left_anti").select(*geometry.blocks, F.lit("D").alias("op"), *[F.lit(None).cast(m.schema.column(n).type.spark).alias(n) for n in names])
        return form.select(*geometry.blocks, F.lit("S").alias("op"), *names).unionByName(gone)

    def replace_chunks(self, form: DataFrame, chunks: DataFrame, columns: list[str] | None = None, *, if_absent: bool = False, expect: int | None = None, user: str = "") -> int:
        """Write whole chunks: blocks of ``chunks`` that ``form`` doesn't hold go, the others are set (or have ``columns`` set).

        The check and the write are one step: if another writer comes between, both are done again, or CONFLICT is raised if ``expect`` is given.
        """
        while True:
            m = self.manifest
            if expect is not None and m.revision != expect:
                raise GridError("CONFLICT", "another writer was first")
            if if_absent and wl.absent_only(chunks, self.identities(only=chunks, manifest=m), m.geometry).count() < chunks.count():
                raise GridError("VERSION_MISMATCH", "the chunk is populated")
            rows = self.chunk_writes(form, chunks, self.blocks(only=chunks, manifest=m), m, columns)
            try:
                return self.write(rows, user=user, expect=m.revision)
            except GridError as error:
                if error.code != "CONFLICT" or expect is not None:
                    raise

    def write_meta(self, rows: DataFrame, *, user: str = "", expect: int | None = None) -> int:
        """Metadata of chunks: chunk coordinates and the columns to set; others keep their values."""
        return self.write(rows, user=user, domain="chunk", expect=expect)

    def merge_segments(self, least: int = 2) -> int:
        """Write segments of one domain and schema version as one, history and all; returns how many were merged.

        Rows carry their revisions, so nothing is lost.  Readers of earlier manifests keep the old files until ``vacuum``.
        """
        m = self.manifest
        groups: dict[tuple[str, int], list[dict]] = {}
        for s in m.segments:
            groups.setdefault((s["domain"], s["schema_version"]), []).append(s)
        merged: dict[str, dict] = {}
        gone: set[str] = set()
        base = f"{self.store.files.root}/{self.folder}"
        for (domain, version), parts in groups.items():
            if len(parts) >= least:
                shape = self._shape(m.schema.at(version), m.geometry, domain)
                rows = self.spark.read.schema(shape).option("basePath", base).parquet(*[f"{base}/{s['path']}" for s in parts]).drop("segment")
                name = f"data/segment={uuid.uuid4().hex}"
                # one task per large chunk's rows, so that a large chunk is one file and not one per task
                rows.repartition(*[F.col(x) for x in m.geometry.larges]).sortWithinPartitions(*m.geometry.larges, *m.geometry.chunks, "rev").write.partitionBy(*m.geometry.larges).parquet(f"{base}/{name}")
                merged[parts[0]["path"]] = {"path": name, "domain": domain, "schema_version": version, "rev": max(s["rev"] for s in parts)}
                gone |= {s["path"] for s in parts}

        def step(now: Manifest) -> Manifest:
            if not gone <= {s["path"] for s in now.segments}:
                raise GridError("CONFLICT", "segments were merged meanwhile")
            kept = [merged[s["path"]] if s["path"] in merged else s for s in now.segments if s["path"] in merged or s["path"] not in gone]
            return replace(now, segments=tuple(kept))

        if gone:
            self._push(step)
        return len(gone)

    def vacuum(self) -> int:
        """Delete segments that the last manifest doesn't name; run it when no reader uses earlier ones."""
        used = {s["path"].split("/", 1)[1] for s in self.manifest.segments}
        stale = [n for n in self.store.files.names(f"{self.folder}/data") if n not in used]
        for n in stale:
            self.store.files.delete(f"{self.folder}/data/{n}")
        return len(stale)

    def compact_tombstones(self, before: int) -> int:
        """Forget tombstones with versions below ``before``; the floor only rises."""
        return self._push(lambda m: replace(m, floor=max(m.floor, min(before - 1, m.revision)) if before > 1 else m.floor)).floor

    def alter(self, change, *, check: bool = True) -> Schema:
        """Publish the next schema version: ``change`` takes the schema and returns the new one."""

        def step(m: Manifest) -> Manifest:
            new = change(m.schema)
            last = new.history[-1]
            if check and last.kind == "type" and not last.policy and not m.schema.widens(last.column.type, last.type):
                found = m.schema.misfits(m.geometry.addressed(self.blocks()), last.column.name, last.type, [*m.geometry.chunks, *m.geometry.blocks]).first()
                if found:
                    at = ", ".join(str(found[b]) for b in m.geometry.blocks)
                    raise invalid(f"block ({at}) holds {found['holds']}")
            if last.kind == "add" and last.column.required and not last.column.has_default and last.domain == "block" and not self.blocks().limit(1).isEmpty():
                raise invalid(f"column {last.column.name} is required and blocks are present")
            return replace(m, schema=new, versions=(*m.versions, (m.revision + 1, new.version)))

        return self._push(step).schema

    def set_option(self, name: str, value: int) -> None:
        if name not in OPTIONS or value <= 0:
            raise invalid(f"bad option {name}")
        self._push(lambda m: replace(m, options=m.options | {name: value}))

    def check_var_bytes(self) -> DataFrame:
        """Chunks over the variable-byte budget."""
        m = self.manifest
        most = (OPTIONS | m.options)["var_max_chunk_bytes"]
        return wl.var_bytes(self.blocks(), m.schema, m.geometry).where(F.col("var_bytes") > most)

    def verify(self) -> list[str]:
        """Integrity: segments are there, revisions are at most the manifest's, coordinates agree with their chunk."""
        m = self.manifest
        found = []
        for s in m.segments:
            if not self.store.files.names(f"{self.folder}/{s['path']}"):
                found.append(f"missing {s['path']}")
        rows = self.log()
        wrong = rows.where(F.col("rev") > m.revision)
        moved = m.geometry.addressed(rows.select(*m.geometry.blocks, *[F.col(c).alias(f"s{c}") for c in m.geometry.chunks]))
        for c in m.geometry.chunks:
            if not moved.where(F.col(c) != F.col(f"s{c}")).limit(1).isEmpty():
                found.append(f"rows of another chunk by {c}")
        if not wrong.limit(1).isEmpty():
            found.append("rows beyond the last revision")
        return found


class Transaction:
    """A snapshot of one table with private writes over it; commits if no chunk it read or wrote has changed."""

    def __init__(self, table: Table, user: str = "", *, seconds: float = MAX_SECONDS) -> None:
        self.table, self.user = table, user
        self.start, self.ends = table.manifest, time.monotonic() + seconds
        self.private: DataFrame | None = None
        self.read: set[tuple[int, ...]] = set()

    def _touch(self, area: areas.Area) -> None:
        """Chunks of all reads together are bounded, empty ones counted."""
        areas.admit(area, MAX_READ_CHUNKS)
        self.read.update(tuple(c) for c in areas.cells(area))
        if len(self.read) > MAX_READ_CHUNKS:
            raise GridError("OUT_OF_RANGE", f"a transaction reads at most {MAX_READ_CHUNKS} chunks")

    def _alive(self) -> None:
        if time.monotonic() > self.ends:
            raise GridError("CONFLICT", "the transaction was open for too long")

    def _view(self, area: areas.Area | None = None) -> DataFrame:
        self._alive()
        m = self.start
        found = self.table.blocks(area=area, manifest=m).select(*m.geometry.blocks, *[c.name for c in m.schema.columns])
        if self.private is None:
            return found
        mine = self.private if area is None else areas.select(m.geometry.addressed(self.private), area, m.geometry)
        return wl.overlay(found, mine, m.geometry)

    def blocks(self, area: areas.Area | None = None) -> DataFrame:
        """The view: the snapshot's blocks with the transaction's own writes.  An area that is read counts with its empty chunks."""
        if area is not None:
            self._touch(area)
        return self._view(area)

    def _mine(self) -> DataFrame | None:
        """Chunks with private writes."""
        return None if self.private is None else self.start.geometry.addressed(self.private).select(*self.start.geometry.chunks).distinct()

    def chunk(self, at: tuple[int, ...]) -> dict | None:
        """Version and commit time of a chunk: the snapshot's, both None if the transaction wrote there; None for a chunk that isn't there."""
        m, box = self.start, areas.Box(at, at)
        mine = self._mine()
        if mine is not None and not areas.select(mine, box, m.geometry).isEmpty():
            there = not self._view(box).limit(1).isEmpty() or not self.table.identities(area=box, manifest=m).isEmpty()
            return {"version": None, "commit_time_ms": None} if there else None
        row = self.table.identities(area=box, manifest=m).select("version", "commit_time_ms").first()
        return row.asDict() if row else None

    def area(self, area: areas.Area, columns: list[str] | None = None, *, limit: int | None = None, after: tuple[int, ...] | None = None) -> areas.Page | DataFrame:
        """As ``Table.area`` over the view; chunks that the transaction wrote have no version."""
        m = self.start
        cells = wl.chunk_forms(self.blocks(area), m.schema, m.geometry, columns)
        found = self.table.identities(area=area, manifest=m).join(cells, m.geometry.chunks, "full")
        mine = self._mine()
        if mine is not None:
            found = found.join(mine.withColumn("_mine", F.lit(True)), m.geometry.chunks, "left")
            found = found.withColumns({c: F.when(F.col("_mine").isNull(), F.col(c)) for c in ("version", "commit_time_ms")}).drop("_mine")
        # a chunk without blocks is populated if its metadata is
        by_meta = F.coalesce(F.col("populated") & (F.col("blocks") == 0), F.lit(False))
        found = found.withColumns({"blocks": F.coalesce(F.size("cells"), F.lit(0)).cast("long"), "populated": F.col("cells").isNotNull() | by_meta}).where("populated")
        if limit is None and after is None:
            return found.orderBy(*m.geometry.chunks)
        return areas.page(found, area, m.geometry, limit=limit or areas.MAX_AREA_CHUNKS, after=after)

    def replace_chunk(self, form: DataFrame, at: tuple[int, ...], columns: list[str] | None = None, *, if_absent: bool = False) -> None:
        """Make a chunk of the view into what ``form`` holds; with ``columns`` present blocks keep the others."""
        m = self.start
        geometry = m.geometry
        here = self.blocks(areas.Box(at, at))
        if if_absent and not self.area(areas.Box(at, at)).isEmpty():
            raise GridError("VERSION_MISMATCH", "the chunk is populated")
        chunks = self.table.spark.createDataFrame([at], ", ".join(f"{c} long" for c in geometry.chunks))
        rows = self.table.chunk_writes(form, chunks, here, m, columns)
        if columns:
            rest = [c.name for c in m.schema.columns if c.name not in columns]
            old = here.select(*geometry.blocks, F.lit(True).alias("_old"), *[F.col(n).alias(f"_o_{n}") for n in rest])
            self._need(rows.where("op = 'S'").join(old, geometry.blocks, "left_anti"), columns)
            rows = rows.join(old, geometry.blocks, "left")
            rows = rows.withColumns({c.name: F.when(F.col("_old"), F.col(f"_o_{c.name}")).otherwise(c.initial_col()) for c in m.schema.columns if c.name in rest}).drop("_old", *[f"_o_{n}" for n in rest])
        self.write(rows)

    def _need(self, new: DataFrame, given: list[str]) -> None:
        """New blocks must be given the REQUIRED columns that have no default."""
        for c in self.start.schema.columns:
            if c.required and not c.has_default and c.name not in given and not new.limit(1).isEmpty():
                raise invalid(f"column {c.name} is required")

    def write(self, rows: DataFrame) -> None:
        """Full rows to set, or coordinates with ``op`` 'D'; a later write of a block replaces an earlier one.

        Columns that aren't there get their initial values, unless a new block must be given them.
        """
        m = self.start
        columns = [c.name for c in m.schema.columns]
        rows = rows if "op" in rows.columns else rows.withColumn("op", F.lit("S"))
        if not set(columns) <= set(rows.columns):
            self._need(rows.where("op = 'S'").join(self._view().select(*m.geometry.blocks), m.geometry.blocks, "left_anti"), rows.columns)
        for c in m.schema.columns:
            if c.name not in rows.columns:
                rows = rows.withColumn(c.name, c.initial_col())
        rows = rows.select(*m.geometry.blocks, *columns, "op")
        self.private = rows if self.private is None else self.private.join(rows.select(*m.geometry.blocks), m.geometry.blocks, "left_anti").unionByName(rows)
        if m.geometry.addressed(self.private).select(*m.geometry.chunks).distinct().limit(MAX_WRITTEN_CHUNKS + 1).count() > MAX_WRITTEN_CHUNKS:
            raise GridError("OUT_OF_RANGE", f"a transaction writes at most {MAX_WRITTEN_CHUNKS} chunks")

    def commit(self) -> int | None:
        """One revision for all writes; None if they change nothing.  CONFLICT if a touched chunk has a version above the snapshot."""
        self._alive()
        m = self.start
        if self.private is None:
            return None
        touched = m.geometry.addressed(self.private).select(*m.geometry.chunks)
        if self.read:
            touched = touched.unionByName(self.table.spark.createDataFrame(sorted(self.read), ", ".join(f"{c} long" for c in m.geometry.chunks)))
        while True:
            now = self.table.manifest
            if now.epoch != m.epoch or now.schema.version != m.schema.version:
                raise GridError("CONFLICT", "the table changed")
            if now.revision > m.revision and not wl.conflicts(touched, self.table.identities(only=touched, manifest=now), m.geometry, m.revision).limit(1).isEmpty():
                raise GridError("CONFLICT", "a chunk changed since the snapshot")
            try:
                revision = self.table.write(self.private, user=self.user, expect=now.revision)
                return revision if revision > now.revision else None
            except GridError as error:
                if error.code != "CONFLICT":
                    raise

    def rollback(self) -> None:
        self.private, self.read = None, set()


class Store:
    """A folder of tables with a catalog."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.files = Files(spark, root)
        self.catalog = Chain(self.files, "catalog")

    def state(self) -> dict:
        return self.catalog.last()[1] or {"tables": {}, "rights": {}, "migrations": [], "slots": None}

    def _change(self, change) -> dict:
        while True:
            number, last = self.catalog.last()
            new = change(json.loads(json.dumps(last or self.state())))
            if self.catalog.push(number + 1, new):
                return new

    def tables(self) -> list[str]:
        return sorted(self.state()["tables"])

    def table(self, name: str) -> Table:
        folder = self.state()["tables"].get(name)
        if folder is None:
            raise GridError("NO_TABLE", f"no table {name}")
        return Table(self, folder)

    def create(self, name: str, schema: Schema, geometry: Geometry, *, if_not_exists: bool = False, lineage: tuple[str, int] | None = None, manifest: Manifest | None = None, fill: Callable[[str], None] | None = None) -> Table:
        """A new table; ``fill`` puts data into its folder before its name is published."""
        if not TABLE_NAME.match(name):
            raise invalid(f"bad table name {name}")
        if name in self.state()["tables"]:
            if if_not_exists:
                return self.table(name)
            raise GridError("TABLE_EXISTS", f"table {name} exists")
        epoch = uuid.uuid4().hex
        folder = f"tables/{epoch}"
        first = replace(manifest, epoch=epoch, lineage=lineage) if manifest else Manifest(epoch, schema, geometry)
        Chain(self.files, f"{folder}/manifest").push(1, first.dump())
        if fill:
            fill(folder)

        def add(state: dict) -> dict:
            if name in state["tables"]:
                raise GridError("TABLE_EXISTS", f"table {name} exists")
            state["tables"][name] = folder
            return state

        self._change(add)
        return Table(self, folder)

    def drop(self, name: str, *, if_exists: bool = False) -> None:
        if name not in self.state()["tables"]:
            if if_exists:
                return
            raise GridError("NO_TABLE", f"no table {name}")

        held: list[str] = []

        def remove(state: dict) -> dict:
            held[:] = [state["tables"].pop(name)] if name in state["tables"] else []
            state["rights"] = {u: {t: v for t, v in r.items() if t != name} for u, r in state["rights"].items()}
            return state

        self._change(remove)
        for folder in held:
            self.files.delete(folder)

    def swap(self, a: str, b: str) -> None:
        """Exchange two names in one step; data and epochs stay with their tables, rights with the names."""
        if a == b:
            raise invalid("two tables are needed")

        def exchange(state: dict) -> dict:
            for n in (a, b):
                if n not in state["tables"]:
                    raise GridError("NO_TABLE", f"no table {n}")
            state["tables"][a], state["tables"][b] = state["tables"][b], state["tables"][a]
            return state

        self._change(exchange)

    def backup(self, target: str) -> list[str]:
        """Copy every table as of its last manifest; tables aren't cut at one time."""
        names = self.tables()
        for name in names:
            self.files.copy(self.state()["tables"][name], f"{target}/{name}")
        return names

    def restore(self, source: str, name: str, new: str | None = None) -> Table:
        """A new table with a new epoch from a backup, with the parent's epoch and revision as its lineage."""
        from_files = Files(self.spark, f"{source}/{name}")
        document = Chain(from_files, "manifest").last()[1]
        if document is None:
            raise GridError("NO_TABLE", f"no table {name} in the backup")
        parent = Manifest.load(document)

        def fill(folder: str) -> None:
            if from_files.names("data"):
                from_files.copy("data", f"{self.files.root}/{folder}/data")

        return self.create(new or name, parent.schema, parent.geometry, lineage=(parent.epoch, parent.revision), manifest=parent, fill=fill)

    def migrate(self, name: str, statement: str, run, user: str = "") -> str:
        """Run a statement once under a permanent name: applied, skipped, or refused if the name has another text."""
        text = statement.strip()
        for m in self.state()["migrations"]:
            if m["name"] == name:
                if m["statement"] != text:
                    raise GridError("MIGRATION_MISMATCH", f"{name} is recorded with another statement")
                return "skipped"
        run(text)

        def record(state: dict) -> dict:
            state["migrations"].append({"name": name, "applied_ms": int(time.time() * 1000), "user": user, "statement": text})
            return state

        self._change(record)
        return "applied"

    def migrations(self) -> DataFrame:
        rows = [(m["name"], m["applied_ms"], m["user"], m["statement"]) for m in self.state()["migrations"]]
        return self.spark.createDataFrame(rows, "name string, applied_ms long, user string, statement string")

    def grant(self, user: str, target: str, names: list[str], *, take: bool = False) -> None:
        def change(state: dict) -> dict:
            mine = state["rights"].get(user, {})
            state["rights"][user] = (rights.revoke if take else rights.grant)(mine, target, names)
            return state

        self._change(change)

    def allowed(self, user: str, target: str) -> int:
        return rights.right(self.state()["rights"].get(user, {}), target)

    def slots(self) -> feed.Slots:
        """The slots; a change is made to the catalog's last document, so that changes by others stay."""
        return feed.Slots(lambda: self.state()["slots"], apply=lambda step: self._change(lambda state: state | {"slots": step(state["slots"])}))
