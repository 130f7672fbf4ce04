"""The change feed: committed changes with their rows before and after, as a batch and as a stream.

A position is (epoch, revision).  Revisions order a table's changes; commit times may go back and order nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.geometry import Geometry
from gridlake.operators import area as areas
from gridlake.operators import log as wl
from gridlake.schema import GridError, Schema, invalid


#: Changes of a chunk that are kept together when its forms are made.
GROUP = 64


def changes(log: DataFrame, schema: Schema, geometry: Geometry, *, after: int | None = None, upto: int | None = None, area: areas.Area | None = None, columns: list[str] | None = None, before: bool = True) -> DataFrame:
    """Changed blocks: rev, commit_time_ms, user, chunk and block coordinates, ``before`` and ``after`` (null if absent).

    Writes that changed nothing aren't in the feed.  A filter on chunks or columns doesn't hide that a block changed: ``columns`` only chooses the values shown, in declared order.
    """
    if columns is not None and len(set(columns)) < len(columns):
        raise invalid("a column is named twice")
    if upto is not None:
        log = log.where(F.col("rev") <= upto)
    at = geometry.addressed(log)
    if area is not None:
        at = areas.select(at, area, geometry)  # an area's history needs only its own writes
    found = wl.history(at, schema, geometry).where("effective")
    if after is not None:
        found = found.where(F.col("rev") > after)
    if columns is not None:
        for c in columns:
            schema.column(c)
        picked = [c.name for c in schema.columns if c.name in columns]
        for side in ("before", "after"):
            found = found.withColumn(side, F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.{c}").alias(c) for c in picked])))
    return found.select("rev", "commit_time_ms", *(["user"] if "user" in found.columns else []), *geometry.chunks, *geometry.blocks, *(["before"] if before else []), "after")


def events(found: DataFrame, geometry: Geometry) -> DataFrame:
    """One event per commit: rev, time, user and the changed blocks in coordinate order.  A commit holds at most a transaction's blocks."""
    block = F.struct(*[c for c in (*geometry.blocks, "before", "after") if c in found.columns])
    return found.groupBy("rev").agg(F.max("commit_time_ms").alias("commit_time_ms"), *([F.max("user").alias("user")] if "user" in found.columns else []), F.sort_array(F.collect_list(block)).alias("blocks"))


def chunk_forms_at_commits(log: DataFrame, schema: Schema, geometry: Geometry) -> DataFrame:
    """(rev, chunk, ``cells``): each touched chunk's present blocks after each commit that changed it.

    A change is valid until its block's next one.  A chunk's commits are put into groups of about ``GROUP`` changes (fewer if a chunk is smaller); a change
    is copied to the groups it is valid in, and a group's changes are one array, from which each of its commits takes those valid at it.  So what is shuffled is a
    fraction of the forms, however many commits a chunk has and however far apart they are, and no table is broadcast, as all grow with the log.
    """
    at = geometry.addressed(log) if geometry.chunks[0] not in log.columns else log
    span = min(prod(geometry.chunk), GROUP)
    history = wl.history(at, schema, geometry).where("effective").withColumn("_range", F.expr(f"rev div {span}L"))
    chunk, block = Window.partitionBy(*geometry.chunks), Window.partitionBy(*geometry.blocks).orderBy("rev")
    ranges = history.groupBy(*geometry.chunks, "_range").agg(F.count("*").alias("_n"))
    ranges = ranges.withColumn("_group", F.floor((F.sum("_n").over(chunk.orderBy("_range")) - F.col("_n")) / span))
    ranges = ranges.withColumn("_nth", F.dense_rank().over(chunk.orderBy("_group"))).withColumn("_last", F.max("_nth").over(chunk))
    ranked = history.join(ranges.select(*geometry.chunks, "_range", "_nth", "_last").hint("merge"), [*geometry.chunks, "_range"])
    spans = ranked.withColumns({"until": F.lead("rev").over(block), "_end": F.coalesce(F.lead("_nth").over(block), F.col("_last"))}).where("after is not null")
    spans = spans.select(*geometry.chunks, F.struct(geometry.local_index().alias("index"), F.col("rev").alias("since"), "until", F.col("after").alias("row")).alias("change"), F.explode(F.sequence("_nth", "_end")).alias("_nth"))
    held = spans.groupBy(*geometry.chunks, "_nth").agg(F.sort_array(F.collect_list("change")).alias("held"))
    commits = ranked.select("rev", *geometry.chunks, "_nth").distinct()
    cells = F.expr("transform(filter(held, c -> c.since <= rev and (c.until is null or c.until > rev)), c -> struct(c.index as index, c.row as row))")
    joined = commits.join(held.hint("merge"), [*geometry.chunks, "_nth"], "left")
    return joined.select("rev", *geometry.chunks, F.coalesce(cells, F.array().cast(joined.select(cells).schema[0].dataType)).alias("cells"))


def schema_events(found: DataFrame, versions: list[tuple[int, int]]) -> DataFrame:
    """(rev, schema_version): the first change under each schema version.  ``versions`` says from which revision a version holds."""
    held = F.array(*[F.struct(F.lit(a).cast("long").alias("since"), F.lit(v).alias("v")) for a, v in versions])
    current = F.array_max(F.transform(F.filter(held, lambda h: h["since"] <= F.col("rev")), lambda h: h["v"]))
    return found.select("rev", current.alias("schema_version")).groupBy("schema_version").agg(F.min("rev").alias("rev")).select("rev", "schema_version")


@dataclass(frozen=True)
class Slot:
    """A durable named consumer: fixed filters, an owner, and the last acknowledged revision."""

    name: str
    table: str
    epoch: str
    acked: int
    owner: str = ""
    area: tuple | None = None
    columns: tuple[str, ...] | None = None
    before: bool = True
    holder: str = ""
    sent: int = 0
    lost: str = ""

    def filters(self) -> dict:
        box = areas.Box(tuple(self.area[0]), tuple(self.area[1])) if self.area else None
        return {"area": box, "columns": list(self.columns) if self.columns else None, "before": self.before}


@dataclass
class Slots:
    """The slots of a store, kept as one JSON document: by load and save, or by ``apply``, which runs a step from the last document to the next as one change."""

    load: Callable[[], str | None]
    save: Callable[[str], None] | None = None
    slots: dict[str, Slot] = field(default_factory=dict)
    apply: Callable[[Callable[[str | None], str]], object] | None = None

    def __post_init__(self) -> None:
        self.slots = self._read(self.load())

    @staticmethod
    def _read(text: str | None) -> dict[str, Slot]:
        return {k: Slot(**{**v, "columns": tuple(v["columns"]) if v["columns"] else None}) for k, v in json.loads(text or "{}").items()}

    def _change(self, change: Callable[[dict[str, Slot]], None]) -> None:
        """Make a change to the slots as they are now; it may run again if another change was first."""

        def step(text: str | None) -> str:
            self.slots = self._read(text)
            change(self.slots)
            return json.dumps({k: asdict(v) for k, v in self.slots.items()})

        if self.apply:
            self.apply(step)
        else:
            self.save(step(self.load()))

    def _replace(self, name: str, make: Callable[[Slot], Slot]) -> Slot:
        self._change(lambda slots: slots.update({name: make(self.get(name))}))
        return self.slots[name]

    def create(self, name: str, table: str, epoch: str, frontier: int, **filters) -> Slot:
        def add(slots: dict[str, Slot]) -> None:
            if name in slots:
                raise GridError("SLOT_EXISTS", f"slot {name} exists")
            slots[name] = Slot(name, table, epoch, frontier, sent=frontier, **filters)

        self._change(add)
        return self.slots[name]

    def drop(self, name: str) -> None:
        def remove(slots: dict[str, Slot]) -> None:
            self.get(name)
            del slots[name]

        self._change(remove)

    def get(self, name: str) -> Slot:
        if name not in self.slots:
            raise GridError("NO_SLOT", f"no slot {name}")
        return self.slots[name]

    def claim(self, name: str, holder: str, takeover: bool = False) -> Slot:
        """One watcher at a time; a takeover replaces it."""

        def make(slot: Slot) -> Slot:
            if slot.holder and slot.holder != holder and not takeover:
                raise GridError("SLOT_BUSY", f"slot {name} is watched")
            return replace(slot, holder=holder)

        return self._replace(name, make)

    def release(self, name: str, holder: str) -> Slot:
        """The holder watches no more; another may."""
        return self._replace(name, lambda slot: replace(slot, holder="") if slot.holder == holder else slot)

    def sent(self, name: str, rev: int) -> Slot:
        return self._replace(name, lambda slot: replace(slot, sent=max(slot.sent, rev)))

    def ack(self, name: str, rev: int) -> Slot:
        """Acknowledge all up to a revision: never back, and never beyond what was sent."""

        def make(slot: Slot) -> Slot:
            if rev > slot.sent:
                raise invalid(f"ACK {rev} is beyond the last sent revision {slot.sent}")
            return replace(slot, acked=max(slot.acked, rev))

        return self._replace(name, make)

    def lose(self, name: str, reason: str) -> Slot:
        return self._replace(name, lambda slot: replace(slot, lost=reason))

    def check_columns(self, schema: Schema, table: str | None = None) -> None:
        """A slot (of a table, if one is named) whose column was dropped is lost."""
        there = {c.name for c in schema.columns}

        def change(slots: dict[str, Slot]) -> None:
            slots.update({k: replace(s, lost="schema_filter") for k, s in slots.items() if table in (None, s.table) and s.columns and not set(s.columns) <= there})

        self._change(change)

    def retained(self, table: str | None = None) -> int | None:
        """The revision up to which history (of a table, if one is named) may go: the least acknowledged of live slots."""
        live = [s.acked for s in self.slots.values() if not s.lost and table in (None, s.table)]
        return min(live) if live else None


def start(position: tuple[str, int] | None, epoch: str, frontier: int, floor: int, lineage: tuple[str, int] | None = None) -> tuple[str, int]:
    """('change', revision to go on after), or ('resync', frontier) if history there isn't to be had.

    A position of the parent goes on only at exactly the point where the table was forked from it.
    """
    if position is None:
        return "change", frontier
    if position[0] == epoch and floor <= position[1] <= frontier:
        return "change", position[1]
    if lineage and position == lineage:
        return "change", lineage[1]
    return "resync", frontier


def stream_changes(log_stream: DataFrame, read_state: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], schema: Schema, geometry: Geometry, checkpoint: str, *, area: areas.Area | None = None):
    """A streaming query over an append-only log: each micro-batch is a closed range of revisions.

    ``read_state`` gives the blocks before the batch (coordinates, columns); ``write`` gets the batch's changes and its number, once or more often after a
    failure, so it must be idempotent by (epoch, rev).  Rows before the batch enter the history as sets below its revisions.
    """

    def step(batch: DataFrame, number: int) -> None:
        touched = batch.select(*geometry.blocks).distinct()
        state = read_state().join(touched, geometry.blocks, "left_semi")
        columns = [c.name for c in schema.columns]
        base = state.select(F.lit(0).cast("long").alias("rev"), *geometry.blocks, F.lit("S").alias("op"), F.lit(None).cast("array<string>").alias("names"), *columns)
        # 0 is below every revision: the state enters the history as sets of all columns
        merged = batch.unionByName(base, allowMissingColumns=True)
        write(changes(merged, schema, geometry, after=0, area=area), number)

    return log_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
