"""Areas of chunks: boxes and Euclidean balls, with the predicate a scan can push down, counts and keyset pages.

A selector filters on the stored chunk coordinates.  ``prune`` adds bounds on large-chunk coordinates, which Spark
can't infer through the floor division, so partitions outside the area aren't listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.geometry import MAX64, MIN64, Geometry
from gridlake.schema import GridError

MAX_AREA_CHUNKS = 4096


class AreaError(GridError):
    """An area or page that can't be served; ``code`` says why."""


@dataclass(frozen=True)
class Box:
    """Chunks between two corners, both included."""

    low: tuple[int, ...]
    high: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.low) != len(self.high) or any(a > b for a, b in zip(self.low, self.high)):
            raise AreaError("INVALID_ARGUMENT", "area corners must be ordered on every axis")

    @property
    def dims(self) -> int:
        return len(self.low)

    def bounds(self) -> list[tuple[int, int]]:
        return list(zip(self.low, self.high))

    def inside(self, names: list[str]) -> Column:
        out = F.lit(True)
        for name, (a, b) in zip(names, self.bounds()):
            out = out & F.col(name).between(F.lit(a).cast("long"), F.lit(b).cast("long"))
        return out

    def contains(self, at: tuple[int, ...]) -> bool:
        return all(a <= v <= b for v, (a, b) in zip(at, self.bounds()))

    def exceeds(self, most: int) -> bool:
        count = 1
        for a, b in self.bounds():
            count *= b - a + 1
        return count > most

    def row(self, head: tuple[int, ...]) -> tuple[int, int]:
        """Range of the last axis, given the others."""
        return self.low[-1], self.high[-1]


@dataclass(frozen=True)
class Ball:
    """Chunks whose squared distance from a chunk is at most radius²; exact on all 64-bit coordinates."""

    center: tuple[int, ...]
    radius: int

    def __post_init__(self) -> None:
        if not 0 <= self.radius <= MAX64:
            raise AreaError("INVALID_ARGUMENT", "radius must not be negative")

    @property
    def dims(self) -> int:
        return len(self.center)

    def bounds(self) -> list[tuple[int, int]]:
        return [(max(MIN64, c - self.radius), min(MAX64, c + self.radius)) for c in self.center]

    def inside(self, names: list[str]) -> Column:
        """A box that a scan can push down, and the exact test inside it, in staged decimals where 64 bits wouldn't do."""
        box = Box(*zip(*self.bounds())).inside(names)
        if self.radius < 1 << 30:
            square = sum(((F.col(n) - F.lit(c).cast("long")) * (F.col(n) - F.lit(c).cast("long")) for n, c in zip(names, self.center)), F.lit(0).cast("long"))
            test = square <= F.lit(self.radius**2).cast("long")
        else:
            wide = "decimal(20,0)"
            left = F.lit(str(self.radius**2)).cast("decimal(38,0)")
            test = F.lit(True)
            for n, c in zip(names, self.center):
                delta = F.col(n).cast(wide) - F.lit(str(c)).cast(wide)
                square = (delta.cast("decimal(19,0)") * delta.cast("decimal(19,0)")).cast("decimal(38,0)")
                fits = F.when(F.abs(delta) <= F.lit(str(self.radius)).cast(wide), F.coalesce(square <= left, F.lit(False))).otherwise(False)
                test = F.when(test, fits).otherwise(False)
                left = F.when(test, (left - square).cast("decimal(38,0)"))
        return box & F.when(box, test).otherwise(False)

    def contains(self, at: tuple[int, ...]) -> bool:
        return sum((a - b) ** 2 for a, b in zip(at, self.center)) <= self.radius**2

    def exceeds(self, most: int) -> bool:
        """Whether the unclipped ball has more chunks; a cube inside it settles large radii at once."""
        if (2 * isqrt(self.radius**2 // self.dims) + 1) ** self.dims > most:
            return True
        count = 0
        for head in self._heads(clipped=False):
            a, b = self._row(head)
            count += b - a + 1
            if count > most:
                return True
        return False

    def _row(self, head: tuple[int, ...]) -> tuple[int, int]:
        reach = isqrt(self.radius**2 - sum((a - b) ** 2 for a, b in zip(head, self.center)))
        return self.center[-1] - reach, self.center[-1] + reach

    def row(self, head: tuple[int, ...]) -> tuple[int, int]:
        a, b = self._row(head)
        return max(a, MIN64), min(b, MAX64)

    def _heads(self, clipped: bool = True, start: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
        return _heads(self, clipped, start)


Area = Box | Ball


def _heads(area: Area, clipped: bool, start: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """Values of all axes but the last, in order, from ``start`` on."""

    def grow(head: tuple[int, ...], tied: bool) -> Iterator[tuple[int, ...]]:
        axis = len(head)
        if axis == area.dims - 1:
            yield head
            return
        if isinstance(area, Box):
            a, b = area.bounds()[axis]
        else:
            reach = isqrt(area.radius**2 - sum((p - q) ** 2 for p, q in zip(head, area.center)))
            a, b = area.center[axis] - reach, area.center[axis] + reach
            if clipped:
                a, b = max(a, MIN64), min(b, MAX64)
        first = max(a, start[axis]) if tied and start else a
        for v in range(first, b + 1):
            yield from grow((*head, v), tied and bool(start) and v == start[axis])

    return grow((), True)


def cells(area: Area, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...]]:
    """The area's chunks in coordinate order, strictly after a position; made one by one, never as a whole."""
    for head in _heads(area, True, after[:-1] if after else ()):
        a, b = area.row(head)
        if after and head == after[:-1]:
            a = max(a, after[-1] + 1)
        for v in range(a, b + 1):
            yield (*head, v)


def prune(area: Area, geometry: Geometry) -> Column:
    """Bounds on the large-chunk coordinates that hold the area."""
    out = F.lit(True)
    for name, (a, b), side in zip(geometry.larges, area.bounds(), geometry.large):
        out = out & F.col(name).between(F.lit(a // side).cast("long"), F.lit(b // side).cast("long"))
    return out


def select(chunks: DataFrame, area: Area, geometry: Geometry) -> DataFrame:
    """Rows of the area, whatever their number; large-chunk columns are used where the rows have them."""
    if area.dims != geometry.dims:
        raise AreaError("INVALID_ARGUMENT", f"the table has {geometry.dims} axes")
    if set(geometry.larges) <= set(chunks.columns):
        chunks = chunks.where(prune(area, geometry))
    return chunks.where(area.inside(geometry.chunks))


def admit(area: Area, most: int = MAX_AREA_CHUNKS) -> None:
    """Refuses an unpaged area with more requested chunks than ``most``, empty ones counted."""
    if area.exceeds(most):
        raise AreaError("INVALID_ARGUMENT", f"the area has more than {most} chunks; use LIMIT")


@dataclass(frozen=True)
class Page:
    """One keyset page: the populated chunks among ``limit`` requested cells, whether there is more, and where to go on."""

    chunks: DataFrame
    more: bool
    after: tuple[int, ...] | None


def page(chunks: DataFrame, area: Area, geometry: Geometry, *, limit: int = MAX_AREA_CHUNKS, after: tuple[int, ...] | None = None, most: int = MAX_AREA_CHUNKS) -> Page:
    """A page of an area.  ``limit`` counts requested cells, empty ones too, so it bounds the cells made on the driver."""
    if not 1 <= limit <= most:
        raise AreaError("INVALID_ARGUMENT", f"LIMIT must be from 1 to {most}")
    if after is not None and (len(after) != area.dims or not area.contains(after)):
        raise AreaError("INVALID_ARGUMENT", "AFTER must lie inside the area")
    found = list(islice(cells(area, after), limit + 1))
    more, found = len(found) > limit, found[:limit]
    if not found:
        return Page(chunks.limit(0), False, None)
    # the cells of a page are one run in coordinate order: two bounds select them, no join
    first, last = found[0], found[-1]
    row = F.struct(*[F.col(c) for c in geometry.chunks])
    bound = lambda at: F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(at, geometry.chunks)])
    return Page(select(chunks, area, geometry).where((row >= bound(first)) & (row <= bound(last))), more, last if more else None)


def budgeted(chunks: DataFrame, geometry: Geometry, size: Column, budget: int) -> DataFrame:
    """The first chunks of a page whose sizes add up to at most ``budget`` bytes.

    A page has at most ``MAX_AREA_CHUNKS`` chunks, so one ordered window over it is bounded.  A first chunk over the budget is refused.
    """
    from pyspark.sql import Window

    order = Window.orderBy(*geometry.chunks)
    total = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = chunks.withColumn("_size", size).withColumn("_total", total).withColumn("_place", F.row_number().over(order))
    refuse = F.raise_error(F.concat(F.lit("OUT_OF_RANGE area_entry_too_large required="), F.col("_size").cast("string"), F.lit(f" limit={budget}")))
    kept = sized.withColumn("_keep", F.when((F.col("_place") == 1) & (F.col("_size") > budget), refuse.cast("boolean")).otherwise(F.col("_total") <= budget))
    return kept.where("_keep").drop("_size", "_total", "_place", "_keep")
