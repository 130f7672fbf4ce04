"""Address algebra: blocks, chunks and large chunks on signed 64-bit axes.

Everything is integer SQL.  Division by ``/`` would go through doubles and lose bits above 2^53, and
``x - pmod(x, w)`` underflows near the smallest integer, so floor division corrects the truncated quotient instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN64, MAX64 = -(1 << 63), (1 << 63) - 1
#: Fixed limits of a table's geometry: side, blocks in a chunk, chunks in a large chunk per axis.
MAX_SIDE, MAX_VOLUME, MAX_LARGE = 4096, 1 << 20, 10**6


def floor_div(value: str, by: int) -> str:
    """SQL for the quotient rounded down; exact on all 64-bit integers, null for null."""
    return f"(`{value}` div {by}L - case when `{value}` % {by}L < 0 then 1L else 0L end)"


def floor_mod(value: str, by: int) -> str:
    return f"pmod(`{value}`, {by}L)"


@dataclass(frozen=True)
class Geometry:
    """Sides of a chunk in blocks, and of a large chunk in chunks; two or three axes."""

    chunk: tuple[int, ...] = (16, 16)
    large: tuple[int, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.large:
            object.__setattr__(self, "large", (8,) * len(self.chunk))
        if len(self.chunk) not in (2, 3) or len(self.large) != len(self.chunk):
            raise ValueError("geometry has two or three axes, the same for chunks and large chunks")
        volume = 1
        for side in self.chunk:
            volume *= side
        if any(not 1 <= s <= MAX_SIDE for s in self.chunk) or volume > MAX_VOLUME or any(not 1 <= s <= MAX_LARGE for s in self.large):
            raise ValueError("geometry is out of range")

    @property
    def dims(self) -> int:
        return len(self.chunk)

    @property
    def blocks(self) -> list[str]:
        return ["x", "y", "z"][: self.dims]

    @property
    def chunks(self) -> list[str]:
        return ["cx", "cy", "cz"][: self.dims]

    @property
    def larges(self) -> list[str]:
        return ["lx", "ly", "lz"][: self.dims]

    def addressed(self, blocks: DataFrame, *, large: bool = False) -> DataFrame:
        """Adds the chunk coordinates, and the large chunk's, to rows with block coordinates."""
        out = blocks.withColumns({c: F.expr(floor_div(b, s)) for c, b, s in zip(self.chunks, self.blocks, self.chunk)})
        return self.sharded(out) if large else out

    def sharded(self, chunks: DataFrame) -> DataFrame:
        """Adds the large chunk's coordinates, the partition columns of stored tables."""
        return chunks.withColumns({c: F.expr(floor_div(b, s)) for c, b, s in zip(self.larges, self.chunks, self.large)})

    def local(self) -> list[Column]:
        """Position inside the chunk, on each axis."""
        return [F.expr(floor_mod(b, s)) for b, s in zip(self.blocks, self.chunk)]

    def local_index(self) -> Column:
        """Position in the chunk, the first axis fastest."""
        index, stride = F.lit(0).cast("long"), 1
        for at, side in zip(self.local(), self.chunk):
            index, stride = index + at * F.lit(stride).cast("long"), stride * side
        return index

    def absolute(self, chunk: str, local: str, axis: int) -> Column:
        """Block coordinate of a chunk and a local position; null where it lies beyond 64 bits, and the pair must be kept instead."""
        return F.expr(f"try_add(try_multiply(`{chunk}`, {self.chunk[axis]}L), `{local}`)")

    def chunk_of(self, *blocks: int) -> tuple[int, ...]:
        return tuple(b // s for b, s in zip(blocks, self.chunk))
