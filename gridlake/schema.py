"""Column types and versioned schemas.

A schema is a list of block columns and a list of chunk (metadata) columns with stable ids.  Each change is one version; any
earlier version can be had by undoing changes, and rows written under it are brought to the current version by a chain of
projections, which Catalyst collapses into one.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS, MAX_NAME, MAX_FIXED_BITS, MAX_VALUE, MAX_VERSION = 1024, 63, 65535, 16 << 20, 65535
F32_MAX = struct.unpack("<f", b"\xff\xff\x7f\x7f")[0]
NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
TABLE_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}\Z")


class GridError(ValueError):
    """A refused statement; ``code`` is its class."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code} {message}")
        self.code = code


def invalid(message: str) -> GridError:
    return GridError("INVALID_ARGUMENT", message)


@dataclass(frozen=True)
class Type:
    """One of u, i, bool, f, bits, text, bytes; ``size`` is the width in bits, the number of bits, or the most bytes."""

    kind: str
    size: int = 0

    @classmethod
    def parse(cls, text: str) -> Type:
        text = text.strip().lower()
        if text == "bool":
            return cls("bool")
        if m := re.fullmatch(r"([uif])([0-9]+)", text):
            kind, size = m[1], int(m[2])
            if kind == "f" and size in (32, 64) or kind == "u" and 1 <= size <= 64 or kind == "i" and 2 <= size <= 64:
                return cls(kind, size)
        if m := re.fullmatch(r"(bits|text|bytes)\s*\(\s*([0-9]+)\s*\)", text):
            kind, size = m[1], int(m[2])
            if kind == "bits" and 1 <= size <= MAX_FIXED_BITS or kind != "bits" and 1 <= size <= MAX_VALUE:
                return cls(kind, size)
        raise invalid(f"unknown type {text}")

    def __str__(self) -> str:
        return self.kind if self.kind == "bool" else f"{self.kind}{self.size}" if self.kind in "uif" else f"{self.kind}({self.size})"

    @property
    def family(self) -> str:
        return "int" if self.kind in "ui" else "float" if self.kind == "f" else self.kind

    @property
    def fixed_bits(self) -> int:
        return 1 if self.kind == "bool" else 0 if self.kind in ("text", "bytes") else self.size

    @property
    def spark(self) -> str:
        """Physical type: the smallest that holds every value; u64 needs a decimal."""
        if self.kind == "bool":
            return "boolean"
        if self.kind == "f":
            return "float" if self.size == 32 else "double"
        if self.kind in ("bits", "text"):
            return "string"
        if self.kind == "bytes":
            return "binary"
        bits = self.size + (self.kind == "u")
        return "tinyint" if bits <= 8 else "smallint" if bits <= 16 else "int" if bits <= 32 else "bigint" if bits <= 64 else "decimal(20,0)"

    @property
    def range(self) -> tuple[int, int]:
        return (0, (1 << self.size) - 1) if self.kind == "u" else (-(1 << self.size - 1), (1 << self.size - 1) - 1)

    @property
    def zero(self) -> Any:
        return {"int": 0, "float": 0.0, "bool": False, "bits": "0" * self.size, "text": "", "bytes": b""}[self.family]

    def literal(self, value: Any) -> Col:
        if value is None:
            return F.lit(None).cast(self.spark)
        if self.family == "int":
            return F.lit(str(value)).cast("decimal(20,0)").cast(self.spark)
        return F.lit(value).cast(self.spark)

    def fits(self, value: Col) -> Col:
        """Whether a value of the same family fits; null doesn't say no."""
        if self.family == "int":
            low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in self.range)
            ok = value.cast("decimal(38,0)").between(low, high)
        elif self.family == "float":
            finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
            ok = F.lit(True) if self.size == 64 else ~finite | (F.abs(value.cast("double")) <= F.lit(F32_MAX))
        elif self.kind == "text":
            ok = F.octet_length(value) <= self.size
        elif self.kind == "bytes":
            ok = F.octet_length(value) <= self.size
        elif self.kind == "bits":
            # a shorter value is padded; of a longer one the digits beyond must be 0
            ok = (F.length(value) <= self.size) | ~F.substring(value, self.size + 1, MAX_FIXED_BITS).contains("1")
        else:
            ok = F.lit(True)
        return F.coalesce(ok, F.lit(True))

    def cast(self, value: Col) -> Col:
        """A value that fits, in this type."""
        return F.rpad(F.substring(value, 1, self.size), self.size, "0") if self.kind == "bits" else value.cast(self.spark)

    def clamp(self, value: Col) -> Col:
        """The nearest value that fits; NaN and infinities stay."""
        if self.family == "int":
            low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in self.range)
            wide = value.cast("decimal(20,0)")
            return F.when(wide < low, low).when(wide > high, high).otherwise(wide).cast(self.spark)
        if self.family == "float":
            if self.size == 64:
                return value.cast("double")
            wide = value.cast("double")
            inf = F.lit(float("inf"))
            bound = F.lit(F32_MAX)
            return F.when(F.isnan(wide) | (F.abs(wide) == inf), wide).when(wide > bound, bound).when(wide < -bound, -bound).otherwise(wide).cast("float")
        raise invalid("CLAMP is for numbers")

    def truncate(self, value: Col) -> Col:
        """Text is cut before the character that crosses the bound, bytes and bits at it."""
        if self.kind == "bits":
            return F.rpad(F.substring(value, 1, self.size), self.size, "0")
        raw = value.cast("binary")
        if self.kind == "bytes":
            return F.substring(raw, 1, self.size)
        if self.kind != "text":
            raise invalid("TRUNCATE is for text, bytes and bits")
        # the byte after the cut continues a character (10xxxxxx): step back to that character's start, 3 bytes at most
        follows = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
        cut = F.lit(self.size)
        for back in range(min(3, self.size), 0, -1):
            all_follow = F.lit(True)
            for k in range(back):
                all_follow = all_follow & follows(self.size - k)
            cut = F.when(all_follow & (cut > self.size - back), F.lit(self.size - back)).otherwise(cut)
        return F.when(F.octet_length(value) <= self.size, value).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: Type
    nullable: bool = False
    required: bool = False
    default: Any = None
    has_default: bool = False

    @property
    def initial(self) -> Any:
        """Value of a new block that doesn't name the column: the default, else null, else zero."""
        return self.default if self.has_default else None if self.nullable else self.type.zero

    def initial_col(self) -> Col:
        return self.type.literal(self.initial)


@dataclass(frozen=True)
class Change:
    """One schema version's step.  ``kind``: add, drop, rename, type."""

    kind: str
    domain: str
    column: Column
    position: int = 0
    name: str = ""
    type: Type | None = None
    policy: str = ""


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    chunk_columns: tuple[Column, ...] = ()
    version: int = 1
    next_id: int = 1
    history: tuple[Change, ...] = ()

    @classmethod
    def of(cls, columns: list[Column], chunk_columns: list[Column] = ()) -> Schema:  # type: ignore[assignment]
        n, out = 1, ([], [])
        for k, part in enumerate((columns, chunk_columns)):
            for c in part:
                out[k].append(replace(c, id=n))
                n += 1
        found = cls(tuple(out[0]), tuple(out[1]), 1, n)
        found.check()
        return found

    def check(self) -> None:
        for part in (self.columns, self.chunk_columns):
            if len(part) > MAX_COLUMNS:
                raise invalid("too many columns")
            names = [c.name for c in part]
            if len(set(names)) < len(names):
                raise invalid("a column is named twice")
            for c in part:
                if not NAME.match(c.name) or len(c.name) > MAX_NAME:
                    raise invalid(f"bad column name {c.name}")
                if c.has_default and c.default is None and not c.nullable:
                    raise invalid(f"column {c.name} can't be NULL by default")
        if not any(c.type.fixed_bits for c in self.columns):
            raise invalid("a table needs a column of fixed width")
        if sum(c.type.fixed_bits for c in self.columns) > MAX_FIXED_BITS:
            raise invalid("a block is too wide")

    def part(self, domain: str) -> tuple[Column, ...]:
        return self.columns if domain == "block" else self.chunk_columns

    def column(self, name: str, domain: str = "block") -> Column:
        for c in self.part(domain):
            if c.name == name:
                return c
        raise invalid(f"unknown column {name}")

    def _with(self, domain: str, columns: list[Column], change: Change, next_id: int | None = None) -> Schema:
        if self.version >= MAX_VERSION:
            raise invalid("too many schema versions")
        new = {"columns": tuple(columns)} if domain == "block" else {"chunk_columns": tuple(columns)}
        found = replace(self, **new, version=self.version + 1, next_id=next_id or self.next_id, history=(*self.history, change))
        found.check()
        return found

    def add(self, column: Column, domain: str = "block") -> Schema:
        column = replace(column, id=self.next_id)
        return self._with(domain, [*self.part(domain), column], Change("add", domain, column, len(self.part(domain))), self.next_id + 1)

    def drop(self, name: str, domain: str = "block") -> Schema:
        column = self.column(name, domain)
        columns = list(self.part(domain))
        at = columns.index(column)
        return self._with(domain, columns[:at] + columns[at + 1 :], Change("drop", domain, column, at))

    def rename(self, name: str, new: str, domain: str = "block") -> Schema:
        column = self.column(name, domain)
        columns = [replace(c, name=new) if c is column else c for c in self.part(domain)]
        return self._with(domain, columns, Change("rename", domain, column, columns.index(replace(column, name=new)), new))

    def retype(self, name: str, kind: Type, policy: str = "") -> Schema:
        """Change a block column's type within its family.  Narrowing without a policy needs ``misfits`` to be empty first."""
        column = self.column(name)
        if column.type.family != kind.family:
            raise invalid(f"column {name} can't change from {column.type} to {kind}")
        if policy == "CLAMP" and kind.family not in ("int", "float") or policy == "TRUNCATE" and kind.family not in ("text", "bytes", "bits"):
            raise invalid(f"USING {policy} doesn't fit {kind}")
        columns = [self._retyped(c, kind, policy) if c is column else c for c in self.columns]
        return self._with("block", columns, Change("type", "block", column, self.columns.index(column), "", kind, policy))

    @staticmethod
    def _retyped(column: Column, kind: Type, policy: str) -> Column:
        """The column under its new type; a default that doesn't fit is converted as the values are."""
        value = column.default
        if column.has_default and value is not None:
            if kind.family == "int" and not kind.range[0] <= value <= kind.range[1]:
                if policy != "CLAMP":
                    raise invalid(f"the default {value} doesn't fit {kind}")
                value = min(max(value, kind.range[0]), kind.range[1])
            elif kind == Type("f", 32) and abs(value) != float("inf") and abs(value) > F32_MAX:
                value = F32_MAX if value > 0 else -F32_MAX
            elif kind.kind == "bits":
                value = value[: kind.size].ljust(kind.size, "0")
            elif kind.kind == "bytes":
                value = value[: kind.size]
            elif kind.kind == "text":
                value = value.encode()[: kind.size].decode(errors="ignore")
        return replace(column, type=kind, default=value)

    def at(self, version: int) -> Schema:
        """The schema as it was, by undoing steps from the last."""
        if not 1 <= version <= self.version:
            raise invalid(f"no schema version {version}")
        found = self
        while found.version > version:
            change, columns = found.history[-1], list(found.part(found.history[-1].domain))
            if change.kind == "add":
                columns = [c for c in columns if c.id != change.column.id]
            elif change.kind == "drop":
                columns.insert(change.position, change.column)
            else:
                columns[[c.id for c in columns].index(change.column.id)] = change.column
            new = {"columns": tuple(columns)} if change.domain == "block" else {"chunk_columns": tuple(columns)}
            found = replace(found, **new, version=found.version - 1, history=found.history[:-1])
        return found

    def widens(self, old: Type, new: Type) -> bool:
        if old.family == "int":
            return new.range[0] <= old.range[0] and old.range[1] <= new.range[1]
        return old.kind == "bool" or new.size >= old.size

    def convert(self, change: Change, value: Col) -> Col:
        """A stored value under a type change: widened, or as the change's policy says."""
        new = change.type
        if change.policy == "CLAMP":
            return new.clamp(value)
        if change.policy == "TRUNCATE":
            return new.truncate(value)
        if change.policy == "DEFAULT":
            fallback = replace(change.column, type=new).initial_col()
            return F.when(value.isNull() | new.fits(value), F.when(new.fits(value), new.cast(value))).otherwise(fallback)
        return new.cast(value)

    def translate(self, rows: DataFrame, version: int, domain: str = "block") -> DataFrame:
        """Rows written under ``version`` with the columns of this version; other columns (addresses, revisions) pass through."""
        old = self.at(version)
        current = {c.id: F.col(f"`{c.name}`") for c in old.part(domain)}
        own = {c.name for c in old.part(domain)}
        for change in self.history[version - 1 :]:
            if change.domain != domain:
                continue
            if change.kind == "add":
                current[change.column.id] = change.column.initial_col()
            elif change.kind == "drop":
                current.pop(change.column.id)
            elif change.kind == "type":
                current[change.column.id] = self.convert(change, current[change.column.id])
        passing = [F.col(f"`{c}`") for c in rows.columns if c not in own]
        return rows.select(*passing, *[current[c.id].alias(c.name) for c in self.part(domain)])

    def misfits(self, blocks: DataFrame, name: str, kind: Type, order: list[str]) -> DataFrame:
        """The first block, in coordinate order, whose value doesn't fit a narrower type; empty if all fit."""
        return blocks.where(~kind.fits(F.col(name))).orderBy(*order).limit(1).select(*order, F.col(name).alias("holds"))


def parse_column(text: str) -> Column:
    """``name type [NULL] [REQUIRED] [DEFAULT value]``, for tables declared in code."""
    m = re.fullmatch(r"\s*(\w+)\s+(\w+(?:\s*\(\s*\d+\s*\))?)((?:\s+(?:NULL|REQUIRED|DEFAULT\s+\S+))*)\s*", text, re.I)
    if not m:
        raise invalid(f"bad column {text}")
    kind, rest = Type.parse(m[2]), m[3]
    d = re.search(r"DEFAULT\s+(\S+)", rest, re.I)
    rest = re.sub(r"DEFAULT\s+\S+", "", rest, flags=re.I)
    value: Any = None
    if d and d[1].upper() != "NULL":
        value = int(d[1]) if kind.family == "int" else float(d[1]) if kind.family == "float" else d[1].upper() == "TRUE" if kind.kind == "bool" else d[1].strip("'b")
    nullable = bool(re.search(r"\bNULL\b", rest, re.I))
    return Column(0, m[1], kind, nullable, bool(re.search("REQUIRED", rest, re.I)), value, bool(d) and not (value is None and nullable))


def parse_schema(columns: str, chunk_columns: str = "") -> Schema:
    split = lambda s: [parse_column(x) for x in re.split(r",(?![^(]*\))", s) if x.strip()]
    return Schema.of(split(columns), split(chunk_columns))
