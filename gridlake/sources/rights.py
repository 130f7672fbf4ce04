"""Users' rights on tables: READ < WRITE < ADMIN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"READ": 1, "WRITE": 2, "ADMIN": 3}
NAMES = {v: k for k, v in LEVELS.items()}
ALL = "*"


def grant(rights: dict[str, int], target: str, names: list[str]) -> dict[str, int]:
    """A list grants its highest right; a grant never lowers one."""
    return rights | {target: max(rights.get(target, 0), *(LEVELS[n] for n in names))}


def revoke(rights: dict[str, int], target: str, names: list[str]) -> dict[str, int]:
    """A list revokes from its lowest right up, of exactly this entry; the right below it stays, and nothing below READ."""
    left = min(rights.get(target, 0), min(LEVELS[n] for n in names) - 1)
    return {k: v for k, v in (rights | {target: left}).items() if v}


def right(rights: dict[str, int], target: str) -> int:
    return max(rights.get(target, 0), rights.get(ALL, 0))


def effective(grants: DataFrame) -> DataFrame:
    """(name, target, level) for every entry (name, target, level): the higher of it and the user's entry for all tables."""
    best = grants.groupBy("name").agg(F.max(F.when(F.col("target") == ALL, F.col("level"))).alias("everywhere"))
    own = grants.groupBy("name", "target").agg(F.max("level").alias("own"))
    return own.join(best, "name").select("name", "target", F.greatest("own", "everywhere").alias("level"))
