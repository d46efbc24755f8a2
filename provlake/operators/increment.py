"""What is new, stale and orphaned: expected rows against stored ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.filters import parse

STATUS = "status"


@dataclass(frozen=True)
class Increment:
    """Lazy frames. ``new`` and ``stale`` have expected rows, ``orphaned`` stored ones; ``input`` is all expected."""

    new: DataFrame
    stale: DataFrame
    orphaned: DataFrame
    input: DataFrame | None = None
    changed: DataFrame | None = None

    def changes(self) -> DataFrame:
        """new and stale in one frame, with a status column; by one join, where resolve made one."""
        if self.changed is not None:
            return self.changed
        return self.new.withColumn(STATUS, F.lit("new")).unionByName(self.stale.withColumn(STATUS, F.lit("stale")), allowMissingColumns=True)

    def persist(self) -> Increment:
        """The three frames kept on disk between uses, so that none is worked out twice."""
        from pyspark import StorageLevel

        return Increment(*[x.persist(StorageLevel.DISK_ONLY_2) for x in (self.new, self.stale, self.orphaned)], self.input)


def _stale(stored: str, fresh: str, also: str | None) -> Column:
    c = C.col(stored).isNull() | (C.col(stored) != C.col(fresh))
    return c | F.coalesce(C.col(also), F.lit(False)) if also else c


def _marked(current: DataFrame, stale_if: Sequence[object]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(parse(p), F.lit(False)) for p in stale_if]) if stale_if else F.lit(False)


def collapse(current: DataFrame, ids: Sequence[str]) -> DataFrame:
    """1:N: the stored children of each parent as one row, any of them."""
    rest = [c for c in current.columns if c not in ids]
    return current.groupBy(*map(C.col, ids)).agg(*[F.any_value(C.col(c), F.lit(True)).alias(c) for c in rest])


def resolve(expected: DataFrame, current: DataFrame | None, ids: Sequence[str], *, stale_if: Sequence[object] = (), expands: bool = False) -> Increment:
    """Rows of expected that current lacks, or has with another provenance, and of current that expected lacks.

    ``stale_if`` are conditions on stored rows that make them stale whatever their provenance. Rows
    with a null id match nothing: they are new on one side and orphaned on the other.
    """
    ids = list(ids)
    if current is None:
        none = expected.limit(0)
        return Increment(expected, none, none, expected)
    if expands:
        current = collapse(current, ids)
    side = current.select(*map(C.col, ids), C.col(C.PROV).alias("__stored__"), _marked(current, stale_if).alias("__marked__"))
    new = expected.join(side.select(*map(C.col, ids)), ids, "left_anti")
    stale = expected.join(side, ids, "inner").where(_stale("__stored__", C.PROV, "__marked__")).select(*map(C.col, expected.columns))
    orphaned = current.join(expected.select(*map(C.col, ids)), ids, "left_anti")
    # both sides are worked out once
    found = expected.join(side.withColumn("__there__", F.lit(True)), ids, "left")
    status = F.when(F.col("__there__").isNull(), "new").when(_stale("__stored__", C.PROV, "__marked__"), "stale")
    changed = found.withColumn(STATUS, status).where(C.col(STATUS).isNotNull()).select(*map(C.col, expected.columns), STATUS)
    return Increment(new, stale, orphaned, expected, changed)


def tagged(expected: DataFrame, current: DataFrame, ids: Sequence[str], *, stale_if: Sequence[object] = ()) -> DataFrame:
    """(ids, status) of every row of either side in one pass: new, stale, fresh or orphaned.

    One full join where resolve takes three, for counts and status; ids must be unique on both sides.
    """
    ids = list(ids)
    e = expected.select(*map(C.col, ids), C.col(C.PROV).alias("__fresh__"), F.lit(True).alias("__e__"))
    c = current.select(*map(C.col, ids), C.col(C.PROV).alias("__stored__"), _marked(current, stale_if).alias("__marked__"), F.lit(True).alias("__c__"))
    status = F.when(F.col("__c__").isNull(), "new").when(F.col("__e__").isNull(), "orphaned").when(_stale("__stored__", "__fresh__", "__marked__"), "stale").otherwise("fresh")
    return e.join(c, ids, "full").select(*map(C.col, ids), status.alias(STATUS))
