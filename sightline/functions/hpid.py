"""Hierarchical paths: dot-joined ordinals such as 1.4.2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(hpid: Column) -> Column:
    return F.split(hpid, r"\.")


def numeric(hpid: Column) -> Column:
    """Ordinals as numbers, so that 01 equals 1."""
    return F.transform(segments(hpid), lambda s: s.try_cast("int"))


def depth(hpid: Column) -> Column:
    return F.size(segments(hpid))


def parent(hpid: Column) -> Column:
    """The path one step up; empty for a root."""
    return F.array_join(F.slice(segments(hpid), 1, F.greatest(depth(hpid) - 1, F.lit(0))), ".")


def ancestors(hpid: Column) -> Column:
    """All proper prefixes, from the root down."""
    steps = F.when(depth(hpid) > 1, F.sequence(F.lit(1), depth(hpid) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(segments(hpid), 1, n), "."))


def suffix(hpid: Column, n: int) -> Column:
    """The last n ordinals, or the whole of a shorter path."""
    return F.array_join(F.slice(segments(hpid), F.greatest(depth(hpid) - n + 1, F.lit(1)), n), ".")


def root(hpid: Column) -> Column:
    return F.get(segments(hpid), F.lit(0))
