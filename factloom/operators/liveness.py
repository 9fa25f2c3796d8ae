"""What must not be seen when a target is learned: dependents of the target, and slices after the present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Domain, SchemaError
from .deduce import SLICE, names_in


def calls(domain: Domain) -> dict[str, set[str]]:
    """Which tables each rule reads: those its SQL or its goals name, those it was seen to read or its plan shows, and those declared; helpers are named in ``domain.helpers``."""
    found = {s.name: set(s.depends_on) | domain.captured.get(s.name, set()) | (names_in(s.rule) if isinstance(s.rule, str) else getattr(s.rule, "reads", set())) for s in domain.signatures.values()}
    for name, reads in domain.helpers.items():
        found.setdefault(name, set()).update(reads)
    return found


def dependents(domain: Domain, target: str) -> set[str]:
    """Signatures to kill with a target: itself, what it is derived from, what is derived from it, and what that is derived from.

    Descendants of ancestors stay, and so do names declared safe.
    """
    below = calls(domain)
    above: dict[str, set[str]] = {}
    for a, reads in below.items():
        for b in reads:
            above.setdefault(b, set()).add(a)

    def closure(start: str, step: dict[str, set[str]]) -> set[str]:
        found, todo = set(), [start]
        while todo:
            for x in step.get(todo.pop(), ()):
                if x not in found and x not in domain.safe:
                    found.add(x)
                    todo.append(x)
        return found

    users = closure(target, above)
    out = {target} | closure(target, below) | users
    for u in users:
        out |= closure(u, below)
    return out & set(domain.signatures)


def check_target(domain: Domain, target: str) -> None:
    """A target's own vertices can't be kernel centres: they are dead."""
    if domain.is_kernel_point(target):
        raise SchemaError(f"target {target} is a kernel point")


def alive_unless(signatures: set[str]) -> Column:
    return ~F.col("sig").isin(sorted(signatures))


def kill_future(vertices: DataFrame, last: object) -> DataFrame:
    """Vertices of later slices become dead; those without a slice stay."""
    return vertices.withColumn("alive", F.col("alive") & (F.col(SLICE).isNull() | (F.col(SLICE) <= F.lit(last))))


def resuscitate(vertices: DataFrame, first: object) -> DataFrame:
    """Vertices of slices from ``first`` on are alive again."""
    return vertices.withColumn("alive", F.col("alive") | F.coalesce(F.col(SLICE) >= F.lit(first), F.lit(False)))


def set_alive(vertices: DataFrame, condition: Column, state: bool) -> DataFrame:
    """State of all vertices that meet a condition: a signature, a slice, both, or any."""
    return vertices.withColumn("alive", F.when(condition, F.lit(state)).otherwise(F.col("alive")))


def extreme_slice(rows: DataFrame, order: DataFrame | None = None, last: bool = True) -> DataFrame:
    """The last or first slice of each interpretation, by native order or by a table (slice, ord)."""
    pick = F.max_by if last else F.min_by
    if order is None:
        return rows.groupBy("ex").agg((F.max if last else F.min)(SLICE).alias(SLICE))
    return rows.select("ex", SLICE).distinct().join(order, SLICE).groupBy("ex").agg(pick(SLICE, "ord").alias(SLICE))


def is_sliced(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ex").agg((F.count_distinct(SLICE) > 1).alias("sliced"))


def dependency_dot(domain: Domain) -> str:
    lines = [f'  "{a}" -> "{b}";' for a, reads in sorted(calls(domain).items()) for b in sorted(reads)]
    return "\n".join(["digraph dependencies {", *lines, "}"])
