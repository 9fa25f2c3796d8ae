"""Derived tables: rules as DataFrame functions or SQL, evaluated in order of their dependencies."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Mapping
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Domain, SchemaError
from .lineage import Lineage

EX, SLICE = "ex", "slice"


def evaluation_order(domain: Domain) -> list[str]:
    """Intensional signatures, each after those that its rule reads."""
    order: list[str] = []
    waiting = {n: set(domain.signatures[n].depends_on) & set(domain.intensional_signatures) - {n} for n in domain.intensional_signatures}
    while waiting:
        ready = sorted(n for n, needs in waiting.items() if needs <= set(order))
        if not ready:
            raise SchemaError(f"rules depend on each other: {sorted(waiting)}; use a fixpoint rule")
        order += ready
        for n in ready:
            del waiting[n]
    return order


def names_in(rule: str) -> set[str]:
    """The tables that a rule's SQL names, in braces."""
    return {re.match(r"\w*", name)[0] for _, name, _, _ in Formatter().parse(rule) if name}


class _Reading(Mapping):
    """Tables by name; remembers which were asked for."""

    def __init__(self, names: list[str], find: Callable[[str], DataFrame]):
        self.names, self.find, self.seen = names, find, set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        self.seen.add(name)
        return self.find(name)

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def deduce(domain: Domain, tables: dict[str, DataFrame], keep: bool = False) -> dict[str, DataFrame]:
    """All tables of the domain: the given ones with set semantics, and the derived ones.

    What a rule reads is evaluated first, declared or not, and noted in ``domain.captured``, as are the tables that its plan shows to take
    part, so that nothing derived from a target is overlooked. With ``keep`` derived tables are checkpointed, so that what reads them several times (a graph, other rules) runs their joins once.
    """
    out, doing = dict(tables), []
    for name in domain.extensional_signatures:
        out[name] = tables[name].dropDuplicates()
    known = [*out, *(n for n in domain.intensional_signatures if n not in out)]
    for name in domain.intensional_signatures:
        out.pop(name, None)
    plans: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name in out:
            return out[name]
        if name in doing:
            raise SchemaError(f"rules depend on each other: {doing[doing.index(name):]}; use a fixpoint rule")
        doing.append(name)
        s, reading = domain.signatures[name], _Reading(known, table)
        if isinstance(s.rule, str):
            read = {n: reading[n] for n in sorted(names_in(s.rule))}
            spark = next(iter([*read.values(), *out.values()])).sparkSession
            found = spark.sql(s.rule, **read)
        else:
            found = s.rule(reading)
        domain.captured[name] = reading.seen
        keys = [EX, *([SLICE] if SLICE in found.columns else [])]
        found = found.select(*keys, *[c.name for c in s.columns]).dropDuplicates()
        plans[name] = found
        out[name] = cut(found) if keep else found
        doing.remove(name)
        return out[name]

    for name in evaluation_order(domain):
        table(name)
    # plans are compared when all are known: a rule may hold what another one derives, whichever comes first
    lineage = Lineage(tables)
    for name, df in (out | plans).items():
        lineage.add(name, df)
        if keep and name in plans:
            lineage.add(name, out[name])
    for name, df in plans.items():
        domain.captured[name] |= lineage.reads(df, name)
    return out


def union_of(*clauses: DataFrame) -> DataFrame:
    """Several clauses of one head: their union as a set."""
    return reduce(DataFrame.unionByName, clauses).dropDuplicates()


def exists(rows: DataFrame, goal: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(goal, on, "left_semi")


def absent(rows: DataFrame, goal: DataFrame, on: list[str]) -> DataFrame:
    """Negation as failure."""
    return rows.join(goal, on, "left_anti")


def unnest(rows: DataFrame, column: str, alias: str) -> DataFrame:
    return rows.withColumn(alias, F.explode(column)).drop(column)


def forall(rows: DataFrame, condition: Column, goal: Column, by: list[str]) -> DataFrame:
    """Groups in which every row that meets the condition meets the goal."""
    return rows.groupBy(*by).agg(F.coalesce(F.bool_and(F.when(condition, goal)), F.lit(True)).alias("holds")).filter("holds").drop("holds")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Semi-naive recursion: ``step`` maps the rows found last to new ones, until there are none.

    Every round is written as a checkpoint, so plans stay short and a lost executor costs one round.
    """
    found = fresh = cut(seed.dropDuplicates())
    for _ in range(rounds):
        fresh = cut(step(fresh).select(*found.columns).dropDuplicates().join(found, found.columns, "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"no fixpoint within {rounds} rounds")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans start from its files, and a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder of spark.checkpoint.dir; a temporary one only for a local session, whose executors see the driver's disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(found)


def ground_violations(rows: DataFrame) -> DataFrame:
    """Derived rows with an unbound column."""
    return rows.filter(reduce(Column.__or__, [F.col(c).isNull() for c in rows.columns]))


def key_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur with different properties."""
    return rows.dropDuplicates().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cumulative(found: DataFrame, slices: list[str], head: list[str]) -> DataFrame:
    """Rules over sliced facts: a fact belongs to the first slice in which all that it was derived from is known."""
    return found.groupBy(*head).agg(F.min(F.greatest(*slices) if len(slices) > 1 else F.col(slices[0])).alias(SLICE))


def signature_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table per interpretation."""
    parts = [t.groupBy(EX).agg(F.count(F.lit(1)).alias("n")).select(EX, F.lit(name).alias("sig"), "n") for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)
