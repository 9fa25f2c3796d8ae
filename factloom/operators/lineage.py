"""What a rule reads, from the analysed plan of its result.

A rule may hold a DataFrame of its own, in a closure say, that no name gives away. Its plan does: a table of the domain that takes part in
a rule is a subtree of the rule's analysed plan, equal to the table's own plan but for the numbers of its columns. Sources that
lie in no such subtree are charged to the tables that read them, so a second way to a table's files is seen as well;
if several tables read that source, it is charged to all of them, as nothing that may tell of a target should stay alive.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def _plan(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def _inner(plan) -> list:
    """Children, and the plans of subqueries in expressions."""
    return [seq.apply(k) for seq in (plan.children(), plan.subqueries()) for k in range(seq.size())]


def _leaves(plan) -> list:
    """The sources of a plan."""
    inner = _inner(plan)
    return [leaf for child in inner for leaf in _leaves(child)] if inner else [plan]


class _Known:
    """Plans by hash, then by comparison."""

    def __init__(self):
        self.plans: dict[int, list] = {}

    def add(self, plan, name: str) -> None:
        self.plans.setdefault(plan.semanticHash(), []).append((plan, name))

    def names(self, plan) -> set[str]:
        return {name for other, name in self.plans.get(plan.semanticHash(), ()) if plan.sameResult(other)}


class Lineage:
    """Knows the plans of tables; a table may be known by several (as it was given, and without its duplicates)."""

    def __init__(self, tables: Mapping[str, DataFrame] | None = None):
        self.whole, self.sources = _Known(), _Known()
        for name, df in (tables or {}).items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> None:
        plan = _plan(df)
        self.whole.add(plan, name)
        for leaf in _leaves(plan):
            if leaf.nodeName() not in ("OneRowRelation", "Range"):
                self.sources.add(leaf, name)

    def reads(self, df: DataFrame, own: str | None = None) -> set[str]:
        """The tables that take part in ``df``, but for its ``own`` name."""

        def walk(plan) -> set[str]:
            if found := self.whole.names(plan) - {own}:
                return found
            inner = _inner(plan)
            return set().union(*map(walk, inner)) if inner else self.sources.names(plan) - {own}

        return walk(_plan(df))
