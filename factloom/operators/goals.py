"""Rule bodies as lists of goals with shared variables, turned into one join plan.

A body is a tuple of goals: ``goal(table, column=term, ...)`` for a fact, ``absent(...)`` for the failure of one or several goals, ``holds`` for a
comparison, ``let`` for a computed value, ``member`` for an element of a list, and ``another`` for a second fact that only has to be there. Terms are variables (``Var``) or constants. Bodies are plain tuples, so
they are joined with ``+``; ``occurs`` and ``missing`` look goals up by unification.

The order in which goals are written doesn't matter. Facts join along their shared variables (never as a product), a fact that binds
nothing that is needed later only filters (a semi join), and comparisons and negations come as soon as their variables are bound.
A rule whose result would depend on a variable that no fact binds is refused. Nulls unify with nothing, as in SQL.

Tables with a column ``ex`` meet within one interpretation, whether goals name it or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SchemaError
from .deduce import EX


class UnsafeRule(SchemaError):
    """A rule with a variable that nothing binds, or with goals that share no variable."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Goal:
    """A fact of a table whose columns match terms."""

    table: str
    terms: tuple[tuple[str, object], ...]

    @property
    def variables(self) -> set[str]:
        return {t.name for _, t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Absent:
    """Negation as failure of a conjunction; variables that only it has are its own."""

    body: tuple

    @property
    def variables(self) -> set[str]:
        return set().union(*(g.variables for g in self.body))


@dataclass(frozen=True)
class Holds:
    """A condition on bound variables."""

    test: Callable[..., Column]
    inputs: tuple[Var, ...]

    @property
    def variables(self) -> set[str]:
        return {v.name for v in self.inputs}


@dataclass(frozen=True)
class Let:
    """A variable computed from bound ones, or, with ``each``, each element of the list computed. A bound variable must equal it."""

    output: Var
    value: Callable[..., Column]
    inputs: tuple[Var, ...]
    each: bool = False

    @property
    def variables(self) -> set[str]:
        return {self.output.name} | {v.name for v in self.inputs}


@dataclass(frozen=True)
class Another:
    """A conjunction has an answer in which ``other`` is another value than the bound ``one``."""

    one: Var
    other: Var
    body: tuple

    @property
    def variables(self) -> set[str]:
        return {self.one.name}.union(*(g.variables for g in self.body)) - {self.other.name}


Literal = Goal | Absent | Holds | Let | Another


def goal(table: str, **terms: object) -> Goal:
    return Goal(table, tuple(terms.items()))


def absent(*body: Literal) -> Absent:
    return Absent(body)


def holds(test: Callable[..., Column], *inputs: Var) -> Holds:
    return Holds(test, inputs)


def let(output: Var, value: Callable[..., Column], *inputs: Var) -> Let:
    return Let(output, value, inputs)


def another(one: Var, other: Var, *body: Literal) -> Another:
    """Facts that differ from a bound one: ``other`` is a variable of the body alone, with values that have an order."""
    return Another(one, other, body)


def member(element: Var, items: Var) -> Let:
    return Let(element, lambda x: x, (items,), each=True)


# -- lists of goals -------------------------------------------------------------------------------------------------


def unify(a: Literal, b: Literal, known: Mapping[str, object] | None = None) -> dict[str, object] | None:
    """The most general substitution under which two facts are the same, or None. Columns that one leaves open match anything."""
    if not isinstance(a, Goal) or not isinstance(b, Goal):
        return dict(known or {}) if a == b else None
    if a.table != b.table:
        return None
    found, right = dict(known or {}), dict(b.terms)

    def bound(term):
        while isinstance(term, Var) and term.name in found:
            term = found[term.name]
        return term

    for column, term in a.terms:
        if column in right:
            x, y = bound(term), bound(right[column])
            if isinstance(x, Var):
                if x != y:
                    found[x.name] = y
            elif isinstance(y, Var):
                found[y.name] = x
            elif type(x) is not type(y) or x != y:
                return None
    return found


def occurs(wanted: Literal, body: Iterable[Literal]) -> list[dict[str, object]]:
    """A substitution for each goal of the body that unifies with the wanted one, in order."""
    return [s for g in body if (s := unify(wanted, g)) is not None]


def missing(wanted: Literal, body: Iterable[Literal]) -> bool:
    """No goal of the body unifies with the wanted one."""
    return not occurs(wanted, body)


def substitute(body: Iterable[Literal], known: Mapping[str, object]) -> tuple[Literal, ...]:
    """The body with its variables replaced; conditions take variables only."""

    def value(term):
        while isinstance(term, Var) and term.name in known:
            term = known[term.name]
        return term

    def variable(term: Var) -> Var:
        found = value(term)
        if not isinstance(found, Var):
            raise SchemaError(f"{term.name} stands in a condition and can't become {found!r}")
        return found

    out: list[Literal] = []
    for g in body:
        if isinstance(g, Goal):
            out.append(Goal(g.table, tuple((c, value(t)) for c, t in g.terms)))
        elif isinstance(g, Absent):
            out.append(Absent(substitute(g.body, known)))
        elif isinstance(g, Holds):
            out.append(Holds(g.test, tuple(map(variable, g.inputs))))
        elif isinstance(g, Another):
            out.append(Another(variable(g.one), variable(g.other), substitute(g.body, known)))
        else:
            out.append(Let(variable(g.output), g.value, tuple(map(variable, g.inputs)), g.each))
    return tuple(out)


def tables_in(body: Iterable[Literal]) -> set[str]:
    """The tables that a body reads, those of its negations as well."""
    return set().union(*(tables_in(g.body) if isinstance(g, Absent | Another) else {g.table} if isinstance(g, Goal) else set() for g in body))


# -- plans ---------------------------------------------------------------------------------------------------------------


def _rows(g: Goal, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The facts that match a goal, a column a variable, with ``ex`` where the table has it."""
    df = tables[g.table]
    conditions, places = [], {}
    for column, term in g.terms:
        if column not in df.columns:
            raise SchemaError(f"{g.table} has no column {column}")
        if not isinstance(term, Var):
            conditions.append(df[column].isNull() if term is None else df[column] == F.lit(term))
        elif term.name in places:
            conditions.append(df[column] == df[places[term.name]])
        else:
            places[term.name] = column
    if conditions:
        df = df.filter(reduce(Column.__and__, conditions))
    own = [F.col(EX)] if EX in df.columns and EX not in dict(g.terms) and EX not in places else []
    return df.select(*own, *[F.col(c).alias(v) for v, c in places.items()])


class _Plan:
    """Takes goals one after another: ``df`` holds the variables bound so far; ``scoped`` are negations that need the interpretation bound."""

    def __init__(self, body: tuple, needed: set[str]):
        self.df: DataFrame | None = None
        self.needed = needed
        self.todo = list(body)

    @property
    def bound(self) -> set[str]:
        return set(self.df.columns) if self.df is not None else set()

    def _wanted_later(self, done: Literal) -> set[str]:
        return self.needed.union(*(g.variables for g in self.todo if g is not done))

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        facts = {id(g): _rows(g, tables) for g in self.todo if isinstance(g, Goal)}
        scoped = any(EX in f.columns for f in facts.values())
        self.scoped = {id(g) for g in self.todo if isinstance(g, Absent | Another) and scoped and any(EX in tables[t].columns for t in tables_in(g.body))}
        while self.todo:
            g = self._next(facts)
            if isinstance(g, Goal):
                self._join(g, facts[id(g)])
            elif isinstance(g, Absent):
                self._without(g, tables)
            elif isinstance(g, Another):
                self._besides(g, tables)
            elif isinstance(g, Holds):
                self.df = self.df.filter(g.test(*[F.col(v.name) for v in g.inputs]))
            else:
                self._compute(g)
            self.todo.remove(g)
        if loose := self.needed - self.bound:
            raise UnsafeRule(f"nothing binds {sorted(loose)}")
        return self.df

    def _next(self, facts: dict[int, DataFrame]) -> Literal:
        ready = [g for g in self.todo if self._ready(g)]
        if ready:  # what only filters goes first
            return ready[0]
        goals = [g for g in self.todo if isinstance(g, Goal)]
        if self.df is None:
            if not goals:
                raise UnsafeRule("no fact binds a variable")
            # the fact with most constants leads; of equals, the one that shares most variables with others
            return max(goals, key=lambda g: (len(g.terms) - len(g.variables), sum(len(g.variables & o.variables) for o in self.todo if o is not g)))
        linked = [g for g in goals if self.bound & set(facts[id(g)].columns)]
        if linked:
            return max(linked, key=lambda g: (len(self.bound & g.variables), len(g.terms) - len(g.variables)))
        if goals:
            raise UnsafeRule(f"{goals[0].table} shares no variable with what comes before it")
        loose = sorted(set().union(*(g.variables for g in self.todo)) - self.bound)
        raise UnsafeRule(f"nothing binds {loose}")

    def _ready(self, g: Literal) -> bool:
        if self.df is None:
            return False
        if isinstance(g, Goal):  # a fact that binds nothing of use
            return bool(g.variables & self.bound) and not (g.variables - self.bound) & self._wanted_later(g)
        if isinstance(g, Absent):
            # variables that others have as well must be bound first; the rest are its own
            return g.variables & self._wanted_later(g) <= self.bound and (id(g) not in self.scoped or EX in self.bound)
        if isinstance(g, Another):
            return g.one.name in self.bound and g.variables & self._wanted_later(g) <= self.bound and (id(g) not in self.scoped or EX in self.bound)
        return {v.name for v in g.inputs} <= self.bound

    def _join(self, g: Goal, rows: DataFrame) -> None:
        if self.df is None:
            self.df = rows
            return
        on = [c for c in rows.columns if c in self.bound]
        fresh = set(rows.columns) - set(on)
        # an interpretation that was open before is bound from here on
        how = "inner" if fresh & (self._wanted_later(g) | {EX}) else "left_semi"
        self.df = self.df.join(rows, on, how)

    def _without(self, g: Absent, tables: Mapping[str, DataFrame]) -> None:
        on = g.variables & self.bound
        if not on:
            raise UnsafeRule("a negation shares no variable with the facts beside it")
        found = _Plan(g.body, on).run(tables)
        keys = sorted(on) + ([EX] if EX in found.columns and EX in self.bound and EX not in on else [])
        self.df = self.df.join(found.select(*keys), keys, "left_anti")

    def _besides(self, g: Another, tables: Mapping[str, DataFrame]) -> None:
        """Some answer differs if the smallest or the largest does: answers are never paired with rows, but for these two."""
        if g.other.name in self.bound:
            raise UnsafeRule(f"{g.other.name} is bound outside its conjunction")
        own = set().union(*(x.variables for x in g.body))
        on = own & self.bound - {g.one.name}
        if not on:
            raise UnsafeRule("a conjunction shares no variable with the facts beside it")
        found = _Plan(g.body, on | {g.other.name}).run(tables)
        keys = sorted(on) + ([EX] if EX in found.columns and EX in self.bound and EX not in on else [])
        ends = found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(g.other.name).alias("_least"), F.max(g.other.name).alias("_most"))
        one = F.col(g.one.name)
        same = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys])
        self.df = self.df.join(ends, same & ((F.col("_least") != one) | (F.col("_most") != one)), "left_semi")

    def _compute(self, g: Let) -> None:
        value = g.value(*[F.col(v.name) for v in g.inputs])
        value = F.explode(value) if g.each else value
        if g.output.name in self.bound:
            self.df = self.df.withColumn("_value", value).filter(F.col("_value") == F.col(g.output.name)).drop("_value")
        else:
            self.df = self.df.withColumn(g.output.name, value)


def solve(body: Iterable[Literal], tables: Mapping[str, DataFrame], head: Mapping[str, object]) -> DataFrame:
    """The answers of a body as a set: a column for each entry of the head, a variable or a constant."""
    body = tuple(body)
    needed = {t.name for t in head.values() if isinstance(t, Var)}
    df = _Plan(body, needed).run(tables)
    return df.select(*[F.col(t.name).alias(c) if isinstance(t, Var) else F.lit(t).alias(c) for c, t in head.items()]).dropDuplicates()


class Rule:
    """Clauses of one head, each a body; a rule of a domain. Its tables are known before it is evaluated.

    A domain's rule needs the column ``ex``: it is added to the head where a clause's tables have it.
    """

    def __init__(self, head: Mapping[str, object], *bodies: Iterable[Literal]):
        if not bodies:
            raise SchemaError("a rule needs a body")
        self.head, self.bodies = dict(head), [tuple(b) for b in bodies]
        self.reads = set().union(*map(tables_in, self.bodies))

    def __call__(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        read = {n: tables[n] for n in sorted(self.reads)}
        parts = []
        for body in self.bodies:
            own = {EX: Var(EX)} if EX not in self.head and any(EX in read[n].columns for n in tables_in(g for g in body if not isinstance(g, Absent))) else {}
            parts.append(solve(body, read, own | self.head))
        return reduce(DataFrame.unionByName, parts).dropDuplicates()
