"""Signatures and domains: the declared entity/relationship schema and its checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SELF, PROPERTY = "self", "property"


class SchemaError(ValueError):
    """A declaration that breaks a rule of the schema."""


@dataclass(frozen=True)
class Column:
    """A column: ``kind`` is self, property or the name of the entity it refers to; ``role`` labels the edge it makes."""

    name: str
    kind: str
    role: str | None = None


@dataclass(frozen=True)
class Signature:
    """A table of the domain."""

    name: str
    columns: tuple[Column, ...]
    level: str = "extensional"
    rule: Callable[[dict[str, DataFrame]], DataFrame] | str | None = None
    depends_on: tuple[str, ...] = ()
    ghost: bool = False
    candidate_filter: Callable[[DataFrame], DataFrame] | None = None

    @property
    def kind(self) -> str:
        return "entity" if any(c.kind == SELF for c in self.columns) else "relationship"

    @property
    def arity(self) -> int:
        return len(self.columns)

    @property
    def id_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.kind != PROPERTY)

    @property
    def property_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.kind == PROPERTY)

    @property
    def relational_arity(self) -> int:
        return len(self.id_columns)

    @property
    def references(self) -> tuple[str, ...]:
        """The entity of each identifier in order; self refers to the signature itself."""
        return tuple(self.name if c.kind == SELF else c.kind for c in self.id_columns)

    def role(self, column: Column) -> str:
        """The declared role, or ``p`` and the number of columns after this one."""
        return column.role or f"p{self.arity - 1 - self.columns.index(column)}"

    def id_position(self) -> int | None:
        """Where the self column stands, from 1."""
        return next((k for k, c in enumerate(self.columns, 1) if c.kind == SELF), None)

    def traits(self) -> dict[str, object]:
        return {
            "kind": self.kind, "arity": self.arity, "level": self.level, "column_types": [c.kind for c in self.columns], "column_names": [c.name for c in self.columns],
            "column_roles": [self.role(c) for c in self.columns if c.kind not in (PROPERTY, SELF)], "relational_arity": self.relational_arity, "ghost": self.ghost,
        }


@dataclass
class Domain:
    """A checked set of signatures, with the signatures whose vertices may be kernel centres."""

    name: str = "domain"
    signatures: dict[str, Signature] = field(default_factory=dict)
    kernel_points: frozenset[str] = frozenset()
    safe: frozenset[str] = frozenset()
    helpers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: The tables that each rule was seen to read when it was evaluated.
    captured: dict[str, set[str]] = field(default_factory=dict)
    closed: bool = False

    def add(self, signature: Signature) -> Domain:
        if self.closed:
            raise SchemaError(f"{self.name} is closed")
        if signature.name in self.signatures:
            raise SchemaError(f"{signature.name} is declared twice")
        if signature.level not in ("extensional", "intensional"):
            raise SchemaError(f"{signature.name}: no level {signature.level!r}")
        if sum(c.kind == SELF for c in signature.columns) > 1:
            raise SchemaError(f"{signature.name}: more than one self column")
        if len({c.name for c in signature.columns}) < signature.arity:
            raise SchemaError(f"{signature.name}: a column name occurs twice")
        if signature.level == "intensional" and signature.rule is None:
            raise SchemaError(f"{signature.name} is intensional and has no rule")
        if signature.level == "extensional" and signature.rule is not None:
            raise SchemaError(f"{signature.name} is extensional and can't have a rule")
        self.signatures[signature.name] = signature
        return self

    def entity(self, name: str, *columns: str, **more) -> Domain:
        return self.add(Signature(name, _columns(columns), **more))

    relationship = entity

    def intensional(self, name: str, *columns: str, rule, depends_on: tuple[str, ...] = (), **more) -> Domain:
        return self.add(Signature(name, _columns(columns), "intensional", rule, depends_on, **more))

    def close(self, kernel_points: list[str] | None = None, safe: tuple[str, ...] = ()) -> Domain:
        """The checks that need all signatures; then nothing more may be added."""
        entities = self.entities
        for s in self.signatures.values():
            for c in s.columns:
                if c.kind not in (SELF, PROPERTY) and c.kind not in entities:
                    raise SchemaError(f"{s.name}.{c.name}: {c.kind!r} is no entity, self or property")
            if s.kind == "entity" and s.relational_arity > 1:
                raise SchemaError(f"{s.name}: an entity can't refer to others")
        for kind, found in (("entity", entities), ("relationship", self.relationships)):
            if not found:
                raise SchemaError(f"{self.name} has no {kind}")
            if all(self.signatures[x].ghost for x in found):
                raise SchemaError(f"every {kind} of {self.name} is a ghost")
        points = frozenset(self.signatures if kernel_points is None else kernel_points)
        if unknown := points - set(self.signatures):
            raise SchemaError(f"kernel points that aren't declared: {sorted(unknown)}")
        self.kernel_points, self.safe, self.closed = points, frozenset(safe), True
        return self

    def _named(self, **traits) -> list[str]:
        return sorted(s.name for s in self.signatures.values() if all(getattr(s, k) == v for k, v in traits.items()))

    @property
    def entities(self) -> list[str]:
        return self._named(kind="entity")

    @property
    def relationships(self) -> list[str]:
        return self._named(kind="relationship")

    @property
    def extensional_signatures(self) -> list[str]:
        return self._named(level="extensional")

    @property
    def intensional_signatures(self) -> list[str]:
        return self._named(level="intensional")

    @property
    def active(self) -> list[str]:
        """Signatures that make vertices."""
        return self._named(ghost=False)

    def is_kernel_point(self, name: str) -> bool:
        return name in self.kernel_points

    def describe(self) -> dict[str, dict[str, object]]:
        return {name: s.traits() for name, s in sorted(self.signatures.items())}


def _columns(specs: tuple[str, ...]) -> tuple[Column, ...]:
    """``name:kind@role`` texts to columns."""
    found = []
    for spec in specs:
        m = re.fullmatch(r"(\w+):(\w+)(?:@(\w+))?", spec.replace(" ", ""))
        if not m:
            raise SchemaError(f"no column: {spec!r}")
        found.append(Column(*m.groups()))
    return tuple(found)


DECLARATION = re.compile(r"signature\s+(\w+)\s*(?:\(([^)]*)\))?\s*::\s*(\w+)\s*\.")


def parse_declarations(text: str, rules: dict[str, Callable | str] | None = None, depends_on: dict[str, tuple[str, ...]] | None = None) -> Domain:
    """A domain from declarations ``signature name(column::kind, column@role::kind) :: level.``; rules come by name."""
    text = re.sub(r"%[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    domain = Domain()
    for name, body, level in DECLARATION.findall(text):
        specs = []
        for part in filter(None, (x.strip() for x in body.split(","))):
            column, _, kind = part.partition("::")
            column, _, role = column.strip().partition("@")
            specs.append(f"{column}:{kind.strip()}" + (f"@{role}" if role else ""))
        domain.add(Signature(name, _columns(tuple(specs)), level, (rules or {}).get(name) if level == "intensional" else None, (depends_on or {}).get(name, ())))
    return domain


def er_diagram(domain: Domain) -> str:
    """The schema as dot: boxes for entities, diamonds for relationships, dashed ones if intensional."""
    lines = ["graph er {"]
    for s in domain.signatures.values():
        shape = "box" if s.kind == "entity" else "diamond"
        lines.append(f'  "{s.name}" [shape={shape}{", style=dashed" if s.level == "intensional" else ""}];')
        lines += [f'  "{s.name}.{c.name}" [shape=ellipse, label="{c.name}"]; "{s.name}" -- "{s.name}.{c.name}";' for c in s.property_columns]
        lines += [f'  "{s.name}" -- "{c.kind}" [label="{s.role(c)}"];' for c in s.id_columns if c.kind != SELF]
    return "\n".join([*lines, "}"])
