"""References between tables: who refers to a missing entity, and what to do about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SELF, Domain
from .deduce import EX

PLACEHOLDER = "?"


def identifiers(domain: Domain, tables: dict[str, DataFrame]) -> DataFrame:
    """(ex, sig, id) of every entity."""
    parts = []
    for name in domain.entities:
        column = domain.signatures[name].id_columns[0].name
        parts.append(tables[name].select(EX, F.lit(name).alias("sig"), F.col(column).cast("string").alias("id")))
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def dangling(domain: Domain, tables: dict[str, DataFrame], signature: str) -> DataFrame:
    """(ex, sig, column, entity, id, n): references of one table without their entity; one anti join a reference column."""
    s = domain.signatures[signature]
    parts = []
    for c in s.id_columns:
        if c.kind == SELF:
            continue
        own = domain.signatures[c.kind].id_columns[0].name
        known = tables[c.kind].select(EX, F.col(own).alias(c.name)).dropDuplicates()
        missing = tables[signature].join(known, [EX, c.name], "left_anti")
        parts.append(missing.groupBy(EX, F.col(c.name).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(EX, F.lit(signature).alias("sig"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("entity"), "id", "n"))
    return reduce(DataFrame.unionByName, parts)


def check_and_repair(domain: Domain, tables: dict[str, DataFrame], how: str = "ignore") -> dict[str, DataFrame]:
    """``add`` puts in missing entities with ``?`` (null for numbers) as properties, ``delete`` drops rows that refer to them, ``ignore`` keeps both."""
    if how not in ("ignore", "add", "delete"):
        raise ValueError(how)
    out = dict(tables)
    if how == "ignore":
        return out
    for name in domain.relationships:
        s = domain.signatures[name]
        for c in s.id_columns:
            entity = domain.signatures[c.kind]
            own = entity.id_columns[0].name
            known = out[c.kind].select(EX, F.col(own).alias(c.name)).dropDuplicates()
            if how == "delete":
                out[name] = out[name].join(known, [EX, c.name], "left_semi")
                continue
            schema = out[c.kind].schema
            missing = out[name].join(known, [EX, c.name], "left_anti").select(EX, F.col(c.name).alias(own)).dropDuplicates()
            filled = [F.lit(PLACEHOLDER if schema[p.name].dataType.simpleString() == "string" else None).cast(schema[p.name].dataType).alias(p.name) for p in entity.property_columns]
            out[c.kind] = out[c.kind].unionByName(missing.select(EX, own, *filled), allowMissingColumns=True)
    return out


def duplicate_ids(domain: Domain, tables: dict[str, DataFrame]) -> DataFrame:
    """(ex, sig, id, n): entities that occur more than once."""
    parts = []
    for name in domain.entities:
        column = domain.signatures[name].id_columns[0].name
        parts.append(tables[name].groupBy(EX, F.col(column).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(EX, F.lit(name).alias("sig"), "id", "n"))
    return reduce(DataFrame.unionByName, parts)
