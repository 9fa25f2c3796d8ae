"""Fact text files: one ground fact a line, ``interpretation(<ex>, <sig>(<arg>, ...)).``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Domain

LINE = r"^\s*(?:\w+:)?interpretation\(\s*(.+?)\s*,\s*(\w+)\s*(?:\((.*)\))?\s*\)\s*\.\s*$"
SLICED = r"^(\w+)\((.+)\)$"


def top_level_split(text: Column) -> Column:
    """Arguments of a fact: commas inside brackets or quotes don't part them."""
    # commas at depth 0 become a separator that no fact holds
    state = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("quoted")),
        lambda a, c: F.struct(
            F.concat(a.out, F.when((c == ",") & (a.depth == 0) & ~a.quoted, F.lit("\x01")).otherwise(c)).alias("out"),
            (a.depth + F.when(~a.quoted & c.isin("(", "["), 1).when(~a.quoted & c.isin(")", "]"), -1).otherwise(0)).alias("depth"),
            F.when(c == "'", ~a.quoted).otherwise(a.quoted).alias("quoted"),
        ),
    ).out
    simple = F.split(text, ",")
    pieces = F.when(text.rlike(r"[\[('\]]"), F.split(state, "\x01")).otherwise(simple)
    return F.transform(pieces, lambda x: F.regexp_replace(F.trim(x), r"^'(.*)'$", "$1"))


def read_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ex, slice, sig, args) of one or more files, plain or gzipped; other lines (comments, directives) are passed over."""
    return parse_facts(spark.read.text(paths))


def parse_facts(lines: DataFrame) -> DataFrame:
    m = lambda k: F.regexp_extract("value", LINE, k)
    rows = lines.filter(F.col("value").rlike(LINE)).select(m(1).alias("id"), m(2).alias("sig"), m(3).alias("body"))
    cut = lambda k: F.regexp_extract("id", SLICED, k)
    sliced = F.col("id").rlike(SLICED)
    args = F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(top_level_split(F.col("body")))
    return rows.select(F.when(sliced, cut(1)).otherwise(F.col("id")).alias("ex"), F.when(sliced, cut(2)).alias("slice"), "sig", args.alias("args"))


def inline_facts(spark: SparkSession, facts: list[tuple]) -> DataFrame:
    """Facts given as (ex, sig, arg...) tuples."""
    return spark.createDataFrame([(str(f[0]), None, f[1], [str(a) for a in f[2:]]) for f in facts], "ex string, slice string, sig string, args array<string>")


def tables_of(domain: Domain, facts: DataFrame, sliced: bool = False) -> dict[str, DataFrame]:
    """One table per extensional signature and helper found in the declarations; numbers in property columns stay text until cast by rules."""
    out = {}
    for name in domain.extensional_signatures:
        s = domain.signatures[name]
        rows = facts.filter((F.col("sig") == name) & (F.size("args") == s.arity))
        out[name] = rows.select("ex", *(["slice"] if sliced else []), *[F.col("args")[k].alias(c.name) for k, c in enumerate(s.columns)]).dropDuplicates()
    return out


def helper_table(facts: DataFrame, name: str, *columns: str) -> DataFrame:
    """Background facts that rules read and the domain doesn't declare."""
    rows = facts.filter((F.col("sig") == name) & (F.size("args") == len(columns)))
    return rows.select("ex", *[F.col("args")[k].alias(c) for k, c in enumerate(columns)]).dropDuplicates()


def fact_lines(facts: DataFrame) -> DataFrame:
    """(value): facts as text lines again."""
    ex = F.when(F.col("slice").isNull(), F.col("ex")).otherwise(F.format_string("%s(%s)", "ex", "slice"))
    body = F.when(F.size("args") == 0, F.col("sig")).otherwise(F.format_string("%s(%s)", "sig", F.concat_ws(",", "args")))
    return facts.select(F.format_string("interpretation(%s,%s).", ex, body).alias("value"))


def save_view(domain: Domain, facts: DataFrame, path: str) -> None:
    """Writes the facts of declared signatures."""
    fact_lines(facts.filter(F.col("sig").isin(sorted(domain.signatures)))).write.text(path)
