"""The 31-bit string and list hash of the feature space, inside whole-stage evaluation.

The state is an unsigned 32-bit number held in a BIGINT; every product stays below 2**62, so ANSI
arithmetic never overflows. The SQL twins generate the same arithmetic for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: its start, the word mask and the default result mask.
START, WORD, MASK = 0xAAAAAAAA, 0xFFFFFFFF, 0x7FFFFFFF


def _fold(elements: Column, mask: int) -> Column:
    def step(h: Column, e: Column) -> Column:
        even = F.shiftleft(h, 7).bitwiseAND(WORD).bitwiseXOR((e.c * F.shiftright(h, 3)).bitwiseAND(WORD))
        odd = (F.shiftleft(h, 11) + e.c).bitwiseAND(WORD).bitwiseXOR(F.shiftright(h, 5)).bitwiseXOR(F.lit(WORD))
        return h.bitwiseXOR(F.when(e.i % 2 == 0, even).otherwise(odd))

    return F.aggregate(elements, F.lit(START).cast("bigint"), step).bitwiseAND(mask)


def hash_list(values: Column, mask: int = MASK) -> Column:
    """Hash of an array of unsigned 32-bit numbers."""
    return _fold(F.transform(values, lambda x, i: F.struct(x.cast("bigint").alias("c"), i.alias("i"))), mask)


def hash_string(text: Column, mask: int = MASK) -> Column:
    """Hash of a string's UTF-8 bytes; bytes from 128 on count as negative, widened to 32 bits."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    return _fold(F.transform(pairs, lambda x, i: F.struct((F.conv(x, 16, 10).cast("bigint") + F.when(x >= "80", F.lit(0xFFFFFF00)).otherwise(F.lit(0))).alias("c"), i.alias("i"))), mask)


def sql_hash_list(values: str, mask: int = MASK) -> str:
    """DuckDB: hash of a list expression of BIGINT."""
    step = (
        f"xor(s.c, CASE WHEN e.i % 2 = 0 THEN xor((s.c << 7) & {WORD}, (e.c * (s.c >> 3)) & {WORD}) "
        f"ELSE xor(xor(((s.c << 11) + e.c) & {WORD}, s.c >> 5), {WORD}) END)"
    )
    # the state travels in the same struct as the elements
    return (
        f"(list_reduce(list_prepend({{'c': {START}::BIGINT, 'i': 0::BIGINT}}, list_transform({values}, lambda x, k: {{'c': x::BIGINT, 'i': (k - 1)::BIGINT}})), "
        f"lambda s, e: {{'c': {step}, 'i': 0::BIGINT}}).c & {mask})"
    )


def sql_hash_string(text: str, mask: int = MASK) -> str:
    """DuckDB: hash of an ASCII string expression."""
    return sql_hash_list(f"list_transform(string_split({text}, ''), lambda ch: unicode(ch))", mask)
