"""Removal of byte strings that have occurred before, by threshold-bounded interval expansion on a BWT.

Every string of LENGTH bytes belongs to one piece: the run of window starts whose smallest hashed gram
(leftmost on ties) is the same one. That choice depends on the window's own bytes only, so equal windows
always meet under the same gram, and grams that occur once need no further work. Pieces of equal bytes
collapse to their first occurrence by a combinable minimum; later ones are removed whole.

Where different pieces share a gram, their bytes are joined, suffixes sorted, and the Burrows-Wheeler
transform is extended backwards, interval by interval and breadth first: round l settles all common
prefixes of length l. It stops at LENGTH; suffixes whose common prefix is not settled by then share at
least LENGTH bytes. In each such class all windows but the earliest are removed.

A gram with more than GROUP different pieces (which would outgrow a task) has them split further, by the
smallest grams of their windows under other hashes, again and again until each part is small: equal windows
stay together, equal parts collapse as before, and the transform settles what is left.

Pieces count as equal if two 64-bit polynomial hashes with random factors, besides their gram's, agree; bytes
are compared where pieces differ, in the transform.

Defined cases: null is the empty text; rows with a null doc_id are kept whole and precede nothing; texts
shorter than LENGTH are kept whole; rows that share doc_id and text count as one document and get equal
results; rows that share a doc_id only are documents of their own, in order of a hash of the text; an empty
table gives an empty result; columns of any other name stay as they are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, ddl, scratch, stored, tidy

LENGTH, GRAM = 100, 32
#: Bytes hashed at once, bytes joined for one transform, and different pieces under one gram that go to one transform.
SLICE, JOINED, GROUP = 1 << 18, 1 << 18, 3000
#: Other hashes that split the pieces of a hot gram at the first turn; each turn has twice as many as the one before, up to a window's grams.
#: From turn LAST on, windows that no smallest gram tells apart (those of periodic texts have the same grams) are parts of their own, under their contents.
SPLIT, LAST = 4, 5
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW = np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A random number for each byte; for two content hashes another one, with the powers of an odd base and of its inverse up to ``n``."""
    rng = np.random.default_rng(5)
    first, *others = rng.integers(0, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sides = []
    for table in others:
        base = int(rng.integers(1 << 60, 1 << 63)) * 2 + 1
        powers, inverse = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        sides.append((table, np.cumprod(powers), np.cumprod(inverse)))
    return first, sides


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h, m = _tables(SLICE + 2 * LENGTH)[0][data], 1
    while m < gram:
        h = h[:-m] * A + h[m:]
        h ^= h >> np.uint64(29)
        m *= 2
    h *= B
    h ^= h >> np.uint64(32)
    return h


def _least_places(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` hashes the place of the smallest one, leftmost on ties of its upper half."""
    low, m = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * m <= w:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if w > m:
        low = np.minimum(low[: -(w - m)], low[w - m :])
    return (low & LOW).astype(np.int64)


def _contents(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> list[np.ndarray]:
    """Two hashes of the bytes of the windows lo to hi - 1."""
    out = []
    for table, powers, inverse in _tables(SLICE + 2 * LENGTH)[1]:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * powers[: len(data)])])
        found = (sums[hi + length - 1] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * B
        out.append(found ^ (found >> np.uint64(31)))
    return out


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, contents: bool = True):
    """Pieces of the documents [starts, ends) of a buffer: first window, number of windows, gram hash, and two content hashes."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, *[none.astype(np.uint64)] * 3
    h = _gram_hashes(data, gram)
    at = _least_places(h, length - gram + 1)
    edge = np.zeros(len(at) + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    change = np.empty(len(at) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    cut = np.flatnonzero(change)
    lo, hi = cut[:-1], cut[1:]
    keep = inside[lo]
    lo, hi = lo[keep], hi[keep]
    key = h[at[lo]]
    return (lo, hi - lo, key, *(_contents(data, lo, hi, length) if contents else (key, key)))


def parts_of(data: np.ndarray, key: int, turn: int, length: int = LENGTH, gram: int = GRAM):
    """A piece cut where the smallest gram of its windows changes under any of a turn's hashes: first window, number of windows, key, content hashes."""
    h = _gram_hashes(data, gram)
    n = len(data) - length + 1
    change = np.zeros(n + 1, bool)
    change[0] = change[-1] = True
    places = []
    for k in range(min(length - gram + 1, SPLIT << min(turn, 16))):
        other = (h ^ np.uint64((1000 * turn + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * B
        other ^= other >> np.uint64(29)
        other *= A
        places.append((at := _least_places(other, length - gram + 1)))
        change[1:-1] |= at[1:] != at[:-1]
    if turn >= LAST:
        change[:] = True
    cut = np.flatnonzero(change)
    lo, hi = cut[:-1], cut[1:]
    contents = _contents(data, lo, hi, length)
    keys = np.full(len(lo), np.uint64(key & (1 << 64) - 1))
    for at in places:
        keys = (keys ^ h[at[lo]]) * A
        keys ^= keys >> np.uint64(32)
    if turn >= LAST:
        keys = (keys ^ contents[0]) * A ^ contents[1]
    return lo, hi - lo, keys, *contents


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols at least, by doubling; equal ones by position. Symbols are 0 to 256."""
    n = len(text)
    wide = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    rank, m = np.zeros(n, np.int64), 6
    for k in range(m):
        rank = rank * 257 + wide[k : n + k]
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) + 1
        if m >= depth:
            return order
        later = np.zeros(n, np.int64)
        later[:-m] = new[m:]
        rank, m = new * (n + 1) + later, 2 * m


def common_prefixes(text: np.ndarray, order: np.ndarray, bound: int) -> np.ndarray:
    """For each suffix in order, its common prefix with the one before it if below ``bound``, else -1.

    Intervals of one round are disjoint. Mapped backwards, the rows of an interval that are preceded by
    one symbol form one run, whose end has a common prefix of this round's length unless that was
    settled before; only runs that settle an end are extended further.
    """
    n = len(text)
    before = text[order - 1]  # the transform; position -1 is the last symbol, a separator
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    leading = text[order]
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    owner = np.zeros(n, np.int32)
    for value in range(bound):
        size = hi - lo
        total = int(size.sum())
        if total == 0:
            break
        which = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        rows = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        mapped = back[rows]
        owner[mapped] = which
        if total > n // 8:
            mark = np.zeros(n, bool)
            mark[mapped] = True
            mapped = np.flatnonzero(mark)
        else:
            mapped.sort()
        own, lead = owner[mapped], leading[mapped]
        cut = np.flatnonzero((mapped[1:] != mapped[:-1] + 1) | (own[1:] != own[:-1]) | (lead[1:] != lead[:-1]))
        run_lo, run_hi = mapped[np.concatenate([[0], cut + 1])], mapped[np.concatenate([cut, [total - 1]])] + 1
        new = prefix[run_hi] < 0
        lo, hi = run_lo[new], run_hi[new]
        prefix[hi] = value
    return prefix[:n]


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per part, the byte ranges covered by strings of ``length`` that an earlier part or place in the list has."""
    sizes = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int16)
    room = np.zeros(len(text), np.int64)  # bytes from here to the end of the part
    for p, s in zip(parts, starts, strict=True):
        text[s : s + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    room = np.repeat(starts + sizes - 1, sizes) - np.arange(len(text))
    order = suffix_order(text, length)
    prefix = common_prefixes(text, order, length)
    fresh = prefix >= 0
    fresh[0] = True
    group = np.cumsum(fresh) - 1
    least = np.full(int(group[-1]) + 1, len(text), np.int64)
    np.minimum.at(least, group, order)
    later = order[(order != least[group]) & (room[order] >= length)]
    later.sort()
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(later):
        part = np.searchsorted(starts, later, "right") - 1
        cut = np.flatnonzero((later[1:] > later[:-1] + length) | (part[1:] != part[:-1]))
        for a, b in zip(np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(later) - 1]]), strict=True):
            k = part[a]
            out[k].append((int(later[a] - starts[k]), int(later[b] - starts[k] + length)))
    return out


def _buffers(batch, name: str):
    """(first row, bytes, starts, ends, offset of the buffer in its document) in slices; long documents are cut with an overlap of LENGTH - 1."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[end])
        if hi - lo <= SLICE:
            yield row, data[lo:hi], offsets[row:end] - lo, offsets[row + 1 : end + 1] - lo, 0
        else:
            for at in range(0, hi - lo - LENGTH + 1, SLICE):
                part = data[lo + at : min(hi, lo + at + SLICE + LENGTH - 1)]
                yield row, part, np.zeros(1, np.int64), np.full(1, len(part)), at
        row = end


def _columns(values, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


def _occurrences(docs: DataFrame, contents: bool) -> DataFrame:
    """Of documents (a, h, b): the key of each piece, and with ``contents`` also c0, c1, a, h and its place (first window << 32 | windows)."""
    ids_arrow = to_arrow_type(docs.schema["a"].dataType)

    @tidy
    def find(arrow):
        for batch in arrow:
            ids, hashes = (batch.column(batch.schema.get_field_index(c)) for c in "ah")
            for row, data, starts, ends, shift in _buffers(batch, "b"):
                lo, n, key, c0, c1 = pieces(data, starts, ends, contents=contents)
                if not contents:
                    yield _columns([key.view(np.int64)], [pa.int64()], ["key"])
                    continue
                doc = np.searchsorted(starts, lo, "right") - 1
                rows = pa.array(doc + row)
                place = (lo - starts[doc] + shift) << 32 | n
                yield _columns([key.view(np.int64), c0.view(np.int64), c1.view(np.int64), ids.take(rows).cast(ids_arrow), hashes.take(rows), place], [pa.int64()] * 6, ["key", "c0", "c1", "a", "h", "place"])

    return docs.mapInArrow(find, f"key bigint, c0 bigint, c1 bigint, a {ddl(docs.schema['a'].dataType)}, h bigint, place bigint" if contents else "key bigint")


#: Columns that name a document, and the order of occurrences.
DOC, FIRST = ("a", "h"), ("a", "h", "place")


def _collapsed(found: DataFrame, group: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of occurrences (key, c0, c1, a, h, place): ranges of all but the first of equal pieces; the first ones of keys with
    several different pieces; and the same of keys with more than ``group``."""
    same = ["key", "c0", "c1"]
    contents = stored(found.groupBy(*same).agg(F.min(F.struct(*FIRST, *more)).alias("first"), F.count(F.lit(1)).alias("c")), "contents")
    # each later occurrence meets the one row of its content, and hot contents are split by the skew join
    again = contents.filter("c > 1").select(*same, *[F.col("first")[c].alias(f"f_{c}") for c in FIRST])
    later = found.join(again, same).filter(F.struct(*FIRST) != F.struct(*[F.col(f"f_{c}").alias(c) for c in FIRST]))
    start = F.shiftright("place", 32)
    whole = stored(later.select(*DOC, start.alias("lo"), (start + F.col("place").bitwiseAND(0xFFFFFFFF) + (LENGTH - 1)).alias("hi")), "whole")
    kinds = stored(contents.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "kinds")
    several = contents.join(kinds, "key").select("key", "k", "first.*")
    return whole, several.filter(F.col("k") <= group).drop("k"), several.filter(F.col("k") > group).drop("k")


def _taken(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted pieces (key, a, h, place), as (key, a, h, place, bytes): texts meet one row a document."""
    kind = docs.schema["a"].dataType
    ids_arrow = to_arrow_type(kind)

    @tidy
    def take(arrow):
        for batch in arrow:
            for k in range(batch.num_rows):
                a, h, text, wants = (batch.column(j)[k] for j in range(4))
                raw, wants = text.as_py().encode("utf-8", "surrogatepass"), wants.as_py()
                places = [w["place"] for w in wants]
                found = [raw[p >> 32 : (p >> 32) + (p & 0xFFFFFFFF) + LENGTH - 1] for p in places]
                yield _columns([[w["key"] for w in wants], [a.as_py()] * len(places), [h.as_py()] * len(places), places, found], [pa.int64(), ids_arrow, pa.int64(), pa.int64(), pa.binary()], ["key", "a", "h", "place", "bytes"])

    per_doc = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("key", "place")).alias("wants"))
    return docs.join(per_doc, list(DOC)).select("a", "h", "b", "wants").mapInArrow(take, f"key bigint, a {ddl(kind)}, h bigint, place bigint, bytes binary")


def _split(hot: DataFrame, turn: int) -> DataFrame:
    """Pieces (key, a, h, place, bytes) of hot grams in parts, each with a key and content hashes of its own."""
    kind = hot.schema["a"].dataType
    ids_arrow = to_arrow_type(kind)

    @tidy
    def split(arrow):
        for batch in arrow:
            out = [[] for _ in range(7)]
            for key, a, h, place, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, n, keys, c0, c1 = parts_of(np.frombuffer(raw, np.uint8), key, turn)
                for values, new in zip(out, (keys.view(np.int64).tolist(), c0.view(np.int64).tolist(), c1.view(np.int64).tolist(), [a] * len(lo), [h] * len(lo), ((lo + (place >> 32)) << 32 | n).tolist(), [raw[x : x + m + LENGTH - 1] for x, m in zip(lo.tolist(), n.tolist(), strict=True)]), strict=True):
                    values += new
            yield _columns(out, [*[pa.int64()] * 3, ids_arrow, pa.int64(), pa.int64(), pa.binary()], ["key", "c0", "c1", "a", "h", "place", "bytes"])

    return hot.select("key", "a", "h", "place", "bytes").mapInArrow(split, f"key bigint, c0 bigint, c1 bigint, a {ddl(kind)}, h bigint, place bigint, bytes binary")


def _expanded(taken: DataFrame) -> DataFrame:
    """Ranges (a, h, lo, hi) of repeated windows in different pieces of one gram, by the transform."""
    kind = taken.schema["a"].dataType
    ids_arrow = to_arrow_type(kind)

    def settled(rows):
        rows.sort(key=lambda r: r[1:4])  # the order of documents and places is the order in the joined text
        rows = [r for k, r in enumerate(rows) if k == 0 or r[:4] != rows[k - 1][:4]]  # repeated rows are one document
        found = repeated_windows([r[4] for r in rows])
        flat = [(r[1], r[2], (r[3] >> 32) + x, (r[3] >> 32) + y) for r, ranges in zip(rows, found, strict=True) for x, y in ranges]
        return _columns([[x[k] for x in flat] for k in range(4)], [ids_arrow, *[pa.int64()] * 3], ["a", "h", "lo", "hi"])

    @tidy
    def expand(arrow):
        rows, size, last = [], 0, None
        for batch in arrow:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != last and size >= JOINED:
                    yield settled(rows)
                    rows, size = [], 0
                last = row[0]
                rows.append(row)
                size += len(row[4])
        if rows:
            yield settled(rows)

    return taken.select("key", "a", "h", "place", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(expand, f"a {ddl(kind)}, h bigint, lo bigint, hi bigint")


def repeated_ranges(docs: DataFrame, group: int | None = None) -> DataFrame:
    """Of documents (a, h, b): (a, h, ranges), the byte ranges, maybe touching, that repeat earlier bytes; only documents that have some."""
    group = group or GROUP
    docs = docs.filter("a is not null and b is not null")
    with scratch(docs.sparkSession) as keep:
        shared = stored(_occurrences(docs, contents=False).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "grams")
        found = stored(_occurrences(docs, contents=True).join(shared, "key", "left_semi"), "pieces")
        ranges, few, many = _collapsed(found, group)
        ranges = ranges.union(_expanded(_taken(docs, few)))
        turn, many = 0, stored(many, "hot")
        if not many.isEmpty():
            many = stored(_taken(docs, many), "hot")
            while not many.isEmpty():
                whole, few, many = _collapsed(stored(_split(many, turn), "parts"), group, ("bytes",))
                ranges = ranges.union(whole).union(_expanded(few))
                turn, many = turn + 1, stored(many, "hot")
        return keep(stored(ranges.groupBy(*DOC).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents (a, h, b) and the same with ``_row``, the other columns. h tells rows of one doc_id apart by their texts; where doc_ids are unique it is 0."""
    a, b = col(docs, id_col), col(docs, text_col)
    several = not docs.groupBy(a.alias("a")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and a is not null").isEmpty()
    h = F.xxhash64(b) if several else F.lit(0).cast("bigint")
    row = F.struct(*[col(docs, c).alias(f"c{k}") for k, c in enumerate(rest)], F.lit(0).alias("end"))
    return docs.select(a.alias("a"), h.alias("h"), b.alias("b")), docs.select(a.alias("a"), h.alias("h"), b.alias("b"), row.alias("_row"))


def merged(ranges, size: int) -> list[tuple[int, int]]:
    """Disjoint ranges in order, touching ones as one, cut off at ``size``."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], min(r["hi"], size)) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        elif lo < hi:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for lo, hi in spans:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, narrowed so that no character of the text is cut."""
    out = []
    for lo, hi in spans:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Every row as (doc_id, n_bytes, n_removed, n_spans) and what is left of it: ``kept_sha256`` over its bytes, or ``kept_text`` in whole characters."""
    ids_type = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(ids_type)
    name = "kept_sha256" if digests else "kept_text"

    @tidy
    def cut(arrow):
        for batch in arrow:
            for at in range(0, batch.num_rows, 512):
                ids, texts, ranges = (c.to_pylist() for c in batch.slice(at, 512).columns)
                rows = []
                for text, found in zip(texts, ranges, strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    spans = merged(found, len(raw))
                    left = hashlib.sha256(remaining(raw, spans)).hexdigest() if digests else None if text is None else remaining(raw, whole_characters(raw, spans)).decode("utf-8", "surrogatepass")
                    rows.append((len(raw), sum(b - a for a, b in spans), len(spans), left))
                yield _columns([ids, *zip(*rows, strict=True)], [ids_arrow, *[pa.int64()] * 3, pa.string()], ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    rows, _ = _keyed(docs, id_col, text_col, [])
    return rows.join(repeated_ranges(rows), list(DOC), "left").select("a", "b", "ranges").mapInArrow(cut, f"doc_id {ddl(ids_type)}, n_bytes bigint, n_removed bigint, n_spans bigint, {name} string")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns, where each text has lost what repeats earlier bytes; ``chars_col``, if there, counts what is left."""

    @tidy
    def cut(arrow):
        for batch in arrow:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    texts.append(None if text is None else remaining(raw, whole_characters(raw, merged(found, len(raw)))).decode("utf-8", "surrogatepass"))
                yield _columns([part.column(0), texts], [None, pa.string()], ["_row", "kept"])

    rest = [c for c in docs.columns if c != text_col]
    rows, full = _keyed(docs, id_col, text_col, rest)
    kept = full.join(repeated_ranges(rows), list(DOC), "left").select("_row", "b", "ranges").mapInArrow(cut, f"_row {ddl(full.schema['_row'].dataType)}, kept string")

    def column(c: str):
        if c == text_col:
            return F.col("kept").alias(c)
        if c == chars_col:
            return F.char_length("kept").cast(docs.schema[c].dataType).alias(c)
        return F.col("_row")[f"c{rest.index(c)}"].alias(c)

    return kept.select(*[column(c) for c in docs.columns])
