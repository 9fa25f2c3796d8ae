"""Canonical exact digests of documents.

A text is canonicalised (Unicode NFKC, case folding, white space runs to one space, trimmed) and hashed
with 128-bit xxh3. Documents of equal hashes form a bucket, and the canonical bytes in a bucket are
compared: a combinable minimum and maximum tell whether they are all the same, so a bucket with a third
of all rows is never gathered. In a bucket of different texts the fingerprint gets a SHA-256 suffix.

Defined cases: null is the empty text; texts of white space only share its fingerprint; a single document
is its own next document; equal doc_ids are ordered by a hash of their text; repeated rows stay repeated.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, small, stored, tidy


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        # folding can undo NFKC and composing can undo folding: repeat until nothing changes
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        while not folded.isascii() and folded != (again := unicodedata.normalize("NFKC", folded.casefold())):
            folded = again
    else:
        folded = text.lower()
    return " ".join(folded.split())


def fingerprint(text: str | None) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def collisions(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes that different canonical texts share. Only documents in buckets of two or more are read again for their bytes."""
    shared = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    members = small(prints.join(shared, "fingerprint", "left_semi").select(F.col("doc_id").alias("m")).distinct())

    @tidy
    def canon(arrow):
        for (text,) in batches(arrow, ["b"]):
            texts = [canonical(x) for x in text]
            import xxhash

            raw = [x.encode("utf-8", "surrogatepass") for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(x) for x in raw]), pa.array(raw, pa.binary())], ["fingerprint", "canon"])

    rows = docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b"))
    texts = rows.join(members, rows.a.eqNullSafe(members.m), "left_semi").select("b").mapInArrow(canon, "fingerprint string, canon binary")
    return texts.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low != high").select("fingerprint")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id): group_id is the smallest doc_id of the same canonical text."""
    ids_type = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(ids_type)

    @tidy
    def prints(arrow):
        for doc_id, text in batches(arrow, ["a", "b"]):
            raw = [canonical(x).encode("utf-8", "surrogatepass") for x in text]
            import xxhash

            yield pa.RecordBatch.from_arrays([pa.array(doc_id, ids_arrow), pa.array([xxhash.xxh3_128_hexdigest(x) for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])], ["doc_id", "fingerprint", "second"])

    found = stored(docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b")).mapInArrow(prints, f"doc_id {ddl(ids_type)}, fingerprint string, second string"), "fingerprints")
    return _grouped(docs, found, id_col, text_col).select("doc_id", "fingerprint", "group_id")


def _grouped(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Settle collisions by bytes, then the smallest doc_id of each fingerprint."""
    clash = stored(collisions(docs, found, id_col, text_col), "collisions")
    if not clash.isEmpty():
        # only rows in a colliding bucket change: their fingerprint becomes one of the canonical bytes alone
        clash = small(clash.select(F.col("fingerprint").alias("c")))
        found = found.join(clash, found.fingerprint == clash.c, "left").withColumn("fingerprint", F.when(F.col("c").isNull(), F.col("fingerprint")).otherwise(F.concat_ws("-", "fingerprint", "second"))).drop("c")
    first = found.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    # groups of one need no join; the rest meet their one row each, and a hot group is split by the skew join
    shared = small(stored(first.filter("n > 1").drop("n"), "groups"))
    return found.join(shared, "fingerprint", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the fingerprint, that of its edited text (the last half replaced by the start of the next document), and their likeness.

    Texts move once, into ranges of doc_id. Within a range each row meets its neighbour; the first and last
    rows of the ranges, two a partition, meet in a small second step.
    """
    ids_type = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(ids_type)
    out = f"doc_id {ddl(ids_type)}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, second string"
    names = [x.split()[0] for x in out.split(", ")]

    def judged(a, text, own, following, following_own):
        """``own`` and ``following_own`` are the canonical texts."""
        import xxhash

        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        raw, raw_edit = own.encode("utf-8", "surrogatepass"), canonical(edited).encode("utf-8", "surrogatepass")
        prints = xxhash.xxh3_128_hexdigest(raw), xxhash.xxh3_128_hexdigest(raw_edit)
        return a, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), *prints, float(prints[0] == prints[1] and raw == raw_edit), float(own == following_own), hashlib.sha256(raw).hexdigest()

    def packed(rows, edges):
        rows = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        kinds = [ids_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        n = len(rows[0]) if rows else 0
        columns = [pa.array([*rows[k], *([e[2] if k == 0 else None for e in edges])], kinds[k]) for k in range(len(names))]
        columns += [pa.array([None] * n + [e[0] for e in edges], pa.int64()), pa.array([None] * n + [e[1] for e in edges], pa.string()), pa.array([None] * n + [e[3] for e in edges], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*names, "part", "edge", "edge_text"])

    @tidy
    def ranges(arrow):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for doc_id, text in batches(arrow, ["a", "b"], 128):
            rows, edges = [], []
            for a, b in zip(doc_id, text, strict=True):
                row = (a, b or "", canonical(b))
                if last is None:
                    edges.append((part, "first", a, row[1]))
                else:
                    rows.append(judged(*last, *row[1:]))
                last = row
            yield packed(rows, edges)
        if last is not None:
            yield packed([], [(part, "last", *last[:2])])

    @tidy
    def pairs(arrow):
        for doc_id, text, following in batches(arrow, ["doc_id", "edge_text", "following"], 64):
            yield packed([judged(a, b, canonical(b), c, canonical(c)) for a, b, c in zip(doc_id, text, following, strict=True)], [])

    rows = docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b"), F.xxhash64(col(docs, text_col)).alias("h"))
    full = out + ", part bigint, edge string, edge_text string"
    met = stored(rows.repartitionByRange("a", "h").sortWithinPartitions("a", "h").drop("h").mapInArrow(ranges, full), "edits")
    firsts, lasts = met.filter("edge = 'first'"), met.filter("edge = 'last'")
    # two numbers a partition: the next partition that has rows, and after the last one the first
    order = firsts.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part"))).withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    edges = lasts.join(order, "part").join(firsts.select(F.col("part").alias("next"), F.col("edge_text").alias("following")), "next")
    found = met.filter("edge is null").unionByName(edges.select("doc_id", "edge_text", "following").mapInArrow(pairs, full)).drop("part", "edge", "edge_text")
    return _grouped(docs, found, id_col, text_col).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")
