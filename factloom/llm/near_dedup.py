"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Words are parted by ASCII white space after lower-casing A-Z. A document's set holds its distinct
k-word shingles (64-bit hashes). Of each permutation both the minimum and the maximum are kept, so a
signature of 2p values takes p hash evaluations a shingle. Bands of these values propose candidates, and
four bits of every value make a sketch that estimates similarity.

Equal sets collapse into one class first. Within a bucket of a band, classes whose sketches come near
the threshold are joined into a forest, of at most one edge a member; the forests of all buckets give
clusters, outside which no link can lie. In a cluster the full sets decide: from class to class, only
those not reached yet are compared, and again one link a member suffices.

Buckets and clusters of more than two blocks are dealt in blocks, each with the group's few representatives;
what is near them, the bulk of a group of copies, is connected so at a cost in proportion to its size. Only
members outside the group's largest component meet all its blocks afterwards, so no group outgrows a task,
no link is lost, and a group of copies never makes pairs of all its blocks.

With 5 rows in 36 bands a pair at similarity 0.8 meets in some band but for 7 in 10 million; at 0.9, 6 in
10^15. A sketch of 640 values at 0.8 falls below NEAR, 5.5 standard deviations away, for 2 in 100 million.

Defined cases: null texts and texts without words have an empty set and link with nothing; texts with
fewer than k words have one shingle, the whole sequence; rows with a null doc_id link with nothing;
repeated rows are returned as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, scratch, small, stored, tidy
from .graph import components

ROWS, BANDS = 5, 36
#: Values in a sketch, and the share of equal four-bit values from which a pair is looked at (0.8 gives 0.8125 on average).
VALUES, NEAR = 640, 0.7275
#: Members of a block; groups of up to two blocks stay whole. Bytes of sets in a block of a cluster. Representatives of a group, about.
BLOCK, BLOCK_BYTES, REPRESENTATIVES = 1000, 16_000_000, 24
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Shingles hashed at once: two such arrays stay in a core's cache.
CHUNK = 1 << 15


class _Words(dict):
    """Word to 64-bit hash; a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * STEP
    h = h ^ (h >> np.uint64(29))
    h = h * MIX
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    n = min(k, len(w))
    h = w[: len(w) - n + 1] + np.uint64(n)
    for j in range(1, n):
        h = h * MIX + w[j : len(w) - n + 1 + j]
    return np.unique(mixed(h))


def permutations(values: int = VALUES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_817)
    p = values // 2
    return rng.integers(0, 1 << 63, p, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, p, dtype=np.uint64) * np.uint64(2)


def min_max(sets: list[np.ndarray], perms) -> np.ndarray:
    """(number of sets, permutations, 2): minimum and maximum of each set under each permutation; all sets must have members."""
    factors, masks = perms
    p = len(factors)
    out = np.empty((len(sets), p, 2), np.uint64)
    sizes = [len(s) for s in sets]
    at = 0
    while at < len(sets):
        end, n = at + 1, sizes[at]
        while end < len(sets) and n + sizes[end] <= CHUNK:
            n += sizes[end]
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum(sizes[at : end - 1])]).astype(np.int64) if end > at + 1 else np.zeros(1, np.int64)
        v = np.empty_like(x)
        for j in range(p):
            np.bitwise_xor(x, masks[j], out=v)
            np.multiply(v, factors[j], out=v)
            out[at:end, j, 0] = np.minimum.reduceat(v, starts)
            out[at:end, j, 1] = np.maximum.reduceat(v, starts)
        at = end
    return out


def band_keys(values: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """(number of sets, bands) bucket keys; a band has minima or maxima of different permutations."""
    m = rows * bands // 2
    x = np.concatenate([values[:, :m, 0], values[:, :m, 1]], axis=1).reshape(len(values), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), x.shape[:2]).copy()
    for j in range(rows):
        keys = mixed(keys * MIX + x[:, :, j])
    return keys


def sketches(values: np.ndarray) -> np.ndarray:
    """(number of sets, values / 2) bytes of two four-bit values."""
    x = (mixed(values.reshape(len(values), 2 * values.shape[1])) & np.uint64(15)).astype(np.uint8)
    return x[:, ::2] << 4 | x[:, 1::2]


#: How many of the two four-bit values of a byte are 0.
EQUAL = np.array([(b < 16) + (b % 16 == 0) for b in range(256)], np.uint8)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, node, keys, sketch): set size, 128-bit digest of the set, bucket keys and sketch; the last three null for empty sets."""
    ids_type = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(ids_type)

    @tidy
    def sign(arrow):
        import xxhash

        perms = permutations()
        for doc_id, text in batches(arrow, ["a", "b"], 256):
            sets = [shingle_set(x, k) for x in text]
            full = [s for s in sets if len(s)]
            values = min_max(full, perms) if full else np.empty((0, VALUES // 2, 2), np.uint64)
            keys, marks = iter(band_keys(values).astype(np.int64)), iter(sketches(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_id, ids_arrow), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([next(marks).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "node", "keys", "sketch"],
            )

    return docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b")).mapInArrow(sign, f"doc_id {ddl(ids_type)}, n bigint, node string, keys array<bigint>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the wanted documents, hashed again from their texts."""

    @tidy
    def make(arrow):
        import xxhash

        for (text,) in batches(arrow, ["b"], 256):
            raw = [shingle_set(x, k).tobytes() for x in text]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(x) for x in raw]), pa.array(raw, pa.binary())], ["node", "set"])

    rows = docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b"))
    return rows.join(small(wanted), rows.a == wanted.rep, "left_semi").select("b").mapInArrow(make, "node string, set binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(sizes: np.ndarray, marks: np.ndarray, sets: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all that near sketches connect; with ``sets``, all that links of full sets connect.

    Each member is expanded once, against those that no expansion has reached yet.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sizes))
    least = NEAR * 2 * marks.shape[1]
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.minimum(sizes[rest], sizes[x]) * 100 >= np.maximum(sizes[rest], sizes[x]) * percent
            chosen = np.flatnonzero(near)
            chosen = chosen[EQUAL[marks[rest[chosen]] ^ marks[x]].sum(axis=1, dtype=np.int32) >= least]
            if sets is not None:
                chosen = np.array([c for c in chosen if _linked(sets[x], sets[rest[c]], percent)], np.int64)
            if len(chosen):
                found = rest[chosen]
                out += [(int(x), int(y)) for y in found]
                frontier += found.tolist()
                rest = np.delete(rest, chosen)
    return out


def _forests(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (u, v) of each group (g, i, j); rows hold node, n, sketch and, if ``exact``, set."""

    def grow(group):
        nodes = [r[3] for r in group]
        marks = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(len(group), -1)
        edges = forest(np.array([r[4] for r in group]), marks, [np.frombuffer(r[6], np.uint64) for r in group] if exact else None, percent)
        return [(nodes[a], nodes[b]) for a, b in edges]

    @tidy
    def run(arrow):
        group: list[tuple] = []
        for batch in arrow:
            edges = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[:3] != group[0][:3]:
                    edges += grow(group)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.string()), pa.array([e[1] for e in edges], pa.string())], ["u", "v"])
        edges = grow(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.string()), pa.array([e[1] for e in edges], pa.string())], ["u", "v"])

    columns = ["g", "i", "j", "node", "n", "sketch", *(["set"] if exact else [])]
    return rows.select(*columns).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node").mapInArrow(run, "u string, v string")


def _grown(rows: DataFrame, blocks: Column, percent: int, exact: bool) -> DataFrame:
    """Edges (u, v) that connect what links connect in each group g of rows (g, m members, node, n, sketch, maybe set); ``blocks`` is how many a group has. Stored."""
    zero, own = F.lit(0).cast("bigint"), F.pmod(F.xxhash64("node"), F.col("_blocks"))
    rows = rows.withColumn("_blocks", blocks.cast("bigint"))
    edges = stored(_forests(rows.filter("_blocks = 1").withColumns({"i": zero, "j": zero}), percent, exact), "edges")
    hot = rows.filter("_blocks > 1").withColumn("_own", own)
    if hot.isEmpty():
        return edges
    # each block with the representatives of its group
    everywhere = F.sequence(zero, F.col("_blocks") - 1)
    chosen = F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")) < REPRESENTATIVES
    dealt = hot.withColumn("i", F.explode(F.when(chosen, everywhere).otherwise(F.array("_own")))).withColumn("j", F.col("i"))
    edges = stored(edges.union(_forests(dealt, percent, exact)), "edges")
    # members outside the largest component, in blocks of their own, meet each other and all blocks of the others
    named = hot.select("g", "node").join(components(edges), "node", "left").select("g", "node", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    sizes = named.groupBy("g", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = stored(sizes.groupBy("g").agg(F.max_by("component", F.struct("k", "component")).alias("_largest"), (F.sum("k") - F.max("k")).alias("_rest")).filter("_rest > 0"), "largest")
    if largest.isEmpty():
        return edges
    rest = F.ceil(F.col("_rest") / BLOCK)
    hot = hot.join(named, ["g", "node"]).join(small(largest), "g").withColumns({"_others": rest, "_mine": F.pmod(F.xxhash64("node"), rest)})
    # rest blocks come after the group's own ones in the numbering of pairs
    others = F.transform(F.sequence(zero, F.col("_others") - 1), lambda b: b + F.col("_blocks"))
    mine = F.col("_mine") + F.col("_blocks")
    outside = F.concat(F.transform(everywhere, lambda b: F.struct(b.alias("i"), mine.alias("j"))), F.transform(others, lambda b: F.struct(F.least(b, mine).alias("i"), F.greatest(b, mine).alias("j"))))
    inside = F.transform(others, lambda b: F.struct(F.col("_own").alias("i"), b.alias("j")))
    dealt = hot.withColumn("_p", F.explode(F.when(F.col("component") == F.col("_largest"), inside).otherwise(outside))).withColumns({"i": F.col("_p.i"), "j": F.col("_p.j")})
    return stored(edges.union(_forests(dealt, percent, exact)), "edges")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest doc_id reachable over links."""
    signed = stored(signatures(docs, k, id_col, text_col), "signatures")
    several = lambda m: F.when(m > 2 * BLOCK, F.ceil(m / BLOCK)).otherwise(1)
    with scratch(docs.sparkSession) as keep:
        usable = signed.filter("node is not null and doc_id is not null")
        classes = stored(usable.groupBy("node").agg(F.min(F.struct("doc_id", "n", "keys", "sketch")).alias("x"), F.count(F.lit(1)).alias("copies")).select("node", F.col("x.doc_id").alias("rep"), "x.n", "x.keys", "x.sketch", "copies"), "classes")
        rows = classes.select("node", F.explode("keys").alias("g"))
        shared = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
        members = stored(rows.join(shared, "g"), "members")
        marked = members.join(classes.select("node", "n", "sketch"), "node")
        near = _grown(marked, several(F.col("m")), percent, exact=False)

        sizes = stored(classes.join(components(near), "node").select("node", "rep", "n", "sketch", F.col("component").alias("g")), "clustered")
        per_cluster = stored(sizes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), (8 * F.sum("n")).alias("bytes")), "sizes")
        sets = _sets(docs, sizes.select("rep"), k, id_col, text_col)
        full = sizes.join(per_cluster, "g").join(sets, "node")
        blocks = F.greatest(several(F.col("m")), F.when(F.col("bytes") > 2 * BLOCK_BYTES, F.ceil(F.col("bytes") / BLOCK_BYTES)).otherwise(1))
        links = _grown(stored(full, "sets"), blocks, percent, exact=True)

        labels = components(links)
        named = stored(labels.join(classes.select("node", "rep"), "node"), "named")
        first = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        linked = named.join(small(stored(first, "firsts")), "component").select("node", "component_id")
        # only classes with copies or links change a row
        alone = classes.filter("copies > 1").select("node", "rep").join(small(labels.select("node")), "node", "left_anti").select("node", F.col("rep").alias("component_id"))
        changed = keep(stored(linked.union(alone), "changed"))
    out = signed.select("doc_id", "n", "node").join(small(changed), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies (that of the smallest doc_id), with all its columns; repeated rows of that one stay."""
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs, k, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
        found = small(keep(stored(found, "dropped")))
    return docs.join(found, col(docs, id_col) == found._id, "left_anti")
