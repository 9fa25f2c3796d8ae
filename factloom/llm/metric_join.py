"""Exact joins of documents within a Jaccard distance, and the classes that their links make, in the metric space of shingle sets.

In this space d(x, y) = 1 - |x & y| / |x | y| is a metric, so a pivot p parts sets: sets within EPS = 1 - percent / 100 of each other differ by at most EPS
in their distance from p.

* Equal sets collapse into one class first; its smallest doc_id stands for it.
* Pivots are members of the data. Sets that share no shingle are at distance 1, from pivots too, so each set only
  has to know pivots that share one of its rarest shingles: two sets within EPS share one of them (of n shingles, the first tenth of the
  larger, and of the smaller the first n - 2t / (1 + t) n). The sets of one such shingle and a range of sizes elect the least of them as pivot,
  so sets within EPS always have a pivot in common, in whose region both lie. With some more shingles shown, two such sets share as many more
  of them, so sets that share fewer with all others leave, and again while many do.
* First every set is measured against its home, the pivot most of its shingles elect; what lies within EPS of it is linked. A region whose
  members are of one component then has nothing more to tell, and is not looked at again.
* In the others, distances from the pivot make windows: a set is compared with sets of the window that the triangle inequality
  leaves, and with those of other components only; sets that share too few members with other components leave first. A region too large for a task is cut into Voronoi cells of further pivots drawn from its
  members: a set goes to the cell of its nearest pivot, and to all others whose distance is at most 2 EPS larger; cells are cut again until
  they fit. Sets that lie equally far from all pivots would go to every cell; such a region stays whole and meets block by block.
* Before each of these steps a region loses the sets that share too few of their shown shingles with other components there.

The order of rarity comes from the counts of a hashed share of the documents; it changes the cost alone, as any order that all documents use
gives the same links.

Defined cases: null texts and texts without words have an empty set and link with nothing; texts with fewer than k words have one shingle, the
whole sequence; rows with a null doc_id link with nothing and have a null component; repeated rows are returned as often as they come; an empty table gives an
empty result; other columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, col, ddl, scratch, small, stored, tidy
from .graph import components, merged
from .near_dedup import shingle_set

#: One in so many documents is counted for the order of rarity; counts from COMMON on tell, of at most KNOWN shingles (12 bytes each in every worker).
SHARE, COMMON, KNOWN = 16, 4, 1 << 19
#: A range of sizes, in links: how often a set may be smaller than another by the most that a link allows.
RING = 4
#: How many shown shingles two linked sets share at least: VOTES, and one more for every EACH shingles of the smaller.
VOTES, EACH = 4, 50
#: Sets and bytes of sets that a task compares at once; pivots that cut a larger region; how often it is cut before its blocks meet.
BLOCK, BLOCK_BYTES, PIVOTS, CUTS = 1000, 16_000_000, 24, 2


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def common_shingles(docs: DataFrame, k: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many of the documents counted have, sorted, and the logarithm of their counts."""

    @tidy
    def count(arrow):
        held: list[np.ndarray] = []
        size = 0
        for (text,) in batches(arrow, ["b"]):
            for t in text:
                held.append(shingle_set(t, k))
                size += len(held[-1])
                if size > 1 << 20:
                    yield _counted(held)
                    held, size = [], 0
        yield _counted(held)

    def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    some = docs.select(col(docs, text_col).alias("b")).filter(F.pmod(F.xxhash64("b"), F.lit(SHARE)) == 0).mapInArrow(count, "h bigint, n bigint")
    counted = some.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(KNOWN)
    rows = counted.select("h", F.floor(F.log2("n")).cast("int").alias("n")).toArrow()
    h, level = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.int32)
    order = np.argsort(h)
    return h[order], level[order]


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles a set shows as the larger of two, and as the smaller; none if no other set can link with it."""
    if percent * (n + 1) > 100 * n:
        return 0, 0
    more = VOTES + n // EACH
    return min(n, n - -(-percent * n // 100) + more), min(n, n - -(-2 * percent * n // (100 + percent)) + more)


def signed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, rare): set size, 128-bit digest of the set, and its rarest shingles in order; ``digest`` is null for empty sets, ``rare`` for those that link with no other."""
    known, levels = common_shingles(docs, k, text_col)
    kind = docs.schema[id_col].dataType
    ids_arrow = to_arrow_type(kind)
    shared = docs.sparkSession.sparkContext.broadcast((known, levels))

    @tidy
    def sign(arrow):
        known, levels = shared.value
        for doc_id, text in batches(arrow, ["a", "b"], 64):
            sets = [shingle_set(t, k) for t in text]
            rare = []
            for s in sets:
                most = prefix_sizes(len(s), percent)[0]
                if not most:
                    rare.append(None)
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, levels[at], 0), kind="stable")]
                rare.append(s[:most].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, ids_arrow), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(rare, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "rare"],
            )

    return docs.select(col(docs, id_col).alias("a"), col(docs, text_col).alias("b")).mapInArrow(sign, f"doc_id {ddl(kind)}, n bigint, digest binary, rare array<bigint>")


def _ring(n: Column, percent: int) -> Column:
    """Sizes in ranges a few links wide: a set links with sets of its own range and of one neighbour at most."""
    return F.floor(F.log(n.cast("double")) / (RING * -math.log(percent / 100))).cast("int")


def elected(classes: DataFrame, percent: int) -> DataFrame:
    """(pivot, ring, node, votes): the regions that each class (node, n, rare) lies in. Stored; what can have no link is left out.

    Nodes are numbers, as a row goes out for each shown shingle. A shingle elects a pivot for each range of sizes; sets near the lower end of their range show theirs in the range below, too, as the larger of two.
    """
    with scratch(classes.sparkSession) as keep:
        least = F.expr(f"least(n, n - int((2L * {percent} * n + {99 + percent}) / {100 + percent}) + {VOTES} + int(n / {EACH}))")
        own, below = _ring(F.col("n"), percent), _ring(F.ceil(percent * F.col("n") / 100), percent)
        rows = classes.filter("rare is not null").select("node", "rare", least.alias("_least"), _share(percent), own.alias("_own"), F.explode(F.array_distinct(F.array(own, below))).alias("ring"))
        rows = rows.select("node", "ring", "share", F.when(F.col("ring") == F.col("_own"), F.col("_least")).otherwise(0).alias("_least"), F.posexplode("rare").alias("at", "s"))
        entries = rows.select("node", "ring", F.xxhash64("s", "ring").alias("s"), (F.col("at") < F.col("_least")).cast("int").alias("lesser"), "share")
        while True:
            # a shingle that one set shows, or none as the smaller of two, links nothing
            pivots = entries.groupBy("s").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"), F.max("lesser").alias("_some")).filter("pivot != _last and _some = 1").select("s", "pivot")
            entries = stored(entries.join(stored(pivots, "pivots"), "s").select("node", "ring", "s", "lesser", "share", "pivot"), "entries")
            voters = stored(entries.groupBy("node", "ring").agg(F.count(F.lit(1)).alias("votes"), F.max("share").alias("share")), "voters")
            few = voters.filter("votes < share").select("node", "ring")
            if 20 * few.count() <= voters.count():  # a round costs as much as those that stay
                break
            entries = entries.join(small(few), ["node", "ring"], "left_anti").select("node", "ring", "s", "lesser", "share")
        return keep(stored(entries.groupBy("pivot", "ring", "node").agg(F.count(F.lit(1)).alias("votes")), "regions"))


def shared_count(sets: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """How many members each set shares with ``x``; all are sorted and have members."""
    if not sets:
        return np.empty(0, np.int64)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    return np.add.reduceat((x[at] == flat).astype(np.int64), starts)


def distance(sets: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard distances from ``x``, and the numbers of shared members."""
    both = shared_count(sets, x)
    return 1 - both / (np.array([len(s) for s in sets]) + len(x) - both), both


def linked(both: np.ndarray, sizes: np.ndarray, n: int, percent: int) -> np.ndarray:
    return 100 * both >= percent * (sizes + n - both)


def peeled(sets: list[np.ndarray], own: np.ndarray, percent: int) -> np.ndarray:
    """The sets that may link with one of another component here: most of their members occur in several components, again after the others have left."""
    left = np.arange(len(sets))
    while len(left):
        sizes = np.array([len(sets[i]) for i in left])
        of = np.repeat(own[left], sizes)
        flat = np.concatenate([sets[i] for i in left])
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
        several = np.minimum.reduceat(of[order], first) != np.maximum.reduceat(of[order], first)
        useful = np.empty(len(flat), np.int64)
        useful[order] = np.repeat(several, np.diff(np.append(first, len(flat))))
        stay = 100 * np.add.reduceat(useful, np.cumsum(sizes) - sizes) >= percent * sizes
        if stay.all():
            return left
        left = left[stay]
    return left


def joined(sets: list[np.ndarray], classes: list[int], percent: int, pivots: int = 3) -> list[tuple[int, int]]:
    """Links that connect what links connect among the sets, where they are of different classes (components known so far).

    Distances from a few pivots leave windows of EPS, and in these the sets that show enough of each other's rarest members are
    compared, each with those of other components only.
    """
    if len(sets) < 2 or len(set(classes)) < 2:
        return []
    own = np.unique(np.array(classes), return_inverse=True)[1]
    left = peeled(sets, own, percent)
    if len(left) < len(sets):
        return [(int(left[a]), int(left[b])) for a, b in joined([sets[i] for i in left], [classes[i] for i in left], percent, pivots)]
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    eps = 1 - percent / 100 + 1e-9
    away = np.array([distance(sets, sets[p])[0] for p in range(0, m, max(1, m // pivots))[:pivots]])
    shown = _Shown(sets, sizes, percent)
    out: list[tuple[int, int]] = []
    for i in range(m):
        fits = (own != own[i]) & (sizes <= sizes[i]) & (100 * sizes >= percent * sizes[i]) & (np.abs(away - away[:, i : i + 1]) <= eps).all(axis=0)
        found = np.flatnonzero(fits)
        if len(found):
            found = found[shown.votes(i)[found] >= np.minimum(VOTES + sizes[found] // EACH, -(-percent * int(sizes[i]) // 100))]
        if len(found):
            both = shared_count([sets[j] for j in found], sets[i])
            for j in found[linked(both, sizes[found], int(sizes[i]), percent)]:
                if own[j] != own[i]:
                    out.append((i, int(j)))
                    own[own == own[j]] = own[i]
    return out


class _Shown:
    """The rarest members that sets show, by their counts among these sets: those of the larger of two against those of the smaller."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        rank = np.empty(len(times), np.int64)
        rank[np.lexsort((np.arange(len(times)), times))] = np.arange(len(times))
        of = np.repeat(np.arange(len(sets)), sizes)
        ranks = rank[flat]
        ranks = ranks[np.lexsort((ranks, of))]
        place = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
        most, least = np.array([prefix_sizes(int(n), percent) for n in sizes]).T
        larger, smaller = place < most[of], place < least[of]
        self.own = np.split(ranks[larger], np.cumsum(most)[:-1])
        order = np.argsort(ranks[smaller], kind="stable")
        self.holders, held = of[smaller][order], ranks[smaller][order]
        self.starts = np.searchsorted(held, np.arange(len(times) + 1))
        self.m = len(sets)

    def votes(self, i: int) -> np.ndarray:
        """How many of the members that set i shows each set shows as well."""
        start, number = self.starts[self.own[i]], self.starts[self.own[i] + 1] - self.starts[self.own[i]]
        at = np.repeat(start - np.cumsum(number) + number, number) + np.arange(number.sum())
        return np.bincount(self.holders[at], minlength=self.m)


def _grouped(rows: DataFrame, keys: list[str], k: int, run, schema: str, arrow_schema: pa.Schema) -> DataFrame:
    """Runs ``run(group key, rows of (node, set, tag))``, which yields result rows, over groups in the order of ``tag``; rows have node, digest, text and tag.

    ``run`` takes an iterator, so a group need not fit in memory. A text whose set isn't that of the digest, or a node's second row, is skipped.
    """

    @tidy
    def each(arrow):
        def lines():
            for values in batches(arrow, [*keys, "tag", "node", "digest", "text"], 128):
                yield from zip(*values, strict=True)

        from itertools import groupby

        def members(group):
            last = None
            for r in group:
                tag, node, digest, text = r[-4:]
                if (tag, node) != last:
                    s = shingle_set(text, k)
                    if _digest(s) == digest:
                        last = tag, node
                        yield node, s, tag

        held: list[tuple] = []
        for key, group in groupby(lines(), lambda r: r[: len(keys)]):
            for found in run(key, members(group)):
                held.append(found)
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow_schema.names, h, strict=True)) for h in held], arrow_schema)
                    held = []
        yield pa.RecordBatch.from_pylist([dict(zip(arrow_schema.names, h, strict=True)) for h in held], arrow_schema)

    return rows.select(*keys, "tag", "node", "digest", "text").repartition(*keys).sortWithinPartitions(*keys, "tag", "node").mapInArrow(each, schema)


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _measured(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links of members (tag: 1) with the pivot (tag: 0) of their group (g, salt)."""

    def run(key, members):
        pivot = None
        for node, s, tag in members:
            if tag == 0:
                pivot = node, s
            elif pivot and pivot[0] != node:
                both = shared_count([s], pivot[1])
                if linked(both, np.array([len(s)]), len(pivot[1]), percent)[0]:
                    yield pivot[0], node

    return _grouped(rows, ["g", "salt"], k, run, "u bigint, v bigint", EDGE)


def _cells(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(g, node, cell, near): for members (tag: 1) of a group (g, salt), the numbers of the pivots (tag: 0) in whose cells they go, and those that they link with."""
    eps = 1 - percent / 100 + 1e-9

    def run(key, members):
        pivots: list[tuple[int, np.ndarray]] = []
        for node, s, tag in members:
            if tag == 0:
                pivots.append((node, s))
            elif pivots:
                d, both = distance([p for _, p in pivots], s)
                near = linked(both, np.array([len(p) for _, p in pivots]), len(s), percent)
                for j in np.flatnonzero(d <= d.min() + 2 * eps).tolist():
                    yield key[0], node, pivots[j][0], bool(near[j])

    return _grouped(rows, ["g", "salt"], k, run, "g bigint, node bigint, cell bigint, near boolean", pa.schema([("g", pa.int64()), ("node", pa.int64()), ("cell", pa.int64()), ("near", pa.bool_())]))


def _pairs(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links within groups (g, i, j) that connect different components (tag)."""

    def run(key, members):
        found = list(members)
        for a, b in joined([s for _, s, _ in found], [c for _, _, c in found], percent):
            yield found[a][0], found[b][0]

    return _grouped(rows, ["g", "i", "j"], k, run, "u bigint, v bigint", EDGE)


def linked_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component): what links connect of the classes (node, digest, rep, n, rare); those without links are left out. Stored."""
    regions = elected(classes, percent)
    texts = docs.select(col(docs, id_col).alias("rep"), col(docs, text_col).alias("text")).filter("rep is not null")
    def with_texts(rows: DataFrame) -> DataFrame:
        """Rows with node, beside the digests and texts of the nodes."""
        wanted = classes.select("node", "digest", "rep").join(rows.select("node").distinct(), "node", "left_semi")
        return rows.join(texts.join(small(stored(wanted, "wanted")), "rep").select("node", "digest", "text"), "node")

    # each set against its home
    home = regions.filter("pivot != node").groupBy("pivot", "node").agg(F.sum("votes").alias("votes")).groupBy("node").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("g"))
    home = stored(home, "homes")
    salts = stored(home.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts")), "salts")
    zero = F.lit(0).cast("bigint")
    members = home.join(small(salts), "g").select("g", F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.lit(1).alias("tag"), "node")
    pivots = salts.select("g", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), F.col("g").alias("node"))
    labels = components(stored(_measured(with_texts(members.union(pivots)), k, percent), "links"))

    # regions that hold several components, cut into cells until they fit a task
    # (two regions whose numbers agree would be one, in which the same links are found)
    rest = regions.select(F.xxhash64("pivot", "ring").alias("g"), "node").distinct()
    for turn in range(CUTS + 1):
        rest = _parted(rest, labels, classes, percent)
        if rest.isEmpty():
            return labels
        large = (F.col("m") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)
        one = rest.filter(~large).select("g", zero.alias("i"), zero.alias("j"), F.col("component").alias("tag"), "node")
        if turn == CUTS:  # what doesn't shrink meets block by block
            blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("bigint")
            own = F.pmod(F.xxhash64("node"), blocks)
            meet = F.transform(F.sequence(zero, blocks - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
            many = rest.filter(large).select("g", F.explode(meet).alias("p"), F.col("component").alias("tag"), "node").select("g", "p.i", "p.j", "tag", "node")
            return merged(labels, stored(_pairs(with_texts(one.union(many)), k, percent), "links"))
        edges = stored(_pairs(with_texts(one), k, percent), "links")
        rest = rest.filter(large)
        if rest.isEmpty():
            return merged(labels, edges)
        chosen = F.pmod(F.xxhash64("g", "node", F.lit(turn)), F.col("m")) < PIVOTS
        salts = F.ceil(F.col("m") / BLOCK)
        members = rest.select("g", F.pmod(F.xxhash64("node"), salts).alias("salt"), F.lit(1).alias("tag"), "node")
        pivots = rest.filter(chosen).select("g", F.explode(F.sequence(zero, salts - 1)).alias("salt"), F.lit(0).alias("tag"), "node")
        cells = stored(_cells(with_texts(members.union(pivots)), k, percent), "cells")
        labels = merged(labels, edges.union(cells.filter("near and cell != node").select(F.col("cell").alias("u"), F.col("node").alias("v"))))
        # cells that hold most of their region each, as sets equally far from all pivots make them, are no gain: such a region stays whole
        per_cell = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("k"))
        gain = per_cell.groupBy("g").agg(F.sum(F.col("k") * F.col("k")).alias("_work")).join(rest.select("g", "m").distinct(), "g").filter("2 * _work < m * m").select("g")
        gain = small(stored(gain, "gain"))
        smaller = cells.join(gain, "g", "left_semi").select(F.xxhash64("g", "cell").alias("g"), "node").distinct()
        stays = rest.select("g", "node").join(gain, "g", "left_anti")
        rest = smaller.union(stays)
    raise AssertionError("not reached")


def _parted(rest: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(g, node, component, m, bytes): members of regions that may link with another component there, with the regions' sizes. Stored."""
    known = rest.join(small(labels), "node", "left").select("g", "node", F.coalesce("component", "node").alias("component"))
    known = _several(stored(known, "known"))
    # within its region too, a set shares enough of what it shows with sets of other components
    shown = known.join(classes.select("node", "rare", _share(percent)), "node").select(F.xxhash64("g", "node").alias("member"), F.xxhash64("component").alias("c"), "share", "g", F.explode("rare").alias("s"))
    shown = shown.select(F.xxhash64("g", "s").alias("k"), "member", "c", "share")
    useful = shown.groupBy("k").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low != _high").select("k")
    votes = shown.join(useful, "k").groupBy("member").agg(F.count(F.lit(1)).alias("votes"), F.max("share").alias("share")).filter("votes >= share").select("member")
    known = known.withColumn("member", F.xxhash64("g", "node")).join(small(stored(votes, "voters")), "member", "left_semi").drop("member")
    known = stored(known.join(classes.select("node", "n"), "node"), "known")
    sizes = known.groupBy("g").agg(F.count(F.lit(1)).alias("m"), (8 * F.sum("n")).alias("bytes"), *_ends()).filter("_low != _high").select("g", "m", "bytes")
    return stored(known.drop("n").join(small(stored(sizes, "sizes")), "g"), "parted")


def _ends() -> tuple[Column, Column]:
    return F.min("component").alias("_low"), F.max("component").alias("_high")


def _several(known: DataFrame) -> DataFrame:
    """The members of regions with more than one component."""
    mixed = known.groupBy("g").agg(*_ends()).filter("_low != _high").select("g")
    return known.join(small(stored(mixed, "mixed")), "g", "left_semi")


def _share(percent: int) -> Column:
    """How many shown members a set shares with any that it links with; none that links with a set of n is smaller than ``partner``."""
    partner = F.ceil(percent * F.col("n") / 100)
    return F.least(VOTES + F.floor(partner / EACH), partner).cast("int").alias("share")


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    with scratch(docs.sparkSession) as keep:
        with scratch(docs.sparkSession) as keep_named:  # the shown shingles are kept once, beside the classes
            found = stored(signed(docs, k, percent, id_col, text_col), "signed")
            usable = found.filter("digest is not null and doc_id is not null")
            least = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "rare")).alias("x"), F.count(F.lit(1)).alias("copies"))
            classes = keep_named(stored(least.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("x.doc_id").alias("rep"), "x.n", "x.rare", "copies"), "classes"))
            rows = keep_named(stored(found.select("doc_id", "n", "digest"), "rows"))
        labels = linked_classes(docs, classes, k, percent, id_col, text_col)
        named = stored(labels.join(classes.select("node", "digest", "rep"), "node"), "named")
        first = stored(named.groupBy("component").agg(F.min("rep").alias("component_id")), "firsts")
        linked_ones = named.join(small(first), "component").select("digest", "component_id")
        alone = classes.filter("copies > 1").select("node", "digest", "rep").join(small(labels.select("node")), "node", "left_anti").select("digest", F.col("rep").alias("component_id"))
        changed = small(stored(linked_ones.union(alone), "changed"))
        out = rows.join(changed, "digest", "left")
        component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return keep(stored(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "similar"))
