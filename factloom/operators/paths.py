"""Bounded breadth-first distances over all sources at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.algebra import grouped
from .deduce import EX, cut
from .graph import Graph

#: Vertices of a block (most, and fewest where more blocks would keep more cores busy); pairs of a piece of a tile; tasks that tiles are dealt to.
BLOCK, LEAST, CELLS, TASKS = 16_000, 200, 1_000_000, 2_000


def distances(graph: Graph, bound: int, sources: DataFrame | None = None) -> DataFrame:
    """(ex, src, dst, d) for d up to ``bound``, through alive vertices only, d = 0 included.

    Each round joins the frontier to the edges and keeps the smallest distance of a pair, a combinable
    aggregate; the loop is as long as the bound, not the data. From all vertices, whose pairs grow with the square at a hub,
    rounds go to half the bound only, and both halves meet in tiles.
    """
    g = graph.living()
    if sources is None and bound > 1:
        return _all_pairs(g, bound)
    return _rounds(g, bound, sources)


def _rounds(g: Graph, bound: int, sources: DataFrame | None = None) -> DataFrame:
    start = g.vertices.select(EX, "vid") if sources is None else sources.select(EX, "vid").join(g.vertices.select(EX, "vid"), [EX, "vid"], "left_semi").dropDuplicates()
    found = start.select(EX, F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("d"))
    step = g.edges.select(EX, F.col("src").alias("dst"), F.col("dst").alias("next")).dropDuplicates()
    for d in range(1, bound + 1):
        frontier = found.filter(F.col("d") == d - 1)
        reached = frontier.join(step, [EX, "dst"]).select(EX, "src", F.col("next").alias("dst"), F.lit(d).alias("d"))
        found = found.unionByName(reached).groupBy(EX, "src", "dst").agg(F.min("d").alias("d"))
        if d % 2 == 0 and d < bound:  # each round reads the last one twice
            found = cut(found)
    return found


def _block(vertex: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(EX, vertex), F.lit(blocks)).cast("int")


def _all_pairs(g: Graph, bound: int) -> DataFrame:
    """Distances between all vertices; no pair is shuffled.

    Vertices are dealt in blocks. A tile of two blocks is a task's: it gets the walks of half the bound that leave the one (side 0) and those that
    end in the other (side 1), where they meet, and for an odd bound the edges between their ends (side 2). What is shuffled are these walks,
    once for each block that they may meet.
    """
    half = bound // 2
    flipped = Graph(g.vertices, g.edges.select(EX, F.col("dst").alias("src"), F.col("src").alias("dst"), "role"))
    ahead, back = (cut(_rounds(x, half).select(EX, F.col("src").alias("v"), F.col("dst").alias("m"), "d").filter(F.col(EX).isNotNull() & F.col("v").isNotNull())) for x in (g, flipped))
    n = g.vertices.count()
    blocks = max(1, -(-n // BLOCK), min(math.isqrt(8 * g.vertices.sparkSession.sparkContext.defaultParallelism), n // LEAST))
    p, q = (cut(x.select(EX, "m", _block("v", blocks).alias(name)).distinct()) for x, name in ((ahead, "p"), (back, "q")))
    met, mid = (p, q), None
    if bound % 2:
        edges = g.edges.select(EX, F.col("src").alias("v"), F.col("dst").alias("m")).distinct()
        after = edges.join(q, [EX, "m"])
        mid = after.join(p.withColumnRenamed("m", "v"), [EX, "v"])
        met = (
            p.unionByName(edges.join(p.withColumnRenamed("m", "v"), [EX, "v"]).select(EX, "m", "p")).distinct(),
            q.unionByName(after.select(EX, F.col("v").alias("m"), "q")).distinct(),
        )
    rows = ahead.join(met[1], [EX, "m"]).select(_block("v", blocks).alias("p"), "q", F.lit(0).alias("side"), EX, "v", "m", "d")
    rows = rows.unionByName(back.join(met[0], [EX, "m"]).select("p", _block("v", blocks).alias("q"), F.lit(1).alias("side"), EX, "v", "m", "d"))
    if mid is not None:
        rows = rows.unionByName(mid.select("p", "q", F.lit(2).alias("side"), EX, "v", "m", F.lit(1).alias("d")))
    kinds = {f.name: f.dataType for f in ahead.schema}
    out = T.StructType([T.StructField(EX, kinds[EX]), T.StructField("src", kinds["v"]), T.StructField("dst", kinds["v"]), T.StructField("d", T.IntegerType())])

    def run(batches):
        for _, table in grouped(batches):
            yield from _tile(table, bound)

    found = rows.repartition(min(blocks * blocks, TASKS), "p", "q").sortWithinPartitions("p", "q", "side").mapInArrow(run, out)
    # a vertex without a name meets nothing, not even itself
    nameless = g.vertices.filter(F.col(EX).isNull() | F.col("vid").isNull()).select(EX, F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("d")).distinct()
    return found.unionByName(nameless)


def _names(table: pa.Table, column: str) -> pa.Array:
    """Interpretation and vertex as one text."""
    ex, vertex = (pc.cast(table[c].combine_chunks(), pa.string()) for c in (EX, column))
    return pc.binary_join_element_wise(pc.cast(pc.utf8_length(ex), pa.string()), ex, vertex, ":")


def _led(at: np.ndarray, starts: np.ndarray):
    """(entries, places): for entries at keys, the places from ``starts`` of their keys; about CELLS of them at a time."""
    counts = starts[at + 1] - starts[at]
    ends, low = np.cumsum(counts), 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, side="right")))
        c = counts[low:high]
        yield np.repeat(np.arange(low, high), c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(starts[at[low:high]], c)
        low = high


def _tile(table: pa.Table, bound: int):
    """The distances of a tile, piece by piece."""
    ahead, back, mid = (table.filter(pc.equal(table["side"], k)) for k in range(3))
    if not len(ahead) or not len(back):
        return
    every = pc.unique(pa.concat_arrays([_names(ahead, "m"), _names(back, "m"), _names(mid, "v"), _names(mid, "m")]))
    code = lambda t, c: pc.index_in(_names(t, c), every).to_numpy(zero_copy_only=False).astype(np.int64)

    def side(t: pa.Table) -> tuple:
        v = _names(t, "v").dictionary_encode().indices.to_numpy()
        first = pa.array(np.unique(v, return_index=True)[1])
        return v.astype(np.int64), code(t, "m"), t["d"].to_numpy().astype(np.int64), t[EX].combine_chunks().take(first), t["v"].combine_chunks().take(first)

    (i, im, di, ex, src), (j, jm, dj, _, dst) = side(ahead), side(back)
    order = np.argsort(i, kind="stable")
    i, im, di = i[order], im[order], di[order]
    order = np.argsort(jm, kind="stable")
    j, dj, begins = j[order], dj[order], np.searchsorted(jm[order], np.arange(len(every) + 1))
    u, w = code(mid, "v"), code(mid, "m")
    order = np.argsort(u, kind="stable")
    w, leave = w[order], np.searchsorted(u[order], np.arange(len(every) + 1))
    width, none = len(dst), bound + 1
    step = max(1, CELLS // width)

    def met(level: np.ndarray, row: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
        for e, to in _led(at, begins):
            cells, far = row[e] * width + j[to], d[e] + dj[to]
            for t in np.unique(far):  # of one distance: which of equal cells is written last makes no difference
                c = cells[far == t]
                level[c] = np.minimum(level[c], t)

    for first in range(0, len(src), step):
        last = min(len(src), first + step)
        a, b = np.searchsorted(i, [first, last])
        level = np.full((last - first) * width, none, np.uint8 if none < 256 else np.int32)
        met(level, i[a:b] - first, im[a:b], di[a:b])
        if len(w):
            for e, to in _led(im[a:b], leave):
                met(level, i[a:b][e] - first, w[to], di[a:b][e] + 1)
        cells = np.flatnonzero(level < none)
        rows = pa.array(cells // width + first)
        yield pa.RecordBatch.from_arrays([ex.take(rows), src.take(rows), dst.take(pa.array(cells % width)), pa.array(level[cells].astype(np.int32))], [EX, "src", "dst", "d"])


def at_distance(dist: DataFrame, d: int) -> DataFrame:
    return dist.filter(F.col("d") == d)


def ball(dist: DataFrame, radius: int) -> DataFrame:
    return dist.filter(F.col("d") <= radius)


def pairwise(dist: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (ex, src, dst) with their distance, -1 where it passes the bound."""
    return pairs.join(dist, [EX, "src", "dst"], "left").withColumn("d", F.coalesce("d", F.lit(-1)))
