"""Algebra on long-form sparse vectors (case_id, feature, value): dot products and kernel matrices."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cases (most, and fewest where more blocks would keep more cores busy) and values of a block; cells of a piece of products, and of a block's dense form; tasks that pairs of blocks are dealt to.
CASES, LEAST, VALUES, CELLS, DENSE, TASKS = 4_000, 100, 500_000, 250_000, 4_000_000, 2_000


def scale(vectors: DataFrame, factor: float) -> DataFrame:
    return vectors.withColumn("value", F.col("value") * factor)


def combine(a: DataFrame, b: DataFrame, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    """wa * a + wb * b, entry by entry; zero entries are not stored."""
    both = scale(a, wa).unionByName(scale(b, wb))
    return both.groupBy("case_id", "feature").agg(F.sum("value").alias("value")).filter("value != 0")


def squared_norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("case_id").agg(F.sum(F.col("value") * F.col("value")).alias("norm2"))


def _packed(vectors: DataFrame) -> DataFrame:
    """(case_id, i, v, norm2): a row a case; features that are null meet nothing."""
    known = F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "value")))
    return vectors.groupBy("case_id").agg(known.alias("x"), F.sum(F.col("value") * F.col("value")).alias("norm2")).select("case_id", F.col("x.feature").alias("i"), F.col("x.value").cast("array<double>").alias("v"), "norm2")


def _bucket(case: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(case), F.lit(parts)).cast("int")


def _parts(rows: DataFrame, cases: int) -> int:
    """Blocks of packed rows: of so many cases and VALUES values at most, and enough of them to keep all cores busy with pairs of blocks."""
    n, values = (x or 0 for x in rows.agg(F.count(F.lit(1)), F.sum(F.size("i"))).first())
    return max(1, -(-n // cases), -(-values // VALUES), min(math.isqrt(8 * rows.sparkSession.sparkContext.defaultParallelism), n // LEAST))


class _Rows:
    """Sparse rows of a block: ids, squared norms, and entries by row as codes of features."""

    def __init__(self, table: pa.Table, features: pa.Array):
        self.ids, self.norms = table["case_id"].combine_chunks(), table["norm2"].fill_null(0.0).to_numpy()
        counts = pc.list_value_length(table["i"].combine_chunks()).fill_null(0).to_numpy(zero_copy_only=False)
        self.size, self.row = len(counts), np.repeat(np.arange(len(counts)), counts)
        self.code = pc.index_in(pc.list_flatten(table["i"].combine_chunks()), features).to_numpy(zero_copy_only=False).astype(np.int64)
        given = pc.list_flatten(table["v"].combine_chunks())
        self.valued = pc.is_valid(given).to_numpy(zero_copy_only=False).astype(float)
        self.value = given.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
        self.starts = np.concatenate([[0], np.cumsum(counts)])


def _features(*tables: pa.Table) -> pa.Array:
    return pc.unique(pa.chunked_array([pc.list_flatten(t["i"].combine_chunks()) for t in tables]))


def _multiplied(a: _Rows, b: _Rows, width: int):
    """(first row of a, matrices over a piece of its rows and all of b): products of values, common features, and those with both values."""
    weights = [lambda x: x.value, lambda x: np.ones(len(x.code))] + ([lambda x: x.valued] if a.valued.min(initial=1.0) * b.valued.min(initial=1.0) < 1 else [])
    step = max(1, CELLS // max(1, b.size))
    if (a.size + b.size) * width <= DENSE and np.isfinite(a.value).all() and np.isfinite(b.value).all():
        made = [[np.bincount(x.row * width + x.code, w(x), x.size * width).reshape(x.size, width) for x in (a, b)] for w in weights]
        for first in range(0, a.size, step):
            yield first, [m[first : first + step] @ n.T for m, n in made]
        return
    order = np.argsort(b.code, kind="stable")
    begins, owners = np.searchsorted(b.code[order], np.arange(width + 1)), b.row[order]
    for first in range(0, a.size, step):
        last = min(a.size, first + step)
        out, low = [np.zeros((last - first) * b.size) for _ in weights], a.starts[first]
        while low < a.starts[last]:  # entries of a with about CELLS meetings
            met = np.cumsum(np.diff(begins)[a.code[low : a.starts[last]]])
            high = low + max(1, int(np.searchsorted(met, CELLS, side="right")))
            counts = np.diff(begins)[a.code[low:high]]
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins[a.code[low:high]], counts)
            cells = np.repeat(a.row[low:high] - first, counts) * b.size + owners[place]
            for m, w in zip(out, weights, strict=True):
                m += np.bincount(cells, np.repeat(w(a)[low:high], counts) * w(b)[order][place], len(m))
            low = high
        yield first, [m.reshape(last - first, b.size) for m in out]


def grouped(batches):
    """Tables of one pair of blocks each, as their rows come sorted."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("p", "q")], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
        for first, last in zip([0, *edges], [*edges, len(keys)], strict=True):
            if first < last:
                if key is not None and tuple(keys[first]) != key:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = tuple(keys[first])
                held.append(batch.slice(first, last - first))
    if held:
        yield key, pa.Table.from_batches(held)


def _products(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(case_a, case_b, dot, xx, yy): dot products and squared norms of pairs that share a feature.

    Cases are dealt in blocks, and each pair of blocks meets in a task that multiplies piece by piece: no pair is shuffled, and what is shuffled are the
    vectors, once for each block of the other side.
    """
    sides = [_packed(x) for x in ([a] if b is None else [a, b])]
    sizes = [_parts(x, CASES) for x in sides]
    parts, others = sizes[0], sizes[-1]

    def dealt(x: DataFrame, own: Column, other: int, side: int) -> DataFrame:
        row = x.select("case_id", "i", "v", "norm2", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        if b is None:  # a block meets those that come after it, and itself once
            return row.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "case_id", "i", "v", "norm2")
        p, q = ("own", "other") if side == 0 else ("other", "own")
        return row.select(F.col(p).alias("p"), F.col(q).alias("q"), F.lit(side).alias("side"), "case_id", "i", "v", "norm2")

    rows = dealt(sides[0], _bucket("case_id", parts), others, 0)
    if b is not None:
        rows = rows.unionByName(dealt(sides[1], _bucket("case_id", others), parts, 1))
    alone = b is None

    def run(batches):
        for (p, q), table in grouped(batches):
            left = table.filter(pc.equal(table["side"], 0))
            right = left if alone and p == q else table.filter(pc.equal(table["side"], 1))
            if not len(left) or not len(right):
                continue
            features = _features(left, right)
            x, y = _Rows(left, features), _Rows(right, features)
            ids = pa.concat_arrays([x.ids, y.ids]) if alone else None
            rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) if alone else None
            for first, (dot, shared, *valued) in _multiplied(x, y, len(features)):
                i, j = np.nonzero(shared > 0)
                value = pa.array(dot[i, j], mask=valued[0][i, j] == 0 if valued else None)
                i += first
                xx, yy = x.norms[i], y.norms[j]
                if alone:
                    known = np.ones(len(i), bool) if p != q else rank[i] <= rank[x.size + j]
                    i, j, xx, yy, value = i[known], j[known] + x.size, xx[known], yy[known], value.filter(pa.array(known))
                    turned = rank[i] > rank[j]
                    i, j, xx, yy = np.where(turned, j, i), np.where(turned, i, j), np.where(turned, yy, xx), np.where(turned, xx, yy)
                    pair = ids.take(pa.array(i)), ids.take(pa.array(j))
                else:
                    pair = x.ids.take(pa.array(i)), y.ids.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([*pair, value, pa.array(xx), pa.array(yy)], ["case_a", "case_b", "dot", "xx", "yy"])

    keys = parts * (parts + 1) // 2 if alone else parts * others
    one, two = (x.schema["case_id"].dataType for x in (sides[0], sides[-1]))
    out = T.StructType([T.StructField("case_a", one), T.StructField("case_b", two), *[T.StructField(c, T.DoubleType()) for c in ("dot", "xx", "yy")]])
    if alone:
        rows = rows.filter("case_id is not null")
    return rows.repartition(min(keys, TASKS), "p", "q").sortWithinPartitions("p", "q", "side").mapInArrow(run, out)


def dot_products(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(case_a, case_b, dot) over pairs that share a feature; blocks of vectors meet, pairs are not shuffled.

    Without ``b`` each unordered pair comes once, with case_a <= case_b.
    """
    return _products(a, b).select("case_a", "case_b", "dot")


def _kernel(kernel: str, gamma: float, coef0: float, degree: int) -> Column:
    """A kernel's value from ``dot`` and, for rbf, the squared norms ``xx`` and ``yy``."""
    dot = F.col("dot")
    made: dict[str, Column] = {"linear": dot, "poly": F.pow(gamma * dot + coef0, F.lit(degree)), "sigmoid": F.tanh(gamma * dot + coef0)}
    return F.exp(-gamma * (F.col("xx") + F.col("yy") - 2 * dot)) if kernel == "rbf" else made[kernel]


def gram(vectors: DataFrame, kernel: str = "linear", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> DataFrame:
    """Kernel values for pairs that share a feature; ``kernel`` is linear, poly, rbf or sigmoid.

    All other pairs have the value of a zero dot product, which ``unshared`` gives without listing them; ``gram_of`` has it for chosen pairs.
    """
    return _products(vectors).select("case_a", "case_b", _kernel(kernel, gamma, coef0, degree).alias("k"))


def unshared(vectors: DataFrame, kernel: str = "linear", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> DataFrame:
    """(case_id, factor): the kernel of two cases without a common feature is the product of their factors, up to the sign of ``unshared_sign``."""
    constant = {"linear": 0.0, "poly": float(coef0) ** degree, "sigmoid": math.tanh(coef0)}
    if kernel == "rbf":
        return squared_norms(vectors).select("case_id", F.exp(-gamma * F.col("norm2")).alias("factor"))
    return vectors.select("case_id").distinct().withColumn("factor", F.lit(math.sqrt(abs(constant[kernel]))))


def unshared_sign(kernel: str, coef0: float = 0.0, degree: int = 3) -> int:
    """The sign of the values of pairs without a common feature."""
    return -1 if coef0 < 0 and (kernel == "sigmoid" or kernel == "poly" and degree % 2) else 1


def gram_of(pairs: DataFrame, vectors: DataFrame, kernel: str = "linear", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> DataFrame:
    """Kernel values (case_a, case_b, k) of the given pairs, whether they share a feature or not.

    Pairs go to the pair of blocks that holds their vectors, which are sent once for each other block and never with each pair.
    """
    packed = _packed(vectors)
    parts = _parts(packed, VALUES)
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {f.name: f.dataType for f in packed.schema}
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    own = packed.select("case_id", "i", "v", "norm2", _bucket("case_id", parts).alias("own"), every)
    rows = reduce(DataFrame.unionByName, [
        *[own.select(F.col(p).alias("p"), F.col(q).alias("q"), F.lit(side).alias("side"), "case_id", null(kinds["case_id"]).alias("case_b"), "i", "v", "norm2") for side, p, q in ((0, "own", "other"), (1, "other", "own"))],
        pairs.select(_bucket("case_a", parts).alias("p"), _bucket("case_b", parts).alias("q"), F.lit(2).alias("side"), F.col("case_a").cast(kinds["case_id"]).alias("case_id"), F.col("case_b").cast(kinds["case_id"]).alias("case_b"), *[null(kinds[c]).alias(c) for c in ("i", "v", "norm2")]),
    ])

    def run(batches):
        key, held, blocks = None, [], None
        for batch in batches:
            for (p, q, side), piece in _sides(batch):
                if key != (p, q):
                    key, held, blocks = (p, q), [], None
                if side < 2:
                    held.append(piece)
                    continue
                if blocks is None:
                    table = pa.Table.from_batches(held or [piece.slice(0, 0)])
                    a, b = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
                    features = _features(a, b)
                    x, y = _Rows(a, features), _Rows(b, features)
                    width, cells = max(1, len(features)), y.row * max(1, len(features)) + y.code
                    order = np.argsort(cells, kind="stable")
                    # repeated entries of a case add up
                    cells, begins = np.unique(cells[order], return_index=True)
                    blocks = x, y, width, cells, np.add.reduceat(y.value[order], begins) if len(begins) else np.zeros(0)
                yield _paired(piece, *blocks)

    out = T.StructType([T.StructField("case_a", kinds["case_id"]), T.StructField("case_b", kinds["case_id"]), *[T.StructField(c, T.DoubleType()) for c in ("dot", "xx", "yy")]])
    found = rows.repartition(min(parts * parts, TASKS), "p", "q").sortWithinPartitions("p", "q", "side").mapInArrow(run, out)
    return found.select("case_a", "case_b", _kernel(kernel, gamma, coef0, degree).alias("k"))


def _sides(batch: pa.RecordBatch):
    keys = np.stack([batch.column(c).to_numpy() for c in ("p", "q", "side")], axis=1)
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
    for first, last in zip([0, *edges], [*edges, len(keys)], strict=True):
        if first < last:
            yield tuple(keys[first]), batch.slice(first, last - first)


def _paired(piece: pa.RecordBatch, x: _Rows, y: _Rows, width: int, cells: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Dot products and squared norms of the pairs of a piece; a case without a vector is one of zeros."""
    i, j = (pc.index_in(piece.column(c), side.ids).fill_null(-1).to_numpy(zero_copy_only=False) for c, side in (("case_id", x), ("case_b", y)))
    known = np.flatnonzero((i >= 0) & (j >= 0))
    begins, counts = x.starts[i[known]], x.starts[i[known] + 1] - x.starts[i[known]]
    dot = np.zeros(len(i))
    if len(cells) and counts.sum():
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
        wanted = np.repeat(j[known].astype(np.int64), counts) * width + x.code[place]
        at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
        dot = np.bincount(np.repeat(known, counts), np.where(cells[at] == wanted, x.value[place] * values[at], 0.0), len(i))
    norms = [np.where(k >= 0, np.append(side.norms, 0.0)[k], 0.0) for k, side in ((i, x), (j, y))]
    return pa.RecordBatch.from_arrays([piece.column("case_id"), piece.column("case_b"), pa.array(dot), *map(pa.array, norms)], ["case_a", "case_b", "dot", "xx", "yy"])
