"""Linear models of all folds in one distributed pass: dual coordinate ascent in blocks of cases.

The regularised loss of every fold's training cases, mean(c * loss(w.x, y)) + lambda / 2 * |w|^2, has a dual with one variable a case. Cases are
dealt in blocks; in a round each block improves its own variables with the others' effect frozen in the weights, and the changes of the
weights add up, a combinable sum by feature (the additive scheme of Ma et al., "Adding vs. averaging in distributed
primal-dual optimization", 2015, with the blocks' number as the safe factor). A case goes through once for all folds: its
variables are an array, weights are a table (feature, array), and in the column of a case's own fold nothing moves.

The gap between primal and dual cost bounds the distance from the optimum, is measured in every round, and ends the rounds; no
convergence within ``rounds`` is an error. Smooth losses over few features take no rounds: they are solved directly (``_solved``, ``_newton``), and their gap
is measured alike. A block holds no more than VALUES values, and of the weights those of its own features
only; nothing but two sums a fold reaches the driver. Cases, blocks and features may be any number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SgdOptions
from .workspace import Workspace, workspace

#: Values and cases of a block; folds that are trained side by side; half width of the insensitive tube (as in models.LOSSES).
VALUES, CASES, WIDTH, TUBE = 1_000_000, 20_000, 32, 0.01
#: Passes of a block over its cases when it is the only one and can go on to the end.
ALONE = 2000
#: Features up to which smooth losses are solved directly: the squared one by its normal equations, others by Newton's steps; most passes of these, and the gap that they go on to.
DIRECT, NEWTON, NEAR = 200, 60, 1e-8


def losses(kind: str, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kind == "hinge":
        return np.maximum(0, 1 - y * f)
    if kind == "log":
        return np.logaddexp(0, -y * f)
    if kind == "exponential":
        return np.exp(np.minimum(700, -y * f))
    return 0.5 * (f - y) ** 2 if kind == "squared" else np.maximum(0, np.abs(f - y) - TUBE)


def gains(kind: str, a: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What dual variables add to the dual cost: minus c times the loss's conjugate at -a / c."""
    if kind == "squared":
        return a * y - a * a / (2 * c)
    if kind == "epsilon":
        return a * y - TUBE * np.abs(a)
    b = np.maximum(a * y, 0)
    if kind == "hinge":
        return b
    with np.errstate(divide="ignore", invalid="ignore"):
        p = b / c
        if kind == "exponential":
            return np.where(b > 0, b - b * np.log(p), 0.0)
        q = np.maximum(1 - p, 0)
        return -c * (np.where(p > 0, p * np.log(p), 0.0) + np.where(q > 0, q * np.log(q), 0.0))


def best(kind: str, a: np.ndarray, f: np.ndarray, y: float, c: float, q: np.ndarray) -> np.ndarray:
    """The dual variables of a case (one a fold) that are best with all others fixed; ``q`` is the curvature, ``f`` the margins."""
    if kind == "squared":
        return a + (y - f - a / c) / (1 / c + q)
    if kind == "epsilon":
        z = a + (y - f) / q
        return np.clip(np.sign(z) * np.maximum(0, np.abs(z) - TUBE / q), -c, c)
    b = a * y
    if kind == "hinge":
        return y * np.clip(b + (1 - y * f) / q, 0, c)
    # t is the log-odds (or the logarithm) of b / c, where t + y f + q (b(t) - b) vanishes; that rises with t
    t = high = np.minimum(-y * f + q * b, 50.0 if kind == "exponential" else np.inf)
    if kind == "exponential":  # convex, so that Newton's steps from above stay above
        for _ in range(80):
            e = c * np.exp(t)
            step = (t + y * f + q * (e - b)) / (1 + q * e)
            t = t - step
            if np.abs(step).max() < 1e-10:
                break
        return y * c * np.exp(t)
    low = -y * f - q * (c - b)
    for _ in range(60):
        s = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
        g = t + y * f + q * (c * s - b)
        high, low = np.where(g > 0, t, high), np.where(g > 0, low, t)
        new = t - g / (1 + q * c * s * (1 - s))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        moved = np.abs(new - t).max()
        t = new
        if moved < 1e-10:
            break
    return y * c / (1 + np.exp(-np.clip(t, -500, 500)))


class Block:
    """Cases of one task: sparse rows over the block's own features, labels, own folds (-1: none of these), dual variables."""

    def __init__(self, rows: list[tuple], features: np.ndarray, weights: np.ndarray, o: SgdOptions, numbers: np.ndarray, factor: float):
        self.o, self.numbers, self.factor = o, numbers, factor
        self.y = np.array([r[1] for r in rows], float)
        own = np.array([r[2] for r in rows])
        self.places = [np.searchsorted(features, np.asarray(r[3], np.int64)) for r in rows]
        self.values = [np.asarray(r[4], float) for r in rows]
        self.a = np.array([r[5] for r in rows], float)
        self.train = own[:, None] != np.arange(len(numbers))[None, :]
        self.c = np.where(self.y < 0, o.lossratio, 1.0)
        self.w = weights

    def margins(self) -> np.ndarray:
        return np.array([v @ self.w[p] if len(p) else np.zeros(len(self.numbers)) for p, v in zip(self.places, self.values, strict=True)])

    def costs(self) -> np.ndarray:
        """(2, folds): sums of losses and of gains over the training cases."""
        f, y, c = self.margins(), self.y[:, None], self.c[:, None]
        both = losses(self.o.loss, f, y) * c, gains(self.o.loss, self.a, y, c)
        return np.array([np.where(self.train, x, 0.0).sum(axis=0) for x in both])

    def gap(self) -> np.ndarray:
        """Relative gaps, if this is the only block."""
        sums = self.costs() / self.numbers
        norm = self.o.lambda_ / 2 * (self.w**2).sum(axis=0)
        return (sums[0] + 2 * norm - sums[1]) / np.maximum(sums[0] + norm, 1e-12)

    def improve(self, passes: int, rng: np.random.Generator) -> None:
        scale = self.factor / (self.o.lambda_ * self.numbers)
        for _ in range(passes):
            for k in rng.permutation(len(self.y)):
                p, v, a = self.places[k], self.values[k], self.a[k]
                q = np.maximum(scale * (v @ v), 1e-12)
                f = v @ self.w[p] if len(p) else np.zeros(len(scale))
                new = np.where(self.train[k], best(self.o.loss, a, f, self.y[k], self.c[k], q), 0.0)
                change = (new - a) * scale
                if len(p):
                    self.w[p] += v[:, None] * change
                self.a[k] = new


KIND = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("case_id", pa.string()), ("label", pa.float64()), ("own", pa.int32()), ("i", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("a", pa.list_(pa.float64())), ("feature", pa.int64()), ("w", pa.list_(pa.float64()))])
ROUND = "kind int, part bigint, case_id string, label double, own int, i array<bigint>, v array<double>, a array<double>, feature bigint, w array<double>"
CASE, WEIGHT, SUMS = 1, 0, 2


def _round(rows: DataFrame, o: SgdOptions, numbers: list[int], parts: int, turn: int) -> DataFrame:
    """Blocks (rows of kind WEIGHT, then CASE) improved: cases with new dual variables, changes of weights, and sums of costs as they were before."""
    folds, tolerance = np.array(numbers, float), o.tolerance

    def solved(part: int, weights: list[tuple], cases: list[tuple]):
        features = np.array([w[0] for w in weights], np.int64)
        before = np.array([w[1] for w in weights], float).reshape(len(weights), len(folds))
        block = Block(cases, features, before.copy(), o, folds, float(parts))
        sums = block.costs()
        rng = np.random.default_rng((o.seed, turn, part))
        if parts > 1:
            block.improve(o.epochs, rng)
        else:
            for _ in range(ALONE):
                if (block.gap() <= tolerance / 2).all():
                    break
                block.improve(max(1, o.epochs), rng)
        change = (block.w - before) / parts
        size = len(cases)
        yield _batch(CASE, part, size, case_id=[c[0] for c in cases], label=block.y, own=[c[2] for c in cases], i=[c[3] for c in cases], v=[c[4] for c in cases], a=list(block.a))
        moved = np.flatnonzero(change.any(axis=1))
        yield _batch(WEIGHT, part, len(moved), feature=features[moved], w=list(change[moved]))
        yield _batch(SUMS, part, 1, w=[sums.ravel()])

    def run(batches):
        part, weights, cases = None, [], []
        for batch in batches:
            for r in batch.select(["part", "kind", "case_id", "label", "own", "i", "v", "a", "feature", "w"]).to_pylist():
                if r["part"] != part:
                    if cases:
                        yield from solved(part, weights, cases)
                    part, weights, cases = r["part"], [], []
                if r["kind"] == WEIGHT:
                    weights.append((r["feature"], r["w"]))
                else:
                    cases.append((r["case_id"], r["label"], r["own"], r["i"] or [], r["v"] or [], r["a"]))
        if cases:
            yield from solved(part, weights, cases)

    return rows.repartition("part").sortWithinPartitions("part", "kind", "feature", "case_id").mapInArrow(run, ROUND)


def _batch(kind: int, part: int, size: int, **columns) -> pa.RecordBatch:
    found = {"kind": [kind] * size, "part": [part] * size} | columns
    return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(size, f.type) for f in KIND], schema=KIND)


def _added(rows: DataFrame, k: int) -> DataFrame:
    """(feature, w): arrays added up by feature."""
    return rows.groupBy("feature").agg(F.array(*[F.sum(F.col("w")[j]) for j in range(k)]).alias("w"))


def _train(work: Workspace, rows: DataFrame, size: tuple[int, int], numbers: list[int], o: SgdOptions, rounds: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Weights (feature, w) of the folds with these numbers of training cases, and each fold's primal and dual cost; ``rows`` has case_id, label, own, i and v."""
    k, (n, values) = len(numbers), size
    parts = max(1, -(-values // VALUES), -(-n // CASES))
    null = lambda kind: F.lit(None).cast(kind)
    data = work.put(rows.select(F.lit(CASE).alias("kind"), F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("bigint").alias("part"), "case_id", F.col("label").cast("double").alias("label"), "own", "i", "v", F.array_repeat(F.lit(0.0), k).alias("a"), null("bigint").alias("feature"), null("array<double>").alias("w")))
    uses = work.put(data.select("part", F.explode("i").alias("feature")).distinct())
    weights = work.put(uses.select("feature").distinct().withColumn("w", F.array_repeat(F.lit(0.0), k)))
    for turn in range(rounds):
        known = uses.join(weights, "feature").select(F.lit(WEIGHT).alias("kind"), "part", *[null(t).alias(c) for c, t in (("case_id", "string"), ("label", "double"), ("own", "int"), ("i", "array<bigint>"), ("v", "array<double>"), ("a", "array<double>"))], "feature", "w")
        done = work.put(_round(known.unionByName(data), o, numbers, parts, turn))
        sums = done.filter(F.col("kind") == SUMS).agg(*[F.sum(F.col("w")[j]) for j in range(2 * k)]).first()
        norms = weights.agg(*[F.sum(F.col("w")[j] * F.col("w")[j]) for j in range(k)]).first()
        reg = [o.lambda_ / 2 * (x or 0.0) for x in norms]
        costs = [((sums[j] or 0.0) / m + reg[j], (sums[k + j] or 0.0) / m - reg[j]) for j, m in enumerate(numbers)]
        if all(p - d <= o.tolerance * max(p, 1e-12) for p, d in costs):
            work.drop(done)
            return weights, costs
        newer = work.put(_added(weights.union(done.filter(F.col("kind") == WEIGHT).select("feature", "w")), k))
        for old in (data, weights):
            work.drop(old)
        data, weights = done.filter(F.col("kind") == CASE), newer
        data._at = done._at
    raise RuntimeError(f"gaps {[round((p - d) / max(p, 1e-12), 5) for p, d in costs]} after {rounds} rounds; the tolerance is {o.tolerance}")


def _solved(usable: DataFrame, o: SgdOptions, chunk: list[int], numbers: list[int]) -> tuple[list[tuple], list[tuple[float, float]]] | None:
    """Weights (fold, feature, weight) and primal and dual costs of the squared loss by the normal equations, if there are at most DIRECT features.

    Their sums are taken on the executors; the driver gets a row for each pair of features and fold. The gap is the gradient's square over 2 lambda.
    """
    features = _few(usable)
    if features is None:
        return None
    c = F.when(F.col("label") < 0, F.lit(o.lossratio)).otherwise(F.lit(1.0))
    # labels go along as one more entry, so that one sum has all products
    rows = usable.select("fold", c.alias("c"), F.concat(F.arrays_zip("i", "v"), F.array(F.struct(F.lit(None).cast("bigint").alias("i"), F.col("label").cast("double").alias("v")))).alias("x"))
    pairs = rows.select("fold", "c", "x", F.explode("x").alias("a")).select("fold", "c", "a", F.explode("x").alias("b"))
    sums = pairs.groupBy("fold", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("c") * F.col("a.v") * F.col("b.v")).alias("s")).collect()
    place, size = {None: len(features)} | {f: k for k, f in enumerate(features)}, len(features)
    whole, own = np.zeros((size + 1, size + 1)), {}
    for r in sums:
        whole[place[r.i], place[r.j]] += r.s
        own.setdefault(r.fold, np.zeros_like(whole))[place[r.i], place[r.j]] += r.s
    weights, costs = [], []
    for fold, n in zip(chunk, numbers, strict=True):
        m = (whole - own.get(fold, 0.0)) / n
        hess, pull = m[:size, :size] + o.lambda_ * np.eye(size), m[:size, size]
        w = np.linalg.solve(hess, pull)
        slope = hess @ w - pull
        primal = max(0.0, (w @ hess @ w - 2 * w @ pull + m[size, size]) / 2)
        costs.append((primal, primal - slope @ slope / (2 * o.lambda_)))
        weights += [(fold, f, float(x)) for f, x in zip(features, w, strict=True) if x]
    if not all(p - d <= o.tolerance * max(p, 1e-12) for p, d in costs):
        return None
    return weights, [(float(p), float(d)) for p, d in costs]


def _few(usable: DataFrame) -> list[int] | None:
    """The features in order, if there are at most DIRECT."""
    features = [r.feature for r in usable.select(F.explode("i").alias("feature")).distinct().orderBy("feature").limit(DIRECT + 1).collect()]
    return features if len(features) <= DIRECT else None


def _curves(kind: str, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a smooth loss by the margin."""
    if kind == "exponential":
        e = np.exp(np.minimum(700, -y * f))
        return -y * e, e
    s = np.exp(-np.logaddexp(0, y * f))
    return -y * s, s * (1 - s)


def _newton(usable: DataFrame, o: SgdOptions, chunk: list[int], numbers: list[int]) -> tuple[list[tuple], list[tuple[float, float]]] | None:
    """Weights and costs of a smooth loss as ``_solved`` gives them, by Newton's steps on the primal cost of all folds; a pass over the cases sums what a step needs."""
    features = _few(usable)
    if not features:
        return None
    size, k, known = len(features), len(chunk), np.array(features, np.int64)

    def summed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each fold: cost, gradient and second derivatives."""

        def run(batches):
            total = 0.0
            for batch in batches:
                n, i = batch.num_rows, batch.column("i")
                if not n:
                    continue
                cells = np.repeat(np.arange(n), np.asarray(i.value_lengths(), np.int64)) * size + np.searchsorted(known, np.asarray(i.flatten(), np.int64))
                x = np.bincount(cells, np.asarray(batch.column("v").flatten(), float), n * size).reshape(n, size)
                y, fold, f = np.asarray(batch.column("label"), float), np.asarray(batch.column("fold"), np.int64), x @ w.T
                c, part = np.where(y < 0, o.lossratio, 1.0), []
                for j in range(k):
                    chosen = np.where(fold != chunk[j], c, 0.0)
                    one, two = _curves(o.loss, f[:, j], y)
                    part.append(np.concatenate([[chosen @ losses(o.loss, f[:, j], y)], x.T @ (chosen * one), (x.T @ ((chosen * two)[:, None] * x)).ravel()]))
                total = total + np.array(part)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

        found = usable.select("label", "fold", "i", "v").mapInArrow(run, "sums array<double>").collect()
        sums = np.sum([r.sums for r in found], axis=0).reshape(k, -1) / np.array(numbers, float)[:, None]
        hess = sums[:, 1 + size :].reshape(k, size, size) + o.lambda_ * np.eye(size)
        return sums[:, 0] + o.lambda_ / 2 * (w**2).sum(axis=1), sums[:, 1 : 1 + size] + o.lambda_ * w, hess

    w = np.zeros((k, size))
    cost, slope, hess = summed(w)
    for _ in range(NEWTON):
        gap = (slope**2).sum(axis=1) / (2 * o.lambda_)
        open_ = gap > min(o.tolerance, NEAR) * np.maximum(cost, 1e-12)
        if not open_.any():
            break
        step = np.array([-np.linalg.solve(h, g) if a else 0 * g for h, g, a in zip(hess, slope, open_, strict=True)])
        length, fall = np.ones(k), (step * slope).sum(axis=1)
        for _ in range(NEWTON):
            new = summed(w + length[:, None] * step)
            short = ~(new[0] <= cost + 1e-4 * length * fall + 1e-13 * np.abs(cost))
            if not short.any():
                break
            length = np.where(short, length / 2, length)
        w, (cost, slope, hess) = w + length[:, None] * step, new
    gap = (slope**2).sum(axis=1) / (2 * o.lambda_)
    if not (gap <= o.tolerance * np.maximum(cost, 1e-12)).all():
        return None
    weights = [(fold, f, float(x)) for fold, row in zip(chunk, w, strict=True) for f, x in zip(features, row, strict=True) if x]
    return weights, [(float(p), float(p - g)) for p, g in zip(cost, gap, strict=True)]


def sparse_vectors(features: DataFrame) -> DataFrame:
    """(case_id, i, v): features in order, and their values."""
    found = features.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("x"))
    return found.select("case_id", F.col("x.feature").cast("array<bigint>").alias("i"), F.col("x.value").cast("array<double>").alias("v"))


def train_folds(features: DataFrame, cases: DataFrame, options: SgdOptions, folds: list[int], rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Models that each leave a fold out, from cases (case_id, label, fold, rejected): weights (fold, feature, weight) and costs (fold, n, primal, dual). Both are stored.

    A fold of no training case has no weights.
    """
    spark = features.sparkSession
    own = Workspace(spark)  # of the results, which outlive this call
    with workspace(spark) as work:
        usable = cases.filter(~F.col("rejected")).join(sparse_vectors(features), "case_id", "left").select("case_id", "label", "fold", "i", "v")
        usable = work.put(usable.withColumns({"i": F.coalesce("i", F.array().cast("array<bigint>")), "v": F.coalesce("v", F.array().cast("array<double>"))}))
        counts = {r.fold: (r.n, r.s) for r in usable.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("i")).alias("s")).collect()}
        n, values = (sum(c[x] for c in counts.values()) for x in (0, 1))
        weights, costs = None, []
        for first in range(0, len(folds), WIDTH):
            chunk = [f for f in folds[first : first + WIDTH] if n > counts.get(f, (0, 0))[0]]
            if not chunk:
                continue
            own_place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in chunk]), F.col("fold")).cast("int") - 1, F.lit(-1))
            numbers = [n - counts.get(f, (0, 0))[0] for f in chunk]
            solve = {"squared": _solved, "log": _newton, "exponential": _newton}.get(options.loss)
            direct = solve(usable, options, chunk, numbers) if solve else None
            if direct is not None:
                part = own.put(spark.createDataFrame(direct[0], "fold int, feature bigint, weight double"))
                weights = part if weights is None else weights.unionByName(part)
                costs += [(f, m, p, d) for f, m, (p, d) in zip(chunk, numbers, direct[1], strict=True)]
                continue
            found, ended = _train(work, usable.select("case_id", "label", own_place.alias("own"), "i", "v"), (n, values), numbers, options, rounds)
            wide = found.select("feature", F.posexplode("w").alias("place", "weight")).filter("weight != 0")
            part = own.put(wide.select(F.element_at(F.array(*[F.lit(f) for f in chunk]), F.col("place") + 1).alias("fold"), F.col("feature"), "weight"))
            weights = part if weights is None else weights.unionByName(part)
            costs += [(f, m, p, d) for f, m, (p, d) in zip(chunk, numbers, ended, strict=True)]
    if weights is None:
        weights = spark.createDataFrame([], "fold int, feature bigint, weight double")
    return weights, spark.createDataFrame(costs, "fold int, n bigint, primal double, dual double")


def margins(features: DataFrame, cases: DataFrame, weights: DataFrame) -> DataFrame:
    """(case_id, prediction) of cases (case_id, fold) by the model that left their fold out."""
    seen = features.join(cases.select("case_id", "fold"), "case_id")
    summed = seen.join(weights, ["fold", "feature"]).groupBy("case_id").agg(F.sum(F.col("value") * F.col("weight")).alias("prediction"))
    return cases.select("case_id").join(summed, "case_id", "left").select("case_id", F.coalesce("prediction", F.lit(0.0)).alias("prediction"))


def cross_validated(features: DataFrame, cases: DataFrame, options: SgdOptions, folds: list[int]) -> DataFrame:
    """(fold, case_id, prediction, label) of cases (case_id, label, fold, rejected): each fold by the model of all others."""
    weights, _ = train_folds(features, cases, options, folds)
    found = margins(features, cases, weights)
    return cases.join(found, "case_id").select(F.col("fold").cast("int").alias("fold"), "case_id", "prediction", F.col("label").cast("double").alias("label"))


def one_versus_rest(features: DataFrame, cases: DataFrame, options: SgdOptions, folds: list[int], most: int = 1000) -> DataFrame:
    """(fold, case_id, prediction, label): the class whose model against all others has the largest margin; ties go to the smaller label."""
    classes = [r.label for r in cases.select("label").distinct().orderBy("label").limit(most + 1).collect()]
    if len(classes) > most:
        raise ValueError(f"more than {most} classes")
    found = None
    for c in classes:
        own = cross_validated(features, cases.withColumn("label", F.when(F.col("label") == c, 1.0).otherwise(-1.0)), options, folds).select("fold", "case_id", "prediction", F.lit(c).alias("class"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return cross_validated(features, cases, options, folds)
    said = found.groupBy("case_id").agg(F.max_by("class", F.struct("prediction", (-F.col("class")).alias("_c"))).alias("prediction"))
    return cases.join(said, "case_id").select(F.col("fold").cast("int").alias("fold"), "case_id", "prediction", F.col("label").cast("double").alias("label"))
