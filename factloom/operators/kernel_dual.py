"""Kernel machines of all folds over any number of cases: the dual is decomposed into bounded working sets.

Decomposition of support-vector training (Osuna, Freund and Girosi, 1997; Joachims, "Making large-scale SVM learning practical", 1999). Every
case carries its dual variables and, for each fold, the value f of that fold's expansion at the case. In a turn the variables that
violate the optimality conditions most are drawn from all cases (a top-q of every task, then of these), their small dual is solved with
all others fixed, one task a fold, and one pass over the cases adds the changes to f: each task computes the block of the Gram matrix
of its own cases against the working set, in pieces, and keeps none of it. Cases of a fold never move in its own column, but their f
does, so the predictions of a cross-validation are there when the turns end, and no set of support vectors is sent anywhere.

Turns end when no two variables of a group violate the conditions by ``tolerance``, the measure of ``solve_dual``; ``turns`` without that is an
error. A working set has ``WORKING`` variables a side, fewer if vectors are long (VALUES bounds what is sent to tasks), and at least one.

With a linear kernel over few features, ``interior`` starts the turns at the optimum, so that the first one only confirms it.

A precomputed kernel is a table of pairs: ``gram_rows`` makes each case's row of the Gram matrix its vector, and a dot product with
the unit vector of another case is their kernel value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SvmOptions
from . import interior
from .deduce import cut
from .linear import WIDTH, sparse_vectors
from .workspace import Workspace, workspace

#: Variables of a working set a side; values of all working sets of a turn; cells of a Gram piece; cases a task starts with.
WORKING, VALUES, CELLS, CASES = 500, 2_000_000, 4_000_000, 20_000
CASE, CANDIDATE, FREE = 0, 1, 2

STATE = pa.schema([("kind", pa.int32()), ("case_id", pa.string()), ("label", pa.float64()), ("own", pa.int32()), ("rejected", pa.bool_()), ("i", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())), ("a", pa.list_(pa.float64())), ("f", pa.list_(pa.float64())), ("fold", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("score", pa.float64()), ("n", pa.int64())])
STATE_DDL = "kind int, case_id string, label double, own int, rejected boolean, i array<bigint>, v array<double>, a array<double>, f array<double>, fold int, part int, side int, score double, n bigint"


class Dual:
    """The dual of one kind (c_svc, nu_svc, eps_svr, nu_svr): signs, bounds and linear terms of the variables of cases with labels y.

    Arrays are (cases, variables of a case): a classifier has one variable a case, a regressor one for each side of the tube.
    """

    def __init__(self, kind: str, o: SvmOptions, y: np.ndarray):
        self.kind, self.o = kind, o
        if kind.endswith("svc"):
            self.s = np.where(y > 0, 1.0, -1.0)[:, None]
            self.upper = o.c * np.where(self.s > 0, o.wp, o.wn) if kind == "c_svc" else np.ones_like(self.s)
            self.p = np.full_like(self.s, -1.0 if kind == "c_svc" else 0.0)
        else:
            self.s = np.tile([1.0, -1.0], (len(y), 1))
            self.upper = np.full_like(self.s, o.c)
            self.p = (o.epsilon_tube if kind == "eps_svr" else 0.0) - self.s * y[:, None]
        #: Variables move in pairs of one part: all, or those of one sign.
        self.part = np.where(self.s > 0, 0, 1) if kind.startswith("nu") else np.zeros(self.s.shape, int)

    @property
    def parts(self) -> int:
        return 2 if self.kind.startswith("nu") else 1

    def score(self, f: np.ndarray) -> np.ndarray:
        """Minus the sign times the gradient."""
        return -f[:, None] - self.s * self.p

    def room(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the signed variable can grow, and where it can shrink."""
        below, above = a < self.upper, a > 0
        return np.where(self.s > 0, below, above), np.where(self.s > 0, above, below)

    def solve(self, k: np.ndarray, a: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The best variables of these cases with all others fixed; ``k`` is their Gram matrix."""
        from .models import solve_dual

        s, start = self.s.T.ravel(), a.T.ravel()
        q = np.tile(k, (a.shape[1], a.shape[1])) * np.outer(s, s)
        p = s * np.tile(f, a.shape[1]) + self.p.T.ravel() - q @ start
        found, _ = solve_dual(q, p, s, self.upper.T.ravel(), start, self.o.tolerance / 2, self.parts == 2)
        return found.reshape(a.shape[1], -1).T


class Against:
    """Kernel values of given cases against fixed ones, by the postings of their features."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], o: SvmOptions):
        self.o, self.size = o, len(rows)
        features = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        owners = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        values = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        order = np.argsort(features, kind="stable")
        self.owners, self.values = owners[order], values[order]
        self.features, self.starts, self.counts = np.unique(features[order], return_index=True, return_counts=True)
        self.norms = np.array([v @ v for _, v in rows])

    def _dots(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        features = np.concatenate([r[0] for r in rows])
        mine = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        values = np.concatenate([r[1] for r in rows])
        at = np.searchsorted(self.features, features)
        hit = np.flatnonzero(at < len(self.features))
        hit = hit[self.features[at[hit]] == features[hit]]
        counts = self.counts[at[hit]]
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.starts[at[hit]], counts)
        cells = np.repeat(mine[hit], counts) * self.size + self.owners[place]
        return np.bincount(cells, np.repeat(values[hit], counts) * self.values[place], len(rows) * self.size).reshape(len(rows), self.size)

    def gram(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        dot, o = self._dots(rows), self.o
        if o.kernel == "poly":
            return (o.gamma * dot + o.coef0) ** o.degree
        if o.kernel == "sigmoid":
            return np.tanh(o.gamma * dot + o.coef0)
        if o.kernel == "rbf":
            return np.exp(-o.gamma * (np.array([v @ v for _, v in rows])[:, None] + self.norms[None, :] - 2 * dot))
        return dot

    def expanded(self, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
        """(rows, columns of weights): sums of kernel values by weight, over pieces of at most CELLS cells or one row."""
        out = np.zeros((len(rows), weights.shape[1]))
        first = 0
        while first < len(rows):
            last, cells = first, 0
            while last < len(rows) and (last == first or cells + self.size * (1 + len(rows[last][0])) <= CELLS):
                cells += self.size * (1 + len(rows[last][0]))
                last += 1
            out[first:last] = self.gram(rows[first:last]) @ weights
            first = last
        return out


def _pair(i, v) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray([] if i is None else i, np.int64), np.asarray([] if v is None else v, float)


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in STATE], schema=STATE)


def _turn(state: DataFrame, kind: str, o: SvmOptions, k: int, width: int, change) -> DataFrame:
    """Cases with the changes added (``change``: a broadcast list of (case_id, i, v, coefficients, variables), or None), the variables of each
    task that violate most on either side, and sums of the scores of free variables."""

    def run(batches):
        moved = change.value if change is not None else []
        against = Against([_pair(i, v) for _, i, v, _, _ in moved], o)
        weights = np.array([w for *_, w, _ in moved], float).reshape(len(moved), k)
        fresh = {c: np.asarray(a, float) for c, *_, a in moved}
        best: dict[tuple[int, int, int], list[tuple[float, str]]] = {}
        free: dict[tuple[int, int], list[float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            d = {c: batch.column(c).to_pylist() for c in ("case_id", "label", "own", "rejected", "i", "v", "a", "f")}
            ids, y, own = d["case_id"], np.array(d["label"], float), np.array(d["own"])
            a = np.array([fresh.get(c, old) for c, old in zip(ids, d["a"], strict=True)], float).reshape(len(ids), k, -1)
            f = np.array(d["f"], float).reshape(len(ids), k)
            if moved:
                f = f + against.expanded([_pair(i, v) for i, v in zip(d["i"], d["v"], strict=True)], weights)
            dual, rejected = Dual(kind, o, y), np.array(d["rejected"], bool)
            for fold in range(k):
                train = ((own != fold) & ~rejected)[:, None]
                score, (up, down) = dual.score(f[:, fold]), dual.room(a[:, fold])
                loose = train & (a[:, fold] > 1e-12) & (a[:, fold] < dual.upper - 1e-12)
                for part in range(dual.parts):
                    chosen = dual.part == part
                    total = free.setdefault((fold, part), [0, 0.0])
                    total[0] += int((loose & chosen).sum())
                    total[1] += float(score[loose & chosen].sum())
                    for side, mask, sign in ((0, up, 1.0), (1, down, -1.0)):
                        rows, cols = np.nonzero(mask & chosen & train)
                        found = sign * score[rows, cols]
                        order = np.argsort(-found, kind="stable")[: 2 * width]
                        merged = best.get((fold, part, side), []) + [(float(found[j]), ids[rows[j]]) for j in order]
                        best[fold, part, side] = sorted(merged, key=lambda x: (-x[0], x[1]))[:width]
            yield _batch(len(ids), kind=[CASE] * len(ids), a=list(a.reshape(len(ids), -1)), f=list(f), **{c: batch.column(c) for c in ("case_id", "label", "own", "rejected", "i", "v")})
        for (fold, part, side), rows in best.items():
            yield _batch(len(rows), kind=[CANDIDATE] * len(rows), case_id=[c for _, c in rows], score=[x for x, _ in rows], fold=[fold] * len(rows), part=[part] * len(rows), side=[side] * len(rows))
        for (fold, part), (n, total) in free.items():
            yield _batch(1, kind=[FREE], fold=[fold], part=[part], n=[n], score=[total])

    return state.select("case_id", "label", "own", "rejected", "i", "v", "a", "f").mapInArrow(run, STATE_DDL)


def _drawn(done: DataFrame, width: int) -> dict[tuple[int, int, int], list[tuple[float, str]]]:
    """By fold, part and side, the ``width`` variables that violate most over all tasks; scores of side 1 have their sign turned."""
    order = Window.partitionBy("fold", "part", "side").orderBy(F.desc("score"), "case_id")
    top = done.filter(F.col("kind") == CANDIDATE).select("fold", "part", "side", "score", "case_id", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= width)
    found: dict[tuple[int, int, int], list[tuple[float, str]]] = {}
    for r in top.collect():
        found.setdefault((r.fold, r.part, r.side), []).append((r.score, r.case_id))
    return found


def _within(rows: DataFrame, numbers: np.ndarray) -> DataFrame:
    """Rows of a Gram matrix (i, v) cut to the columns of these cases."""

    def run(batches):
        for batch in batches:
            cut = []
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), strict=True):
                i, v = _pair(i, v)
                kept = np.isin(i, numbers)
                cut.append((i[kept], v[kept]))
            for name, values, kind in (("i", [c[0] for c in cut], pa.list_(pa.int64())), ("v", [c[1] for c in cut], pa.list_(pa.float64()))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(values, kind))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def _solved(spark, state: DataFrame, kind: str, o: SvmOptions, k: int, sets: dict[int, list[str]]) -> list[tuple]:
    """Changes of the working sets (case ids by fold), one task a fold: (case_id, i, v, coefficients by fold, all variables of the case)."""
    ids = spark.createDataFrame([(f, c) for f, cs in sets.items() for c in cs], "fold int, case_id string")
    rows = state.select("case_id", "label", "i", "v", "a", "f").join(F.broadcast(ids), "case_id").withColumn("number", F.xxhash64("case_id"))
    if o.kernel == "precomputed":
        rows = _within(rows, np.array([r.number for r in ids.select(F.xxhash64("case_id").alias("number")).distinct().collect()], np.int64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("case_id")
        fold = int(pdf.fold.iloc[0])
        vectors = [_pair(i, v) for i, v in zip(pdf.i, pdf.v, strict=True)]
        a = np.array([np.asarray(x, float).reshape(k, -1)[fold] for x in pdf.a])
        f = np.array([x[fold] for x in pdf.f], float)
        units = [(np.array([n], np.int64), np.ones(1)) for n in pdf.number] if o.kernel == "precomputed" else vectors
        dual = Dual(kind, o, pdf.label.to_numpy(float))
        new = dual.solve(Against(units, o).gram(vectors), a, f)
        out = pd.DataFrame({"fold": fold, "case_id": pdf.case_id.to_numpy(), "i": [u[0] for u in units], "v": [u[1] for u in units], "w": ((new - a) * dual.s).sum(axis=1), "new": list(new)})
        return out[(new != a).any(axis=1)]

    found: dict[str, list] = {}
    for r in rows.groupBy("fold").applyInPandas(run, "fold int, case_id string, i array<bigint>, v array<double>, w double, new array<double>").collect():
        entry = found.setdefault(r.case_id, [r.i, r.v, [0.0] * k, {}])
        entry[2][r.fold] = r.w
        entry[3][r.fold] = list(r.new)
    if not found:
        return []
    before = {r.case_id: list(r.a) for r in state.select("case_id", "a").join(F.broadcast(spark.createDataFrame([(c,) for c in found], "case_id string")), "case_id").collect()}
    out = []
    for case, (i, v, w, new) in found.items():
        a = np.array(before[case], float).reshape(k, -1)
        for fold, values in new.items():
            a[fold] = values
        out.append((case, i, v, w, a.ravel().tolist()))
    return out


def _start(rows: DataFrame, kind: str, o: SvmOptions, k: int) -> tuple[DataFrame, bool]:
    """State with feasible variables, and whether f must be filled in. Those of the nu forms start alike in all cases of a part."""
    if kind in ("c_svc", "eps_svr"):
        return rows.withColumn("a", F.array_repeat(F.lit(0.0), k * (1 if kind == "c_svc" else 2))), False
    if kind == "nu_svr":
        return rows.withColumn("a", F.array_repeat(F.lit(o.c * o.nu / 2), 2 * k)), False
    positive, shares = F.col("label") > 0, []
    trained = lambda f, sign: F.sum(((F.col("own") != f) & ~F.col("rejected") & (positive if sign else ~positive)).cast("long"))
    counts = rows.agg(*[trained(f, s).alias(f"n{f}_{s}") for f in range(k) for s in (0, 1)]).first()
    for f in range(k):
        half = [o.nu * ((counts[f"n{f}_0"] or 0) + (counts[f"n{f}_1"] or 0)) / 2 / max(counts[f"n{f}_{s}"] or 0, 1e-12) for s in (0, 1)]
        if max(half) > 1 + 1e-9:
            raise ValueError("nu is infeasible")
        shares.append(F.when((F.col("own") == f) | F.col("rejected"), 0.0).when(positive, min(1.0, half[1])).otherwise(min(1.0, half[0])))
    return rows.withColumn("a", F.array(*shares)), True


def _filled(work: Workspace, state: DataFrame, n: int, kind: str, o: SvmOptions, k: int, width: int) -> DataFrame:
    """f of variables that do not start at zero: the cases are added in blocks of about a working set."""
    blocks, sc = -(-n // width), work.spark.sparkContext
    for b in range(blocks):
        cut = state.filter(F.pmod(F.hash("case_id"), F.lit(blocks)) == b).select("case_id", "label", "i", "v", "a", F.xxhash64("case_id").alias("number")).collect()
        sign = lambda r: 1.0 if r.label > 0 else -1.0
        moved = [(r.case_id, *(([r.number], [1.0]) if o.kernel == "precomputed" else (r.i, r.v)), [sign(r) * x for x in r.a], list(r.a)) for r in cut]
        sent = sc.broadcast(moved)
        newer = work.put(_turn(state, kind, o, k, width, sent).filter(F.col("kind") == CASE))
        sent.destroy()
        work.drop(state)
        state = newer
    return state


def _trained(work: Workspace, rows: DataFrame, kind: str, o: SvmOptions, k: int, turns: int) -> tuple[DataFrame, list[tuple[float, float]]]:
    """The state at the optimum, and each fold's (offset, factor): a prediction is (f + offset) * factor."""
    sc = work.spark.sparkContext
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("i"))).first()
    longest = 1 if o.kernel == "precomputed" else max(1, longest or 1)
    parts = 2 if kind.startswith("nu") else 1
    width = max(1, min(WORKING, VALUES // (2 * parts * k * longest)))
    tasks = max(sc.defaultParallelism, -(-n // CASES))
    state, fill = _start(rows.withColumn("f", F.array_repeat(F.lit(0.0), k)), kind, o, k)
    state = work.put(state.repartition(tasks, "case_id"))
    near = interior.started(work, state, kind, o, k) if o.kernel == "linear" and n else None
    if near is not None:
        work.drop(state)
        state = near
    elif fill:
        state = _filled(work, state, n, kind, o, k, width)
    sent = None
    for _ in range(turns):
        done = work.put(_turn(state, kind, o, k, width, sent))
        if sent is not None:
            sent.destroy()
        work.drop(state)
        state = done.filter(F.col("kind") == CASE)
        state._at = done._at
        top = _drawn(done, width)
        edge = lambda f, p, side: max((x for x, _ in top.get((f, p, side), [])), default=-1e30)
        sets: dict[int, list[str]] = {}
        for f in range(k):
            for p in range(parts):
                up, down = edge(f, p, 0), edge(f, p, 1)
                if up > -1e30 and down > -1e30 and up + down >= o.tolerance:
                    chosen = [c for x, c in top[f, p, 0] if x + down > 0] + [c for x, c in top[f, p, 1] if x + up > 0]
                    sets[f] = list(dict.fromkeys(sets.get(f, []) + chosen))
        if not sets:
            means = {(r.fold, r.part): (r.n, r.s) for r in done.filter(F.col("kind") == FREE).groupBy("fold", "part").agg(F.sum("n").alias("n"), F.sum("score").alias("s")).collect()}
            ends = []
            for f in range(k):
                offsets = []
                for p in range(parts):
                    count, total = means.get((f, p), (0, 0.0))
                    offsets.append(total / count if count else (edge(f, p, 0) - edge(f, p, 1)) / 2)
                rho = (offsets[-1] - offsets[0]) / 2 if kind == "nu_svc" else 0.0
                ends.append((sum(offsets) / len(offsets), 1 / rho if rho else 1.0))
            return state, ends
        sent = sc.broadcast(_solved(work.spark, state, kind, o, k, sets))
    raise RuntimeError(f"no solution within {o.tolerance} after {turns} turns")


def cross_validated(features: DataFrame, cases: DataFrame, kind: str, options: SvmOptions, folds: list[int], turns: int = 10_000) -> DataFrame:
    """(fold, case_id, prediction, label) of cases (case_id, label, fold, rejected): each fold by the machine of all others.

    Cases without a feature are rows of zeros; repeated case ids are an error of the caller. The result is stored and outlives the call.
    """
    spark = features.sparkSession
    own, found = Workspace(spark), None
    with workspace(spark) as work:
        usable = work.put(cases.join(sparse_vectors(features), "case_id", "left").select("case_id", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"), "rejected", F.coalesce("i", F.array().cast("array<bigint>")).alias("i"), F.coalesce("v", F.array().cast("array<double>")).alias("v")))
        for first in range(0, len(folds), WIDTH):
            chunk = folds[first : first + WIDTH]
            place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in chunk]), F.col("fold")).cast("int") - 1, F.lit(-1))
            state, ends = _trained(work, usable.withColumn("own", place).drop("fold"), kind, options, len(chunk), turns)
            at = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("own"))
            said = (F.get("f", F.col("own")) + at([b for b, _ in ends])) * at([m for _, m in ends])
            part = own.put(state.filter("own >= 0").select(F.get(F.array(*[F.lit(f) for f in chunk]), F.col("own")).alias("fold"), "case_id", said.alias("prediction"), "label"))
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "fold int, case_id string, prediction double, label double")


def one_versus_one(features: DataFrame, cases: DataFrame, options: SvmOptions, folds: list[int]) -> DataFrame:
    """(fold, case_id, prediction, label) of cases (case_id, label, fold, rejected): classes by votes of machines for each two, all folds of two classes together.

    Ties go to the class met first among a fold's training cases, in order of case ids. That class is also the positive one of a machine, so folds
    that met two classes in different orders train apart.
    """
    spark, features, cases = features.sparkSession, cut(features), cut(cases.withColumn("label", F.col("label").cast("double")))
    met = cases.filter(~F.col("rejected")).groupBy("fold", "label").agg(F.min("case_id").alias("first")).collect()
    tested = {r.fold for r in cases.select("fold").distinct().collect()}
    ranks, chosen = [], {}
    for fold in [f for f in folds if f in tested]:
        first: dict[float, str] = {}
        for r in met:
            if r.fold != fold:
                first[r.label] = min(first.get(r.label, r.first), r.first)
        if not first:
            raise ValueError(f"no training case for fold {fold}")
        order = sorted(first, key=lambda c: first[c])
        ranks += [(fold, c, k) for k, c in enumerate(order)]
        for k, a in enumerate(order):
            for b in order[k + 1 :]:
                chosen.setdefault((a, b), []).append(fold)
    votes = spark.createDataFrame([], "case_id string, class double")
    for (a, b), own in sorted(chosen.items()):
        two = cases.select("case_id", F.when(F.col("label") == a, 1.0).otherwise(-1.0).alias("label"), "fold", (F.col("rejected") | ~F.col("label").isin(a, b)).alias("rejected"))
        won = cross_validated(features, two, "c_svc", options, own)
        votes = votes.unionByName(won.select("case_id", F.when(F.col("prediction") > 0, a).otherwise(b).alias("class")))
    counted = votes.groupBy("case_id", "class").agg(F.count(F.lit(1)).alias("n"))
    standing = cases.select("case_id", "fold").join(spark.createDataFrame(ranks, "fold int, class double, rank int"), "fold").join(counted, ["case_id", "class"], "left")
    said = standing.groupBy("case_id").agg(F.max_by("class", F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.col("rank")).alias("rank"))).alias("prediction"))
    return cases.join(said, "case_id").select("fold", "case_id", "prediction", "label")


def gram_rows(pairs: DataFrame) -> DataFrame:
    """Features (case_id, feature, value) of a precomputed kernel, from pairs (a, b, value) with both orders and the diagonal; absent pairs are 0.

    Two case ids with one 64-bit number are refused.
    """
    clash = pairs.select("b").distinct().groupBy(F.xxhash64("b").alias("n")).count().filter("count > 1").limit(1).count()
    if clash:
        raise ValueError("two case ids have one number")
    return pairs.select(F.col("a").alias("case_id"), F.xxhash64("b").alias("feature"), F.col("value").cast("double").alias("value"))
