"""Kernel machines with a linear kernel over few features: the dual of all folds by an interior-point method.

The Gram matrix of a linear kernel has no higher rank than there are features, so Newton's system of the barrier problem shrinks to one row a
feature and one an equality (Fine and Scheinberg, "Efficient SVM training using low-rank kernel representations", 2001; Ferris and Munson,
"Interior-point methods for massive support vector machines", 2002). A pass over the cases sums that system, the driver solves it, and
Mehrotra's predictor and corrector take two more passes for the step. The number of steps hardly depends on the number of cases.

No case's variables are stored between passes: they follow from the steps so far, which are a few numbers a feature and fold, and a task
takes its cases through them again. What ends here is a start for ``kernel_dual``, whose measure of the optimum decides, as without it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SvmOptions
from .workspace import Workspace

#: Features up to which this is used; steps; largest product of a variable and its multiplier at the end, as a share of the tolerance; multiplier, as a share of it, from which a variable is at its bound.
FEATURES, STEPS, CLOSE, BOUND = 200, 80, 1e-7, 0.02
SUMS = "sums array<double>, least array<double>"


@dataclass
class Step:
    """Weights and offsets (folds, n) before a step, the directions of predictor and corrector, and each fold's centring and length."""

    w: np.ndarray
    nu: np.ndarray
    guess: tuple[np.ndarray, np.ndarray]
    push: np.ndarray
    way: tuple[np.ndarray, np.ndarray]
    length: np.ndarray


@dataclass
class Course:
    """What a task needs to know: coordinates, start and steps."""

    kind: str
    o: SvmOptions
    k: int
    features: np.ndarray
    centre: np.ndarray
    basis: np.ndarray
    share: np.ndarray  # (folds, sign): start of the variables as a share of their bounds
    w: np.ndarray | None = None
    nu: np.ndarray | None = None
    slack: np.ndarray | None = None  # (folds): what the multipliers start with beside the score
    steps: list[Step] = field(default_factory=list)


class Block:
    """Cases of a batch with their variables; arrays are (cases, folds, variables of a case)."""

    def __init__(self, batch: pa.RecordBatch, course: Course):
        from .kernel_dual import Dual

        self.course, n, d = course, batch.num_rows, len(course.features)
        i, v = batch.column("i"), batch.column("v")
        rows = np.repeat(np.arange(n), np.asarray(i.value_lengths().fill_null(0), np.int64))
        places = np.searchsorted(course.features, np.asarray(i.flatten(), np.int64))
        self.raw = np.bincount(rows * d + places, np.asarray(v.flatten(), float), n * d).reshape(n, d)
        self.x = (self.raw - course.centre) @ course.basis
        own, rejected = np.asarray(batch.column("own"), np.int64), np.asarray(batch.column("rejected").to_pylist(), bool)
        dual = Dual(course.kind, course.o, np.asarray(batch.column("label"), float))
        self.s, self.p, self.part, self.parts = dual.s[:, None, :], dual.p[:, None, :], dual.part, dual.parts
        self.upper = np.repeat(dual.upper[:, None, :], course.k, axis=1)
        self.train = ((own[:, None] != np.arange(course.k)) & ~rejected[:, None])[:, :, None]

    def start(self) -> None:
        self.a = self.upper * np.moveaxis(self.course.share[:, np.where(self.s[:, 0] > 0, 0, 1)], 0, 1)
        self.v = self.upper - self.a

    def of(self, nu: np.ndarray) -> np.ndarray:
        return np.moveaxis(nu[:, self.part], 0, 1)

    def slope(self, w: np.ndarray, nu: np.ndarray) -> np.ndarray:
        return self.s * ((self.x @ w.T)[:, :, None] + self.of(nu)) + self.p

    def multipliers(self) -> None:
        g, slack = self.slope(self.course.w, self.course.nu), self.course.slack[None, :, None]
        self.low, self.high = np.maximum(g, 0) + slack, np.maximum(-g, 0) + slack

    def solved(self, g, way, push=0.0, low=0.0, high=0.0):
        """Changes of the variables and both multipliers along a direction of weights and offsets."""
        a, v = self.a, self.v
        h = -g + push * (1 / a - 1 / v) + low - high
        da = (h - self.s * ((self.x @ way[0].T)[:, :, None] + self.of(way[1]))) / (self.low / a + self.high / v)
        return da, push / a - self.low - self.low / a * da + low, push / v - self.high + self.high / v * da + high

    def corrections(self, da, dlow, dhigh):
        return -da * dlow / self.a, da * dhigh / self.v

    def corrected(self, step: Step):
        g = self.slope(step.w, step.nu)
        return self.solved(g, step.way, step.push[None, :, None], *self.corrections(*self.solved(g, step.guess)))

    def follow(self, steps: list[Step]) -> None:
        self.start()
        self.multipliers()
        for step in steps:
            da, dlow, dhigh = self.corrected(step)
            length = step.length[None, :, None] * self.train
            self.a, self.v = self.a + length * da, self.v - length * da
            self.low, self.high = self.low + length * dlow, self.high + length * dhigh

    def gathered(self, u: np.ndarray) -> np.ndarray:
        """(folds, coordinates and equalities): sums of the signed values of the training variables."""
        u = np.where(self.train, self.s * u, 0.0)
        ends = [np.where(self.part[:, None, :] == e, u, 0.0).sum(axis=(0, 2)) for e in range(self.parts)]
        return np.concatenate([u.sum(axis=2).T @ self.x, np.array(ends).T], axis=1)

    def system(self, w, nu) -> np.ndarray:
        """By fold: Newton's matrix, both right sides, sums of the variables, the sum and the largest of the products, and the number of products."""
        d = np.where(self.train, 1 / (self.low / self.a + self.high / self.v), 0.0)
        g, out = self.slope(w, nu), []
        sides = [self.gathered(u) for u in (-d * g, d * (1 / self.a - 1 / self.v), self.a)]
        products = np.where(self.train, self.a * self.low, 0.0), np.where(self.train, self.v * self.high, 0.0)
        for k in range(self.course.k):
            ends = np.stack([np.where(self.part == e, d[:, k], 0.0).sum(axis=1) for e in range(self.parts)], axis=1)
            cross = self.x.T @ ends
            m = np.block([[self.x.T @ (d[:, k].sum(axis=1)[:, None] * self.x), cross], [cross.T, np.diag(ends.sum(axis=0))]])
            out.append(np.concatenate([m.ravel(), *[s[k] for s in sides], [products[0][:, k].sum() + products[1][:, k].sum(), 2 * self.train[:, k].sum() * self.s.shape[2]]]))
        return np.array(out), -np.maximum(*products).max(axis=(0, 2))

    def reach(self, da, dlow, dhigh) -> np.ndarray:
        """By fold: the longest step that leaves everything positive."""
        least = np.full(self.course.k, 1e30)
        for now, change in ((self.a, da), (self.v, -da), (self.low, dlow), (self.high, dhigh)):
            least = np.minimum(least, np.where(self.train & (change < 0), -now / np.minimum(change, -1e-300), 1e30).min(axis=(0, 2)))
        return least

    def predicted(self, w, nu, guess):
        """By fold: coefficients of the products' sum along the step, and the right side of the corrector; the longest step."""
        g = self.slope(w, nu)
        da, dlow, dhigh = self.solved(g, guess)
        low, high = self.corrections(da, dlow, dhigh)
        d = 1 / (self.low / self.a + self.high / self.v)
        powers = [np.where(self.train, x, 0.0).sum(axis=(0, 2)) for x in (self.a * dlow + da * self.low + self.v * dhigh - da * self.high, da * dlow - da * dhigh)]
        return np.concatenate([np.array(powers).T, self.gathered(d * (low - high))], axis=1), self.reach(da, dlow, dhigh)

    def ended(self, tolerance: float) -> np.ndarray:
        """The variables, at their bounds where the multipliers tell; zero where they are not trained."""
        a = np.where(self.low > tolerance, 0.0, np.where(self.high > tolerance, self.upper, np.clip(self.a, 0, self.upper)))
        return np.where(self.train, a, 0.0)


def _summed(state: DataFrame, course: Course, measure) -> tuple[np.ndarray, np.ndarray]:
    """Sums and least values over all cases of what ``measure`` gives for a block."""
    sent = state.sparkSession.sparkContext.broadcast(course)

    def run(batches):
        sums = least = None
        for batch in batches:
            if batch.num_rows:
                one, two = measure(Block(batch, sent.value))
                sums, least = (one, two) if sums is None else (sums + one, np.minimum(least, two))
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64())), pa.array([least.ravel()], pa.list_(pa.float64()))], ["sums", "least"])

    found = state.select("label", "own", "rejected", "i", "v").mapInArrow(run, SUMS).collect()
    sent.destroy()
    return np.sum([r.sums for r in found], axis=0), np.min([r.least for r in found], axis=0)


def _coordinates(state: DataFrame, course: Course) -> None:
    """Turns the features so that none is a sum of others or of a constant; lengths stay, and so do weights that are sums of cases."""
    d = len(course.features)
    none = np.zeros(1)
    sums, _ = _summed(state, course, lambda b: (np.concatenate([[len(b.raw)], b.raw.sum(axis=0)]), none))
    course.centre = sums[1:] / sums[0]
    sums, _ = _summed(state, course, lambda b: ((b.raw - b.course.centre).T @ (b.raw - b.course.centre), none))
    size, turn = np.linalg.eigh(sums.reshape(d, d))
    course.basis = turn[:, size > 1e-14 * max(size.max(), 1e-300)]


def _solve(m: np.ndarray, right: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.diag(m), 1e-300))
    m, right = m * np.outer(scale, scale), right * scale
    found = np.linalg.solve(m, right)
    return scale * (found + np.linalg.solve(m, right - m @ found))


def started(work: Workspace, state: DataFrame, kind: str, o: SvmOptions, k: int) -> DataFrame | None:
    """The state with variables at the optimum and their f, if features are few and all folds have room between the bounds."""
    found = [r.feature for r in state.select(F.explode("i").alias("feature")).distinct().orderBy("feature").limit(FEATURES + 1).collect()]
    if not found or len(found) > FEATURES:
        return None
    d, none = len(found), np.zeros(1)
    course = Course(kind, o, k, np.array(found, np.int64), np.zeros(d), np.eye(d)[:, :1], np.zeros((k, 2)))

    def masses(b: Block):
        signs = [np.where(b.train & (b.s > 0 if sign == 0 else b.s < 0), b.upper, 0.0).sum(axis=(0, 2)) for sign in (0, 1)]
        return np.stack([*signs, b.train.sum(axis=(0, 2))], axis=1), none

    counted = _summed(state, course, masses)[0].reshape(k, 3)
    bounds, trained = counted[:, :2], counted[:, 2]
    # sums of the signed variables by part, and a start in the same share of all bounds that has them
    half = {"nu_svc": o.nu * trained / 2, "nu_svr": o.c * o.nu * trained / 2}.get(kind, bounds.min(axis=1) / 2)
    if (bounds <= 0).any() or (half[:, None] >= bounds * (1 - 1e-9)).any():
        return None
    course.share = half[:, None] / bounds
    target = np.stack([half, -half], axis=1) if kind.startswith("nu") else np.zeros((k, 1))
    _coordinates(state, course)
    r = course.basis.shape[1]

    def begun(b: Block):
        b.start()
        return b.gathered(b.a), none

    course.w = _summed(state, course, begun)[0].reshape(k, -1)[:, :r]
    course.nu = np.zeros_like(target)

    def sizes(b: Block):
        return np.where(b.train, np.abs(b.slope(b.course.w, b.course.nu)), 0.0).sum(axis=(0, 2)), none

    course.slack = np.maximum(_summed(state, course, sizes)[0] / trained, 1e-3)
    w, nu = course.w, course.nu
    side, close = r + target.shape[1], o.tolerance * CLOSE * min(1.0, o.c)

    def system(b: Block):
        b.follow(b.course.steps)
        return b.system(w, nu)

    for _ in range(STEPS):
        sums, least = _summed(state, course, system)
        sums, open_ = sums.reshape(k, -1), -least > close
        if not open_.any() or not np.isfinite(sums).all():
            break
        m = sums[:, : side * side].reshape(k, side, side) + np.diag([1.0] * r + [0.0] * (side - r))
        plain, centring, now = (sums[:, side * side + j * side : side * side + (j + 1) * side] for j in range(3))
        plain = plain - np.concatenate([w - now[:, :r], target - now[:, r:]], axis=1)
        mean = sums[:, -2] / sums[:, -1]
        split = lambda x: (x[:, :r], x[:, r:])
        try:
            guess = split(np.array([_solve(m[j], plain[j]) for j in range(k)]))

            def predicted(b: Block, guess=guess):
                b.follow(b.course.steps)
                return b.predicted(w, nu, guess)

            more, reach = _summed(state, course, predicted)
            more, reach = more.reshape(k, -1), np.minimum(1, reach)
            after = (sums[:, -2] + reach * more[:, 0] + reach**2 * more[:, 1]) / sums[:, -1]
            push = np.clip(after / mean, 0, 1) ** 3 * mean
            way = split(np.array([_solve(m[j], plain[j] + push[j] * centring[j] + more[j, 2:]) for j in range(k)]))
        except np.linalg.LinAlgError:
            break
        step = Step(w, nu, guess, push, way, np.zeros(k))

        def longest(b: Block, step=step):
            b.follow(b.course.steps)
            return none, b.reach(*b.corrected(step))

        reach = _summed(state, course, longest)[1]
        step.length = np.where(open_, np.minimum(1, 0.995 * reach), 0.0)
        if not np.isfinite(step.length).all() or step.length[open_].max() < 1e-8:
            break
        course.steps.append(step)
        w, nu = w + step.length[:, None] * way[0], nu + step.length[:, None] * way[1]

    tolerance = o.tolerance * BOUND

    def weights(b: Block):
        b.follow(b.course.steps)
        return (b.s * b.ended(tolerance)).sum(axis=2).T @ b.raw, none

    whole = _summed(state, course, weights)[0].reshape(k, d)
    return work.put(_filled(state, course, whole, tolerance))


def _filled(state: DataFrame, course: Course, whole: np.ndarray, tolerance: float) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast((course, whole))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            b = Block(batch, sent.value[0])
            b.follow(b.course.steps)
            n = batch.num_rows
            for name, values in (("a", b.ended(tolerance).reshape(n, -1)), ("f", b.raw @ sent.value[1].T)):
                batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(list(values), pa.list_(pa.float64())))
            yield batch

    return state.mapInArrow(run, state.schema)
