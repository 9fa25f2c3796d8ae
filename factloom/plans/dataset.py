"""A data set: a domain, its tables and what is made of them."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KernelOptions, SessionOptions
from ..operators import cases as case_ops
from ..operators import integrity, liveness, metrics, splits, tasks
from ..operators.cache import VectorCache
from ..operators.deduce import cut, deduce, signature_counts
from ..operators.graph import Graph, build_graph
from ..operators.kernels import Kernel, ghost_features, remap
from ..operators.models import check_ability, cross_validate
from ..schema import Domain
from ..sources import sinks
from ..sources.facts import read_facts, tables_of

log = logging.getLogger("factloom")


class Timers:
    """Seconds by name."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def time(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self) -> list[tuple[str, float]]:
        return sorted(self.seconds.items())


class Dataset:
    """Attach tables or fact files to a domain; everything after is lazy until asked for."""

    def __init__(self, domain: Domain, tables: dict[str, DataFrame], options: SessionOptions | None = None, cache: str | None = None):
        """``cache`` is a shared folder: vectors of cases whose part of the graph has not changed are taken from there."""
        self.cache = cache
        self.domain, self.given, self.options, self.timers = domain, tables, options or SessionOptions(), Timers()
        with self.timers.time("plan"):
            repaired = integrity.check_and_repair(domain, deduce(domain, tables, keep=True), self.options.referential_integrity_repair)
        self.tables = repaired
        if self.options.check_duplicate_ids and not integrity.duplicate_ids(domain, repaired).isEmpty():
            raise ValueError("an entity occurs twice")
        self._graph: Graph | None = None

    @classmethod
    def attach(cls, spark: SparkSession, domain: Domain, paths: str | list[str], helpers: dict[str, tuple[str, ...]] | None = None, options: SessionOptions | None = None) -> Dataset:
        from ..sources.facts import helper_table

        facts = read_facts(spark, paths)
        tables = tables_of(domain, facts) | {n: helper_table(facts, n, *columns) for n, columns in (helpers or {}).items()}
        return cls(domain, tables, options)

    def detach(self) -> None:
        if self._graph is not None:
            self._graph.unpersist()
            self._graph = None

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = build_graph(self.domain, self.tables)
        return self._graph

    def interpretations(self) -> DataFrame:
        return self.tables[self.domain.entities[0]].select("ex").distinct()

    def counts(self) -> DataFrame:
        return signature_counts({n: self.tables[n] for n in self.domain.signatures})

    def cases(self, target: str, reject=None) -> DataFrame:
        found = case_ops.candidates(self.domain, self.tables, target)
        return case_ops.reject(case_ops.existence_labels(self.domain, self.tables, target, found), reject)

    def features(self, target: str, cases: DataFrame, options: KernelOptions) -> DataFrame:
        """Vectors of the cases; the target and all that tells of it are dead."""
        liveness.check_target(self.domain, target)
        killed = sorted(liveness.dependents(self.domain, target) - set(self.domain.entities))
        log.info("dead for %s: %s", target, killed)
        graph = self.graph.kill(killed)
        found = VectorCache(cases.sparkSession, f"{self.cache}/{target}").features(graph, cases, options) if self.cache else Kernel(graph, options).features(cases)
        for name in sorted(self.domain.signatures):
            s = self.domain.signatures[name]
            if s.ghost and s.property_columns and s.references == self.domain.signatures[target].references:
                found = ghost_features(found, self._ghosts(name, target), name, options.hash_bit_mask)
        return found

    def _ghosts(self, name: str, target: str) -> DataFrame:
        """(case_id, place, value): the properties of ghost rows that hold the identifiers of a case."""
        s = self.domain.signatures[name]
        case = F.concat_ws("/", F.col("ex").cast("string"), F.lit(target), *[F.col(c.name).cast("string") for c in s.id_columns])
        values = F.array(*[F.struct(F.lit(k).alias("place"), F.col(c.name).cast("double").alias("value")) for k, c in enumerate(s.property_columns, 1)])
        return self.tables[name].select(case.alias("case_id"), F.explode(values).alias("x")).select("case_id", "x.place", "x.value")

    def generate_all(self, target: str, options: KernelOptions, path: str) -> None:
        """Writes the vectors of all cases, features numbered from 1, as libsvm lines."""
        cases = self.cases(target)
        sinks.libsvm_lines(remap(self.features(target, cases, options)), cases).select("value").write.text(path)

    def split(self, target: str, parts: DataFrame, kernel: KernelOptions, model: str, **options) -> DataFrame:
        """Predictions for the ``test`` part of (ex, part) by a model of the ``train`` part."""
        return self.kfold(target, 2, kernel, model, folds=parts.select("ex", F.when(F.col("part") == "test", 0).otherwise(1).alias("fold")), **options).filter("fold = 0")

    def induce(self, preds: DataFrame, path: str) -> None:
        """Writes the facts that predictions above the threshold induce, ready to be attached again."""
        sinks.induced_lines(metrics.induced(preds, self.options.pthreshold)).write.text(path)

    def tasks(self, target: str) -> list[tasks.Task]:
        """What there is to learn of a target: each of its properties, or whether its tuples exist."""
        return tasks.tasks(self.domain, self.tables, target)

    def kfold(self, target: str, k: int, kernel: KernelOptions, model: str | None = None, reject=None, folds: DataFrame | None = None, column: str | None = None, **options) -> DataFrame:
        """Predictions of a k-fold cross-validation over interpretations; ``column`` names the property where a target has several."""
        found = [t for t in self.tasks(target) if column in (None, t.column)]
        if len(found) != 1:
            raise ValueError(f"{target} has the tasks {[t.column for t in self.tasks(target)]}; column={column!r} names {'none' if not found else 'several'}")
        return self.kfold_tasks(target, k, kernel, {found[0].kind: model} if model else None, reject, folds, found, **options)[found[0].column]

    def kfold_tasks(self, target: str, k: int, kernel: KernelOptions, models: dict[str, str] | None = None, reject=None, folds: DataFrame | None = None, chosen: list[tasks.Task] | None = None, **options) -> dict[str, DataFrame]:
        """Predictions for each task of a target by its column; ``models`` names the model of a kind. All tasks share one table of features."""
        chosen = chosen if chosen is not None else self.tasks(target)
        named = {t.column: (models or {}).get(t.kind, tasks.MODELS[t.kind]) for t in chosen}
        for t in chosen:
            check_ability(named[t.column], t.kind, **options)
        cases = cut(case_ops.candidates(self.domain, self.tables, target))
        labels = {t.column: cut(case_ops.reject(tasks.labelled(self.domain, self.tables, t, cases), reject)) for t in chosen}
        # features of cases that have a label in some task
        wanted = cases if not all(t.column for t in chosen) else cases.join(reduce(DataFrame.union, [rows.select("case_id") for rows in labels.values()]).distinct(), "case_id", "left_semi")
        features = self.features(target, wanted, kernel)
        features = cut(features) if len(chosen) > 1 else features
        folds = folds if folds is not None else self.folds(k)
        return {t.column: cross_validate(features, labels[t.column], folds, named[t.column], **options) for t in chosen}

    def folds(self, k: int) -> DataFrame:
        return splits.kfold(self.interpretations(), k, self.options.kfold_random_seed)

    def write_results(self, preds: DataFrame, task: tasks.Task, folds: DataFrame, path: str) -> None:
        """Predictions with class names, target lists and evaluations as files a fold."""
        tasks.write_results(preds, task, folds, path)
