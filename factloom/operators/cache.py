"""Fingerprints of graphs and of what each case sees of one, and vectors stored under them.

A vector depends on the living graph within reach of the case's viewpoints and on the kernel's options, so their fingerprint is its key: after
a change only cases whose key changed are computed again. A fingerprint adds up 52-bit parts of the digests of all
vertices and edges, so it is a combinable sum, the same in whatever order and partitions rows come; two independent
parts and the counts make it 104 bits wide.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KernelOptions
from .deduce import EX, cut
from .graph import Graph
from .kernels import Kernel, inside
from .paths import distances
from .workspace import Workspace, delete, exists, workspace

#: Between the fields of a text, and for a null: neither occurs in identifiers.
FIELD, NULL = "\x1f", "\x00"


def _text(*fields: Column) -> Column:
    return F.concat_ws(FIELD, *[F.coalesce(f.cast("string"), F.lit(NULL)) for f in fields])


def vertex_text(v: DataFrame) -> Column:
    """All of a vertex that a kernel reads."""
    return _text(v["vid"], v["sig"], v["kind"], v["is_kp"], F.concat_ws(",", v["syms"]), F.concat_ws(",", F.transform(v["nums"], lambda x: F.coalesce(x.cast("string"), F.lit(NULL)))))


def edge_text(e: DataFrame) -> Column:
    return _text(e["src"], e["dst"], e["role"])


def _part(text: Column, which: int) -> Column:
    """52 bits of a text's digest."""
    return F.conv(F.substring(F.md5(text), 1 + 13 * which, 13), 16, 10).cast("decimal(38,0)")


def _summed(texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, low, high) of rows (by, text)."""
    return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(_part(F.col("text"), 0)).alias("low"), F.sum(_part(F.col("text"), 1)).alias("high"))


def graph_fingerprints(graph: Graph) -> DataFrame:
    """(ex, n, fingerprint): one row an interpretation; ``n`` counts its living vertices and the ends of edges."""
    g = graph.living()
    texts = g.vertices.select(EX, vertex_text(g.vertices).alias("text")).unionByName(g.edges.select(EX, edge_text(g.edges).alias("text")))
    return _summed(texts, [EX]).select(EX, "n", _text(F.col("n"), F.col("low"), F.col("high")).alias("_t")).select(EX, "n", F.md5("_t").alias("fingerprint"))


def reach(options: KernelOptions) -> int:
    """How far from its viewpoints a case's vector can see."""
    if options.variant == "anspdk":  # distances within a ball may lead outside it
        return options.distance + options.radius + max(options.radius, options.distance)
    return options.distance + options.radius


def case_fingerprints(graph: Graph, cases: DataFrame, options: KernelOptions) -> DataFrame:
    """(case_id, fingerprint) of cases (ex, case_id, viewpoints): the part of the graph that each sees; without viewpoints that is all of it.

    A case sees vertices within the kernel's distance, and the ball of each as far as its radius reaches.
    """
    g = graph.living()
    views = cases.filter("viewpoints is not null").select(EX, "case_id", F.explode("viewpoints").alias("view"))
    near = cut(views.join(distances(g, options.distance, views.select(EX, F.col("view").alias("vid")).distinct()).withColumnsRenamed({"src": "view", "dst": "at"}), [EX, "view"]))
    # the ball of a vertex is read once, for all cases that see it
    balls = distances(g, reach(options) - options.distance, near.select(EX, F.col("at").alias("vid")).distinct()).select(EX, F.col("src").alias("at"), F.col("dst").alias("vid"))
    balls = cut(balls)
    vertices = balls.join(g.vertices, [EX, "vid"])
    ends = inside(g.edges.withColumnRenamed(EX, "g"), balls.withColumnRenamed(EX, "g"), "at").select(F.col("g").alias(EX), "at", F.col("i").alias("src"), F.col("j").alias("dst"), "role")
    held = _summed(vertices.select(EX, "at", vertex_text(vertices).alias("text")).union(ends.select(EX, "at", edge_text(ends).alias("text"))), [EX, "at"])
    held = held.select(EX, "at", _text(F.col("n"), F.col("low"), F.col("high")).alias("held"))
    seen = near.join(held, [EX, "at"]).select("case_id", _text(F.lit("at"), F.col("view"), F.col("at"), F.col("d"), F.col("held")).alias("text"))
    marks = views.select("case_id", _text(F.lit("view"), F.col("view")).alias("text"))  # what the case looks from counts as well
    own = _summed(seen.union(marks), ["case_id"]).select("case_id", _text(F.col("n"), F.col("low"), F.col("high")).alias("_t"))
    whole = cases.filter("viewpoints is null").select("case_id", EX).join(graph_fingerprints(g).select(EX, "fingerprint"), EX, "left").select("case_id", _text(F.lit("all"), F.col("fingerprint")).alias("_t"))
    every = cases.select("case_id").distinct().join(own.union(whole), "case_id", "left")
    return every.select("case_id", F.md5(F.concat_ws(FIELD, F.lit(json.dumps(asdict(options), sort_keys=True)), F.coalesce("_t", F.lit(NULL)))).alias("fingerprint"))


class VectorCache:
    """Vectors (case_id, feature, value) under a folder that the driver and all executors share.

    A folder ``vectors-<id>`` holds the rows of one state, ``keys-<id>`` the fingerprints of its cases; ``current`` names the
    state. A state is written whole before it becomes the current one, and the one before is deleted after that, so a
    run that dies leaves the cache as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Cases computed, and taken from the cache, by the last call of ``features``.
        self.computed = self.reused = 0

    def _state(self) -> str | None:
        marker = f"{self.path}/current"
        return self.spark.read.text(marker).first()[0] if exists(self.spark, marker) else None

    def _read(self, state: str) -> tuple[DataFrame, DataFrame]:
        return (
            self.spark.read.schema("case_id string, fingerprint string").parquet(f"{self.path}/keys-{state}"),
            self.spark.read.schema("case_id string, feature bigint, value double").parquet(f"{self.path}/vectors-{state}"),
        )

    def features(self, graph: Graph, cases: DataFrame, options: KernelOptions) -> DataFrame:
        """The vectors of the cases, computed where none is stored under their fingerprints. Afterwards the cache holds just these."""
        with workspace(self.spark) as work:
            now = work.put(case_fingerprints(graph, cases, options))
            before = self._state()
            fresh, kept = now.select("case_id"), None
            if before is not None:
                keys, vectors = self._read(before)
                known = work.put(now.join(keys, ["case_id", "fingerprint"], "left_semi").select("case_id"))
                fresh = now.join(known, "case_id", "left_anti").select("case_id")
                kept = vectors.join(known, "case_id", "left_semi")
                self.reused = known.count()
            else:
                self.reused = 0
            self.computed = now.count() - self.reused
            return self._write(work, graph, cases, options, now, fresh, kept, before)

    def _write(self, work: Workspace, graph: Graph, cases: DataFrame, options: KernelOptions, now: DataFrame, fresh: DataFrame, kept: DataFrame | None, before: str | None) -> DataFrame:
        if before is not None and not self.computed and self._read(before)[0].count() == self.reused:
            return self._read(before)[1]  # nothing came, nothing went
        rows = kept
        if self.computed:
            made = Kernel(graph, options).features(cases.join(fresh, "case_id", "left_semi")).select("case_id", F.col("feature").cast("bigint").alias("feature"), F.col("value").cast("double").alias("value"))
            rows = made if kept is None else kept.unionByName(made)
        elif rows is None:
            rows = self.spark.createDataFrame([], "case_id string, feature bigint, value double")
        state = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/vectors-{state}")
        now.write.parquet(f"{self.path}/keys-{state}")
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        if before is not None:
            self._drop(before)
        return self._read(state)[1]

    def _drop(self, state: str) -> None:
        for what in ("vectors", "keys"):
            delete(self.spark, f"{self.path}/{what}-{state}")

    def clear(self) -> None:
        delete(self.spark, self.path)


# -- graphs as files ---------------------------------------------------------------------------------------------------------


def save_graph(graph: Graph, path: str) -> None:
    """Writes vertices, edges and fingerprints, the last in the end: a folder without them isn't a whole graph."""
    graph.vertices.write.parquet(f"{path}/vertices")
    graph.edges.write.parquet(f"{path}/edges")
    load = graph.vertices.sparkSession.read.parquet
    graph_fingerprints(Graph(load(f"{path}/vertices"), load(f"{path}/edges"))).write.parquet(f"{path}/fingerprints")


def load_graph(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """The graph that ``save_graph`` wrote; raises if it isn't the one whose fingerprints lie beside it."""
    graph = Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
    if check:
        told = spark.read.parquet(f"{path}/fingerprints")
        if changed := changed_interpretations(told, graph_fingerprints(graph)).limit(5).collect():
            raise ValueError(f"{path}: interpretations {[r[0] for r in changed]} are not what was saved")
    return graph


def changed_interpretations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ex): interpretations whose fingerprints (ex, fingerprint) differ, or that only one side has."""
    a, b = before.select(EX, F.col("fingerprint").alias("_a")), after.select(EX, F.col("fingerprint").alias("_b"))
    return a.join(b, EX, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(EX)

