"""Graphicalisation: tables to one bipartite graph per interpretation, as two DataFrames.

vertices (ex, vid, sig, kind, sym_id, syms, nums, is_kp, alive) and edges (ex, src, dst, role), each edge in
both directions. A vertex key names the interpretation, the signature and the identifiers, so equal numbers of
different tables never meet; it needs no numbering and so no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SELF, Domain, Signature
from .deduce import EX, SLICE


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def kill(self, signatures: list[str]) -> Graph:
        """The graph in which vertices of these signatures are dead."""
        return Graph(self.vertices.withColumn("alive", F.col("alive") & ~F.col("sig").isin(list(signatures))), self.edges)

    def living(self) -> Graph:
        """Alive vertices and the edges between them."""
        alive = self.vertices.filter("alive")
        keys = alive.select(EX, "vid")
        edges = self.edges.join(keys.withColumnRenamed("vid", "src"), [EX, "src"], "left_semi").join(keys.withColumnRenamed("vid", "dst"), [EX, "dst"], "left_semi")
        return Graph(alive, edges.select(EX, "src", "dst", "role"))

    def persist(self) -> Graph:
        return Graph(self.vertices.persist(), self.edges.persist())

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()


def vertex_id(sig: str, *ids: Column) -> Column:
    return F.concat_ws("/", F.col(EX).cast("string"), F.lit(sig), *[i.cast("string") for i in ids])


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _vertices(domain: Domain, s: Signature, table: DataFrame) -> DataFrame:
    ids = [F.col(c.name) for c in s.id_columns]
    kinds = {f.name: f.dataType for f in table.schema}
    texts = [F.col(c.name).cast("string") for c in s.property_columns if not _numeric(kinds[c.name])]
    numbers = [F.col(c.name).cast("double") for c in s.property_columns if _numeric(kinds[c.name])]
    return table.select(
        F.col(EX).cast("string").alias(EX), vertex_id(s.name, *ids).alias("vid"), (F.col(SLICE).cast("string") if SLICE in table.columns else F.lit(None).cast("string")).alias(SLICE),
        F.lit(s.name).alias("sig"), F.lit("i" if s.kind == "entity" else "r").alias("kind"),
        (ids[0].cast("string") if s.kind == "entity" else F.concat(F.lit(s.name), *[i.cast("string") for i in ids])).alias("sym_id"),
        F.array(F.lit(s.name), *texts).alias("syms"), (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("nums"),
        F.lit(domain.is_kernel_point(s.name)).alias("is_kp"), F.lit(True).alias("alive"),
    )


def build_graph(domain: Domain, tables: dict[str, DataFrame]) -> Graph:
    """One union over tables for the vertices; each reference column joins its entity once for the edges, so dangling references make no edge."""
    active = [domain.signatures[n] for n in domain.active]
    vertices = reduce(DataFrame.unionByName, [_vertices(domain, s, tables[s.name]) for s in active])
    edges = []
    for s in active:
        for c in s.id_columns:
            if c.kind == SELF or domain.signatures[c.kind].ghost:
                continue
            own = domain.signatures[c.kind].id_columns[0].name
            ids = [F.col(x.name) for x in s.id_columns]
            known = tables[c.kind].select(EX, F.col(own).alias(c.name)).dropDuplicates()
            # a semi join: the vertex key follows from the identifier itself
            ends = tables[s.name].join(known, [EX, c.name], "left_semi").select(
                F.col(EX).cast("string").alias(EX), vertex_id(s.name, *ids).alias("a"), vertex_id(c.kind, F.col(c.name)).alias("b"), F.lit(s.role(c)).alias("role")
            )
            both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
            edges.append(ends.select(EX, both.alias("e"), "role").select(EX, "e.src", "e.dst", "role"))
    return Graph(vertices, reduce(DataFrame.unionByName, edges))


def degrees(graph: Graph) -> DataFrame:
    return graph.edges.groupBy(EX, F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency(graph: Graph) -> DataFrame:
    """(ex, vid, neighbours): the sorted alive neighbours of alive vertices."""
    g = graph.living()
    return g.edges.groupBy(EX, F.col("src").alias("vid")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def induced_subgraph(graph: Graph, chosen: DataFrame) -> Graph:
    """The chosen vertices (ex, vid) and the edges between them."""
    keys = chosen.select(EX, "vid").dropDuplicates()
    edges = graph.edges.join(keys.withColumnRenamed("vid", "src"), [EX, "src"], "left_semi").join(keys.withColumnRenamed("vid", "dst"), [EX, "dst"], "left_semi")
    return Graph(graph.vertices.join(keys, [EX, "vid"], "left_semi"), edges.select(EX, "src", "dst", "role"))


def edge_role(graph: Graph) -> DataFrame:
    """One role for each pair of neighbours: the first by name where there are several edges."""
    return graph.edges.groupBy(EX, "src", "dst").agg(F.min("role").alias("role"))


def sanity(graph: Graph) -> DataFrame:
    """(ex, n_vertices, n_edges, ok) of each interpretation; undirected edges count once."""
    v = graph.vertices.groupBy(EX).agg(F.count(F.lit(1)).alias("n_vertices"))
    e = graph.edges.groupBy(EX).agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n_edges"))
    return v.join(e, EX, "left").select(EX, "n_vertices", F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges")).withColumn("ok", F.col("n_edges") > 0)


def graph_ids(graph: Graph) -> DataFrame:
    return graph.vertices.select(EX).distinct()
