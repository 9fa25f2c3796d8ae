"""Text forms of graphs, vectors and predictions; each is a DataFrame of lines that Spark writes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import six_digits
from ..operators.deduce import EX
from ..operators.graph import Graph


def _label(simple: bool):
    return F.col("syms")[0] if simple else F.concat_ws(".", "syms")


def _numbered(graph: Graph, simple: bool) -> tuple[DataFrame, DataFrame]:
    """Vertices (ex, no, text, kind) numbered from 0 within their interpretation, and undirected edges once."""
    v = graph.vertices.withColumn("no", F.row_number().over(Window.partitionBy(EX).orderBy("kind", "vid")) - 1)
    v = v.select(EX, "vid", "no", _label(simple).alias("text"), "kind")
    ends = v.select(EX, "vid", "no")
    e = graph.edges.join(ends.select(EX, F.col("vid").alias("src"), F.col("no").alias("a")), [EX, "src"]).join(ends.select(EX, F.col("vid").alias("dst"), F.col("no").alias("b")), [EX, "dst"])
    return v, e.filter("a < b").select(EX, "a", "b", "role")


def graph_lines(graph: Graph, form: str, simple: bool = False) -> DataFrame:
    """(ex, part, a, b, value): lines in order of part, a, b; ``form`` is dot, gml, gdl, csv or gspan."""
    v, e = _numbered(graph, simple)
    shapes = {
        "dot": ("graph g {", '%d [label="%s", shape=%s];', '%d -- %d [label="%s"];', "}"),
        "gml": ("graph [", 'node [ id %d label "%s" type "%s" ]', 'edge [ source %d target %d label "%s" ]', "]"),
        "gdl": ("graph: {", 'node: { title: "%d" label: "%s" shape: %s }', 'edge: { source: "%d" target: "%d" label: "%s" }', "}"),
        "csv": (None, "%d;%s;%s", "%d;%d;%s", None),
        "gspan": ("t #", "v %d %s", "e %d %d %s", None),
    }
    head, node, edge, tail = shapes[form]
    shape = F.when(F.col("kind") == "i", F.lit("box")).otherwise(F.lit("diamond")) if form in ("dot", "gdl") else F.col("kind")
    values = ["no", "text"] if form == "gspan" else ["no", "text", shape]
    zero = F.lit(0)
    parts = [v.select(EX, F.lit(1).alias("part"), F.col("no").alias("a"), zero.alias("b"), F.format_string(node, *values).alias("value")), e.select(EX, F.lit(2).alias("part"), "a", "b", F.format_string(edge, "a", "b", "role").alias("value"))]
    ids = graph.vertices.select(EX).distinct()
    if head:
        parts.insert(0, ids.select(EX, zero.alias("part"), zero.alias("a"), zero.alias("b"), (F.concat(F.lit(f"{head} "), EX) if form == "gspan" else F.lit(head)).alias("value")))
    if tail:
        parts.append(ids.select(EX, F.lit(3).alias("part"), zero.alias("a"), zero.alias("b"), F.lit(tail).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_graph(graph: Graph, path: str, form: str, simple: bool = False) -> None:
    """One folder an interpretation, lines in order."""
    graph_lines(graph, form, simple).repartition(EX).sortWithinPartitions(EX, "part", "a", "b").select(EX, "value").write.partitionBy(EX).text(path)


def viewpoint_ball(graph: Graph, viewpoints: DataFrame, radius: int) -> Graph:
    """The graph induced by all that lies within ``radius`` of the viewpoints (ex, vid), for inspection or export."""
    from ..operators.graph import induced_subgraph
    from ..operators.paths import distances

    reach = distances(graph, radius, viewpoints)
    return induced_subgraph(graph, reach.select(EX, F.col("dst").alias("vid")))


def fold_lists(folds: DataFrame, column: str = EX) -> DataFrame:
    """(fold, part, id): the test ids of each fold, and all others as its training ids."""
    from ..operators.models import turns_of

    rows = folds.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in turns_of(folds)])))
    return rows.select(F.col("turn").alias("fold"), F.when(F.col("fold") == F.col("turn"), "test").otherwise("train").alias("part"), F.col(column).alias("id"))


def libsvm_lines(features: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, value): ``label index:value ... # case``, indexes ascending."""
    entry = F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda x: F.concat(x.feature.cast("string"), F.lit(":"), six_digits(x.value)))
    rows = features.groupBy("case_id").agg(entry.alias("x"))
    return cases.select("case_id", "label").join(rows, "case_id", "left").select("case_id", F.concat_ws(" ", six_digits(F.col("label")), F.concat_ws(" ", "x"), F.concat(F.lit("# "), "case_id")).alias("value"))


def libsvm_subset(features: DataFrame, cases: DataFrame, group: str) -> DataFrame:
    """The same for cases that aren't rejected, with a query number per group."""
    kept = cases.filter(~F.col("rejected")) if "rejected" in cases.columns else cases
    numbers = kept.select(group).distinct().withColumn("qid", F.row_number().over(Window.orderBy(group)))
    entry = F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda x: F.concat(x.feature.cast("string"), F.lit(":"), six_digits(x.value)))
    rows = features.groupBy("case_id").agg(entry.alias("x"))
    return kept.join(numbers, group).join(rows, "case_id", "left").select("case_id", "qid", F.concat_ws(" ", six_digits(F.col("label")), F.concat(F.lit("qid:"), F.col("qid").cast("string")), F.concat_ws(" ", "x")).alias("value"))


def prediction_lines(preds: DataFrame) -> DataFrame:
    return preds.select("case_id", F.concat_ws("\t", "case_id", six_digits(F.col("label")), six_digits(F.col("prediction"))).alias("value"))


def induced_lines(facts: DataFrame, prefix: str = "pred_") -> DataFrame:
    """Induced facts as fact lines under a prefixed signature, ready to be read again."""
    part = F.split("case_id", "/")
    ids = F.slice(part, 3, F.greatest(F.size(part) - 2, F.lit(0)))
    args = F.concat(ids, F.array("value")) if "value" in facts.columns else ids
    return facts.select(F.format_string("interpretation(%s,%s%s(%s)).", part[0], F.lit(prefix), part[1], F.concat_ws(",", args)).alias("value"))


def external_predictions(spark, path: str) -> DataFrame:
    """(case_id, prediction) from tab-parted lines; rows meet their cases by id, never by place."""
    return spark.read.csv(path, sep="\t", schema="case_id string, prediction double")


def negatives_sampled(cases: DataFrame, share: float) -> DataFrame:
    """All positive cases and a share of the negative ones, chosen by a hash."""
    from ..operators.cases import hash_share

    return cases.filter((F.col("label") > 0) | (hash_share("case_id") < share))


def results_name(config: dict) -> str:
    """The name of a results folder: SHA-1 of the configuration in canonical form."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def save_results(df: DataFrame, root: str, config: dict, clobber: bool = False) -> str:
    path = f"{root.rstrip('/')}/{results_name(config)}"
    df.write.mode("overwrite" if clobber else "errorifexists").parquet(path)
    return path
