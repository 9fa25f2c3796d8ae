"""Pairwise-neighbourhood graph kernels as long tables of hashed features.

A case sees the alive graph of its interpretation. For each radius r and distance d, every centre s of the case
pairs with the kernel points t at distance d. A pair has a discrete key, from the codes of both
neighbourhoods, and a histogram, from their attributes. Features (case_id, feature, value) come from
grouped sums and windows; nothing is collected and no Python runs on rows.

Encodings are made once a vertex and reused by all cases (the scope ``g`` is the interpretation); only the
variant whose labels depend on the case makes them again per case (a scope of its own), for kernel points whose neighbourhood holds a viewpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAIR_KEYS, KernelOptions
from ..functions.hashing import hash_list, hash_string
from .deduce import EX, cut
from .graph import Graph
from .paths import distances

G, V = "g", "vid"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def inside(e: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    """(g, by, i, j, role): the edges with both ends in a set of vertices (g, by, vid).

    An edge comes to a set by its end of fewer edges: by a hub, all its edges would come to each set that has it.
    """
    degree = e.groupBy(G, F.col("src").alias(V)).agg(F.count(F.lit(1)).alias("n"))
    for end in ("src", "dst"):
        e = e.join(degree.select(G, F.col(V).alias(end), F.col("n").alias(f"n_{end}")), [G, end], "left")
    turned = F.coalesce("n_src", F.lit(0)) > F.coalesce("n_dst", F.lit(0))
    low, high = F.when(turned, F.col("dst")).otherwise(F.col("src")), F.when(turned, F.col("src")).otherwise(F.col("dst"))
    met = sets.withColumnRenamed(V, "low").join(e.select(G, low.alias("low"), high.alias("high"), F.col("src").alias("i"), F.col("dst").alias("j"), "role"), [G, "low"])
    return met.join(sets.withColumnRenamed(V, "high"), [G, by, "high"], "left_semi").select(G, by, "i", "j", "role")


class Kernel:
    """Feature generator over one graph."""

    def __init__(self, graph: Graph, options: KernelOptions, traced: bool = False):
        """With ``traced``, codes and attributes keep the texts that were hashed (columns text, pred_text and bin_text)."""
        self.options, self.mask, self.traced = options, options.hash_bit_mask, traced
        self.graph = graph.living()

    # -- labels ---------------------------------------------------------------------------------------------

    def _plain(self) -> Column:
        """The label of a vertex that no case looks from, as the match type wants it."""
        return F.concat_ws(".", "syms") if self.options.match_type == "hard" else F.col("sig")

    def _labelled(self) -> tuple[DataFrame, DataFrame]:
        """Vertices (g, vid, label, sig, syms, nums, is_kp) and edges (g, src, dst, role) in the scope of interpretations."""
        scope = F.concat(F.lit("0"), EX).alias(G)
        v, e = self.graph.vertices, self.graph.edges
        return v.select(scope, V, self._plain().alias("label"), "sig", "syms", "nums", "is_kp"), e.select(scope, "src", "dst", "role")

    def _marked(self, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(case_id, g, vid) of kernel points whose neighbourhood holds a viewpoint of the case, and the vertices and edges of these neighbourhoods in the scope of cases.

        All else looks alike from every case, and keeps the encodings of its interpretation.
        """
        o = self.options
        if o.variant != "rnspdk" or o.match_type == "mixed":
            return None
        scope = F.concat(F.lit("1"), "case_id").alias(G)
        views = cases.select(EX, "case_id", F.explode("viewpoints").alias("view")).distinct()
        points = self.graph.vertices.filter("is_kp").select(EX, V)
        reach = distances(self.graph, o.radius, views.select(EX, F.col("view").alias(V)).distinct())
        seen = views.join(reach.select(EX, F.col("src").alias("view"), F.col("dst").alias(V)), [EX, "view"]).select(EX, "case_id", V).distinct()
        near = cut(seen.join(points, [EX, V], "left_semi"))
        balls = distances(self.graph, o.radius, near.select(EX, V).distinct())
        members = cut(near.withColumnRenamed(V, "src").join(balls.select(EX, "src", F.col("dst").alias(V)), [EX, "src"]).select(EX, "case_id", V).distinct())
        mark = views.select(EX, "case_id", F.col("view").alias(V), F.lit(True).alias("mark"))
        label = F.when(F.col("mark"), F.concat(F.lit("viewpoint." if o.match_type == "hard" else "viewpoint"), self._plain())).otherwise(self._plain())
        mine = self.graph.vertices.join(members, [EX, V]).join(mark, [EX, "case_id", V], "left").select(scope, V, label.alias("label"), "sig", "syms", "nums", "is_kp")
        e = self.graph.edges.select(F.col(EX).alias(G), "src", "dst", "role")
        inner = inside(e, members.select(F.col(EX).alias(G), "case_id", V), "case_id").select(scope, F.col("i").alias("src"), F.col("j").alias("dst"), "role")
        return near.select("case_id", scope, V), mine, inner

    # -- discrete codes -----------------------------------------------------------------------------------

    def _hard(self, v: DataFrame, e: DataFrame, dist: DataFrame, r: int) -> DataFrame:
        """(g, vid, code) of radius r."""
        kept = lambda text: [text.alias("text")] if self.traced else []
        if r == 0:
            return v.select(G, V, hash_string(F.col("label"), self.mask).alias("code"), *kept(F.col("label")))
        if r == 1:
            child = e.join(v.select(G, F.col(V).alias("dst"), F.col("label").alias("child")), [G, "dst"]).groupBy(G, F.col("src").alias(V)).agg(F.sort_array(F.collect_list(F.concat_ws("-", "child", "role"))).alias("children"))
            text = F.concat(F.col("label"), F.lit(":"), F.concat_ws(".", F.coalesce("children", F.array().cast("array<string>"))))
            return v.join(child, [G, V], "left").select(G, V, hash_string(text, self.mask).alias("code"), *kept(text))
        return self._hard_ball(v, e, dist, r)

    def _hard_ball(self, v: DataFrame, e: DataFrame, dist: DataFrame, r: int) -> DataFrame:
        """Radius of two or more: distances inside the ball of each root describe its vertices, these describe its edges."""
        root = v.filter("is_kp").select(G, F.col(V).alias("root"))
        ball = cut(dist.filter(F.col("d") <= r).select(G, F.col("src").alias("root"), F.col("dst").alias("i"), "d").join(root, [G, "root"], "left_semi"))
        inner = cut(inside(e, ball.select(G, "root", F.col("i").alias(V)), "root"))
        label = v.select(G, F.col(V).alias("j"), (F.col("label") if self.options.variant == "anspdk" else F.col("sig")).alias("text"))
        far_text = F.concat(F.col("d").cast("string"), F.col("text"))
        # texts are kept only on demand, in the order of their hashes, as they repeat the ball's labels
        entry = ["h", *(["x"] if self.traced else [])]
        hops, top = None, 2 * r - 1
        if self.options.variant == "anspdk":  # global distances, unknown beyond the bound
            bound = max(self.options.radius, self.options.distance)
            top = min(top, bound)
            hops = self._around(v, e, ball, inner, r, top)
        seen = self._seen(ball, inner, label, top, hops)
        if self.options.variant == "anspdk":
            seen = seen.withColumn("d", F.when(F.col("d") > bound, -1).otherwise(F.col("d")))
        counted = seen.select(G, "root", "i", hash_string(far_text, self.mask).alias("h"), far_text.alias("x"), "n").groupBy(G, "root", "i", *entry).agg(F.sum("n").cast("int").alias("n")).filter("n > 0")
        told = cut(counted.groupBy(G, "root", "i").agg(F.sort_array(F.collect_list(F.struct(*entry, "n"))).alias("told")))
        # most vertices of a large ball see the same: a list of all that is seen is made once for these
        spread = lambda name: F.flatten(F.transform("told", lambda t: F.array_repeat(t[name], t["n"])))
        made = told.select("told").distinct().select("told", hash_list(spread("h"), self.mask).alias("c"), *([F.concat_ws(" ", spread("x")).alias("cx")] if self.traced else []))
        code = cut(told.join(made, "told").drop("told"))
        ends = [[F.col("c").alias(n), *([F.col("cx").alias(f"{n}x")] if self.traced else [])] for n in "ab"]
        pair = inner.join(code.select(G, "root", "i", *ends[0]), [G, "root", "i"]).join(code.select(G, "root", F.col("i").alias("j"), *ends[1]), [G, "root", "j"])
        h = hash_list(F.array(F.least("a", "b"), F.greatest("a", "b"), hash_string(F.col("role"), self.mask)), self.mask).alias("h")
        way = [F.concat(F.lit("("), F.when(F.col("a") <= F.col("b"), F.concat_ws(" | ", "ax", "bx")).otherwise(F.concat_ws(" | ", "bx", "ax")), F.lit(" | "), "role", F.lit(")")).alias("x")] if self.traced else []
        kept = [F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("h", "x"))), lambda e: e["x"])).alias("text")] if self.traced else []
        found = pair.select(G, "root", h, *way).groupBy(G, F.col("root").alias(V)).agg(F.sort_array(F.collect_list("h")).alias("hs"), *kept)
        kept = [F.coalesce("text", F.lit("")).alias("text")] if self.traced else []
        return root.withColumnRenamed("root", V).join(found, [G, V], "left").select(G, V, hash_list(F.coalesce("hs", F.array().cast("array<bigint>")), self.mask).alias("code"), *kept)

    def _around(self, v: DataFrame, e: DataFrame, ball: DataFrame, inner: DataFrame, r: int, top: int) -> DataFrame | None:
        """(g, root, j, next, k): vertices of a ball that a path around it may join, with their global distance; nothing if there are none.

        A path leaves a ball and comes back by two vertices of its rim that have neighbours outside, so balls with one such vertex have no
        way around, however large what lies behind it is.
        """
        if top < 2:
            return None
        links = e.select(G, "src", "dst").distinct().groupBy(G, F.col("src").alias("i")).agg(F.count(F.lit(1)).alias("all"))
        own = inner.select(G, "root", "i", "j").distinct().groupBy(G, "root", "i").agg(F.count(F.lit(1)).alias("own"))
        rim = ball.filter(F.col("d") == r).select(G, "root", "i").join(own, [G, "root", "i"], "left").join(links, [G, "i"]).filter(F.coalesce("own", F.lit(0)) < F.col("all")).select(G, "root", F.col("i").alias("j"))
        several = rim.groupBy(G, "root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(G, "root")
        rim = cut(rim.join(several, [G, "root"], "left_semi"))
        if rim.isEmpty():
            return None
        far = self._walked(v, e, top, rim.select(G, F.col("j").alias(V)).distinct()).filter("d > 1").select(G, F.col("src").alias("j"), F.col("dst").alias("next"), F.col("d").alias("k"))
        return cut(far.join(rim, [G, "j"]).join(rim.withColumnRenamed("j", "next"), [G, "root", "next"], "left_semi").select(G, "root", "j", "next", "k"))

    @staticmethod
    def _seen(ball: DataFrame, inner: DataFrame, label: DataFrame, top: int, hops: DataFrame | None = None) -> DataFrame:
        """(g, root, i, d, text, n): how many vertices of a text are at a distance; parts of a sum, some of them negative.

        Two vertices are at most as far from each other as both are from the root. Only pairs that are closer, up to ``top``, are walked: all
        vertices of a shortest path between such a pair are closer to its beginning as well. All others are counted by their distance from
        the root. Distances are those inside the ball, unless ``hops`` lead around it.
        """
        out = ball.withColumnRenamed("d", "out")
        step = inner.select(G, "root", F.col("i").alias("j"), F.col("j").alias("next")).distinct().withColumn("k", F.lit(1))
        step, longest = (step, 1) if hops is None else (step.unionByName(hops), top)
        step = step.join(out.select(G, "root", F.col("i").alias("next"), F.col("out").alias("far")), [G, "root", "next"])
        near = out.filter("out > 0").select(G, "root", "i", "out", F.col("i").alias("j"), F.col("out").alias("far"), F.lit(0).alias("d"))
        for d in range(1, top + 1):
            more = near.filter(F.col("d") >= d - longest).drop("far").join(step, [G, "root", "j"]).filter((F.col("d") + F.col("k") == d) & (F.col("out") + F.col("far") > d)).select(G, "root", "i", "out", F.col("next").alias("j"), "far", F.lit(d).alias("d"))
            near = cut(near.unionByName(more).groupBy(G, "root", "i", "out", "j", "far").agg(F.min("d").alias("d")))
        sizes = cut(out.join(label.withColumnRenamed("j", "i"), [G, "i"]).groupBy(G, "root", F.col("out").alias("far"), "text").agg(F.count(F.lit(1)).alias("n")))
        through = out.join(sizes, [G, "root"]).select(G, "root", "i", (F.col("out") + F.col("far")).alias("d"), "text", "n")
        close = near.join(label, [G, "j"])
        turned = F.explode(F.array(F.struct(F.col("d"), F.lit(1).cast("bigint").alias("n")), F.struct((F.col("out") + F.col("far")).alias("d"), F.lit(-1).cast("bigint").alias("n"))))
        return through.unionByName(close.select(G, "root", "i", "text", turned.alias("t")).select(G, "root", "i", "t.d", "text", "t.n"))

    # -- histograms -------------------------------------------------------------------------------------------

    def _attributes(self, rows: DataFrame, label: Column) -> DataFrame:
        """Each row's attributes as (pred, bin, w): symbols count, numbers weigh; the signature name is symbol 0."""
        h = lambda text: hash_string(text, self.mask)

        def named(pred: Column, bin_: Column, w: Column) -> list[Column]:
            return [G, V, h(pred).alias("pred"), h(bin_).alias("bin"), w.alias("w"), *([pred.alias("pred_text"), bin_.alias("bin_text")] if self.traced else [])]

        k = F.col("k").cast("string")
        symbols = rows.select("*", F.posexplode("syms").alias("k", "x")).select(*named(F.concat(F.lit("pred:"), label), F.concat(F.lit("bin:"), k, F.lit("_v:"), F.col("x")), F.lit(1.0)))
        numbers = rows.select("*", F.posexplode("nums").alias("k", "x")).filter("x is not null").select(*named(F.concat(F.lit("f:"), label), F.concat(F.lit("bn:"), k), F.col("x")))
        return symbols.unionByName(numbers)

    def _soft(self, v: DataFrame, e: DataFrame, dist: DataFrame, r: int) -> DataFrame:
        """(g, vid, pred, bin, w) of radius r."""
        hard_soft = self.options.match_type == "hard_soft"
        if r == 0:
            found = self._attributes(v, F.col("label"))
        elif r == 1:
            child = e.select(G, F.col("src").alias("root"), F.col("dst").alias(V), "role").join(v, [G, V])
            label = F.col("label")
            if hard_soft:
                place = F.row_number().over(Window.partitionBy(G, "root").orderBy(F.concat_ws("-", "label", "role"), V)) - 1
                child = child.withColumn("place", place)
                label = F.concat(F.col("label"), F.lit("+pos"), F.col("place").cast("string"))
            root = self._attributes(v, F.concat(F.col("label"), F.lit("+r")))
            found = self._attributes(child.drop(V).withColumnRenamed("root", V), label).unionByName(root)
        else:
            members = dist.filter(F.col("d") <= r).select(G, F.col("src").alias("root"), F.col("dst").alias(V), "d").join(v, [G, V])
            # other than soft: the label tells how far a vertex is from the root
            label = F.col("label") if self.options.match_type == "soft" else F.concat(F.col("d").cast("string"), F.col("label"))
            found = self._attributes(members.drop(V).withColumnRenamed("root", V), label)
        return found.groupBy(G, V, "pred", "bin", *(["pred_text", "bin_text"] if self.traced else [])).agg(F.sum("w").alias("w"))

    def encodings(self, v: DataFrame, e: DataFrame, dist: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Codes (g, vid, r, code) and histograms (g, vid, r, pred, bin, w) for every radius."""
        kind, top = self.options.match_type, self.options.radius
        codes, soft = [], []
        for r in range(top + 1):
            codes.append(self._hard(v, e, dist, 0 if kind == "soft" else r).withColumn("r", F.lit(r)))
            if kind in ("soft", "hard_soft", "mixed"):
                soft.append(self._soft(v, e, dist, top if kind == "mixed" else r).withColumn("r", F.lit(r)))
        code = _union(codes)
        if not soft:
            none = [F.lit(None).cast("string").alias(c) for c in ("pred_text", "bin_text")] if self.traced else []
            return code, code.select(G, V, "r", F.lit(1).cast("bigint").alias("pred"), F.lit(1).cast("bigint").alias("bin"), F.lit(1.0).alias("w"), *none)
        return code, _union(soft)

    # -- directions, for vertices with coordinates ------------------------------------------------------

    def _directions(self, v: DataFrame, dist: DataFrame) -> DataFrame:
        """(g, vid, r, x, y, z): the mean of root minus member over the ball; null vector where the mean is short against the longest."""
        xyz = ["x", "y", "z"]
        place = v.select(G, V, *[F.get("nums", F.lit(k)).alias(c) for k, c in enumerate(xyz)]).filter("x is not null and y is not null and z is not null")
        out = []
        for r in range(self.options.radius + 1):
            pairs = dist.filter((F.col("d") <= r) & (F.col("src") != F.col("dst"))).select(G, F.col("src").alias(V), F.col("dst").alias("o"))
            other = place.select(G, F.col(V).alias("o"), *[F.col(c).alias(f"o{c}") for c in xyz])
            diff = pairs.join(place, [G, V]).join(other, [G, "o"]).select(G, V, *[(F.col(c) - F.col(f"o{c}")).alias(c) for c in xyz])
            square = reduce(Column.__add__, [F.col(c) * F.col(c) for c in xyz])
            mean = diff.groupBy(G, V).agg(*[F.avg(c).alias(c) for c in xyz], F.max(square).alias("most"))
            short = (F.col("most") <= 0) | (square / F.col("most") < 0.05)
            out.append(mean.select(G, V, F.lit(r).alias("r"), *[F.when(short, 0.0).otherwise(F.col(c)).alias(c) for c in xyz]))
        return _union(out)

    # -- pairs and vectors ------------------------------------------------------------------------------------

    def _ends(self, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The ends of all pairs (case_id, g, rd, key, r, vid, and what tells of the key if traced), and the vertices' histograms.

        If traced, pairs name texts by their digests, as a hub's text is as long as its links and comes with each of its pairs; the third table is (digest, text).
        """
        o = self.options
        # self-joins over lazy parts would multiply the plan: each table that is read more than once is cut first
        v, e = (cut(x) for x in self._labelled())
        own = F.concat(F.lit("0"), EX)
        points = v.filter("is_kp").select(G, V)
        given = cases.filter("viewpoints is not null").select("case_id", own.alias(G), F.explode("viewpoints").alias(V))
        free = cases.filter("viewpoints is null" if o.variant != "rnspdk" else "false").select("case_id", own.alias(G)).join(v.select(G, V), G)
        centre = cut(given.unionByName(free).join(points, [G, V], "left_semi").dropDuplicates().withColumnRenamed(V, "s"))
        # pairs begin at centres, so only these are walked from: through a hub all others meet, and their pairs grow with the square
        if o.radius < 2:  # encodings read such balls from the edges, directions need them as distances
            dist = self._walked(v, e, o.distance, centre.select(G, F.col("s").alias(V)).distinct())
            balls = self._walked(v, e, o.radius, points) if o.variant == "nspdk3d" else dist
        else:
            dist = balls = self._walked(v, e, max(o.radius, o.distance), points)
        code, soft = self.encodings(v, e, balls)
        marked = self._marked(cases)
        if marked is not None:
            near, mine, inner = (cut(x) for x in marked)
            again = [x.join(near.select(G, V), [G, V], "left_semi") for x in self.encodings(mine, inner, self._walked(mine, inner, o.radius, near))]
            code, soft = code.unionByName(again[0]), soft.unionByName(again[1])
        code, soft = cut(code), cut(soft)
        pairs = centre.join(dist.filter(F.col("d") <= o.distance).withColumnsRenamed({"src": "s", "dst": "t"}), [G, "s"]).join(points.withColumnRenamed(V, "t"), [G, "t"], "left_semi")
        for end, scope in (("s", "gs"), ("t", "gt")):
            if marked is None:
                pairs = pairs.withColumn(scope, F.col(G))
            else:
                pairs = pairs.join(near.select("case_id", F.col(V).alias(end), F.col(G).alias("_g")), ["case_id", end], "left").withColumn(scope, F.coalesce("_g", G)).drop("_g")
        cs, ct = (code.select(F.col(G).alias(scope), F.col(V).alias(end), "r", F.col("code").alias(c), *([F.sha2("text", 256).alias(f"{c}_text")] if self.traced else [])) for end, scope, c in (("s", "gs", "a"), ("t", "gt", "b")))
        rows = pairs.join(cs, ["gs", "s"]).join(ct, ["gt", "t", "r"])
        h = lambda *x: hash_list(F.array(*[c.cast("bigint") if isinstance(c, Column) else F.lit(c).cast("bigint") for c in x]), self.mask)
        a, b, d, r = F.col("a"), F.col("b"), F.col("d"), F.col("r")
        if o.variant == "nspdk3d":
            way = self._directions(v, balls)
            ws, wt = way.select(G, F.col(V).alias("s"), "r", F.struct("x", "y", "z").alias("p")), way.select(G, F.col(V).alias("t"), "r", F.struct("x", "y", "z").alias("q"))
            rows = rows.join(ws, [G, "s", "r"], "left").join(wt, [G, "t", "r"], "left")
            dot = reduce(Column.__add__, [F.col(f"p.{c}") * F.col(f"q.{c}") for c in "xyz"])
            pp, qq = (F.coalesce(reduce(Column.__add__, [F.col(f"{x}.{c}") * F.col(f"{x}.{c}") for c in "xyz"]), F.lit(0.0)) for x in "pq")
            cosine = dot / F.sqrt(pp * qq)
            turn = F.when((pp == 0) & (qq == 0), 1).when((pp == 0) | (qq == 0), 2).when(cosine > 0.5, 3).when(cosine < -0.5, 4).otherwise(5)
            key = h(a, b, turn)
        elif o.variant in PAIR_KEYS:
            key = PAIR_KEYS[o.variant](a, b, d, r, h)
        elif o.variant == "alnspdk":
            key = F.when(d == 0, h(a)).otherwise(h(a, b))
        elif o.variant == "mnspdk":
            key = h(F.least(a, b), F.greatest(a, b))
        else:
            key = F.when(d == 0, h(a)).otherwise(h(F.least(a, b), F.greatest(a, b)))
        group = h(r) if o.variant == "gnspdk" else h(d, r)
        rows = rows.withColumns({"key": key, "rd": group})
        if o.variant == "gnspdk":  # of each radius, the last distance that has pairs stays
            rows = rows.withColumn("top", F.max("d").over(Window.partitionBy("case_id", "r"))).filter("d = top").drop("top")
        both = ["s", "t"] if o.variant in ("mnspdk", "nspdk3d") else None
        near_end, far_end = (F.struct(F.col(scope).alias(G), F.col(end).alias(V)) for end, scope in (("s", "gs"), ("t", "gt")))
        ends = F.array(near_end, far_end) if both else F.when(d == 0, F.array(near_end)).otherwise(F.array(near_end, far_end))
        told = [F.col("d"), F.col("a_text").alias("near"), F.col("b_text").alias("far")] if self.traced else []
        parts = [rows.select("case_id", "rd", "key", "r", F.explode(ends).alias("end"), *[x.alias(n) for x, n in zip(told, ("d", "near", "far"), strict=False)]).select("case_id", f"end.{G}", "rd", "key", "r", f"end.{V}", *(["d", "near", "far"] if self.traced else []))]
        if o.variant == "alnspdk":  # a second set, of the far ends alone
            told = [F.col("d"), F.lit(None).cast("string").alias("near"), F.col("b_text").alias("far")] if self.traced else []
            parts.append(rows.filter("d > 0").select("case_id", F.col("gt").alias(G), h(F.lit(1), d, r).alias("rd"), h(b).alias("key"), "r", F.col("t").alias(V), *told))
        parts = [cut(x) for x in parts] if len(parts) > 1 else parts
        texts = code.select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"]) if self.traced else None
        return _union(parts), soft, texts

    @staticmethod
    def _walked(v: DataFrame, e: DataFrame, bound: int, roots: DataFrame) -> DataFrame:
        """(g, src, dst, d) from the roots."""
        if not bound:
            return cut(roots.select(G, F.col(V).alias("src"), F.col(V).alias("dst"), F.lit(0).alias("d")))
        scoped = Graph(v.select(F.col(G).alias(EX), V, F.lit(True).alias("alive")), e.select(F.col(G).alias(EX), "src", "dst", "role"))
        return cut(distances(scoped, bound, roots.select(F.col(G).alias(EX), V)).withColumnRenamed(EX, G))

    def histogram(self, cases: DataFrame) -> DataFrame:
        """(case_id, rd, key, pred, bin, w); ``cases`` has ex, case_id and viewpoints (null: every vertex)."""
        ends, soft, _ = self._ends(cases)
        counted = ends.groupBy("case_id", G, "rd", "key", "r", V).agg(F.count(F.lit(1)).alias("times"))
        return counted.join(soft, [G, V, "r"]).groupBy("case_id", "rd", "key", "pred", "bin").agg(F.sum(F.col("w") * F.col("times")).alias("w"))

    def features(self, cases: DataFrame) -> DataFrame:
        """(case_id, feature, value): the sparse vectors."""
        return vectors(self.histogram(cases), self.options)

    def explain(self, cases: DataFrame) -> DataFrame:
        """(feature, text): every feature of the cases with all that was hashed to it, as distinct pairs.

        The text names distance and radius, the near and the far neighbourhood, and the attribute, each as it was before hashing. It is made
        where the hash is, so two texts of one feature are a collision. Not for the unary features of the minimum kernel,
        whose number is that of the values.
        """
        if self.options.min_kernel:
            raise ValueError("the features of the minimum kernel number its values; explain the histogram instead")
        traced = self if self.traced else Kernel(self.graph, self.options, traced=True)
        ends, soft, texts = traced._ends(cases)
        texts = cut(texts)
        # vertices of one text and attribute are many: pairs shrink before texts are put together
        pairs = ends.select(G, "rd", "key", "r", V, "d", "near", "far").distinct().join(soft.drop("w"), [G, V, "r"])
        pairs = pairs.select("rd", "key", "r", "d", "near", "far", "pred", "bin", "pred_text", "bin_text").distinct()
        for end in ("near", "far"):
            pairs = pairs.join(texts.select(F.col("digest").alias(end), F.col("text").alias(f"{end}_text")), end, "left").drop(end).withColumnRenamed(f"{end}_text", end)
        feature = hash_list(F.array("rd", "key", "pred", "bin", F.lit(0).cast("bigint")), self.mask)
        # keys that don't tell the ends of a pair apart name them in order; a centre with itself is named once
        either = self.options.variant not in ("alnspdk", "nspdk3d", *PAIR_KEYS)
        sides = F.array_sort(F.array("near", "far")) if either else F.array("near", "far")
        alone = F.col("near") if self.options.variant != "mnspdk" else F.concat_ws(" ~ ", "near", "near")
        nodes = F.when(F.col("near").isNull(), F.concat(F.lit("~ "), F.col("far"))).when(F.col("d") == 0, alone).otherwise(F.concat_ws(" ~ ", sides))
        step = F.lit("") if self.options.variant == "gnspdk" else F.concat(F.lit("d"), F.col("d").cast("string"), F.lit(" "))
        text = F.concat(step, F.lit("r"), F.col("r").cast("string"), F.lit(" "), nodes, F.coalesce(F.concat(F.lit(" ; "), F.col("pred_text"), F.lit(" ; "), F.col("bin_text")), F.lit("")))
        return pairs.select(feature.alias("feature"), text.alias("text")).distinct()


def collisions(texts: DataFrame) -> DataFrame:
    """(feature, n, first, last): features that several texts share, from pairs (feature, text)."""
    return texts.groupBy("feature").agg(F.count_distinct("text").alias("n"), F.min("text").alias("first"), F.max("text").alias("last")).filter("n > 1")


def vectors(hist: DataFrame, options: KernelOptions) -> DataFrame:
    """Histograms to sparse vectors: normalised, raw, or unary for the minimum kernel.

    Two entries of a case that hash alike keep the last in order of (rd, key, pred, bin).
    """
    mask = options.hash_bit_mask
    order = ["rd", "key", "pred", "bin"]
    if options.min_kernel:
        unary = hist.filter("w > 0").select("case_id", *order, F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil("w").cast("bigint") - 1)).alias("z"))
        return unary.select("case_id", hash_list(F.array(*order, "z"), mask).alias("feature"), F.lit(1.0).alias("value")).dropDuplicates(["case_id", "feature"])
    value = F.col("w")
    if options.normalization:
        hist = cut(hist)
        # sums first, then their counts: three small aggregates over shrinking tables
        n3 = hist.groupBy("case_id", "rd", "key", "pred").agg(F.sum(F.col("w") * F.col("w")).alias("n3"))
        n2 = n3.groupBy("case_id", "rd", "key").agg(F.count(F.lit(1)).alias("n2"))
        n1 = n2.groupBy("case_id", "rd").agg(F.count(F.lit(1)).alias("n1"))
        n0 = n1.groupBy("case_id").agg(F.count(F.lit(1)).alias("n0"))
        hist = hist.join(n3, ["case_id", "rd", "key", "pred"]).join(n2, ["case_id", "rd", "key"]).join(n1, ["case_id", "rd"]).join(n0, "case_id")
        value = F.col("w") / F.sqrt(F.col("n0") * F.col("n1") * F.col("n2") * F.col("n3"))
    rows = hist.filter("w != 0").select("case_id", hash_list(F.array(*order, F.lit(0).cast("bigint")), mask).alias("feature"), value.alias("value"), F.struct(*order).alias("o"))
    return rows.groupBy("case_id", "feature").agg(F.max_by("value", "o").alias("value"))


def ghost_features(features: DataFrame, ghosts: DataFrame, signature: str, mask: int = 2**31 - 1) -> DataFrame:
    """Adds the properties of ghost rows (case_id, place, value) under the hash of ``<signature>_<place>``, over what was there."""
    extra = ghosts.select("case_id", hash_string(F.concat(F.lit(f"{signature}_"), F.col("place").cast("string")), mask).alias("feature"), F.col("value").cast("double").alias("value"))
    return features.join(extra.select("case_id", "feature"), ["case_id", "feature"], "left_anti").unionByName(extra)


def feature_dictionary(features: DataFrame) -> DataFrame:
    """(feature, index): hashed features numbered from 1 in order, by ranges rather than in one task."""
    distinct = features.select("feature").distinct()
    bucket = F.shiftright("feature", 16)
    sizes = distinct.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = distinct.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("feature")))
    return inner.join(before, "bucket").select("feature", (F.col("before") + F.col("place")).alias("index"))


def remap(features: DataFrame) -> DataFrame:
    """Features numbered densely from 1 instead of hashed."""
    return features.join(feature_dictionary(features), "feature").select("case_id", F.col("index").alias("feature"), "value")
