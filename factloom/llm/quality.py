"""Quality rules: robust multivariate outliers among text statistics, with DataFrame functions only.

Base rules come first (too few words; mostly repeated three-word windows). The other documents of each
language and source are described by five transformed statistics, and a minimum-covariance-determinant
estimate is found per group. Three starts (uncorrelated, correlations of tanh scores, and of spatial signs)
each keep the half of the group nearest to them, fit mean and covariance to it, and go on so until the
determinant falls no more; of the three the least determinant is taken. A last fit to all documents within
a 0.975 quantile of that estimate gives the distances, and a document is rejected if its squared
Mahalanobis distance passes a far quantile of chi-squared.

In a small group the covariance is regularised, as the determinant of a few documents says little: mean and
covariance are drawn towards medians and deviations of the group, its language and the whole table, with the
weight of PRIOR documents each. In a group of many documents that weight vanishes.

Statistics are whole numbers of thousandths, and all sums, medians and ranks are exact (ranks of distances
by a histogram of fine steps), so reruns agree whatever the partitions. Every step is a combinable
aggregate; a group with a third of all rows needs no gathering, and distances are plain column arithmetic on
an unrolled Cholesky factor.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups
of their own; groups of any size are judged; a statistic that does not vary in a group has the deviation
named beside it; repeated rows are judged alike; an empty table gives an empty result; columns of any other
name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, let, scratch, small, stored, without, words

#: Transformed statistics, and the deviation in thousandths that a statistic has where it varies less (most documents have no symbols and repeat nothing;
#: lengths a factor of e apart are no oddity in any corpus, so length alone rejects nothing within a factor of 245).
STATISTICS = (("log_words", 1000), ("log_word_length", 20), ("symbols", 40), ("repeated_lines", 80), ("repeated_words", 60))
#: What trimming takes from the variance of normal data with five statistics: 0.5 / P(chi-squared of 7 < median of chi-squared of 5), and so for 0.975.
HALF, MOST_OF = 1.9122, 1.0556
#: The 0.975 and 0.99999 quantiles of chi-squared with five degrees of freedom.
INNER, CUTOFF = 12.8325, 30.856
#: The documents that wider medians and deviations count for. A determinant falls if its logarithm does by this much.
PRIOR, FALLS = 20, 1e-3
#: The share of no correlation in a start, which keeps it regular.
PLAIN = 0.1


def counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(w: Column) -> Column:
        """Hashes of the three-word windows."""
        n = F.size(w)
        hashed = F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c")), lambda z: F.xxhash64(z))
        return F.when(n >= 3, F.slice(hashed, 1, n - 2)).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        """Words in windows found twice or more: with positions sorted, each window adds the words up to the next, three at most."""
        # a window is repeated if a neighbour in order of (hash, position) has its hash
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = let(pairs, lambda s: F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h)))
        places = F.array_sort(F.transform(alike, lambda x: x.i))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def repeated(g: Column) -> Column:
        # most texts repeat no window: comparing the count of distinct ones spares them the sorts
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))

    per_words = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), let(windows(w), repeated).cast("bigint").alias("n_repeat_words")))
    return [per_words.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines")]


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Counts and base verdict of every row; the columns ``keep`` go along as g0, g1 and so on."""
    text = col(docs, text_col)
    kept = [f"g{i}" for i in range(len(keep))]
    rows = docs.select(col(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("_hash"), *[col(docs, c).alias(g) for c, g in zip(keep, kept, strict=True)], *counts(text))
    rows = rows.select("doc_id", "_hash", *kept, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed() -> list[Column]:
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    found = [F.log(n), F.log(c / n), F.sqrt(F.col("n_symbols") / c), F.sqrt(F.col("n_dup_lines") / n), F.col("n_repeat_words") / n]
    return [F.round(1000 * x).cast("bigint").alias(f"x{i}") for i, x in enumerate(found)]


GROUP = ("g0", "g1")


def _num(x: float) -> str:
    """A number as a double literal of SQL."""
    return f"{float(x)!r}D"


def _lower(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _with(rows: DataFrame, few: DataFrame, keys=GROUP, how: str = "inner") -> DataFrame:
    """Rows with the columns of their group; nulls are groups. Groups too many to broadcast meet by shuffle, where the skew join splits hot ones."""
    few = small(few.withColumnsRenamed({k: f"h_{k}" for k in keys}))
    same = rows[keys[0]].eqNullSafe(few[f"h_{keys[0]}"])
    for k in keys[1:]:
        same = same & rows[k].eqNullSafe(few[f"h_{k}"])
    return rows.join(few, same, how).drop(*[f"h_{k}" for k in keys])


def _medians(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of counted values (keys, ``value``, n): their median ``mid`` (the lower one) and their number ``n``, by cumulated counts; one row a value and key."""
    upward = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    found = counted.withColumn("_upto", F.sum("n").over(upward)).withColumn("_all", F.sum("n").over(whole))
    return found.filter(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys).agg(F.min(value).alias("mid"), F.max("_all").alias("n"))


def _targets(points: DataFrame, p: int, floors: list[int]) -> DataFrame:
    """Per group: n, and for each statistic a centre t<i> and a deviation c<i>, drawn from the whole table's over the language's to its own."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("v")) for i in range(p)]))
    own = stored(points.select(*GROUP, each.alias("e")).select(*GROUP, "e.*").groupBy(*GROUP, "i", "v").agg(F.count(F.lit(1)).alias("n")), "values")
    nothing = [F.lit(None).cast(own.schema[g].dataType).alias(g) for g in GROUP]
    levels = [[F.lit(0).alias("level"), F.col("g0"), F.col("g1")], [F.lit(1).alias("level"), F.col("g0"), nothing[1]], [F.lit(2).alias("level"), *nothing]]
    keys = ["level", *GROUP, "i"]
    counted = stored(own.select(F.explode(F.array(*[F.struct(*k, F.col("i")) for k in levels])).alias("k"), "v", "n").select("k.*", "v", "n").groupBy(*keys, "v").agg(F.sum("n").alias("n")), "counted")
    middle = stored(_medians(counted, keys, "v"), "medians")
    away = _with(counted, middle.drop("n"), keys).groupBy(*keys, F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n"))
    deviations = _medians(away, keys, "v").withColumn("c", 1.4826 * F.col("mid")).drop("mid", "n")
    found = _with(middle, deviations, keys)
    sides = [F.max(F.when(F.col("i") == i, F.col(x))).cast("double").alias(f"{to}{i}") for i in range(p) for x, to in (("mid", "t"), ("c", "c"))]
    wide = stored(found.groupBy("level", *GROUP).agg(F.max("n").alias("n"), *sides), "levels")
    names = [f"{to}{i}" for i in range(p) for to in "tc"]

    def drawn(rows: DataFrame, wider: DataFrame, *keys: str) -> DataFrame:
        above = wider.selectExpr("level - 1 AS level", *keys, *[f"{c} AS w_{c}" for c in names])
        return _with(rows, above, ["level", *keys]).selectExpr("level", *GROUP, "n", *[f"(n * {c} + {PRIOR} * w_{c}) / (n + {PRIOR}) AS {c}" for c in names])

    group, language, whole = [wide.filter(F.col("level") == k) for k in range(3)]
    found = drawn(group, drawn(language, whole), "g0").drop("level")
    return stored(found.selectExpr(*GROUP, "n", *[f"t{i}" for i in range(p)], *[f"greatest(c{i}, {_num(floors[i])}) AS c{i}" for i in range(p)]), "targets")


def _starts(points: DataFrame, targets: DataFrame, p: int) -> DataFrame:
    """Per group and start (0, 1, 2): centre m<i> and covariance s<i>_<j>."""
    z = _with(points, targets).selectExpr(*GROUP, *[f"(x{i} - t{i}) / c{i} AS z{i}" for i in range(p)])
    z = z.selectExpr("*", f"sqrt({' + '.join(f'z{i} * z{i}' for i in range(p))}) AS r").selectExpr(*GROUP, *[f"tanh(z{i}) AS h{i}" for i in range(p)], *[f"CASE WHEN r > 0 THEN z{i} / r ELSE 0D END AS u{i}" for i in range(p)])
    # whole millionths: their sums don't depend on the order
    found = z.groupBy(*GROUP).agg(*[F.expr(f"sum(CAST(round(1000000 * {k}{i} * {k}{j}) AS BIGINT)) AS {k}{i}_{j}") for k in "hu" for i, j in _lower(p)])

    def correlation(k: str, i: int, j: int) -> str:
        if i == j:
            return "1D"
        scale = f"sqrt(CAST({k}{i}_{i} AS DOUBLE)) * sqrt(CAST({k}{j}_{j} AS DOUBLE))"
        return "0D" if k == "" else f"(CASE WHEN {k}{i}_{i} > 0 AND {k}{j}_{j} > 0 THEN {_num(1 - PLAIN)} * {k}{i}_{j} / ({scale}) ELSE 0D END)"

    rows = ", ".join(f"named_struct('start', {n}, {', '.join(f'{chr(39)}s{i}_{j}{chr(39)}, {correlation(k, i, j)} * c{i} * c{j}' for i, j in _lower(p))})" for n, k in enumerate(("", "h", "u")))
    return _with(targets, stored(found, "scores")).selectExpr(*GROUP, "n", *[f"t{i} AS m{i}" for i in range(p)], f"explode(array({rows})) AS _s").select(*GROUP, "n", *[f"m{i}" for i in range(p)], "_s.*")


def _distance(p: int) -> str:
    """Squared Mahalanobis distance by forward substitution on the group's inverse factor k<i>_<j>."""
    return " + ".join(f"pow({' + '.join(f'k{i}_{j} * (x{j} - m{j})' for j in range(i + 1))}, 2)" for i in range(p))


def _factored(estimates: DataFrame, p: int) -> DataFrame:
    """Covariances s<i>_<j> as the inverse k<i>_<j> of their lower Cholesky factor, with ``det``, the logarithm of the determinant.

    A column of the factor at a step, then a diagonal of its inverse, so that each step is one projection.
    """
    rest = [f"`{x}`" for x in estimates.columns if x not in {f"s{i}_{j}" for i, j in _lower(p)}]
    for q in range(p):
        left, done = [f"s{i}_{j}" for i, j in _lower(p) if j > q], [f"l{i}_{j}" for i, j in _lower(p) if j < q]
        root = f"sqrt(greatest(s{q}_{q}, 1e-6D))"
        estimates = estimates.selectExpr(*rest, *done, *left, f"{root} AS l{q}_{q}", *[f"s{i}_{q} / {root} AS l{i}_{q}" for i in range(q + 1, p)])
        if left:
            estimates = estimates.selectExpr(*rest, *[f"l{i}_{j}" for i, j in _lower(p) if j <= q], *[f"s{i}_{j} - l{i}_{q} * l{j}_{q} AS s{i}_{j}" for i, j in _lower(p) if j > q])
    estimates = estimates.selectExpr(*rest, f"2 * ({' + '.join(f'ln(l{i}_{i})' for i in range(p))}) AS det", *[f"l{i}_{j}" for i, j in _lower(p)], *[f"1 / l{i}_{i} AS k{i}_{i}" for i in range(p)])
    for d in range(1, p):
        estimates = estimates.selectExpr("*", *[f"-({' + '.join(f'l{i}_{q} * k{q}_{i - d}' for q in range(i - d, i))}) * k{i}_{i} AS k{i}_{i - d}" for i in range(d, p)])
    return estimates.drop(*[f"l{i}_{j}" for i, j in _lower(p)])


def _fitted(chosen: DataFrame, targets: DataFrame, keys: list[str], p: int, floors: list[int], factor: float) -> DataFrame:
    """Mean and covariance of the chosen rows of each key, drawn to the group's targets and with the least deviations, factored."""
    sums = [F.expr(f"sum(x{i}) AS a{i}") for i in range(p)] + [F.expr(f"sum(x{i} * x{j}) AS b{i}_{j}") for i, j in _lower(p)]
    rows = _with(chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("h"), *sums), targets).selectExpr("*", f"n / (n + {PRIOR}D) AS own")

    def drawn(i: int, j: int) -> str:
        fitted = f"own * {_num(factor)} * (b{i}_{j} / h - (a{i} / h) * (a{j} / h))"
        return f"greatest({fitted} + (1 - own) * c{i} * c{i}, {_num(floors[i] ** 2)})" if i == j else fitted

    return _factored(rows.selectExpr(*keys, "n", *[f"own * a{i} / h + (1 - own) * t{i} AS m{i}" for i in range(p)], *[f"{drawn(i, j)} AS s{i}_{j}" for i, j in _lower(p)]), p)


def estimates(points: DataFrame, floors: list[int], falls: float = FALLS) -> DataFrame:
    """Per group (g0, g1) of points (g0, g1, x0..): n, and m<i> and k<i>_<j> of its reweighted minimum-covariance-determinant estimate."""
    p = len(floors)
    lasting = [*GROUP, "start", "n", *[f"m{i}" for i in range(p)], *[f"k{i}_{j}" for i, j in _lower(p)], "det", "going"]
    targets = _targets(points, p, floors)
    state = stored(_factored(_starts(points, targets, p), p).selectExpr(*lasting[:-2], "CAST('Infinity' AS DOUBLE) AS det", "true AS going"), "starts")
    keys, values = [*GROUP, "start"], lasting[3:-1]
    new_row = F.struct(*values).alias("_new")
    while True:
        measured = _with(points, state.filter("going").select(*lasting[:-2])).selectExpr(*keys, f"floor(64 * log2(1 + {_distance(p)})) AS _step", *[f"x{i}" for i in range(p)])
        counted = measured.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("n"))
        half = stored(_medians(counted, keys, "_step").selectExpr(*keys, "mid AS _half"), "halves")
        new = _fitted(_with(measured, half, keys).filter("_step <= _half"), targets, keys, p, floors, HALF).select(*keys, new_row)
        better = f"coalesce(_new.det < det - {_num(falls)}, false)"
        state = stored(_with(state, new, keys, "left").selectExpr(*keys, *[f"if({better}, _new.{c}, {c}) AS {c}" for c in values], f"{better} AS going"), "estimates")
        if state.filter("going").isEmpty():
            break
    least = values[:-1]
    best = stored(state.groupBy(*GROUP).agg(F.min_by(F.struct(*least), F.struct("det", "start")).alias("_b")).select(*GROUP, "_b.*"), "least")
    inner = _with(points, best).filter(f"{_distance(p)} <= {_num(INNER)}").select(*GROUP, *[f"x{i}" for i in range(p)])
    # a group whose documents all lie further out keeps what it has
    final = _with(best, _fitted(inner, targets, list(GROUP), p, floors, MOST_OF).select(*GROUP, F.struct(*least[1:]).alias("_new")), how="left")
    return final.selectExpr(*GROUP, "n", *[f"coalesce(_new.{c}, {c}) AS {c}" for c in least[1:]])


def robust_distances(rows: DataFrame, floors: list[int]) -> DataFrame:
    """``rows`` (g0, g1, x0.. and others) with d2, their squared robust distance."""
    p = len(floors)
    names = [*[f"m{i}" for i in range(p)], *[f"k{i}_{j}" for i, j in _lower(p)]]
    with scratch(rows.sparkSession) as keep:
        found = keep(stored(estimates(rows.select(*GROUP, *[f"x{i}" for i in range(p)]), floors), "robust"))
    return _with(rows, found.drop("n")).withColumn("d2", F.expr(_distance(p))).drop(*names)


def _verdicts(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, str], cutoff: float) -> DataFrame:
    base = stored(base_statistics(docs, id_col, text_col, list(group_cols)), "statistics")
    judged = robust_distances(base.filter("not base_failed").select("*", *transformed()), [f for _, f in STATISTICS])
    whole = base.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).unionByName(judged.drop(*[f"x{i}" for i in range(len(STATISTICS))]))
    distance = F.round("d2", 6)
    return whole.select(
        "doc_id", "_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row."""
    return _verdicts(docs, id_col, text_col, group_cols, cutoff).drop("_hash")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        found = _verdicts(docs, id_col, text_col, group_cols, cutoff).filter("not kept").select(F.col("doc_id").alias("_id"), "_hash").distinct()
        found = keep(stored(found, "rejected"))
    return without(docs, found, id_col, text_col)
