"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document's rate is tilted exponentially so that the token constraint of its source holds and so that the
mix keeps, as far as it can, the corpus's mean logarithm of document size by tokens. Rates lie between 0
and MOST and stay as near to one as they can in the sense of (two-sided) relative entropy over tokens:

    minimise  sum(size * (r log r + (MOST - r) log((MOST - r) / (MOST - 1)))) + (sum(size * r * x))^2 / (2 * RIDGE * total)
    under     sum over a source(size * r) = target,      where x = log(size) - its mean by tokens

The convex dual has one multiplier a source and one, ``slope``, for document sizes, which couples all
sources; its rates are exponentially tilted odds, r / (MOST - r) = exp(multiplier + slope * x) / (MOST - 1). Damped
Newton steps solve it: value, gradient and Hessian are sums over the documents, which are
aggregated by source and size first, and the Hessian's arrow form needs rows of sources and one total only.

Rates are then rounded into copies: the whole part goes to every document; further copies go to documents
in order of a hash of doc_id divided by the rate's fraction (sequential Poisson sampling), until
the source's target is met. The document that crosses it gives the missing words only. The crossing point is
found through sums over ranges of that order, so no source is ordered in one task.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; sources of size
0 have target 0; a source whose target is MOST times its size gives each document MOST times; an empty table
gives an empty result; repeated rows count as often as they come; columns of any other name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, scratch, small, stored, words

#: The weights that sources take in turn, and how often a document may be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: How far the length constraint gives way; the gradient, as a share of all words, at which Newton ends.
RIDGE, EXACT = 0.3, 1e-10
#: Newton steps at most (three or four are usual); what a gradient leaves is made up in rounding, which meets the targets anyway.
STEPS = 60
#: The order of further copies in 2^36 steps, cut twice into 2^12 ranges; what is in one range of the second cut is ordered row by row.
ORDER_BITS, CUT_BITS = 36, 12


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): shares by weight, stopped at ``most`` times the size, the excess shared again.

    In order of most * size / weight the sources that stop come first, and the level of the others follows from sums up to there.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    rows = rows.withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_stop", most * F.col("source_size") / F.col("weight"))
    upward = Window.orderBy("_stop", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_before", F.coalesce(F.sum(most * F.col("source_size")).over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    rows = rows.withColumn("_rest", F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest")).withColumn("_rank", F.row_number().over(upward))
    level = F.min(F.when(F.col("_stop") >= F.col("_level"), F.struct("_rank", "_level"))).over(everything)
    rows = rows.withColumn("_level", level["_level"])
    return rows.withColumn("target", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), most * F.col("source_size").cast("double")))).select("source", "source_size", "weight", "target")


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    per = small(sources.withColumnRenamed("source", "_s"))
    return rows.join(per, rows.source.eqNullSafe(per._s), "left").drop("_s")


def _rate(most: int) -> Column:
    """The rate of a row with its source's multiplier (null on the bound), slope and x."""
    odds = F.exp(-F.least(F.greatest(F.col("multiplier") + F.col("slope") * F.col("x"), F.lit(-60.0)), F.lit(60.0)))
    return F.when(F.col("multiplier").isNotNull(), most / (1 + (most - 1) * odds)).otherwise(float(most))


def multipliers(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Of (source, size, n) and targets: (source, source_size, target, multiplier, slope, mean), by Newton on the dual.

    The multiplier is null where the rate is on its bound: ``most`` for all documents.
    """
    words_in = F.col("size") * F.col("n")
    centre = sizes.filter("size > 0").agg(F.sum(words_in * F.log("size")).alias("a"), F.sum(words_in).alias("b")).first()
    whole, mean = float(centre.b or 1), round(centre.a / centre.b, 9) if centre.b else 0.0
    share = F.col("target") / F.col("source_size")
    start = F.when((F.col("source_size") > 0) & (share < most * (1 - 1e-9)), F.log((most - 1) * share / (most - share)))
    rows = stored(sizes.filter("size > 0").select("source", words_in.cast("double").alias("w"), (F.log("size") - mean).alias("x")), "words")

    def measured(at: DataFrame, slope: float, damping: float):
        """Sums by source at a point, stored, and what the whole dual has there: value, slack of the length constraint, error, and the sums of a step."""
        near = _with(rows, at).withColumn("slope", F.lit(slope))
        wr, free, z = F.col("w") * _rate(most), F.col("multiplier").isNotNull(), F.col("multiplier") + F.col("slope") * F.col("x")
        curve = F.when(free, wr * (1 - _rate(most) / most)).otherwise(0.0)
        value = F.when(free, most * (z + F.log1p((most - 1) * F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0)))))).otherwise(most * F.col("slope") * F.col("x"))
        sums = near.groupBy("source").agg(*[F.sum(v).alias(k) for k, v in (("d", F.col("w") * value), ("g", wr), ("gx", wr * F.col("x")), ("h", curve), ("hx", curve * F.col("x")), ("hxx", curve * F.col("x") * F.col("x")), ("wxx", F.col("w") * F.col("x") * F.col("x")))])
        sums = stored(_with(at.withColumnRenamed("multiplier", "a"), sums), "sums").withColumn("e", F.when(F.col("a").isNotNull(), F.col("g") - F.col("target")))
        return sums, *totals(sums, slope, damping)

    def totals(sums: DataFrame, slope: float, damping: float):
        h, free = F.col("h") + (damping + 1e-12) * F.col("source_size"), F.col("a").isNotNull()
        over = lambda v: F.coalesce(F.sum(F.when(free, v)), F.lit(0.0))
        row = sums.agg(
            F.coalesce(F.sum(F.col("d") - F.coalesce(F.col("a") * F.col("target"), F.lit(0.0))), F.lit(0.0)).alias("d"), over(F.abs("e")).alias("e"), F.coalesce(F.sum("gx"), F.lit(0.0)).alias("gx"),
            over(F.col("hxx") + damping * F.col("wxx") - F.col("hx") * F.col("hx") / h).alias("hxx"), over(F.col("hx") * F.col("e") / h).alias("he"), over(F.col("e") * F.col("e") / h).alias("ee"),
        ).first()
        slack = row.gx + RIDGE * whole * slope
        return row, row.d / whole + RIDGE * slope * slope / 2, slack, (row.e + abs(slack)) / whole

    slope, damping = 0.0, 0.0
    sums, row, value, slack, error = measured(sources.select("source", "source_size", "target", start.alias("multiplier")), slope, damping)
    for _ in range(STEPS):
        if error <= EXACT:
            break
        # arrow form: the slope's step from totals, each source's own from its row
        step = -(slack - row.he) / (row.hxx + RIDGE * whole)
        own = -(F.col("e") + F.col("hx") * step) / (F.col("h") + (damping + 1e-12) * F.col("source_size"))
        moved = sums.select("source", "source_size", "target", (F.col("a") + own).alias("multiplier"))
        fall = (step * slack - row.ee - row.he * step) / whole
        easier = damping / 10 if damping > 1e-6 else 0.0
        tried = measured(moved, slope + step, easier)
        if tried[2] <= value + 1e-3 * fall + 1e-13 * (1 + abs(value)):
            slope, damping, (sums, row, value, slack, error) = slope + step, easier, tried
        elif error < 1e-7:  # as near as the sums' last digits let it
            break
        else:
            damping = max(1e-4, 10 * damping)
            row = totals(sums, slope, damping)[0]
    return sums.select("source", "source_size", "target", F.round("a", 9).alias("multiplier"), F.lit(round(slope, 9)).alias("slope"), F.lit(mean).alias("mean"))


def _crossing(rows: DataFrame, need: str, digit: str, cut: str, left: str) -> DataFrame:
    """Per source: the range in which the sum of sizes passes ``need``, and what is still needed there."""
    sums = rows.groupBy("source", digit, need).agg(F.sum("size").alias("_sum"))
    upward = Window.partitionBy("source").orderBy(digit)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = sums.filter((F.col("_before") <= F.col(need)) & (F.col("_before") + F.col("_sum") > F.col(need)))
    return found.select("source", F.col(digit).alias(cut), (F.col(need) - F.col("_before")).alias(left))


def _rounded(rows: DataFrame, solved: DataFrame, most: int) -> DataFrame:
    """``rows`` (source, size, _h) with their rate, its whole part and their place in the order of further copies, as ranges _a and _b of it."""
    rows = _with(rows, solved).withColumn("x", F.when(F.col("size") > 0, F.log("size") - F.col("mean")))
    # rounded, so that the last bits of a sum show nowhere
    rate = F.when(F.col("size") > 0, F.round(_rate(most), 9)).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("_whole", F.floor("rate"))
    uniform = (F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    part = F.col("rate") - F.col("_whole")
    # ratios up to 1 in the lower half: those are the ones that a plain draw would take
    place = F.when(part > 0, F.floor(F.least(uniform / part / (1 + uniform / part), F.lit(1 - 2.0**-40)) * float(1 << ORDER_BITS))).otherwise(F.lit((1 << ORDER_BITS) - 1))
    rows = rows.withColumn("_place", place.cast("bigint"))
    return rows.withColumns({"_a": F.shiftright("_place", ORDER_BITS - CUT_BITS), "_b": F.shiftright("_place", ORDER_BITS - 2 * CUT_BITS).bitwiseAND((1 << CUT_BITS) - 1)})


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: int, carry: bool) -> DataFrame:
    """Every row with doc_id, source, size, what its source wants, and _whole and _extra; with ``carry`` also the whole row as ``_row``."""
    key = F.md5(F.coalesce(col(docs, id_col).cast("string"), F.lit("")))
    measured = docs.select(
        col(docs, id_col).alias("doc_id"), col(docs, source_col).alias("source"), F.size(words(col(docs, text_col))).cast("bigint").alias("size"), key.alias("_h"),
        *([F.struct(*[col(docs, c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_row")] if carry else []),
    )
    rows = stored(measured.drop("_row"), "sizes")
    with scratch(docs.sparkSession) as keep:
        sizes = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
        sources = stored(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
        solved = keep(stored(multipliers(sizes, sources, most), "solved"))
    rounded = _rounded(rows, solved, most)
    with scratch(docs.sparkSession) as keep:
        given = rounded.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_given"))
        needs = keep(stored(_with(solved.select("source", "target"), given).select("source", (F.floor(F.col("target") + 0.5) - F.col("_given")).alias("_need")), "needs"))
        more = _with(rounded.filter("rate > _whole"), needs)
        cut_a = keep(stored(_crossing(more, "_need", "_a", "_cut_a", "_need_a"), "cuts"))
        cut_b = keep(stored(_crossing(_with(more, cut_a).filter("_a = _cut_a"), "_need_a", "_b", "_cut_b", "_need_b"), "cuts"))
    if carry:  # the texts are read once more, and move only if they are at a crossing
        rounded = _rounded(measured, solved, most)
    rows = _with(_with(_with(rounded, needs), cut_a), cut_b)
    # only rates with a fraction have a further copy; a source without a crossing needs all of these, or none
    more = F.col("rate") > F.col("_whole")
    inside = more & (F.col("_a") == F.col("_cut_a")) & (F.col("_b") == F.col("_cut_b"))
    early = F.col("_cut_a").isNull() & (F.col("_need") > 0) | (F.col("_a") < F.col("_cut_a")) | (F.col("_a") == F.col("_cut_a")) & (F.col("_b") < F.col("_cut_b"))
    plain = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn("_extra", F.when(more & F.coalesce(early, F.lit(False)), F.col("size")).otherwise(0))
    upward = Window.partitionBy("source").orderBy("_place", "_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(inside).withColumn("_sum", F.coalesce(F.sum("size").over(upward), F.lit(0)))
    last = last.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_need_b") - F.col("_sum")))).drop("_sum")
    return plain.unionByName(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row: ``copies`` are whole ones, ``taken`` words."""
    return _mixed(docs, id_col, text_col, source_col, weights, most, False).select(
        "doc_id", "source", "size", "source_size", "target", "rate",
        (F.col("_whole") + F.when((F.col("_extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).cast("bigint").alias("copies"),
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it has copies. The document at a source's crossing is whole if at least half of it is wanted; texts without words have no part in a mix of words and stay out."""
    rows = _mixed(docs, id_col, text_col, source_col, weights, most, True)
    copies = F.col("_whole") + F.when((2 * F.col("_extra") >= F.col("size")) & (F.col("_extra") > 0), 1).otherwise(0)
    out = rows.filter("size > 0").select("_row", copies.cast("int").alias("_n")).filter("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])
