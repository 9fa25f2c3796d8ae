"""Reports over predictions (case_id, prediction, label, ...), as one-row or few-row tables.

All are sums over the predictions, by fold or over all; ``by`` names the columns to report for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def binary_report(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, error (percent), precision, recall, f1; positive means above 0, undefined shares are null."""
    said, true = F.col("prediction") > 0, F.col("label") > 0
    count = lambda x: F.sum(x.cast("bigint"))
    rows = preds.groupBy(*(by or [])).agg(count(said & true).alias("tp"), count(said & ~true).alias("fp"), count(~said & ~true).alias("tn"), count(~said & true).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = rows.withColumns({"error": 100 * _share(fp + fn, tp + fp + tn + fn), "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn)})
    return rows.withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))


def confusion(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return preds.groupBy(*(by or []), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_report(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """label, n, tp, fp, fn, tn, accuracy, precision, recall, f1 of every class; a class that is never predicted has no precision."""
    by = by or []
    cells = confusion(preds, by)
    everything = Window.partitionBy(*by)
    both = cells.select(*by, F.col("label").alias("c"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")).unionByName(
        cells.select(*by, F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("tp"))
    )
    rows = both.groupBy(*by, F.col("c").alias("label")).agg(F.sum("true").alias("n"), F.sum("said").alias("_said"), F.sum("tp").alias("tp")).withColumn("_all", F.sum("n").over(everything))
    rows = rows.withColumns({"fp": F.col("_said") - F.col("tp"), "fn": F.col("n") - F.col("tp")}).withColumn("tn", F.col("_all") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(*by, "label", "n", "tp", "fp", "fn", "tn", ((tp + F.col("tn")) / F.col("_all")).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def multiclass_report(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """error (percent), and precision, recall and f1 as averages over classes: macro, and weighted by class size."""
    rows = class_report(preds, by)
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    names = ("precision", "recall", "f1")
    return rows.groupBy(*(by or [])).agg(
        (100 * (1 - F.sum("tp") / F.sum("n"))).alias("error"), *[F.avg(known(c)).alias(f"macro_{c}") for c in names], *[(F.sum(known(c) * F.col("n")) / F.sum("n")).alias(f"weighted_{c}") for c in names]
    )


def interpretation_error(preds: DataFrame) -> DataFrame:
    """Share of wrong cases in each interpretation, the part of case_id before the last slash."""
    whole = F.regexp_extract("case_id", "^(.*)/[^/]*$", 1)
    return preds.groupBy(whole.alias("interpretation")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("error"))


def regression_report(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mse, rmse, mae, mape (labels above 1e-10 only), r2 (squared correlation)."""
    gap = F.col("prediction") - F.col("label")
    rows = preds.groupBy(*(by or [])).agg(
        F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"),
        F.avg(F.when(F.col("label") > 1e-10, F.abs(gap) / F.col("label"))).alias("mape"), F.pow(F.corr("prediction", "label"), 2).alias("r2"),
    )
    return rows.withColumn("rmse", F.sqrt("mse"))


#: Ranges of margins whose running sums are made side by side.
RANGES = 256


def threshold_counts(preds: DataFrame) -> DataFrame:
    """(prediction, pos, neg, tp, fp): counts at each distinct margin and above; one row a distinct margin.

    Margins are cut into ranges of about equal counts; sums run within each range, and the few totals of
    the ranges above are added, so no task sees all margins.
    """
    at = preds.groupBy("prediction").agg(F.sum((F.col("label") > 0).cast("bigint")).alias("pos"), F.sum((F.col("label") <= 0).cast("bigint")).alias("neg"))
    cuts = at.agg(F.percentile_approx("prediction", [k / RANGES for k in range(1, RANGES)], 10_000).alias("q")).first()[0] or []
    cut = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>")
    at = at.withColumn("_r", F.size(F.filter(cut, lambda x: x < F.col("prediction"))))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy("_r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("_r", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in "pn"])
    down = Window.partitionBy("_r").orderBy(F.desc("prediction")).rowsBetween(Window.unboundedPreceding, 0)
    return at.join(F.broadcast(ranges), "_r").withColumns({"tp": F.col("_p") + F.sum("pos").over(down), "fp": F.col("_n") + F.sum("neg").over(down)}).drop("_r", "_p", "_n")


def auc_roc(preds: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks; ties count half."""
    at = threshold_counts(preds)
    sums = at.agg(F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("lost"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(_share(F.col("p") * F.col("n") - F.col("lost"), F.col("p") * F.col("n")).alias("auc_roc"))


def auc_pr(preds: DataFrame) -> DataFrame:
    """Average precision: precision at each margin, weighted by the recall that it adds."""
    at = threshold_counts(preds)
    sums = at.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("pos").alias("p"))
    return sums.select(_share(F.col("s"), F.col("p")).alias("auc_pr"))


def curves(preds: DataFrame) -> DataFrame:
    """Points of the ROC and precision-recall curves; the two totals come from an aggregate, so no task sees all margins."""
    at = threshold_counts(preds)
    totals = preds.agg(F.sum((F.col("label") > 0).cast("bigint")).alias("_pos"), F.sum((F.col("label") <= 0).cast("bigint")).alias("_neg")).withColumn("_one", F.lit(1))
    points = at.withColumn("_one", (F.col("tp") >= 0).cast("int")).join(F.broadcast(totals), "_one")  # one row
    return points.select("prediction", (F.col("fp") / F.col("_neg")).alias("fpr"), (F.col("tp") / F.col("_pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def fold_summary(reports: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of a long table of measures (measure, value) over folds."""
    return reports.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def differing_parameters(experiments: DataFrame) -> DataFrame:
    """Parameters (experiment, parameter, value) that take more than one value."""
    return experiments.groupBy("parameter").agg(F.sort_array(F.collect_set("value")).alias("values")).filter(F.size("values") > 1)


def induced(preds: DataFrame, threshold: float = 0.0, names: DataFrame | None = None) -> DataFrame:
    """Facts from margins: binary ones above the threshold, or the name of the rounded class."""
    if names is None:
        return preds.filter(F.col("prediction") > threshold).select("case_id")
    return preds.withColumn("code", F.round("prediction")).join(names.select("code", "value"), "code").select("case_id", "value")


def average_cost(preds: DataFrame, loss: Column, weights_norm2: float, lambda_: float) -> DataFrame:
    """Mean loss plus the regulariser."""
    return preds.agg((F.avg(loss) + lambda_ / 2 * weights_norm2).alias("cost"))
