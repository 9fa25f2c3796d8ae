"""Tasks of a target by the kind of its labels: codes, model and report for the existence of tuples and for each property."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Domain, SchemaError
from . import cases as case_ops
from . import metrics

#: Classes of a property; their names go into plans.
MOST_CLASSES = 1000
#: The model of each kind where the caller names none.
MODELS = {"binary": "svm_sgd", "multiclass": "svm_sgd_mc", "regression": "ols_sgd"}


@dataclass(frozen=True)
class Task:
    """``column`` is a property of the target, or empty for the existence of its tuples; ``classes`` are in the order of their codes."""

    target: str
    column: str
    kind: str
    classes: tuple[str, ...] = ()

    def codes(self) -> list[float]:
        """The label of each class: -1 and 1 of two, 1, 2, 3 and so on of more."""
        return [-1.0, 1.0] if self.kind == "binary" else [float(k) for k in range(1, len(self.classes) + 1)]

    def names(self, code):
        """The class of a label or prediction (a margin, of two classes) as a column."""
        if self.kind == "regression":
            return code.cast("string")
        if self.kind == "binary":
            no, yes = self.classes or ("-1", "1")
            return F.when(code > 0, yes).otherwise(no)
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), code.cast("int"))


def tasks(domain: Domain, tables: dict[str, DataFrame], target: str) -> list[Task]:
    """One task a property, or the one of a target without properties."""
    out = []
    for column, kind in case_ops.task_of(domain, tables, target).items():
        classes: tuple[str, ...] = ()
        if column and kind != "regression":
            found = [r[0] for r in tables[target].filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(MOST_CLASSES + 1).collect()]
            if len(found) > MOST_CLASSES:
                raise SchemaError(f"{target}.{column} has more than {MOST_CLASSES} classes")
            classes = tuple(found)
        out.append(Task(target, column, kind, classes))
    return out


def labelled(domain: Domain, tables: dict[str, DataFrame], task: Task, cases: DataFrame) -> DataFrame:
    """Cases with the label of a task; of a property, those that have a value. ``cases`` are candidates of the target."""
    if not task.column:
        return case_ops.existence_labels(domain, tables, task.target, cases)
    rows = case_ops.property_labels(domain, tables, task.target, cases, task.column)
    if task.kind == "regression":
        return rows.withColumn("label", F.col("value").cast("double")).drop("value")
    codes = F.create_map(*[F.lit(x) for pair in zip(task.classes, task.codes(), strict=True) for x in pair])
    return rows.withColumn("label", codes[F.col("value").cast("string")]).drop("value")


def report(preds: DataFrame, task: Task, by: list[str] | None = None) -> DataFrame:
    kind = {"binary": metrics.binary_report, "multiclass": metrics.multiclass_report, "regression": metrics.regression_report}
    return kind[task.kind](preds, by)


def prediction_log(preds: DataFrame, task: Task) -> DataFrame:
    """(fold, case_id, label, said, prediction): the classes by name, and the margin or number itself."""
    return preds.select("fold", "case_id", task.names(F.col("label")).alias("label"), task.names(F.col("prediction")).alias("said"), "prediction")


def write_results(preds: DataFrame, task: Task, folds: DataFrame, path: str) -> None:
    """Per-fold files: ``predictions`` with class names, ``targets`` (which interpretations trained and tested), ``evaluation`` of each fold and of all (fold -1)."""
    from ..sources.sinks import fold_lists

    prediction_log(preds, task).write.partitionBy("fold").json(f"{path}/predictions")
    fold_lists(folds).write.partitionBy("fold", "part").json(f"{path}/targets")
    whole = report(preds, task).withColumn("fold", F.lit(-1))
    report(preds, task, ["fold"]).unionByName(whole).write.partitionBy("fold").json(f"{path}/evaluation")
