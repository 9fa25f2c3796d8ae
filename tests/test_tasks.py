import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.config import KernelOptions
from factloom.operators import tasks
from factloom.plans.dataset import Dataset
from factloom.schema import Domain, SchemaError

KERNEL = KernelOptions(match_type="soft", radius=0, distance=0)


@pytest.fixture(scope="module")
def data(spark):
    people, visits = [], []
    for ex in range(4):
        for k in range(6):
            color = ["blue", "green", "red"][k % 3]
            people.append((str(ex), f"p{k}", color, float(k % 3)))
            visits.append((str(ex), f"p{k}", "t", {"blue": "calm", "green": "glad", "red": "wild"}[color], 2.0 + 3 * (k % 3)))
    d = Domain().entity("person", "person_id:self", "color:property", "age:property").entity("town", "town_id:self").relationship("visit", "person:person", "town:town", "mood:property", "score:property").close(["person", "town"])
    given = {
        "person": spark.createDataFrame(people, "ex string, person_id string, color string, age double"), "town": spark.createDataFrame([(str(k), "t") for k in range(4)], "ex string, town_id string"),
        "visit": spark.createDataFrame([*visits, ("0", "p0", "t", None, None)][:-1] + [("3", "p5", "t", None, None)], "ex string, person string, town string, mood string, score double").filter("not (ex = '3' and person = 'p5' and mood is not null)"),
    }
    return Dataset(d, given)


def test_tasks_of_a_target(data):
    assert {t.column: (t.kind, t.classes) for t in data.tasks("visit")} == {"mood": ("multiclass", ("calm", "glad", "wild")), "score": ("regression", ())}
    with pytest.raises(ValueError, match="several"):
        data.kfold("visit", 2, KERNEL)
    with pytest.raises(ValueError, match="none"):
        data.kfold("visit", 2, KERNEL, column="nowhere")
    with pytest.raises(ValueError, match="multiclass"):
        data.kfold("visit", 2, KERNEL, "svm_sgd", column="mood")


def test_properties_are_learned_from_one_table_of_features(data, monkeypatch, tmp_path):
    made, features = [], Dataset.features
    monkeypatch.setattr(Dataset, "features", lambda self, *a: (made.append(1), features(self, *a))[1])
    folds = data.folds(2)
    found = data.kfold_tasks("visit", 2, KERNEL, folds=folds, lambda_=0.001)
    assert made == [1]
    mood, score = found["mood"].collect(), found["score"].collect()
    assert len(mood) == len(score) == 23  # the visit without values is no case
    assert all(r.prediction == r.label for r in mood) and all(abs(r.prediction - r.label) < 0.6 for r in score)

    kinds = {t.column: t for t in data.tasks("visit")}
    log = tasks.prediction_log(found["mood"], kinds["mood"]).collect()
    assert {r.label for r in log} == {"calm", "glad", "wild"} and all(r.label == r.said for r in log)
    path = str(tmp_path / "results")
    data.write_results(found["mood"], kinds["mood"], folds, path)
    assert {p.name for p in Path(path, "predictions").glob("fold=*")} == {"fold=0", "fold=1"}
    assert {p.name for p in Path(path, "targets", "fold=1").iterdir()} == {"part=train", "part=test"}
    whole = [json.loads(line) for f in Path(path, "evaluation", "fold=-1").glob("*.json") for line in f.read_text().splitlines()]
    assert len(whole) == 1 and whole[0]["error"] == 0.0 and whole[0]["macro_f1"] == 1.0


def test_two_classes_and_existence(spark, data):
    t = tasks.Task("visit", "x", "binary", ("no", "yes"))
    assert t.codes() == [-1.0, 1.0]
    rows = spark.createDataFrame([(0, "a", 1.0, 0.3), (0, "b", -1.0, 0.2), (1, "c", -1.0, -2.0)], "fold int, case_id string, label double, prediction double")
    assert [(r.label, r.said) for r in tasks.prediction_log(rows, t).orderBy("case_id").collect()] == [("yes", "yes"), ("no", "yes"), ("no", "no")]
    assert {r.fold: (r.tp, r.fp, r.tn) for r in tasks.report(rows, t, ["fold"]).collect()} == {0: (1, 1, 0), 1: (0, 0, 1)}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tasks, "MOST_CLASSES", 2)
        with pytest.raises(SchemaError, match="more than 2 classes"):
            data.tasks("visit")


def test_a_target_without_properties_is_about_existence(spark):
    d = Domain().entity("person", "person_id:self", "kind:property").relationship("likes", "a:person@x", "b:person@y").close(["person"])
    people = [(str(ex), f"p{k}", "ab"[k % 2]) for ex in range(2) for k in range(4)]
    likes = [(str(ex), f"p{i}", f"p{j}") for ex in range(2) for i in range(4) for j in range(4) if i % 2 == 0 and j % 2 == 1]
    given = {"person": spark.createDataFrame(people, "ex string, person_id string, kind string"), "likes": spark.createDataFrame(likes, "ex string, a string, b string")}
    found = Dataset(d, given).kfold("likes", 2, KERNEL, reject=F.col("case_id").endswith("p0/p0"), lambda_=0.01).collect()
    assert len(found) == 32 and sum(r.label > 0 for r in found) == 8
