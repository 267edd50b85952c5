import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import learning
from ledgerline.errors import TrainingError
from ledgerline.ml import training as T
from ledgerline.ml.explain import builtin_importance
from ledgerline.ml.features import hold_out, with_folds
from ledgerline.ml.registry import Sizes, algorithms
from tests.conftest import FOLDER

SMALL = Sizes(trees=5, rounds=3, iterations=30, tree_depth=5)


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(0)
    score, age = rng.uniform(0, 100, 120), rng.integers(18, 70, 120)
    rows = [
        (i, float(s), int(a), "abc"[i % 3], int(s > 50)) for i, (s, a) in enumerate(zip(score, age))
    ]
    return spark.createDataFrame(rows, "id long, score double, age int, segment string, target int")


@pytest.fixture(scope="module")
def salaries(spark):
    rng = np.random.default_rng(1)
    years, age = rng.integers(0, 30, 120), rng.integers(20, 65, 120)
    rows = [
        (i, int(y), int(a), "xyz"[i % 3], float(30000 + 1500 * y + n)) for i, (y, a, n) in enumerate(zip(years, age, rng.normal(0, 1000, 120)))
    ]
    return spark.createDataFrame(rows, "id long, experience int, age int, department string, salary double")


def test_classification_run(scores):
    run = T.train_all(scores, "target", "id", only=["LogisticRegression", "RandomForestClassifier"], sizes=SMALL)
    results = {r["algorithm"]: r for r in run.results.collect()}
    assert run.task == "classification" and run.labels == ["0", "1"]
    for r in results.values():
        assert r["status"] == "completed" and r["accuracy"] > 0.7 and r["roc_auc"] > 0.8
        assert r["cv_folds"] == 5 and len(r["cv_scores"]) == 5 and 0 <= r["cv_mean"] <= 1 and r["cv_std"] >= 0
    for name in results:
        assert run.importances[name].first()["feature"] == "score"
        assert run.explain(name).first()["text"].startswith("For predicting target, most weight lies on score")
    assert run.best().count() == 1


def test_regression_run(salaries):
    run = T.train_all(salaries, "salary", "id", only=["LinearRegression", "GradientBoostingRegressor"], sizes=Sizes(5, 30, 30, 5), cross_validate=False)
    results = {r["algorithm"]: r for r in run.results.collect()}
    assert all(r["r2"] > 0.8 and r["rmse"] >= r["mae"] for r in results.values())
    for name in results:
        assert "experience" in [r["feature"] for r in run.importances[name].collect()][:2]


def test_predictions_take_texts_and_unseen_values(spark, scores, tmp_path):
    run = T.train_all(scores, "target", "id", ["score", "segment"], only=["LogisticRegression"], sizes=SMALL, cross_validate=False, explain_models=False)
    path = str(tmp_path / "model")
    T.save_model(run.models["LogisticRegression"], path)
    model = T.load_model(path)
    asked = spark.createDataFrame([("95", "a"), ("3", "never seen"), (None, None)], "score string, segment string")
    rows = T.predict(model, asked, ["score", "segment"]).collect()
    assert [r["predicted_label"] for r in rows[:2]] == ["1", "0"]
    assert all(0.5 <= r["confidence"] <= 1 and sum(r["probabilities"]) == pytest.approx(1) for r in rows)
    with pytest.raises(TrainingError):
        T.predict(model, asked.drop("segment"), ["score", "segment"])


def test_text_labels_and_three_classes(spark, scores):
    df = scores.selectExpr("id", "score", "case when score < 30 then 'low' when score < 70 then 'mid' else 'top' end as band")
    run = T.train_all(df, "band", "id", only=["DecisionTreeClassifier", "GradientBoostingClassifier"], sizes=SMALL, cross_validate=False, explain_models=False)
    assert run.labels == ["low", "mid", "top"]
    assert all(r["status"] == "completed" and r["accuracy"] > 0.7 and r["roc_auc"] > 0.7 for r in run.results.collect())


def test_small_data_has_no_folds(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(15)], "id long, x double, y int")
    run = T.train_all(df, "y", "id", only=["DecisionTreeClassifier"], sizes=SMALL, explain_models=False)
    assert run.results.first()["cv_scores"] is None


def test_one_failure_does_not_stop_the_others(scores, monkeypatch):
    real = algorithms("classification", 2, SMALL)

    def broken():
        raise RuntimeError("cannot fit")

    monkeypatch.setattr(T, "algorithms", lambda *a: {"Broken": broken, "LogisticRegression": real["LogisticRegression"]})
    run = T.train_all(scores, "target", "id", cross_validate=False, explain_models=False)
    rows = {r["algorithm"]: r for r in run.results.collect()}
    assert rows["Broken"]["status"] == "failed" and "cannot fit" in rows["Broken"]["error"]
    assert rows["LogisticRegression"]["status"] == "completed"
    assert run.best().first()["algorithm"] == "LogisticRegression"


def test_the_cause_of_a_failed_fit_is_raised(spark, monkeypatch):
    def broken():
        raise RuntimeError("cannot fit")

    monkeypatch.setattr(T, "algorithms", lambda *a: {"LogisticRegression": broken})
    with pytest.raises(TrainingError, match="LogisticRegression has no result: RuntimeError: cannot fit"):
        learning.predict(spark, FOLDER)


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForestClassifier"])
def test_models_are_applied_in_a_session_that_has_observed_a_query(spark, scores, monkeypatch, name):
    """Cleaning observes its steps; the forest is the trainer's, as for large tables."""
    from pyspark.sql import Observation

    from ledgerline.ml import forests

    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    monkeypatch.setattr(forests, "MOST_CELLS", 1)
    run = T.train_all(scores, "target", "id", only=[name], sizes=SMALL, explain_models=False)
    row = run.results.first()
    assert (row["status"], row["error"], row["cv_folds"]) == ("completed", None, 5)
    assert run.model(name).transform(scores).where("prediction = target").count() > 60


def test_rows_of_one_partition_are_dealt_out(spark):
    df = spark.range(90).selectExpr("id", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS label").coalesce(1)
    made = T._prepare(df, df, ["x"], [], ["id", "features", "label"], 3)
    for side in (made.fit, made.held):
        assert side.select(F.input_file_name()).distinct().count() == 3
        assert sorted(r["id"] for r in side.collect()) == list(range(90))


def test_status_is_read_while_the_run_goes_on(spark, scores, tmp_path, monkeypatch):
    from ledgerline.ml import status

    path = str(tmp_path / "status")
    seen = {}
    real = algorithms("classification", 2, SMALL)

    def looking():
        # Another session, in the middle of a fit.
        rows = status.run_status(spark.newSession(), path).collect()
        seen.update({r["algorithm"]: r["status"] for r in rows})
        return real["LogisticRegression"]()

    def broken():
        raise RuntimeError("cannot fit")

    monkeypatch.setattr(T, "algorithms", lambda *a: {"Broken": broken, "LogisticRegression": looking})
    log = status.RunLog(spark, path)
    T.train_all(scores, "target", "id", cross_validate=False, explain_models=False, log=log, parallel=1)
    assert seen == {"Broken": "failed", "LogisticRegression": "running"}
    last = {r["algorithm"]: r for r in status.run_status(spark, path).collect()}
    assert last["LogisticRegression"]["status"] == "completed" and last["LogisticRegression"]["run"] == log.run
    assert last["Broken"]["status"] == "failed" and "cannot fit" in last["Broken"]["error"]
    steps = [r["status"] for r in status.history(spark, path).where("algorithm = 'LogisticRegression'").orderBy("at", "nth").collect()]
    assert steps == ["pending", "running", "completed"]


def test_too_many_classes_are_refused(spark):
    df = spark.range(1200).selectExpr("id", "id % 7 AS x", "concat('name ', id) AS y")
    with pytest.raises(TrainingError, match="too many for classes"):
        T.train_all(df, "y", "id", only=["LogisticRegression"])


def all_subsets(nodes, x):
    """Shapley values of one row by every subset of features, where a feature that is unknown follows the training rows."""
    import itertools
    import math

    def expected(i, known):
        below, above, feature, threshold, cover, value = nodes[i]
        if below < 0:
            return value
        if feature in known:
            return expected(below if x[feature] <= threshold else above, known)
        return (nodes[below][4] * expected(below, known) + nodes[above][4] * expected(above, known)) / cover

    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        for m in range(n):
            for others in itertools.combinations([j for j in range(n) if j != i], m):
                weight = math.factorial(m) * math.factorial(n - m - 1) / math.factorial(n)
                out[i] += weight * (expected(0, {*others, i}) - expected(0, set(others)))
    return out


@pytest.mark.parametrize("algorithm", ["RandomForestRegressor", "GradientBoostingRegressor"])
def test_tree_attributions_are_exact(spark, salaries, algorithm):
    """Equal to all subsets of features on the trees of a fitted model, and adding up to its output."""
    from pyspark.ml.functions import vector_to_array

    from ledgerline.ml import trees

    run = T.train_all(salaries, "salary", "id", only=[algorithm], sizes=Sizes(3, 3, 30, 4), cross_validate=False, explain_models=False)
    model = run.models[algorithm]
    rows = model.transform(salaries.limit(6)).select(vector_to_array("features").alias("x"), "prediction").collect()
    x = np.array([r["x"] for r in rows])
    nodes = trees.node_table(model.stages[-1], spark).orderBy("tree", "id").collect()
    phi, base = np.zeros(x.shape), 0.0
    for tree in sorted({r["tree"] for r in nodes}):
        own = [(r["below"], r["above"], r["feature"], r["threshold"], r["cover"], r["value"][0]) for r in nodes if r["tree"] == tree]
        columns = [np.array([n[k] for n in own]) for k in range(6)]
        part = np.zeros(x.shape)
        for code, values in trees.tree_values(*columns[:5], columns[5][:, None], x):
            part[:, code] += values
        assert np.allclose(part, [all_subsets(own, row) for row in x])
        phi += part
        leaves = columns[0] < 0
        base += (columns[4][leaves] * columns[5][leaves]).sum() / columns[4][0]
    assert np.allclose(phi.sum(axis=1) + base, [r["prediction"] for r in rows])


def test_builtin_importance(spark, scores):
    run = T.train_all(scores, "target", "id", ["score", "age"], only=["DecisionTreeClassifier"], sizes=SMALL, cross_validate=False, explain_models=False)
    tree = run.models["DecisionTreeClassifier"].stages[-2]
    got = {r["feature"]: r["importance"] for r in builtin_importance(tree, spark, ["score", "age"]).collect()}
    assert got["score"] > got["age"]


@pytest.mark.parametrize(
    "name",
    ["train_classification", "train_regression", "train_multiclass", "cross_validation", "importance_linear", "importance_trees", "explanation", "predict"],
)
def test_queries_train_at_full_size(spark, monkeypatch, name):
    asked, real = [], inspect.signature(T.train_all)

    def spy(*args, **more):
        call = real.bind(*args, **more)
        call.apply_defaults()
        asked.append((call.arguments["sizes"], call.arguments["cross_validate"]))
        raise InterruptedError

    monkeypatch.setattr(T, "train_all", spy)
    with pytest.raises(InterruptedError):
        getattr(learning, name)(spark, FOLDER)
    # Folds are left out only where no column returned depends on them.
    folds = name.startswith("train") or name == "cross_validation"
    assert asked == [(Sizes(trees=200, rounds=100, iterations=1000, tree_depth=30), folds)]


def test_forest_of_full_size(salaries):
    run = T.train_all(salaries, "salary", "id", only=["RandomForestRegressor"], cross_validate=False, explain_models=False)
    forest = run.models["RandomForestRegressor"].stages[-1]
    assert forest.getNumTrees == 200 and forest.getOrDefault("maxDepth") == 30
    row = run.results.first()
    assert row["status"] == "completed" and row["r2"] > 0.8


@pytest.mark.parametrize("features", [["nope"], ["target"]])
def test_bad_features(scores, features):
    with pytest.raises(TrainingError):
        T.train_all(scores, "target", "id", features)


def test_all_missing_target(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id long, x double, y string")
    with pytest.raises(TrainingError):
        T.train_all(df, "y", "id")


def test_split_is_exact_per_class_with_a_dominant_class(spark):
    df = spark.createDataFrame([(i, "common" if i >= 50 else "rare") for i in range(1000)], "id long, y string")
    got = {(r["y"], r["is_test"]): r["count"] for r in hold_out(df, "id", "y").groupBy("y", "is_test").count().collect()}
    assert got == {("common", True): 190, ("common", False): 760, ("rare", True): 10, ("rare", False): 40}
    folds = with_folds(df, "id", 5, "y").groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {("common", 190), ("rare", 10)} and len(folds) == 10


def test_split_keeps_a_lone_row_for_training(spark):
    df = spark.createDataFrame([(1, "lone"), (2, "b"), (3, "b"), (4, "b")], "id long, y string")
    assert [r["is_test"] for r in hold_out(df, "id", "y").where("y = 'lone'").collect()] == [False]


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_forests_are_grown_by_the_tasks(spark, scores, salaries, tmp_path, task):
    """As good as Spark's trainer on the rows left out, with the same nodes after saving; larger tables go to the trainer."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    from ledgerline.ml import forests

    if task == "regression":
        df, numeric, texts, y, name = salaries, ["experience", "age"], ["department"], "salary", "RandomForestRegressor"
        judge = RegressionEvaluator(metricName="r2")
    else:
        df, numeric, texts, y, name = scores, ["score", "age"], ["segment"], "target", "RandomForestClassifier"
        judge = MulticlassClassificationEvaluator(metricName="accuracy")
    stages, _ = T.fit_features(df, numeric, texts)
    rows = T.settle(stages.transform(df).select("id", "features", F.col(y).cast("double").alias("label")), "rows")
    fit, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    forest = algorithms(task, 2, Sizes(trees=100))[name]()
    model, theirs = forest.fit(fit), forest.trainer.fit(fit)
    assert isinstance(model, forests.ForestModel) and model.nodes.select("tree").distinct().count() == 100
    ours, trainers = judge.evaluate(model.transform(held)), judge.evaluate(theirs.transform(held))
    assert ours > 0.8 and abs(ours - trainers) < 0.08
    assert np.allclose(model.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.1)
    model.write().save(str(tmp_path / "forest"))
    again = forests.ForestModel.load(str(tmp_path / "forest"))
    one, two = (m.transform(held).orderBy("id").select("id", "prediction").collect() for m in (model, again))
    assert one == two and len(one) == 30


def test_large_tables_and_bad_labels_go_to_the_trainer(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from ledgerline.ml import forests

    rows = [(Vectors.dense([float(i)]), float(i % 2)) for i in range(20)]
    forest = algorithms("regression", sizes=SMALL)["RandomForestRegressor"]()
    with pytest.raises(Exception, match="NaN"):
        forest.fit(spark.createDataFrame([*rows, (Vectors.dense([1.0]), float("nan"))], ["features", "label"]))
    monkeypatch.setattr(forests, "MOST_CELLS", 19)
    assert not isinstance(forest.fit(spark.createDataFrame(rows, ["features", "label"])), forests.ForestModel)


@pytest.mark.parametrize("classes", [0, 3])
def test_grown_splits_are_the_best(classes):
    """With all slots to choose from, every node has the gain that trying every bound on its rows finds, or none is left."""
    from ledgerline.ml import forests

    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=200), rng.integers(0, 2, 200), rng.integers(0, 5, 200) - 2.0], axis=1)
    y = rng.integers(0, 3, 200) if classes else rng.normal(size=200) + x[:, 0]
    bounds = [forests.bin_bounds(*np.unique(x[:, 0], return_counts=True), 8), np.array([0.5]), np.array([-1.5, -0.5, 0.5, 1.5])]
    assert len(bounds[0]) <= 7
    grower = forests.Grower(bounds, classes, 4, 3, 7)
    at, slots = np.nonzero(x)
    sizes = np.bincount(at, minlength=200)
    made = grower.grow(0, sizes, grower.codes(slots, x[at, slots]), y, np.array([120, 80]))
    weight = np.concatenate([np.random.default_rng([7, 0, 1, i]).poisson(1.0, n) for i, n in enumerate((120, 80))])

    def spread(on):
        if not weight[on].sum():
            return 0.0
        if classes:
            n = np.bincount(y[on], weight[on], classes)
            return n.sum() - (n**2).sum() / n.sum()
        return (weight[on] * (y[on] - np.average(y[on], weights=weight[on])) ** 2).sum()

    seen, todo = 0, [(0, weight > 0)]
    while todo:
        node, on = todo.pop()
        seen += 1
        assert made["cover"][node] == weight[on].sum()
        mean = np.bincount(y[on], weight[on], classes) / weight[on].sum() if classes else [np.average(y[on], weights=weight[on])]
        assert np.allclose(made["value"][node], mean)
        if made["below"][node] >= 0:
            best = max(spread(on) - spread(on & (x[:, s] <= t)) - spread(on & (x[:, s] > t)) for s in range(3) for t in bounds[s])
            low = x[:, made["feature"][node]] <= made["threshold"][node]
            assert made["gain"][node] == pytest.approx(best) and best > 0
            assert spread(on) - spread(on & low) - spread(on & ~low) == pytest.approx(best)
            todo += [(made["below"][node], on & low), (made["above"][node], on & ~low)]
    assert seen == len(made["below"]) > 10


@pytest.mark.parametrize("tasks", [1, 4])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosted_trees_are_the_trainers(spark, monkeypatch, tmp_path, classes, tasks):
    """Predictions, margins and importances are those of Spark's trainer but for ties, from one task or several, and after saving."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from ledgerline.ml import boosting, forests

    rng = np.random.default_rng(classes)
    x = np.stack([rng.normal(size=500), rng.integers(0, 2, 500), rng.integers(0, 6, 500) - 2.0, rng.uniform(5, 9, 500), np.full(500, 4.0)], axis=1)
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=500) + 1000
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes))
    rows = [(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", "features", "label"]).repartition(4).cache()
    monkeypatch.setattr(forests, "BLOCK_ROWS", 40)
    if tasks > 1:
        monkeypatch.setattr(boosting, "TASK_VALUES", 100)
        monkeypatch.setattr(boosting, "WHOLE_CELLS", 100)
    settled = []
    monkeypatch.setattr(boosting, "settle", lambda t, label: settled.append(t) or T.settle(t, label))
    profile, task = ("DeepBoosting", "GradientBoosting")[tasks > 1], ("Classifier" if classes else "Regressor")
    fit = algorithms("classification" if classes else "regression", classes, Sizes(rounds=6))[profile + task]()
    model, theirs = fit.fit(df), fit.whole.fit(df)
    assert isinstance(model, boosting.BoostedModel) and settled[-1].rdd.getNumPartitions() == tasks
    shown = "prediction" if not classes else "rawPrediction"

    def told(m):
        out = m.transform(df).orderBy("id")
        return np.array([r[0] for r in out.select("prediction" if not classes else vector_to_array(shown)).collect()]), [r[0] for r in out.select("prediction").collect()]

    (ours, best), (trainers, theirs_best) = told(model), told(theirs)
    # Many rows of a class have one residual, so several splits are equally good; rounding tells which of them is taken.
    assert np.mean(np.abs(ours - trainers)) < 0.02 if classes else np.allclose(ours, trainers)
    assert np.mean(~np.isclose(best, theirs_best)) <= (0.02 if classes else 0)
    weights = [m.featureImportances.toArray() for m in getattr(theirs, "models", [theirs])]
    assert np.allclose(model.featureImportances.toArray(), np.mean(weights, axis=0), atol=0.05 if classes or tasks == 1 else 1e-8)
    if classes == 2:
        chances = [[[c for c in r[0]] for r in m.transform(df).orderBy("id").select("probability").collect()] for m in (model, theirs)]
        assert np.mean(np.abs(np.subtract(*chances))) < 0.02
    model.write().save(str(tmp_path / "boosted"))
    assert (told(boosting.BoostedModel.load(str(tmp_path / "boosted")))[0] == ours).all()


def test_very_large_tables_are_boosted_by_the_trainer(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from ledgerline.ml import boosting

    df = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 2)) for i in range(20)], ["features", "label"])
    fit = algorithms("regression", sizes=SMALL)["GradientBoostingRegressor"]()
    assert isinstance(fit.fit(df), boosting.BoostedModel)
    monkeypatch.setattr(boosting, "MOST_TASK_VALUES", 5)
    assert not isinstance(fit.fit(df), boosting.BoostedModel)


def test_a_million_values_are_boosted_in_one_task(spark, monkeypatch):
    """Tasks of one fit wait a second for each other at every level; small models are applied without a shuffle."""
    from pyspark.ml.feature import VectorAssembler

    from ledgerline.ml import boosting
    from tests.conftest import plan_text

    rows = spark.range(600_000).selectExpr("CAST(id % 7 AS DOUBLE) a", "CAST(id % 5 - 9 AS DOUBLE) b", "CAST(id % 3 + 1 AS DOUBLE) c")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).withColumn("label", F.expr("10 * a + b"))
    settled = []
    monkeypatch.setattr(boosting, "settle", lambda t, label: settled.append(t) or T.settle(t, label))
    model = algorithms("regression", sizes=Sizes(rounds=2))["DeepBoostingRegressor"]().fit(df)
    assert isinstance(model, boosting.BoostedModel) and settled[-1].rdd.getNumPartitions() == 1
    out = model.transform(df.limit(50))
    assert np.allclose([r["prediction"] for r in out.collect()], [r["label"] for r in out.collect()])
    assert "Exchange" not in plan_text(model.transform(df.drop("label")))


@pytest.mark.parametrize("sizes", [[2, 0, 3, 1, 3], [0, 0], [1, 1, 1], []])
def test_codes_by_place_are_those_of_the_rows(sizes):
    from ledgerline.ml.forests import columns_of

    sizes = np.array(sizes, int)
    code = np.arange(sizes.sum())
    order, columns = columns_of(sizes, code)
    rows = [code[a : a + n].tolist() for a, n in zip(np.cumsum(sizes) - sizes, sizes)]
    assert [[c[i] for c in columns if i < len(c)] for i in range(len(order))] == [rows[o] for o in order]


@pytest.mark.parametrize("classes", [0, 2])
def test_rows_are_sent_to_the_trees_as_codes(spark, monkeypatch, classes):
    """The blocks that every group of trees gets have two bytes a listed value; read again, they are the rows' codes."""
    from pyspark.ml.linalg import Vectors

    from ledgerline.ml import forests

    rows = [(Vectors.dense([i % 9 - 4.0, float(i % 2), 0.0]), float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    seen = []
    monkeypatch.setattr(forests, "settle", lambda t, label: seen.append((label, t)) or T.settle(t, label))
    forest = algorithms("classification" if classes else "regression", classes, SMALL)["RandomForestClassifier" if classes else "RandomForestRegressor"]()
    model = forest.fit(df)
    assert isinstance(model, forests.ForestModel)
    packed = dict(seen)["packed"]
    assert packed.columns == ["block", "sizes", "codes", "ys"]
    grower = forests.Grower([np.arange(-3.5, 4), np.array([0.5]), np.array([0.5])], classes, 5, 2, 1)
    block = packed.toArrow().to_batches()
    sizes, code, y, blocks = forests.read_packed(block, grower)
    x = np.array([r[0].toArray() for r in rows])
    at, slots = np.nonzero(x)
    assert code.dtype == np.uint16 and blocks.tolist() == [50]
    assert (code == grower.codes(slots, x[at, slots])).all() and (sizes == np.bincount(at, minlength=50)).all() and (y == [r[1] for r in rows]).all()


def test_attributions_are_computed_once(spark, salaries):
    """The number of outputs comes from the kept values, not from a second run of the trees."""
    from ledgerline.ml.trees import tree_shapley
    from tests.conftest import plan_text

    run = T.train_all(salaries, "salary", "id", ["experience", "age"], only=["RandomForestRegressor"], sizes=SMALL, cross_validate=False, explain_models=False)
    stages = run.model("RandomForestRegressor").stages
    rows = salaries
    for stage in stages[:-1]:
        rows = stage.transform(rows)
    told = tree_shapley(stages[-1], rows, ["experience", "age"])
    assert "MapInArrow" not in plan_text(told)
    found = {r["feature"]: r["importance"] for r in told.collect()}
    assert found["experience"] > found["age"] > 0


@pytest.mark.parametrize("name", ["RandomForestRegressor", "RandomForestClassifier"])
def test_forests_of_six_million_rows_stay_off_the_driver(spark, monkeypatch, name):
    """6,000,000 rows of 200 slots and 24,000,000 listed values; Spark's trainer holds all nodes in the driver."""
    from pyspark.ml.linalg import Vectors

    from ledgerline.ml import forests

    df = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 2)) for i in range(20)], ["features", "label"])
    classes = 2 if "Classifier" in name else 0
    monkeypatch.setattr(forests, "measures", lambda t: (6_000_000, 200, 24_000_000, 0))
    monkeypatch.setattr(forests, "bounds_of", lambda *a: [np.array([9.5])] + [np.array([0.5])] * 199)
    model = algorithms("classification" if classes else "regression", classes, SMALL)[name]().fit(df)
    assert isinstance(model, forests.ForestModel) and model.nodes.select("tree").distinct().count() == 5
