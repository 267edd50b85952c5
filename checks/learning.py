"""Training, explaining and applying models on whole tables."""

from checks.registry import query, table as t
from ledgerline.ml import explain as X, features as Fe, training as T
from ledgerline.ml.registry import algorithms
from ledgerline.operators.metrics import share_of_total
from ledgerline.operators.roles import split_features
from ledgerline.runtime import scratch_path
from pyspark.sql import functions as F

_KEY = "CAST('0x' || substr(md5(CAST({id} AS VARCHAR) || ':{salt}'), 1, 15) AS BIGINT)"


@query(
    "ml_split_stratified",
    f"""SELECT o_orderkey, o_orderstatus, rn <= CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS is_test FROM (
    SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEY.format(id='o_orderkey', salt='42')}) AS rn,
    count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def split_stratified(spark, d):
    return Fe.hold_out(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(
    "ml_split_plain",
    f"""SELECT o_orderkey, rn <= CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS is_test FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY {_KEY.format(id='o_orderkey', salt='42')}) AS rn, count(*) OVER () AS n FROM orders)""",
)
def split_plain(spark, d):
    return Fe.hold_out(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "ml_folds",
    f"""SELECT o_orderkey, o_orderstatus, CAST((rn > floor(n * 0.2 + 0.5))::INT + (rn > floor(n * 0.4 + 0.5))::INT + (rn > floor(n * 0.6 + 0.5))::INT
      + (rn > floor(n * 0.8 + 0.5))::INT AS INTEGER) AS fold FROM (
    SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEY.format(id='o_orderkey', salt='fold')}) AS rn,
    count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def folds(spark, d):
    return Fe.with_folds(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, "o_orderstatus")


def described(spark, d):
    """Every document with a few plain measurements of the whole text, and its quality label where it has one."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    words = F.size(F.split("text", r"\s+"))
    return docs.select(
        "doc_id", "lang", "n_chars", words.alias("n_words"),
        (F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.col("n_chars")).alias("digit_share"),
        F.size(F.split("text", "\n")).alias("n_lines"), "quality",
    )


def parts(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").withColumn(
        "cost", F.expr("p_retailprice * (1 + p_size / 100) + pmod(p_partkey * 37, 11)")
    )


def _results(run):
    return run.results.drop("training_time_seconds", "error")


def _beaten(run, score, least):
    """Each algorithm with its status and folds, and whether it beats the plainest guess, on the rows held out and on average over the folds."""
    return run.results.select(
        "ordinal", "algorithm", "task_type", "status", "error", "cv_folds", (F.col(score) > least).alias("better"), (F.col("cv_mean") > least).alias("better_in_folds")
    )


def _beaten_sql(task, *algorithms):
    rows = ", ".join(f"({i}::BIGINT, '{a}', '{task}', 'completed', CAST(NULL AS VARCHAR), 5::BIGINT, true, true)" for i, a in enumerate(algorithms))
    return f"SELECT * FROM (VALUES {rows}) v(ordinal, algorithm, task_type, status, error, cv_folds, better, better_in_folds)"


def labelled(spark, d):
    return described(spark, d).where("quality is not null")


@query("ml_train_classification")
def train_classification(spark, d):
    return _results(T.train_all(labelled(spark, d), "quality", "doc_id"))


@query(
    "ml_train_regression",
    _beaten_sql("regression", "LinearRegression", "RandomForestRegressor", "GradientBoostingRegressor", "DeepBoostingRegressor"),
)
def train_regression(spark, d):
    """The mean explains nothing: its R² is 0."""
    return _beaten(T.train_all(parts(spark, d), "cost", "p_partkey"), "r2", F.lit(0.0))


@query(
    "ml_train_multiclass",
    _beaten_sql("classification", "LogisticRegression", "DecisionTreeClassifier", "RandomForestClassifier", "GradientBoostingClassifier", "DeepBoostingClassifier"),
)
def train_multiclass(spark, d):
    """The most frequent class is right in its share of the rows."""
    rows = t(spark, d, "customer").withColumn("band", F.expr("CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END"))
    run = T.train_all(rows, "band", "c_custkey", ["c_acctbal", "c_mktsegment", "c_nationkey"], explain_models=False)
    share = rows.groupBy("band").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return _beaten(run, "accuracy", share)


@query("ml_cross_validation")
def cross_validation(spark, d):
    run = T.train_all(parts(spark, d), "cost", "p_partkey", only=["LinearRegression", "GradientBoostingRegressor"], explain_models=False)
    return _results(run).select("algorithm", "status", "r2", "cv_folds", "cv_scores", "cv_mean", "cv_std")


def _explained(spark, d, algorithm):
    # No column of the attributions depends on the folds.
    return T.train_all(parts(spark, d), "cost", "p_partkey", only=[algorithm], cross_validate=False)


@query("ml_importance_linear")
def importance_linear(spark, d):
    return _explained(spark, d, "LinearRegression").importance("LinearRegression")


@query("ml_importance_trees")
def importance_trees(spark, d):
    return _explained(spark, d, "RandomForestRegressor").importance("RandomForestRegressor")


@query("ml_explanation")
def explanation(spark, d):
    return _explained(spark, d, "LinearRegression").explain("LinearRegression")


@query("ml_predict")
def predict(spark, d):
    docs = described(spark, d)
    run = T.train_all(docs.where("quality is not null"), "quality", "doc_id", only=["LogisticRegression"], cross_validate=False, explain_models=False)
    path = scratch_path(spark, "model")
    T.save_model(run.model("LogisticRegression"), path)
    return T.predict(T.load_model(path), docs.drop("quality"), ["lang", "n_chars", "n_words", "digit_share", "n_lines"])


@query(
    "ml_prepared_features",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS size FROM part),
    f AS (SELECT p_partkey, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM r)) AS size FROM r)
    SELECT p_partkey, round((size - (SELECT avg(size) FROM f)) / (SELECT stddev_samp(size) FROM f), 4) AS scaled FROM f""",
)
def prepared(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = t(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS size")
    numeric, categorical = split_features(rows, ["size"])
    prep, _ = Fe.fit_features(rows, numeric, categorical)
    return prep.transform(rows).select("p_partkey", F.round(F.get(vector_to_array("features"), F.lit(0)), 4).alias("scaled"))


_SEGMENT = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END"


@query(
    "ml_prepared_categories",
    f"""WITH r AS (SELECT c_custkey, {_SEGMENT} AS seg FROM customer), f AS (SELECT seg FROM r WHERE seg IS NOT NULL AND seg <> 'BUILDING'),
    v AS (SELECT seg, row_number() OVER (ORDER BY seg) AS place FROM (SELECT DISTINCT seg FROM f)), m AS (SELECT seg FROM f GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)
    SELECT c_custkey, string_agg(CASE WHEN coalesce(r.seg, (SELECT seg FROM m)) = v.seg THEN '1' ELSE '0' END, '' ORDER BY place) AS slots FROM r, v GROUP BY c_custkey""",
)
def prepared_categories(spark, d):
    """Gaps take the most frequent training value; a value that the training rows lack has no slot."""
    from pyspark.ml.functions import vector_to_array

    rows = t(spark, d, "customer").selectExpr("c_custkey", f"{_SEGMENT} AS seg")
    prep, _ = Fe.fit_features(rows.where("seg IS NULL OR seg <> 'BUILDING'"), [], ["seg"])
    slots = F.transform(vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return prep.transform(rows).select("c_custkey", F.array_join(slots, "").alias("slots"))


@query(
    "ml_feature_names",
    """SELECT 0::BIGINT AS ordinal, 'c_acctbal' AS feature FROM customer HAVING count(*) > 0 UNION ALL SELECT 1, 'c_nationkey' FROM customer HAVING count(*) > 0
    UNION ALL SELECT 1 + row_number() OVER (ORDER BY s), 'c_mktsegment_' || s FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)""",
)
def feature_names(spark, d):
    _, names = Fe.fit_features(t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    return spark.createDataFrame(list(enumerate(names)), "ordinal long, feature string")


@query(
    "ml_builtin_importance",
    """WITH w AS (SELECT 'l_quantity' AS feature, round(2 * stddev_samp(l_quantity), 6) AS importance FROM lineitem
    UNION ALL SELECT 'l_discount', round(300 * stddev_samp(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(40 * stddev_samp(l_tax), 6) FROM lineitem)
    SELECT feature, importance, round(importance / (SELECT sum(importance) FROM w) * 100, 2) AS importance_pct FROM w""",
)
def builtin_importance(spark, d):
    """The coefficients of a target that is an exact sum, each for a step of one deviation."""
    lines = t(spark, d, "lineitem").withColumn("label", F.expr("2 * l_quantity - 300 * l_discount + 40 * l_tax"))
    prep, names = Fe.fit_features(lines, ["l_quantity", "l_discount", "l_tax"], [])
    model = algorithms("regression")["LinearRegression"]().fit(prep.transform(lines).select("features", "label"))
    return share_of_total(X.builtin_importance(model, spark, names))


@query("ml_sample_rows", f"SELECT * FROM orders ORDER BY {_KEY.format(id='o_orderkey', salt='sample')}, o_orderkey LIMIT 100")
def sample_rows(spark, d):
    return X.sample_rows(t(spark, d, "orders"), "o_orderkey", X.EXPLAINED_ROWS)
