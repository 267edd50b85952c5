"""Model quality from a table of labels, predictions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.errors import AnalyticsError
from ledgerline.functions import ranks, values as V
from ledgerline.functions.stats import total

# Classes of a confusion table that is shown in full.
SHOWN_CLASSES = 1000


def label_union(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label): every value seen as truth or as prediction."""
    return df.select(V.ref(label).alias("label")).union(df.select(V.ref(prediction))).distinct().where("label is not null")


def confusion_pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, c) of the pairs that occur, nulls included."""
    return df.groupBy(V.ref(label).alias("label"), V.ref(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("c"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, count) over the square of the label set, absent pairs 0: a table to look at.

    More than SHOWN_CLASSES labels are refused; ``confusion_pairs`` has the pairs that occur, for any number.
    """
    counts = confusion_pairs(df, label, prediction)
    labels = label_union(counts, "label", "prediction")
    names = [r["label"] for r in labels.limit(SHOWN_CLASSES + 1).collect()]
    if len(names) > SHOWN_CLASSES:
        raise AnalyticsError(f"a square of more than {SHOWN_CLASSES} classes is no table to look at; use confusion_pairs")
    other = F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(None))
    square = labels.withColumn("prediction", F.explode(other))
    return square.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("c", F.lit(0)).alias("count")
    )


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (accuracy, precision, recall, f1): of the larger label for two labels, else weighted by support.

    Sums per class come from the pairs that occur, so their number follows the data and not the square of the classes.
    """
    cells = confusion_pairs(df, label, prediction)
    count = F.when(F.col("label").isNotNull() & F.col("prediction").isNotNull(), F.col("c")).otherwise(F.lit(0))
    hit = F.when(F.col("label") == F.col("prediction"), count).otherwise(F.lit(0))
    zero_long = F.lit(0).cast("long")
    both = (
        cells.select(
            F.inline(
                F.array(
                    F.struct(F.col("label").alias("label"), hit.alias("tp"), count.alias("support"), zero_long.alias("claimed")),
                    F.struct(F.col("prediction").alias("label"), zero_long.alias("tp"), zero_long.alias("support"), count.alias("claimed")),
                )
            )
        )
    ).where("label is not null")
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "claimed")])
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("claimed")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("claimed")), zero)
    per = sums.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    def overall(m: str) -> Column:
        weighted = F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), zero)
        return F.round(F.when(F.count(F.lit(1)) == 2, F.max_by(m, "label")).otherwise(weighted), 4).alias(m)

    accuracy = F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), zero)
    return per.agg(F.round(accuracy, 4).alias("accuracy"), overall("precision"), overall("recall"), overall("f1"))


def _auc_by_class(rows: DataFrame) -> DataFrame:
    """(k, n, roc_auc) from rows (k, s, pos, neg): the exact rank statistic, ties counted half; null with a single class."""
    steps = ranks.running_totals(rows, "s", ["pos", "neg"], ["k"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return steps.groupBy("k").agg(F.sum("pos").alias("n"), F.round(F.try_divide(won, pairs), 4).alias("roc_auc"))


def roc_auc(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row (roc_auc): the exact rank statistic, ties counted half; null with a single class."""
    hit = F.coalesce(positive, F.lit(False)).cast("long")
    rows = df.select(F.lit(0).alias("k"), score.cast("double").alias("s"), hit.alias("pos"), (1 - hit).alias("neg"))
    return _auc_by_class(rows).agg(F.max("roc_auc").alias("roc_auc"))


def roc_auc_weighted(df: DataFrame, label: str, scores: str, classes: Sequence) -> DataFrame:
    """One row (roc_auc): one-versus-rest over an array of class scores, weighted by class size.

    ``classes`` lists the label of each array slot. A class without both kinds of rows leaves no result. Every row is spread over
    the classes once and the classes are ranked side by side, in one plan however many there are.
    """
    slots = F.array(*[F.struct(F.lit(i).alias("k"), (V.ref(label) == F.lit(c)).alias("hit"), F.get(V.ref(scores), F.lit(i)).cast("double").alias("s")) for i, c in enumerate(classes)])
    hit = F.coalesce("hit", F.lit(False)).cast("long")
    rows = df.select(F.inline(slots)).select("k", "s", hit.alias("pos"), (1 - hit).alias("neg"))
    every = _auc_by_class(rows)
    known = (F.count("roc_auc") == F.count(F.lit(1))) & (F.count(F.lit(1)) == len(classes))
    mean = F.try_divide(F.sum(F.col("roc_auc") * F.col("n")), F.sum("n"))
    return every.agg(F.when(known, F.round(mean, 4)).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (mae, mse, rmse, r2)."""
    y, p = V.ref(label).cast("double"), V.ref(prediction).cast("double")
    off = y - p
    sums = df.agg(
        F.avg(F.abs(off)).alias("mae"),
        F.avg(off * off).alias("mse"),
        F.var_pop(y).alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - F.try_divide(F.col("mse"), F.col("spread"))).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(
        F.round("mae", 4).alias("mae"),
        F.round("mse", 4).alias("mse"),
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round(r2, 4).alias("r2"),
    )


def best_model(results: DataFrame) -> DataFrame:
    """The completed result with the greatest primary metric; ties go to the earlier algorithm."""
    metric = F.when(F.col("task_type") == "classification", F.col("accuracy")).otherwise(F.col("r2"))
    return (
        results.where("status = 'completed'")
        .withColumn("primary_metric", metric)
        .orderBy(F.col("primary_metric").desc_nulls_last(), "ordinal")
        .limit(1)
    )


def share_of_total(importances: DataFrame, k: int = 10) -> DataFrame:
    """(feature, importance, importance_pct): the ``k`` most important features and their share of the total."""
    whole = importances.agg(total(F.round("importance", 6)).alias("t")).scalar()
    whole = F.when(whole == 0, F.lit(1.0)).otherwise(whole)
    ranked = importances.select("feature", F.round("importance", 6).alias("importance"))
    return (
        ranked.withColumn("importance_pct", F.round(F.col("importance") / whole * 100, 2))
        .orderBy(F.desc("importance"), "feature")
        .limit(k)
    )
