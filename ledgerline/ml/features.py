"""Feature preparation as pipeline stages: fills, one-hot codes, scaling; and the hold-out split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.errors import TrainingError
from ledgerline.functions import ranks, values as V
from ledgerline.operators.aggregates import top_values
from ledgerline.operators.describe import column_quantiles
from ledgerline.runtime import attach

TEST_SHARE = 0.2
SEED = 42
HEX_DIGITS = 15


def row_key(row_id: str, salt: str = str(SEED)) -> Column:
    """A repeatable pseudo-random whole number per row, the same in any engine."""
    digest = F.md5(F.concat(V.ref(row_id).cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def hold_out(df: DataFrame, row_id: str, label: str | None = None) -> DataFrame:
    """Adds ``is_test`` for a fifth of the rows, of each class if ``label`` names one.

    The cut is the key of the wanted rank within the class, found without gathering the class.
    """
    keys = [label] if label else []
    keyed = df.withColumn("__key", row_key(row_id))
    pick = ranks.kth("__cut", lambda n: F.floor(n * F.lit(TEST_SHARE) + 0.5))
    cuts = ranks.pick_values(keyed.select(*keys, "__key"), "__key", [pick], keys).drop("n")
    return attach(keyed, cuts, keys).withColumn(
        "is_test", F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(False))
    ).drop("__key", "__cut")


def with_folds(df: DataFrame, row_id: str, folds: int, label: str | None = None) -> DataFrame:
    """Adds ``fold`` 0 … folds-1 in equal parts, of each class if ``label`` names one."""
    keys = [label] if label else []
    keyed = df.withColumn("__key", row_key(row_id, "fold"))
    picks = [
        ranks.kth(f"__cut{i}", lambda n, i=i: F.floor(n * F.lit(i / folds) + 0.5)) for i in range(1, folds)
    ]
    cuts = ranks.pick_values(keyed.select(*keys, "__key"), "__key", picks, keys).drop("n")
    joined = attach(keyed, cuts, keys)
    above = [F.when(F.coalesce(F.col("__key") > F.col(p.name), F.lit(True)), 1).otherwise(0) for p in picks]
    fold = above[0]
    for part in above[1:]:
        fold = fold + part
    return joined.withColumn("fold", fold).drop("__key", *[p.name for p in picks])


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[PipelineModel, list[str]]:
    """Fitted preparation stages and the names of the feature slots.

    Numbers: gaps take the exact training median, then centre and scale. Texts: gaps take the most
    frequent training value, then one slot per training value; unseen values have no slot.
    """
    if not numeric and not categorical:
        raise TrainingError("no column can be used as a feature")
    medians: dict[str, float] = {}
    if numeric:
        rows = column_quantiles(train, numeric, [ranks.quantile("median", 0.5)]).collect()
        medians = {r["column"]: r["median"] for r in rows}
    common: dict[str, str] = {}
    if categorical:
        common = {r["column"]: r["value"] for r in top_values(train, categorical, 1).collect()}
    filled = []
    for i, c in enumerate(numeric):
        value = f"try_cast({_name(c)} AS DOUBLE)"
        filled.append(f"coalesce(nanvl({value}, NULL), {medians.get(c) or 0.0!r}D) AS __num{i}")
    for i, c in enumerate(categorical):
        filled.append(f"coalesce(CAST({_name(c)} AS STRING), {_quoted(common.get(c) or '')}) AS __cat{i}")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")]
    parts = []
    if numeric:
        stages += [
            VectorAssembler(inputCols=[f"__num{i}" for i in range(len(numeric))], outputCol="__numbers"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        parts.append("__scaled")
    if categorical:
        codes, slots = [f"__code{i}" for i in range(len(categorical))], [f"__slot{i}" for i in range(len(categorical))]
        stages += [
            # An unseen value gets the extra last code, which the encoder drops: all its slots are 0.
            StringIndexer(
                inputCols=[f"__cat{i}" for i in range(len(categorical))], outputCols=codes,
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=codes, outputCols=slots, dropLast=True),
        ]
        parts += slots
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    fitted = Pipeline(stages=stages).fit(train)
    return fitted, list(numeric) + slot_names(fitted, categorical)


def slot_names(fitted: PipelineModel, categorical: Sequence[str]) -> list[str]:
    """Names of the one-hot slots, column and value."""
    for stage in fitted.stages:
        if isinstance(stage, StringIndexerModel):
            return [f"{c}_{v}" for c, values in zip(categorical, stage.labelsArray) for v in values]
    return []
