"""Isolation forest after Liu, Ting and Zhou (2008).

Training needs only 256 rows per tree. A fixed-size pool of rows with the smallest keyed hash is
drawn from the whole table, each tree takes its own sample of the pool, and trees are grown in
parallel as grouped pandas. The forest is a table of at most 100 x 511 nodes; scoring walks it for a
whole batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerline.functions import ranks, values as V
from ledgerline.operators.predicates import complete_rows
from ledgerline.runtime import settle

TREES = 100
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.05
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double, sample int"


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, depth) of one tree; a leaf has feature -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    work = [(np.arange(len(x)), 0, None, None)]
    while work:
        rows, depth, parent, side = work.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([me, -1, 0.0, -1, -1, depth + mean_path(len(rows))])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append([me, f, cut, -1, -1, 0.0])
        below = x[rows, f] <= cut
        work.append((rows[below], depth + 1, me, 3))
        work.append((rows[~below], depth + 1, me, 4))
    return [tuple(n) for n in nodes]


def fit_forest(df: DataFrame, columns: Sequence[str], row_id: str, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The node table of a forest grown on the complete rows: ``trees`` trees on ``sample`` rows each.

    All samples are distinct rows of one pool of ``trees * sample`` rows, drawn from the whole table by a hash of the id.
    """
    names = [f"f{i}" for i in range(len(columns))]
    rows = complete_rows(df, columns).select(
        V.ref(row_id).alias("id"), *[V.number(df, c).alias(n) for c, n in zip(columns, names)]
    )
    pool = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(trees * sample)
    pool = settle(pool, "forest-pool")
    # The pool is dealt out in shuffled order, as often as needed: each deal gives whole samples of
    # distinct rows, and all deals together hold about trees x sample rows.
    size = pool.agg(F.count(F.lit(1)).alias("n")).select(F.greatest("n", F.lit(1)).alias("n")).scalar()
    dealt = (
        pool.withColumn("n", size)
        .withColumn("sample", F.least(F.col("n"), F.lit(sample)))
        .withColumn("per_deal", F.floor(F.col("n") / F.col("sample")))
        .select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(trees) / F.col("per_deal")).cast("int") - 1)).alias("deal"))
    )
    order = W.partitionBy("deal").orderBy(F.xxhash64("id", "deal", F.lit(SEED)), "id")
    drawn = (
        dealt.withColumn("group", F.floor((F.row_number().over(order) - 1) / F.col("sample")))
        .where(F.col("group") < F.col("per_deal"))
        .withColumn("tree", F.col("deal") * F.col("per_deal") + F.col("group"))
        .where(F.col("tree") < trees)
        .select("tree", "id", *names)
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("id")
        nodes = _grow(pdf[names].to_numpy(float), np.random.default_rng([SEED, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        out["sample"] = len(pdf)
        return out

    return drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def path_score(nodes: pd.DataFrame):
    """A vectorised scoring column for a collected node table (its size is fixed by the forest)."""
    trees = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        leaf = t["feature"].to_numpy() < 0
        own = t["node"].to_numpy()
        # A leaf leads back to itself, so every row can take the same number of steps.
        trees.append(
            (
                np.where(leaf, 0, t["feature"]),
                t["cut"].to_numpy(),
                np.where(leaf, own, t["left"]),
                np.where(leaf, own, t["right"]),
                t["depth"].to_numpy(),
            )
        )
    steps = int(np.ceil(np.log2(max(nodes["sample"].max(), 2))))
    norm = max(mean_path(float(nodes["sample"].max())), 1e-12)

    @F.pandas_udf("double")
    def score(cells: pd.DataFrame) -> pd.Series:
        n = len(cells)
        x, every = np.ascontiguousarray(cells.to_numpy(float).T).ravel(), np.arange(n)
        total = np.zeros(n)
        for feature, cut, left, right, depth in trees:
            at = np.zeros(n, dtype=np.int64)
            for _ in range(steps):
                at = np.where(x[feature[at] * n + every] <= cut[at], left[at], right[at])
            total += depth[at]
        return pd.Series(np.power(2.0, -(total / len(trees)) / norm))

    return score


def score_forest(
    df: DataFrame, columns: Sequence[str], row_id: str, contamination: float = CONTAMINATION, trees: int = TREES
) -> DataFrame:
    """Complete rows with ``score`` above the contamination quantile, and ``is_anomaly`` where it is positive."""
    contamination = min(max(float(contamination), 0.001), 0.5)
    # The node table has at most trees x (2 x SAMPLE - 1) rows.
    score = path_score(fit_forest(df, columns, row_id, trees).toPandas())
    rows = complete_rows(df, columns)
    cells = F.struct(*[V.number(df, c).alias(f"f{i}") for i, c in enumerate(columns)])
    # Written once: the quantile and the ranking both read the scores.
    raw = settle(rows.withColumn("__raw", score(cells)), "forest-scores")
    cut = ranks.pick_values(raw.select("__raw"), "__raw", [ranks.quantile("cut", 1.0 - contamination)])
    return (
        raw.withColumn("score", F.col("__raw") - cut.select("cut").scalar())
        .drop("__raw")
        .withColumn("is_anomaly", F.col("score") > 0)
    )
