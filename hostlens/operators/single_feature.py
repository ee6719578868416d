"""How well each feature alone separates the classes: a depth-limited decision tree per feature
and fold, all grown together on counts per distinct value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.lists import FEATURES
from hostlens.operators.prefix import group_sums
from hostlens.sources.scratch import broadcast_if_small, durable

SHORTCUT_AUC = 0.90


def _impurity(n: Column, pos: Column) -> Column:
    """Gini impurity times the rows of a node."""
    return F.when(n > 0, 2.0 * pos * (n - pos) / n).otherwise(0.0)


def grow_trees(counts: DataFrame, depth: int = 3) -> DataFrame:
    """Leaf of every (feature, model, value): `node`, a binary path with a leading 1.

    `counts`: feature, model, value, n, pos = the training rows of each model. A level splits all
    nodes of all trees in one pass: running sums per node give the impurity left by each cut, the
    best cut (the lowest value on a tie) is kept, pure nodes stay whole.
    """
    state = counts.withColumn("node", F.lit(1))
    for _ in range(depth):
        sums = group_sums(state, ("feature", "model", "node"), "value", ("n", "pos"), nexts=F.col("n") > 0)
        left = _impurity(F.col("cum_n"), F.col("cum_pos"))
        right = _impurity(F.col("all_n") - F.col("cum_n"), F.col("all_pos") - F.col("cum_pos"))
        # A cut lies midway between two neighbouring training values.
        at = ((F.col("value") + F.col("next")) / 2).alias("at")
        best = F.when(
            (F.col("n") > 0) & F.col("next").isNotNull(),
            F.struct(F.round(left + right, 9).alias("impurity"), at),
        )
        # One row per node, which many values share: the join keeps them where they are.
        keys = ["feature", "model", "node"]
        cuts = sums.groupBy(*keys).agg(F.min(best).alias("cut"))
        state = sums.join(broadcast_if_small(durable(cuts)), keys)
        mixed = (F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))
        side = (F.col("value") > F.col("cut.at")).cast("int")
        grown = F.when(mixed & F.col("cut").isNotNull(), F.col("node") * 2 + side)
        state = state.select(
            "feature", "model", "value", "n", "pos", F.coalesce(grown, F.col("node")).alias("node")
        )
    return state


def single_feature_power(
    feats: DataFrame, fold: str = "fold", label: str = "label", depth: int = 3, k: int = 5
) -> DataFrame:
    """(feature, auc_mean, auc_std, flag) over k folds; one pass over the rows.

    The counts per (feature, fold, value) are small, and values are rounded (see drift.value_counts).
    Model i trains on the folds other than i and is judged on fold i.
    """
    long = feats.select(
        fold, F.col(label).cast("bigint").alias("y"),
        *[F.round(F.col(f).cast("double"), 12).alias(f) for f in FEATURES],
    ).unpivot([fold, "y"], list(FEATURES), "feature", "value")
    by_fold = long.groupBy("feature", fold, "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    )
    models = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("model")
    mine = F.col(fold) != F.col("model")
    # Values that only the judged fold has take part with no training rows and so find a leaf.
    counts = by_fold.select("*", models).groupBy("feature", "model", "value").agg(
        F.sum(F.when(mine, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(mine, F.col("pos")).otherwise(0)).alias("pos"),
        F.sum(F.when(mine, 0).otherwise(F.col("n"))).alias("val_n"),
        F.sum(F.when(mine, 0).otherwise(F.col("pos"))).alias("val_pos"),
    )
    leaves = grow_trees(counts.select("feature", "model", "value", "n", "pos"), depth)
    judged = leaves.join(
        counts.select("feature", "model", "value", "val_n", "val_pos"), ["feature", "model", "value"]
    )
    # At most 2^depth leaves per tree; rows of equal leaf rate tie.
    leaf = judged.groupBy("feature", "model", "node").agg(
        (F.sum("pos") / F.sum("n")).alias("rate"),
        F.sum("val_n").alias("vn"), F.sum("val_pos").alias("vp"),
    )
    rated = leaf.groupBy("feature", "model", F.round("rate", 12).alias("rate")).agg(
        F.sum("vn").alias("vn"), F.sum("vp").alias("vp")
    )
    tree = Window.partitionBy("feature", "model")
    above = tree.orderBy(F.col("rate").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rated.withColumn("vp_above", F.sum("vp").over(above) - F.col("vp"))
    neg = F.col("vn") - F.col("vp")
    auc = F.sum(neg * (F.col("vp_above") + F.col("vp") / 2)) / F.nullif(
        F.sum("vp") * F.sum(neg), F.lit(0).cast("bigint")
    )
    per_model = ranked.groupBy("feature", "model").agg(auc.alias("auc"))
    out = per_model.groupBy("feature").agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std")
    )
    return out.withColumn("possible_shortcut", F.col("auc_mean") > SHORTCUT_AUC)
