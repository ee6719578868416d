"""Training, comparison and persistence of the models, on the dataset built from the URLs.

All runs have the library's settings: 300 trees, and one comparison that all queries share. Weights cannot be compared with SQL,
but facts about them can: the optimum of the regression, scores by folds that exclude a row, and
equal scores from batch, stream and a plain join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data_queries import dataset
from checks.metric_queries import RANKING
from checks.registry import query, shared
from checks.sqlparts import oracle, r9
from hostlens.functions.features import with_features
from hostlens.operators import metrics
from hostlens.operators.folds import grouped_folds
from hostlens.operators.single_feature import single_feature_power
from hostlens.plans import training as tr
from hostlens.sources import fixtures as fx
from hostlens.sources.scratch import durable, scratch_path

K = 5
GRADIENT = 1e-3  # largest slope of the mean loss that counts as none


def rows(spark, sf):
    return shared("rows", spark, sf, lambda: durable(dataset(spark, sf).rows))


def folded(spark, sf):
    def build():
        train = rows(spark, sf).where("split = 'train'").drop("fold")
        return durable(with_features(grouped_folds(train, "registered_domain", "label", K)))

    return shared("folded", spark, sf, build)


def champion(spark, sf):
    return shared("champion", spark, sf, lambda: tr.Champion.of(comparison(spark, sf)))


def comparison(spark, sf):
    return shared(
        "comparison", spark, sf,
        lambda: tr.compare_models(rows(spark, sf), fx.stress(spark), K),
    )


GRAMS = """
  SELECT hostname, unnest(CASE WHEN hostname = '' THEN [] ELSE list_concat(
    list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substr(w, i, 3)),
    list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)),
    list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5))) END) AS gram
  FROM (SELECT hostname, ' ' || hostname || ' ' AS w FROM url_hosts)"""


@query("t1_char_ngrams", oracle(f"SELECT hostname, gram, count(*) AS n FROM ({GRAMS}) GROUP BY ALL", "url_hosts"))
def t1(spark, sf):
    return tr.ngram_counts(fx.hosts(spark, sf))  # distinct hosts


@query("t2_ngram_vocabulary", oracle(f"""
SELECT gram, {r9('ln((1 + m) / (1 + df)) + 1', 'weight')} FROM (
  SELECT gram, count(*) AS n, count(DISTINCT hostname) AS df, (SELECT count(*) FROM url_hosts) AS m FROM ({GRAMS})
  GROUP BY gram HAVING count(DISTINCT hostname) >= 5)""", "url_hosts"))
def t2(spark, sf):
    return tr.ngram_vocabulary(fx.hosts(spark, sf)).select("gram", "weight")


@query("t2_vocabulary_cut", oracle(f"""
SELECT gram, n, df FROM (SELECT gram, count(*) AS n, count(DISTINCT hostname) AS df FROM ({GRAMS}) GROUP BY gram)
WHERE df >= 2 ORDER BY n DESC, encode(gram) LIMIT 1000""", "url_hosts"))
def t2b(spark, sf):
    """The 1000 most frequent, which ends among n-grams of equal counts."""
    return tr.ngram_vocabulary(fx.hosts(spark, sf), min_df=2, max_ngrams=1000).select("gram", "n", "df")


@query("t3_ngram_logistic")
def t3(spark, sf):
    train = folded(spark, sf)
    return tr.predict(tr.fit_ngram(train), train).select("hostname", "label", "probability")


@query("t3_optimum_of_the_regression", oracle("""
SELECT count(*) AS n_hosts, true AS same_scores, true AS at_optimum FROM dataset WHERE split = 'train'""", "dataset"))
def t3b(spark, sf):
    """The loss is strictly convex, so a vanishing gradient proves the fit; scores by a join of grams
    with their weights must equal the model's."""
    train = folded(spark, sf).select("hostname", "label")
    model = tr.fit_ngram(train)
    weights = model.table(spark).where("gram IS NOT NULL").selectExpr("gram", "weight AS idf", "coefficient AS coef")
    n, n_pos = train.agg(F.count("*"), F.sum("label")).first()
    counts = train.select("hostname", F.explode(F.expr(tr.ngram_sql())).alias("gram")).groupBy("hostname", "gram").count()
    entries = counts.join(weights, "gram").withColumn("x", (1 + F.log("count")) * F.col("idf"))
    norm = entries.groupBy("hostname").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"), F.sum(F.col("x") * F.col("coef")).alias("dot"))
    margin = F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)) + model.intercept
    weight = F.when(F.col("label") == 1, n / (2.0 * n_pos)).otherwise(n / (2.0 * (n - n_pos)))
    hosts = durable(train.join(norm, "hostname", "left").withColumn("p", 1 / (1 + F.exp(-margin))).withColumn("r", weight * (F.col("p") - F.col("label")) / n))
    slopes = entries.join(hosts.select("hostname", "norm", "r"), "hostname").groupBy("gram").agg(
        (F.sum(F.col("r") * F.col("x") / F.col("norm")) + F.first("coef") / n).alias("slope")
    )
    steepest = slopes.agg(F.max(F.abs("slope"))).scalar()
    scored = tr.predict(model, train)
    same = hosts.join(scored.select("hostname", "probability"), "hostname")
    return same.agg(
        F.count("*").alias("n_hosts"), (F.max(F.abs(F.col("p") - F.col("probability"))) < 1e-9).alias("same_scores"),
        ((F.abs(F.sum("r")) < GRADIENT) & (steepest < GRADIENT)).alias("at_optimum"),
    )


@query("t5_scores_by_other_folds", oracle("""
SELECT m.model, count(*) AS n_hosts, count(*) AS n_scores, 0::BIGINT AS n_odd
FROM dataset, (VALUES ('boosted_all'), ('boosted_base'), ('ngram_lr'), ('stacked')) m(model) WHERE split = 'train' GROUP BY 1""", "dataset"))
def t5b(spark, sf):
    """Each train host is scored once, in its own fold; a score beyond 0 to 1 or a host whose folds
    differ between models is odd."""
    oof = comparison(spark, sf)._all("oof")
    folds = oof.groupBy("hostname").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    odd = ~F.col("probability").between(0, 1) | (F.col("lo") != F.col("hi"))
    return oof.join(folds, "hostname").groupBy("model").agg(
        F.count_distinct("hostname").alias("n_hosts"), F.count("*").alias("n_scores"), F.sum(odd.cast("bigint")).alias("n_odd")
    )


@query("t4_boosted_trees")
def t4(spark, sf):
    train = folded(spark, sf)
    model = tr.fit_boosted(train)
    return tr.predict(model, train).select("hostname", "label", "probability")


@query("t4_scores_from_the_tree_table", oracle("""
SELECT count(*) AS n_hosts, 0::BIGINT AS n_off, true AS loss_falls, 300::BIGINT AS n_trees FROM dataset WHERE split = 'train'""", "dataset"))
def t4b(spark, sf):
    """The scores follow from the stored trees alone: every host walks every tree by plain joins and
    CASE, and the margins are summed. The training loss must fall with every tree."""
    train = folded(spark, sf)
    model = tr.fit_boosted(train)
    trees = model.table(spark)
    x = F.array(*[F.col(c).cast("double") for c in model.columns])
    walk = train.select("hostname", x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(tr.TREES - 1))).alias("tree"))
    walk = walk.join(F.broadcast(trees), "tree").withColumn("i", F.lit(1))  # a row per tree
    for _ in range(tr.TREE_DEPTH):
        right = F.expr("CASE WHEN feature[i] >= 0 AND x[greatest(feature[i], 0)] >= threshold[i] THEN 1 ELSE 0 END")
        walk = walk.withColumn("i", F.col("i") * 2 + right)
    margins = walk.groupBy("hostname").agg(F.sum(F.expr("value[i]")).alias("margin"))
    scored = tr.predict(model, train).select("hostname", "probability").join(margins, "hostname")
    off = F.abs(F.col("probability") - 1 / (1 + F.exp(-F.col("margin")))) > 1e-9
    return scored.agg(
        F.count("*").alias("n_hosts"), F.sum(off.cast("bigint")).alias("n_off"),
        F.lit(bool((model.loss[1:] < model.loss[:-1]).all())).alias("loss_falls"), F.lit(len(model.loss)).cast("bigint").alias("n_trees"),
    )


@query("t5_t7_model_comparison")
def t7(spark, sf):
    return comparison(spark, sf).table()


@query("t6_stacked_scores")
def t6(spark, sf):
    return comparison(spark, sf).evaluations["stacked"].test


@query("t7_flagged_stress_hosts")
def t7b(spark, sf):
    return comparison(spark, sf).flagged_stress()


@query("t8_w5_top_importance")
def t8(spark, sf):
    return tr.top_importance(champion(spark, sf).boosted)


@query("t9_single_feature_power", oracle(f"""
SELECT feature, {r9('auc_mean', 'auc_mean')}, {r9('auc_std', 'auc_std')}, auc_mean > 0.9 AS possible_shortcut FROM power""", "power"))
def t9(spark, sf):
    return single_feature_power(folded(spark, sf), k=K)


FOLD_RANKING = RANKING.format(by="fold,", part="PARTITION BY fold", group="GROUP BY fold").replace(
    "FROM scored", "FROM (SELECT fold, label, hostname_length / 253 AS probability FROM folded)")


@query("a16_average_over_folds", oracle(f"""
SELECT {r9('avg(ap)', 'cv_pr_auc_mean')}, {r9('stddev_pop(ap)', 'cv_pr_auc_std')}, {r9('avg(auc)', 'cv_roc_auc_mean')} FROM ({FOLD_RANKING})""", "folded"))
def a16_folds(spark, sf):
    """Ranking of each fold by the length of the host, and its mean over the folds."""
    scores = folded(spark, sf).select("fold", "label", (F.col("hostname_length") / 253).alias("probability"))
    return metrics.fold_summary(metrics.ranking_metrics(scores, by=("fold",)))


@query("t10_bulk_scoring")
def t10(spark, sf):
    return champion(spark, sf).score(rows(spark, sf).select("hostname", "label"))


@query("io9_a19_saved_model_parity", oracle("""
SELECT count(*) AS n, 0.0::DOUBLE AS max_abs_diff, 0::BIGINT AS unmatched, true AS same_threshold FROM dataset""", "dataset"))
def io9(spark, sf):
    path = scratch_path(spark, "model")
    model = champion(spark, sf)
    model.save(spark, path)
    hosts = rows(spark, sf).select("hostname")
    loaded = tr.Champion.load(spark, path)
    return metrics.score_parity(model.score(hosts), loaded.score(hosts), "hostname").withColumn(
        "same_threshold", F.lit(loaded.threshold == model.threshold)
    )
