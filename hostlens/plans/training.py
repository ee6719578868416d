"""Train, compare, stack and keep the hostname models. Every fit and score is a Spark job."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from hostlens.functions.features import with_features
from hostlens.functions.lists import BASE_FEATURES, FEATURES
from hostlens.functions.stage import computed_once
from hostlens.operators import metrics
from hostlens.operators.boosting import Boosted, Fit as BoostedFit, constant, fit_all
from hostlens.operators.folds import grouped_folds
from hostlens.operators.selection import largest
from hostlens.sources.scratch import durable, scratch_path

# Model settings and versions.
NGRAM_SIZES = (3, 4, 5)
MIN_DF = 5
MAX_NGRAMS = 200_000
LR_ITERATIONS = 2000
TREES = 300
TREE_DEPTH = 6
LEARNING_RATE = 0.1
SEED = 42
TARGET_FPR = 0.01
DEFAULT_THRESHOLD = 0.5
DATA_VERSION = "v2"
FEATURE_VERSION = "v1.1"
NGRAM_COLUMN = "ngram_prob"
FITS_AT_ONCE = 6
TERMS_AT_ONCE = 200_000  # n-grams of the models that are fitted, scored or looked up together
PLAN_TEXT = 50_000  # characters of a plan that Spark keeps on the driver, for each of its last 1,000 queries
FIT_ROWS = 50_000  # of a task of the regression
BUCKET_ENTRIES = 4  # n-grams of a bucket of the hash table, at most on average


# ------------------------------------------------------------------- character n-grams
def ngram_sql(host: str = "hostname") -> str:
    """Character n-grams of each word, padded by a blank on both sides. A padded word shorter
    than the smallest n counts once, as a whole; larger n need a word as long as they are."""
    grams = []
    for n in NGRAM_SIZES:
        grams.append(
            f"CASE WHEN length(w) >= {n} THEN "
            f"transform(sequence(1, length(w) - {n - 1}), i -> substring(w, i, {n})) "
            f"ELSE {'array(w)' if n == min(NGRAM_SIZES) else 'array()'} END"
        )
    words = f"filter(split(lower({host}), '\\\\s+'), w -> w != '')"
    return f"flatten(transform(transform({words}, w -> ' ' || w || ' '), w -> concat({', '.join(grams)})))"


def ngram_counts(hosts: DataFrame) -> DataFrame:
    """(hostname, gram, n): how often each row has each of its n-grams. They are counted inside the row, so
    nothing is shuffled; a host of two rows has its n-grams twice."""
    rows = computed_once(hosts.select("hostname"), {"_grams": F.expr(ngram_sql())})
    rows = computed_once(rows, {"_distinct": F.array_distinct("_grams")})
    once = F.size("_distinct") == F.size("_grams")
    counted = F.transform("_distinct", lambda g: F.struct(
        g.alias("gram"),
        F.when(once, 1).otherwise(F.size("_grams") - F.size(F.array_remove("_grams", g))).cast("bigint").alias("n"),
    ))
    return rows.select("hostname", F.inline(counted))


def ngram_vocabulary(hosts: DataFrame, min_df: int = MIN_DF, max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """(gram, n, df, weight) of the n-grams that at least `min_df` rows have: the `max_ngrams` most frequent,
    ties by text. Weight: smooth inverse document frequency plus one, so an n-gram of every row counts.

    One shuffle by n-gram, combined before it; a row tells of each n-gram whether it is its first there.
    """
    return vocabularies(hosts, [F.lit(True)], min_df, max_ngrams)[0]


def vocabularies(
    hosts: DataFrame, sets: list[Column], min_df: int = MIN_DF, max_ngrams: int = MAX_NGRAMS
) -> list[DataFrame]:
    """`ngram_vocabulary` of each of several sets of the rows, given by their conditions; the n-grams of all are
    counted together."""
    each = range(len(sets))
    marks = [F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"_in{i}") for i, c in enumerate(sets)]
    rows = hosts.select("hostname", *marks)
    grams = computed_once(rows, {"_grams": F.sort_array(F.expr(ngram_sql()))})
    first = lambda g, i: ~g.eqNullSafe(F.get("_grams", i - 1))  # noqa: E731  (in order, equal ones are neighbours)
    marked = F.transform("_grams", lambda g, i: F.struct(g.alias("gram"), first(g, i).alias("first")))
    named = grams.select(*[f"_in{i}" for i in each], F.inline(marked))
    counts = durable(named.groupBy("gram").agg(
        *[F.count_if(f"_in{i}").alias(f"n{i}") for i in each],
        *[F.count_if(F.col(f"_in{i}") & F.col("first")).alias(f"df{i}") for i in each],
    ).where(reduce(or_, [F.col(f"df{i}") >= max(min_df, 1) for i in each])))
    sizes = rows.agg(*[F.count_if(f"_in{i}") for i in each]).first()

    def cut(i: int) -> DataFrame:
        own = counts.select("gram", F.col(f"n{i}").alias("n"), F.col(f"df{i}").alias("df")).where(F.col("df") >= max(min_df, 1))
        kept = largest(own, max_ngrams, "n", "gram")
        return kept.withColumn("weight", F.log((F.lit(1.0) + sizes[i]) / (1.0 + F.col("df"))) + 1.0)

    return side_by_side(cut, list(each))


@dataclass
class NgramModel:
    """A regression on the tf-idf of character n-grams: per n-gram its weight and coefficient, in the order
    of a hash of the n-gram. Built-in expressions only, in batches and streams alike.

    The table has at most MAX_NGRAMS entries and travels inside the expression as constants: a map from
    n-gram to place per bucket, and the weights by place.
    """

    grams: list[str]
    weight: np.ndarray
    coefficient: np.ndarray
    intercept: float

    @staticmethod
    def of(vocabulary: DataFrame) -> "NgramModel":
        """The untrained model of a vocabulary: all coefficients 0."""
        return NgramModel._of_rows(vocabulary.select("gram", "weight").toArrow())  # at most max_ngrams

    @staticmethod
    def _of_rows(rows: pa.Table) -> "NgramModel":
        grams = map(sys.intern, rows["gram"].to_pylist())  # one text for the models of all folds
        return NgramModel._untrained(dict(zip(grams, rows["weight"].to_pylist())))

    @staticmethod
    def _untrained(weights: dict[str, float]) -> "NgramModel":
        slots = _slots(len(weights))
        grams = sorted(weights, key=lambda g: (_slot(g, slots), g))
        return NgramModel(grams, np.array([weights[g] for g in grams], float), np.zeros(len(grams)), 0.0)

    @staticmethod
    def over(models: list["NgramModel"]) -> "NgramModel":
        """All n-grams of the models, with weights 1: its entries hold 1 + ln of the counts."""
        return NgramModel._untrained({gram: 1.0 for m in models for gram in m.grams})

    def _entries(self, df: DataFrame, host: str) -> DataFrame:
        """`df` with `_entries`, an array of (at, x): the place of each known n-gram of the host and 1 + ln of
        its count times its weight; not yet of unit length."""
        _describe_briefly(df.sparkSession)
        # Constants stay inside the expressions: as columns they would be copied into every row. The n-grams are a map
        # per bucket of a hash: other lookups in an array leave it by an exception for each n-gram that they find.
        buckets: list[dict[str, int]] = [{} for _ in range(max(_slots(len(self.grams)) // BUCKET_ENTRIES, 1))]
        for at, gram in enumerate(self.grams):
            buckets[_slot(gram, len(buckets))][gram] = at
        places, weight = constant(buckets, "map<string,int>"), constant(self.weight.tolist(), "double")
        rows = computed_once(df, {"_grams": F.coalesce(F.expr(ngram_sql(host)), F.array().cast("array<string>"))})
        rows = computed_once(rows, {"_distinct": F.array_distinct("_grams"), "_ordered": F.sort_array("_grams")})
        # All occurrences of an n-gram but one: few, so that a count does not go over all n-grams of the host.
        again = F.filter("_ordered", lambda g, i: g == F.get("_ordered", i - 1))
        rows = computed_once(rows, {"_again": again}).drop("_grams", "_ordered")

        def placed(g: Column) -> Column:
            bucket = F.crc32(g.cast("binary")).bitwiseAND(len(buckets) - 1).cast("int")
            return F.struct(g.alias("g"), F.get(places, bucket)[g].alias("at"))

        def weighed(e: Column) -> Column:
            count = 1 + F.size("_again") - F.size(F.array_remove("_again", e["g"]))
            often = F.when(F.size("_again") == 0, 1.0).otherwise(1 + F.log(count))
            return F.struct(e["at"].alias("at"), (often * F.get(weight, e["at"])).alias("x"))

        found = F.filter(F.transform("_distinct", placed), lambda e: e["at"].isNotNull())
        return computed_once(rows, {"_entries": F.transform(found, weighed)}).drop("_distinct", "_again")

    def units(self, df: DataFrame, output: str = "_unit", host: str = "hostname") -> DataFrame:
        """Add the tf-idf vector of unit length (all 0 without known n-grams), as the struct that a sparse vector
        is stored as: files of it read as vectors."""
        keep = [F.col(c) for c in df.columns if c != output]
        return self._unit(self._entries(df, host), keep, output)

    def _unit(self, entries: DataFrame, keep: list, output: str) -> DataFrame:
        """`keep` and the vector of unit length of rows with `_entries`."""
        ready = computed_once(entries, {"_norm": F.expr(_NORM), "_sorted": F.sort_array("_entries")})
        return ready.select(*keep, F.expr(
            f"named_struct('type', CAST(0 AS TINYINT), 'size', {len(self.grams)}, "
            "'indices', transform(_sorted, e -> e.at), 'values', transform(_sorted, e -> e.x / _norm))"
        ).alias(output))

    def recoded(self, df: DataFrame, every: "NgramModel", output: str = "_unit") -> DataFrame:
        """`units` of rows whose `_entries` are those of `every`, a model of weights 1 that has all n-grams of this
        one: numbers are looked up, not texts."""
        _describe_briefly(df.sparkSession)
        at = {gram: i for i, gram in enumerate(self.grams)}
        places = [at.get(gram) for gram in every.grams]
        weights = [0.0 if i is None else float(self.weight[i]) for i in places]
        place, weight = constant(places, "int"), constant(weights, "double")
        keep = [F.col(c) for c in df.columns if c not in ("_entries", output)]
        known = F.filter("_entries", lambda e: F.get(place, e["at"]).isNotNull())
        own = F.transform(known, lambda e: F.struct(
            F.get(place, e["at"]).alias("at"), (e["x"] * F.get(weight, e["at"])).alias("x")))
        return self._unit(computed_once(df, {"_entries": own}), keep, output)

    def vectors(self, df: DataFrame, output: str = "_unit", host: str = "hostname") -> DataFrame:
        """`units` as a vector column, by way of the vector's JSON form: the only constructor of sparse vectors
        among the built-in functions."""
        keep = [F.col(c) for c in df.columns if c != output]
        shape = StructType([StructField("v", VectorUDT())])
        text = F.to_json(F.struct(F.col(output).alias("v")))
        return self.units(df, output, host).select(*keep, F.from_json(text, shape)["v"].alias(output))

    def score(self, df: DataFrame, output: str = "probability", host: str = "hostname") -> DataFrame:
        """Add the probability of class 1."""
        keep = [F.col(c) for c in df.columns if c != output]
        coefficient = constant(self.coefficient.tolist(), "double")
        dot = F.aggregate("_entries", F.lit(0.0), lambda a, e: a + e["x"] * F.get(coefficient, e["at"]))
        margin = F.when(F.size("_entries") == 0, 0.0).otherwise(dot / F.expr(_NORM)) + F.lit(float(self.intercept))
        return self._entries(df, host).select(*keep, (1.0 / (1.0 + F.exp(-margin))).alias(output))

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, weight, coefficient, intercept): a row per n-gram, in order; one with a NULL gram for the
        intercept."""
        return spark.createDataFrame(pa.table({
            "at": pa.array(range(len(self.grams) + 1), pa.int32()), "gram": pa.array([*self.grams, None], pa.string()),
            "weight": pa.array([*self.weight.tolist(), None], pa.float64()),
            "coefficient": pa.array([*self.coefficient.tolist(), self.intercept], pa.float64()),
        }))

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "NgramModel":
        rows = spark.read.parquet(path).toArrow().sort_by("at")  # at most MAX_NGRAMS
        weight, coefficient = (rows[c].to_numpy() for c in ("weight", "coefficient"))
        return NgramModel(rows["gram"].to_pylist()[:-1], weight[:-1], coefficient[:-1], float(coefficient[-1]))


_NORM = "sqrt(aggregate(_entries, 0D, (a, e) -> a + e.x * e.x))"


def _describe_briefly(spark: SparkSession) -> None:
    """Keep the text of plans short: it spells out each constant, and the texts of past queries stay on the driver."""
    if spark.conf.get("spark.sql.maxPlanStringLength", None) is None:  # what the caller has set holds
        spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)


def _slots(entries: int) -> int:
    return 1 << max(entries, 1).bit_length()


def _slot(gram: str, slots: int) -> int:
    return zlib.crc32(gram.encode()) & (slots - 1)


def fit_ngram(
    train: DataFrame, min_df: int = MIN_DF, max_ngrams: int = MAX_NGRAMS,
    iterations: int = LR_ITERATIONS,
) -> NgramModel:
    """tf-idf of character n-grams and a class-balanced, L2-regularized logistic regression.

    The vocabulary is refit on the rows given. The penalty weighs like 1 per data set: the mean
    loss over n rows takes 1/n.
    """
    return fit_ngrams(train, [F.lit(True)], min_df, max_ngrams, iterations)[0]


def fit_ngrams(
    train: DataFrame, sets: list[Column], min_df: int = MIN_DF, max_ngrams: int = MAX_NGRAMS,
    iterations: int = LR_ITERATIONS,
) -> list[NgramModel]:
    """`fit_ngram` of each of several sets of the rows, given by their conditions. Each has its own vocabulary,
    weights and regression; the n-grams of a row are made and looked up once for all of them."""
    # One table of texts and weights after the other: the packed rows of all are small.
    chosen = side_by_side(lambda v: v.select("gram", "weight").toArrow(), vocabularies(train, sets, min_df, max_ngrams))
    models = [NgramModel._of_rows(rows) for rows in chosen]
    every = NgramModel.over(models)
    marks = [F.coalesce(c.cast("boolean"), F.lit(False)).alias(f"_in{i}") for i, c in enumerate(sets)]
    coded = durable(every._entries(train.select("hostname", F.col("label").cast("double"), *marks), "hostname").drop("hostname"))

    def run(i: int) -> NgramModel:
        rows = coded.where(f"_in{i}").select("label", "_entries")
        return _regression(models[i], rows, every, iterations)

    return side_by_side(run, list(range(len(sets))), terms_at_once(models))


def _regression(model: NgramModel, rows: DataFrame, every: NgramModel, iterations: int) -> NgramModel:
    """`model` fitted to (label, _entries), the entries of `every`."""
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # two rows
    n = sum(r.n for r in size)
    weight = F.lit(0.0)
    for r in size:
        weight = F.when(F.col("label") == r.label, n / (2.0 * r.n)).otherwise(weight)
    ready = model.recoded(rows.withColumn("_weight", weight), every)
    regression = LogisticRegression(
        featuresCol="_unit", labelCol="label", weightCol="_weight", maxIter=iterations,
        standardization=False, regParam=1.0 / n, tol=1e-4,
    )
    # Stored, as each of up to `iterations` steps reads the vectors; in no more parts than the rows need, as a step is
    # a job whose tasks each hand over a whole gradient.
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "table")
    ready.select("_unit", "label", "_weight").write.parquet(path)
    stored = StructType([StructField("_unit", VectorUDT()), *(ready.schema[c] for c in ("label", "_weight"))])
    fitted = regression.fit(spark.read.schema(stored).parquet(path).coalesce(max(ceil(n / FIT_ROWS), 1)))
    model.coefficient, model.intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    return model


# ---------------------------------------------------------------------- boosted trees
def fit_boosted(
    train: DataFrame, columns: tuple[str, ...] = FEATURES, trees: int = TREES,
    depth: int = TREE_DEPTH,
) -> Boosted:
    fit = BoostedFit("all", tuple(columns))
    return fit_all(train, [fit], trees, depth, LEARNING_RATE)[fit.name]


def importance(model: Boosted) -> DataFrame:
    """(feature, importance), one row per feature: its mean gain per split, as a share."""
    return SparkSession.active().createDataFrame(model.importance(), "feature STRING, importance DOUBLE")


def top_importance(model: Boosted, k: int = 15) -> DataFrame:
    return importance(model).orderBy(F.col("importance").desc(), "feature").limit(k)


Model = NgramModel | Boosted
Fit = Callable[[DataFrame], Model]


def predict(model: Model, df: DataFrame, output: str = "probability") -> DataFrame:
    """Add the probability of class 1; every partition is scored where it lies."""
    return model.score(df.select(*[c for c in df.columns if c != output]), output)


def predictions(asked: list[tuple[Model, DataFrame, list[str]]]) -> list[DataFrame]:
    """The stored predictions of each (model, rows, columns to keep): a plan has the constants of one model."""
    run = lambda a: durable(predict(a[0], a[1]).select(*a[2]))
    return side_by_side(run, asked, terms_at_once([a[0] for a in asked]))


# ------------------------------------------------------------------------- evaluation
@dataclass
class Evaluation:
    """Out-of-fold, test and stress scores of one model, and the model fit on all of train."""

    oof: DataFrame
    test: DataFrame
    stress: DataFrame
    model: Model


def fit_eval(fit: Fit, train: DataFrame, test: DataFrame, stress: DataFrame, k: int = 5) -> Evaluation:
    """k fits on `fold != i` that score `fold = i`, and one on all rows."""
    *parts, model = fit_each(fit, [train.where(F.col("fold") != i) for i in range(k)] + [train])
    return evaluate(parts, model, train, test, stress)


def fit_each(fit: Fit, sets: list[DataFrame]) -> list[Model]:
    """The fits of several sets of rows, submitted together: each is a row of short jobs that wait for the
    driver between two steps, and the jobs of the others fill the gaps."""
    return side_by_side(fit, sets)


def folds_out(k: int) -> list[Column]:
    """The sets of k fits that each leave a fold out, and of one on all rows."""
    return [*[F.col("fold") != i for i in range(k)], F.lit(True)]


def side_by_side(run: Callable, items: list, at_once: int = FITS_AT_ONCE) -> list:
    """`run` of each item, at most `at_once` of them submitted together."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(run), items))


def terms_at_once(models: list[Model]) -> int:
    """How many of the models may be at work together: each fit of a regression has some 25 vectors of the length of its
    vocabulary on the driver, and each plan its n-grams. Steps over rows enough for large vocabularies fill the
    executors one at a time."""
    most = max((len(m.grams) for m in models if isinstance(m, NgramModel)), default=0)
    return max(1, min(FITS_AT_ONCE, TERMS_AT_ONCE // max(most, 1)))


def evaluate(
    parts: list[Model], model: Model, train: DataFrame, test: DataFrame, stress: DataFrame,
) -> Evaluation:
    """Scores of train by the model of `parts` that has not seen the row's fold, of the rest by `model`."""
    keep = [c for c in ("hostname", "label", "fold", "source") if c in train.columns]
    asked = [(part, train.where(F.col("fold") == i), [*keep, "probability"]) for i, part in enumerate(parts)]
    asked += [(model, test, ["hostname", "label", "source", "probability"]), (model, stress, ["hostname", "probability"])]
    *scored, of_test, of_stress = predictions(asked)
    return Evaluation(reduce(DataFrame.unionByName, scored), of_test, of_stress, model)


def boosted_evaluations(
    models: dict[str, tuple[str, ...]], train: DataFrame, test: DataFrame, stress: DataFrame, k: int = 5,
    trees: int = TREES, depth: int = TREE_DEPTH,
) -> dict[str, Evaluation]:
    """`fit_eval` of boosted trees over several sets of columns; the k + 1 fits of each are grown together."""
    fits = [BoostedFit(f"{name} {i}", columns, i) for name, columns in models.items() for i in range(k)]
    fits += [BoostedFit(name, columns) for name, columns in models.items()]
    grown = fit_all(train, fits, trees, depth, LEARNING_RATE)
    scored = side_by_side(
        lambda name: evaluate([grown[f"{name} {i}"] for i in range(k)], grown[name], train, test, stress), list(models))
    return dict(zip(models, scored))


def with_ngram_column(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach another model's probability by hostname, the row id of the host tables."""
    ngram = scores.select("hostname", F.col("probability").alias(NGRAM_COLUMN))
    return df.join(ngram, "hostname")


@dataclass
class Comparison:
    evaluations: dict[str, Evaluation]

    def _all(self, part: str) -> DataFrame:
        out = None
        for name, e in self.evaluations.items():
            df = getattr(e, part).withColumn("model", F.lit(name))
            out = df if out is None else out.unionByName(df)
        return out

    def thresholds(self, target_fpr: float = TARGET_FPR) -> DataFrame:
        """(model, threshold): one row per model."""
        spark = SparkSession.active()
        rows = [
            (name, metrics.pick_threshold(e.oof, target_fpr))
            for name, e in self.evaluations.items()
        ]
        return spark.createDataFrame(rows, "model STRING, threshold DOUBLE")

    def table(self) -> DataFrame:
        """(model, metric, value) for all models at once; pivot for the wide view."""
        limit = F.broadcast(self.thresholds())  # one row per model
        oof, test, stress = self._all("oof"), self._all("test"), self._all("stress")
        at = test.join(limit, "model")
        parts = [
            limit,
            metrics.fold_summary(
                metrics.ranking_metrics(oof, by=("model", "fold")), ("model",)
            ),
            metrics.ranking_metrics(test, by=("model",)).selectExpr(
                "model", "average_precision AS test_pr_auc", "roc_auc AS test_roc_auc"
            ),
            oof.where("label = 0").join(limit, "model").groupBy("model").agg(
                F.avg((F.col("probability") >= F.col("threshold")).cast("double")).alias(
                    "oof_fpr"
                )
            ),
        ]
        for name, t in (("fpr1", F.col("threshold")), ("t05", F.lit(DEFAULT_THRESHOLD))):
            m = metrics.threshold_metrics(at, t, by=("model",))
            parts.append(
                m.select(
                    "model",
                    *[F.col(c).alias(f"test_{name}_{c}") for c in ("precision", "recall", "f1", "fpr")],
                )
            )
        high = F.col("probability") >= F.col("threshold")
        parts.append(
            stress.join(limit, "model").groupBy("model").agg(
                F.avg(high.cast("double")).alias("stress_fp_rate_fpr1"),
                F.avg((F.col("probability") >= DEFAULT_THRESHOLD).cast("double")).alias(
                    "stress_fp_rate_t05"
                ),
            )
        )
        by_source = at.where("label = 0").groupBy("model", "source").agg(
            F.avg("probability").alias("mean_prob_legit"), F.avg(high.cast("double")).alias("fpr_legit")
        )
        long = None
        for part in parts:
            names = [c for c in part.columns if c != "model"]
            rows = part.unpivot(["model"], names, "metric", "value")
            long = rows if long is None else long.unionByName(rows)
        sources = by_source.unpivot(
            ["model", "source"], ["mean_prob_legit", "fpr_legit"], "metric", "value"
        ).select("model", F.concat_ws("_", F.lit("test"), "metric", "source").alias("metric"), "value")
        return long.unionByName(sources)

    def flagged_stress(self) -> DataFrame:
        """(model, at, hostname, probability): stress hosts at or above each model's threshold (`fpr1`) and at
        or above 0.5 (`t05`)."""
        limits = self.thresholds().withColumn("at", F.lit("fpr1"))
        limits = limits.unionByName(limits.withColumn("at", F.lit("t05")).withColumn("threshold", F.lit(DEFAULT_THRESHOLD)))
        hits = self._all("stress").join(F.broadcast(limits), "model")  # two rows a model
        return hits.where("probability >= threshold").select("model", "at", "hostname", "probability")


def compare_models(
    rows: DataFrame, stress: DataFrame, k: int = 5, trees: int = TREES, depth: int = TREE_DEPTH,
    iterations: int = LR_ITERATIONS, seed: int = SEED,
) -> Comparison:
    """The four models on the same folds. `rows`: hostname, registered_domain, label, source,
    split; `stress`: hostname. Features and folds are computed once."""
    train = rows.where("split = 'train'").drop("fold")
    train = durable(with_features(grouped_folds(train, "registered_domain", "label", k, seed)))
    test = durable(with_features(rows.where("split = 'test'")))
    stress = durable(with_features(stress))

    *parts, model = fit_ngrams(train, folds_out(k), iterations=iterations)
    base = evaluate(parts, model, train, test, stress)
    boosted = boosted_evaluations(
        {"boosted_base": BASE_FEATURES, "boosted_all": FEATURES, "stacked": (*FEATURES, NGRAM_COLUMN)},
        durable(with_ngram_column(train, base.oof)), durable(with_ngram_column(test, base.test)),
        durable(with_ngram_column(stress, base.stress)), k, trees, depth,
    )
    return Comparison({
        "boosted_base": boosted["boosted_base"], "boosted_all": boosted["boosted_all"], "ngram_lr": base,
        "stacked": boosted["stacked"],
    })


# --------------------------------------------------------------------------- champion
@dataclass
class Champion:
    """The stacked model with its threshold: hostname in, probability out."""

    ngram: NgramModel
    boosted: Boosted
    threshold: float
    data_version: str = DATA_VERSION
    feature_version: str = FEATURE_VERSION

    @staticmethod
    def of(comparison: Comparison) -> "Champion":
        stacked = comparison.evaluations["stacked"]
        return Champion(
            comparison.evaluations["ngram_lr"].model, stacked.model,
            metrics.pick_threshold(stacked.oof, TARGET_FPR),
        )

    def score_features(self, feats: DataFrame) -> DataFrame:
        """Score rows that already carry the 22 features."""
        return predict(self.boosted, predict(self.ngram, feats, NGRAM_COLUMN)).drop(NGRAM_COLUMN)

    def score(self, hosts: DataFrame) -> DataFrame:
        """Add `probability`; batch or streaming."""
        keep = [c for c in hosts.columns if c not in FEATURES]
        return self.score_features(with_features(hosts)).select(*keep, "probability")

    def save(self, spark: SparkSession, path: str) -> None:
        self.ngram.save(spark, f"{path}/ngram")
        self.boosted.save(spark, f"{path}/boosted")
        row = [(self.threshold, self.data_version, self.feature_version)]
        spark.createDataFrame(
            row, "threshold DOUBLE, data_version STRING, feature_version STRING"
        ).coalesce(1).write.parquet(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Champion":
        meta = spark.read.parquet(f"{path}/metadata").first()
        return Champion(
            NgramModel.load(spark, f"{path}/ngram"), Boosted.load(spark, f"{path}/boosted"),
            meta.threshold, meta.data_version, meta.feature_version,
        )


def train_champion(
    train: DataFrame, k: int = 5, trees: int = TREES, depth: int = TREE_DEPTH,
    iterations: int = LR_ITERATIONS,
) -> Champion:
    """Only what the stacked model needs. `train`: hostname, label, fold and the features."""
    *parts, whole = fit_ngrams(train, folds_out(k), iterations=iterations)
    keep = [F.col(c) for c in train.columns if c != NGRAM_COLUMN]
    named = [*keep, F.col("probability").alias(NGRAM_COLUMN)]
    asked = [(model, train.where(F.col("fold") == i), named) for i, model in enumerate(parts)]
    columns = (*FEATURES, NGRAM_COLUMN)
    stacked = reduce(DataFrame.unionByName, predictions(asked))
    fits = [BoostedFit(str(i), columns, i) for i in range(k)] + [BoostedFit("all", columns)]
    grown = fit_all(stacked, fits, trees, depth, LEARNING_RATE)
    scores = None
    for i in range(k):
        part = predict(grown[str(i)], stacked.where(F.col("fold") == i)).select("label", "probability")
        scores = part if scores is None else scores.unionByName(part)
    threshold = metrics.pick_threshold(durable(scores), TARGET_FPR)
    return Champion(whole, grown["all"], threshold)
