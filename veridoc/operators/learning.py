"""Feature pipelines and classifiers over a labelled history, evaluated by grouped folds and by time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.functions.session import cut, known
from veridoc.operators.corpus import binary_metrics
from veridoc.operators.history import send_index, temporal_split


class FrequentIndexer(Estimator):
    """A StringIndexer of the categories that training has `least` times or more; all others share the slot of those it hasn't seen."""

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], least: int):
        super().__init__()
        self.inputs, self.outputs, self.least = list(inputs), list(outputs), least

    def _fit(self, dataset: DataFrame) -> StringIndexerModel:
        labels = StringIndexer(inputCols=self.inputs, outputCols=self.outputs, handleInvalid="keep", stringOrderType="frequencyDesc").fit(dataset).labelsArray
        # labels stand by falling frequency, so the frequent ones come first
        often = [dataset.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).filter(F.col("n") >= self.least).agg(F.count("*").alias(c)) for c in self.inputs]
        kept = [list(x)[: df.head()[0]] for x, df in zip(labels, often, strict=True)]
        return StringIndexerModel.from_arrays_of_labels(kept, inputCols=self.inputs, outputCols=self.outputs, handleInvalid="keep")


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str], *, least: int = 2) -> Pipeline:
    """Median imputation and scaling of numbers, one-hot categories of `least` rows or more, with one slot for rarer ones and those not seen in training."""
    filled = [f"{c}_filled" for c in numeric]
    indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    stages = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(withMean=True, inputCol="numbers", outputCol="scaled"),
    ]
    if categorical:
        stages += [FrequentIndexer(categorical, indexed, least), OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep")]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["scaled", *hot], outputCol="features")])


def logistic_model(*, n: int, label: str = "label", c: float = 0.3) -> LogisticRegression:
    """Balanced logistic regression; the penalty is 1 / (C n), as the loss is a mean here."""
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * max(1, n)), maxIter=50)


def _weighted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    n, ones = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).head()
    w = F.when(F.col(label) == 1, n / (2.0 * max(1, ones))).otherwise(n / (2.0 * max(1, n - ones)))
    return df.withColumn("weight", w), n


def fit_predict(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *, label: str) -> DataFrame:
    """`test` with `score`, the probability of label 1 that a model of `train` gives."""
    weighted, n = _weighted(train, label)
    model = Pipeline(stages=[feature_pipeline(numeric, categorical), logistic_model(n=n, label=label)]).fit(weighted)
    drop = [c for c in model.transform(test.limit(0)).columns if c not in test.columns]
    return model.transform(test).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop(*drop)


def deal(classes: Sequence[tuple[int, int, int]], folds: int) -> dict[tuple[int, int], list[int]]:
    """For each class of groups (positives, negatives, how many such groups) how many of them each fold gets.

    Large groups are dealt first. Of a class every fold gets the same number; what is left over goes one by one to the fold
    that then has the least share of the scarcer label, and of rows among equals, so folds are alike in both.
    """
    rows, ones = [0] * folds, [0] * folds
    out = {}
    scarce = 0 if sum(p * n for p, _, n in classes) <= sum(q * n for _, q, n in classes) else 1
    for p, q, n in sorted(classes, key=lambda c: (-c[scarce], -(c[0] + c[1]), c)):
        got = [n // folds] * folds
        for _ in range(n % folds):
            at = min((f for f in range(folds) if got[f] == n // folds), key=lambda f: (ones[f] + got[f] * (p, q)[scarce], rows[f] + got[f] * (p + q), f))
            got[at] += 1
        for f in range(folds):
            rows[f] += got[f] * (p + q)
            ones[f] += got[f] * (p, q)[scarce]
        out[(p, q)] = got
    return out


def grouped_folds(df: DataFrame, group: str, *, label: str, folds: int = 5) -> DataFrame:
    """`fold`: rows of a group are never parted, and folds are alike in rows and in labels. A row without a group is one by itself.

    Groups are counted by their positives and negatives; a row for each such pair, of which there are few however many
    groups, is dealt in the driver. Groups of one pair are numbered by a hash and take the folds in order.
    """
    rows = cut(df.withColumn("_group", F.when(known(group), F.concat(F.lit("g"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("r"), F.monotonically_increasing_id()))))
    one = (F.col(label) == 1).cast("long")
    groups = cut(rows.groupBy("_group").agg(F.coalesce(F.sum(one), F.lit(0)).alias("_p"), F.count("*").alias("_all")).withColumn("_h", F.xxhash64("_group")))
    classes = groups.groupBy("_p", "_all").agg(F.count("*").alias("n")).orderBy("_p", "_all").collect()
    dealt, table, before = deal([(r["_p"], r["_all"] - r["_p"], r["n"]) for r in classes], folds), [], 0
    for r in classes:  # the groups' numbers, in the order of their classes
        upto = list(accumulate(dealt[(r["_p"], r["_all"] - r["_p"])]))
        table.append((r["_p"], r["_all"], before, upto))
        before += r["n"]
    numbered = send_index(groups, ["_p", "_all", "_h", "_group"], out="_no")
    of = df.sparkSession.createDataFrame(table, "_p long, _all long, _first long, _upto array<long>")
    fold = F.size(F.filter("_upto", lambda x: x < F.col("_no") - F.col("_first")))
    placed = numbered.join(of, ["_p", "_all"]).select("_group", fold.alias("fold"))
    return rows.join(placed, "_group").drop("_group")


def grouped_cv(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str], *, label: str, folds: int = 5) -> DataFrame:
    """A row of binary_metrics for each fold, scored by a model of the other folds, and one with a null `fold` for all scores together; with test_size and test_passes."""
    f = cut(grouped_folds(df, group, label=label, folds=folds))
    parts = [cut(fit_predict(f.filter(F.col("fold") != k), f.filter(F.col("fold") == k), numeric, categorical, label=label).withColumn("score", F.round("score", 9))) for k in range(folds)]
    return fold_metrics(parts, label)


def fold_metrics(parts: Sequence[DataFrame], label: str, *, score: str = "score") -> DataFrame:
    """binary_metrics of each of the scored `parts`, numbered from 0, and of all together with a null `fold`."""
    every = reduce(DataFrame.unionByName, parts)
    out = []
    for k, part in [*enumerate(parts), (None, every)]:
        sizes = part.agg(F.count("*").alias("test_size"), F.count_if(F.col(label) == 1).alias("test_passes"))
        # both sides are one row
        out.append(binary_metrics(part, label, score).withColumn("fold", F.lit(k).cast("int")).withColumn("_k", F.lit(1)).join(sizes.withColumn("_k", F.lit(1)), "_k").drop("_k"))
    return reduce(DataFrame.unionByName, out)


def temporal_holdout(df: DataFrame, order: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], *, label: str, frac: float = 0.7) -> DataFrame:
    """binary_metrics of the later rows, scored by a model of the earlier ones."""
    s = cut(temporal_split(df, order, frac=frac))
    scored = fit_predict(s.filter("split = 'train'"), s.filter("split = 'test'"), numeric, categorical, label=label)
    return binary_metrics(scored.withColumn("score", F.round("score", 9)), label, "score")
