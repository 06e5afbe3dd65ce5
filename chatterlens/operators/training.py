"""Training sets, evaluation, fitting and the deployment gate."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatterlens.functions import decode as dec, labels as lab, scalars as sc
from chatterlens.operators import filters

# Shares of the splits, least training size, default loss.
THREE_WAY = {"train": 80, "val": 10, "test": 10}
TWO_WAY = {"train": 80, "val": 20}
MIN_SAMPLES = 100
DEFAULT_LOSS = 15.0


# --- data -------------------------------------------------------------------

def aligned(comments: DataFrame) -> DataFrame:
    """Labels with spans; comments left without labels drop out."""
    folded = comments.withColumn("folded", F.lower("text"))
    spans = folded.withColumn("labels", lab.align("labels", "text", "folded")).drop("folded")
    return sc.where_found(spans, "labels", F.when(F.size("labels") > 0, F.col("labels")))


def with_targets(comments: DataFrame, **limits) -> DataFrame:
    return aligned(comments).withColumn("targets", lab.target_matrix("labels", "text", **limits))


def quadruples(comments: DataFrame) -> DataFrame:
    """Text and label quadruples of labeled comments, missing fields empty."""
    return filters.labeled(comments).select(
        "comment_id", "text", lab.training_quadruples("labels").alias("quadruples"))


def split_name(bucket: Column, shares: dict[str, int] = THREE_WAY) -> Column:
    """Split of a bucket number in 0..99."""
    names = list(shares)
    choice, upper = F.lit(names[-1]), 100
    for name in reversed(names[:-1]):
        upper -= shares[names[names.index(name) + 1]]
        choice = F.when(bucket < upper, name).otherwise(choice)
    return choice


def with_split(df: DataFrame, key: str = "comment_id", shares: dict[str, int] = THREE_WAY, seed: int = 42) -> DataFrame:
    """A split per row that depends only on its key and the seed, so reruns agree."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(100))
    return df.withColumn("split", split_name(bucket, shares))


def quality(samples: DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    count = F.count("*")
    return samples.agg(count.alias("samples"), (count >= least).alias("passed"))


def require_quality(samples: DataFrame, least: int = MIN_SAMPLES) -> int:
    found = quality(samples, least).first()
    if not found["passed"]:
        raise ValueError(f"insufficient training data: {found['samples']} < {least}")
    return found["samples"]


# --- evaluation -------------------------------------------------------------

def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = sc.ratio(tp, tp + fp), sc.ratio(tp, tp + fn)
    f1 = sc.ratio(2 * tp, 2 * tp + fp + fn)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score")]


def slot_metrics(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """Strict slot-by-slot match of six numbers. A slot is valid when its
    target starts with anything but -1; every miss is a false positive and a
    false negative at once."""
    pairs = F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))
    slots = sc.each(rows, pairs, "slot").select("slot.*")
    valid = slots.filter(F.col("t")[0] != -1)
    counts = valid.agg(F.count("*").alias("valid"), F.count_if(F.col("p") == F.col("t")).alias("tp"))
    miss = F.col("valid") - F.col("tp")
    return counts.select(
        "valid", "tp", sc.ratio("tp", "valid").alias("accuracy"), *_scores(F.col("tp"), miss, miss))


def quad_metrics(predicted: DataFrame, gold: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Set comparison of predicted and gold quads by all ``keys``."""
    p = predicted.select(*keys).distinct().withColumn("in_predicted", F.lit(True))
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    both = p.join(g, list(keys), "full")
    hit = F.col("in_predicted").isNotNull() & F.col("in_gold").isNotNull()
    counts = both.agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("in_gold").isNull()).alias("fp"),
        F.count_if(F.col("in_predicted").isNull()).alias("fn"),
    )
    return counts.select("tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def head_numbers(aspect, sentiment, e_start, e_end, o_start, o_end) -> Column:
    """The six numbers of one predicted slot."""
    order = (e_start, e_end, o_start, o_end, aspect, sentiment)
    return F.array(*[dec.argmax(head) for head in order])


# --- fitting ----------------------------------------------------------------

def text_classifier(label: str, text: str = "text", features: int = 1 << 16) -> Pipeline:
    """TF-IDF and logistic regression over the words of a text."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="target", handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol="target", maxIter=20),
    ])


def _f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="target", metricName="f1")


def fit_best(samples: DataFrame, label: str, strengths=(0.0, 0.01, 0.1), seed: int = 42) -> PipelineModel:
    """The regularisation strength with the best validation F1."""
    pipeline = text_classifier(label)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].regParam, list(strengths)).build()
    search = TrainValidationSplit(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=_f1(), trainRatio=0.8, seed=seed)
    return search.fit(samples).bestModel


def evaluate(model: PipelineModel, samples: DataFrame, label: str) -> dict[str, float]:
    scored = model.transform(samples)
    loss = MulticlassClassificationEvaluator(labelCol="target", metricName="logLoss")
    return {"label": label, "f1": _f1().evaluate(scored), "loss": loss.evaluate(scored)}


def best_epoch(history: DataFrame, patience: int = 20) -> DataFrame:
    """Best validation F1 per run, earliest epoch on a tie, among the epochs a
    run with the given patience would have seen."""
    so_far = Window.partitionBy("run").orderBy("epoch")
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    improves = F.col("f1") > F.coalesce(F.max("f1").over(earlier), F.lit(float("-inf")))
    marked = history.withColumn("last_best", F.when(improves, F.col("epoch")))
    marked = marked.withColumn("last_best", F.max("last_best").over(so_far))
    stop = F.when(F.col("epoch") - F.col("last_best") >= patience, F.col("epoch"))
    stops = marked.groupBy("run").agg(F.min(stop).alias("stopped_at"))
    seen = history.join(stops, "run").filter(
        F.col("stopped_at").isNull() | (F.col("epoch") <= F.col("stopped_at")))
    best = F.max(F.struct("f1", (-F.col("epoch")).alias("neg"), "epoch")).alias("best")
    return seen.groupBy("run").agg(best, F.max("epoch").alias("last_epoch")).select(
        "run", F.col("best.epoch").alias("best_epoch"), F.col("best.f1").alias("best_f1"), "last_epoch")


def deploy_decisions(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Deploy a model only if its loss is below the one in use (15.0 when none)."""
    used = current.select("model", F.col("loss").alias("current_loss"))
    gate = F.when(F.col("loss") < F.col("current_loss"), "deployed").otherwise("skipped")
    return (
        candidates.join(used, "model", "left")
        .fillna(DEFAULT_LOSS, ["current_loss"]).withColumn("decision", gate)
    )
