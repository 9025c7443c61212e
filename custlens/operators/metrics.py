"""Classifier metrics from a table of labels (0 or 1) and scores, exact at any size.

Curves never sort the table in one task: equal scores are counted first, the distinct scores are dealt to tasks by ranges,
as many as their size asks for, and running totals are taken inside each range on top of the totals of the ranges before
it. ``by`` names columns with few levels, e.g. the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from custlens.functions.scalars import ratio
from custlens.session import materialize


def score_curve(
    scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """One row per distinct score, highest first, with counts and running totals of both classes.

    Runs at once up to the counts of the distinct scores, which it writes. Broadcast sides hold at most one row per range and
    level of ``by``. The ranges are as many as Spark finds fit, or ``tasks``.
    """
    by = list(by)
    keys = by or ["everything"]
    rows = scored.select(
        *(by or [F.lit(0).alias("everything")]),
        F.col(label).cast("long").alias("label"),
        F.col(score).cast("double").alias("score"),
    )
    positives, negatives = F.sum("label"), F.sum(1 - F.col("label"))
    counted = rows.groupBy(*keys, "score").agg(positives.alias("pos"), negatives.alias("neg"))
    # Ranges are numbered from the highest scores down.
    ranged = counted.repartitionByRange(*([tasks] if tasks else []), *keys, F.desc("score"))
    counted = materialize(ranged.withColumn("bucket", F.spark_partition_id()), "scores")
    in_order = W.partitionBy(*keys).orderBy("bucket")
    totals = (
        counted.groupBy(*keys, "bucket")
        .agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.max("score").alias("top"))
        .withColumn("p_before", F.sum("p").over(in_order) - F.col("p"))
        .withColumn("q_before", F.sum("q").over(in_order) - F.col("q"))
        .withColumn("positives", F.sum("p").over(W.partitionBy(*keys)))
        .withColumn("negatives", F.sum("q").over(W.partitionBy(*keys)))
        .drop("p", "q")
    )
    # A range's totals and the first score of the range after it.
    totals = totals.withColumn("next_top", F.lead("top").over(in_order)).drop("top")
    downwards = W.partitionBy(*keys, "bucket").orderBy(F.desc("score"))
    return (
        counted.join(F.broadcast(totals), [*keys, "bucket"])
        .withColumn("cum_pos", F.col("p_before") + F.sum("pos").over(downwards))
        .withColumn("cum_neg", F.col("q_before") + F.sum("neg").over(downwards))
        .withColumn("next_score", F.coalesce(F.lead("score").over(downwards), "next_top"))
        .select(
            *keys, "bucket", "score", "pos", "neg", "cum_pos", "cum_neg", "positives", "negatives", "next_score"
        )
    )


def ranking_metrics(
    scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """ROC-AUC (tied scores count half) and average precision; null when a class is missing."""
    curve = score_curve(scored, label, score, by, tasks)
    keys = [c for c in by] or ["everything"]
    wide = F.col("neg").cast("decimal(38,0)")
    result = curve.groupBy(*keys).agg(
        ratio(
            F.sum(wide * (2 * F.col("cum_pos") - F.col("pos"))),
            2 * F.max("positives").cast("decimal(38,0)") * F.max("negatives"),
        ).alias("auc_roc"),
        ratio(
            F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))), F.max("positives")
        ).alias("auc_pr"),
    )
    return result if by else result.drop("everything")


def roc_points(
    scored: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Points of the ROC curve from (0, 0) on: the first and last score, and every corner between them."""
    curve = score_curve(scored, label, score, by, tasks)
    keys = [c for c in by] or ["everything"]
    # The step that follows a point, even across buckets, is the counts of the next lower score. Its
    # counts are on the row of that score, at most one row per bucket boundary away.
    down = W.partitionBy(*keys, "bucket").orderBy(F.desc("score"))
    firsts = curve.groupBy(*keys, "bucket").agg(
        F.max("score").alias("first_score"),
        F.max_by("pos", "score").alias("first_pos"),
        F.max_by("neg", "score").alias("first_neg"),
    )
    stepped = (
        curve.withColumn("next_pos", F.lead("pos").over(down))
        .withColumn("next_neg", F.lead("neg").over(down))
        .join(
            F.broadcast(firsts.drop("bucket").withColumnRenamed("first_score", "next_score")),
            [*keys, "next_score"],
            "left",
        )
        .withColumn("next_pos", F.coalesce("next_pos", "first_pos"))
        .withColumn("next_neg", F.coalesce("next_neg", "first_neg"))
    )
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    corners = stepped.where(
        first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    ).select(
        *keys,
        ratio(F.col("cum_neg"), F.col("negatives")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("positives")).alias("tpr"),
    )
    origin = curve.groupBy(*keys).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = origin.unionByName(corners)
    return points if by else points.drop("everything")


def binary_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, each 0 where it would divide by zero."""
    y, guess = F.col(label) == 1, F.col(prediction) == 1
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(y & guess).alias("hit"),
        F.count_if(guess).alias("guessed"),
        F.count_if(y).alias("actual"),
        F.count_if(y == guess).alias("right"),
    )
    return counts.select(
        *by,
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        _or_zero(F.col("hit"), F.col("guessed")).alias("precision"),
        _or_zero(F.col("hit"), F.col("actual")).alias("recall"),
        _or_zero(2 * F.col("hit"), F.col("guessed") + F.col("actual")).alias("f1"),
    )


def weighted_report(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of every class, averaged with the classes' sizes as weights."""
    cells = scored.groupBy(*by, F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("g")).agg(
        F.count("*").alias("n")
    )
    # Each confusion cell counts towards its actual and its predicted class: at most classes squared rows.
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed")),
                F.struct(F.col("g").alias("cls"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed")),
            )
        ),
        F.when(F.col("y") == F.col("g"), F.col("n")).otherwise(0).alias("hit2"),
    )
    classes = sides.groupBy(*by, "cls").agg(
        F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), (F.sum("hit2") / 2).alias("hit")
    )
    support = F.sum("actual").cast("double")

    def weighted(part: Column, whole: Column) -> Column:
        return F.sum(_or_zero(part, whole) * F.col("actual")) / support

    return classes.groupBy(*by).agg(
        weighted(F.col("hit"), F.col("guessed")).alias("precision"),
        weighted(F.col("hit"), F.col("actual")).alias("recall"),
        weighted(2 * F.col("hit"), F.col("guessed") + F.col("actual")).alias("f1"),
    )


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))
