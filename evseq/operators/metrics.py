"""Evaluation. Scores are first counted by value; running totals over values go by ranges of them, so no task holds them all, and all
metrics of all labels come from one curve, whose input is read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Counts and ratios at a threshold. A label that isn't 1 is negative; rows with a null label or score count for nothing. A ratio of
    nothing is 0. Empty table: one row of zeros, or with `by` none."""
    hit = F.col(p) >= threshold
    pos = F.col(y) == 1
    d = df.groupBy(*by).agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return d.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def curve(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score, from the highest: tp and fp so far, pos and neg here, n_pos and n_neg of all, precision and recall. Scores may
    be any numbers; rows whose label is neither 0 nor 1 count for nothing, a null score is below all others. Null `by` values are one label.
    Empty table: no rows.

    Counted scores are dealt out once, by ranges; a range's scores are summed by themselves, and the ranges before it add their totals, which
    are read from the same exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = df.groupBy(*by, F.col(p).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    # The number of ranges is stated, so that both sides see the same ones.
    c = c.repartitionByRange(n, *by, F.col("score").desc_nulls_last()).withColumn("_part", F.spark_partition_id())
    per = c.groupBy("_part", *by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    every = Window.partitionBy(*by)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_tp": F.coalesce(F.sum("_pos").over(before), F.lit(0)), "_fp": F.coalesce(F.sum("_neg").over(before), F.lit(0)), "n_pos": F.sum("_pos").over(every), "n_neg": F.sum("_neg").over(every)}
    per = per.withColumns(sums).select(*[F.col(k).alias(f"_r{k}") for k in ("_part", *by)], *sums)
    so_far = Window.partitionBy("_part", *by).orderBy(F.col("score").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    d = c.withColumns({"tp": F.sum("pos").over(so_far), "fp": F.sum("neg").over(so_far)})
    d = d.join(per, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in ("_part", *by)])
    d = d.withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")}).drop("_part", "_tp", "_fp", *[f"_r{k}" for k in ("_part", *by)])
    return d.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tp") / F.nullif("n_pos", F.lit(0))})


def areas(recall: float = 0.8) -> dict[str, Column]:
    """Aggregates of curve(). auroc: the share of pairs in order, ties half; null with one class. ap: steps of recall times precision. auc_pr:
    trapezoids between neighbouring thresholds, from recall 0 and precision 1; what the threshold before had follows from the running
    totals. precision: the greatest at the given recall or more."""
    below = F.col("n_neg") - F.col("fp")
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    return {
        "auroc": F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0))) / F.nullif(F.max("n_pos") * F.max("n_neg"), F.lit(0)),
        "ap": F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("n_pos"), F.lit(0)),
        "auc_pr": F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * (F.col("precision") + before) / 2),
        "precision": F.max(F.when(F.col("recall") >= recall, F.col("precision"))),
    }


def curve_metrics(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = (), recall: float = 0.8, names: tuple[str, ...] = ("auroc", "ap", "auc_pr", "precision")) -> DataFrame:
    """All of areas(), or those named, for each label, in one pass. Without `by` one row always, of nulls if the table is empty."""
    every = areas(recall)
    return curve(df, y, p, by).groupBy(*by).agg(*[every[n].alias(n) for n in names])


def auroc(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """The share of pairs in order, ties half; null with one class."""
    return curve_metrics(df, y, p, by, names=("auroc",))


def average_precision(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Steps of recall times precision. Of probabilities, or of hard predictions if those are given as p."""
    return curve_metrics(df, y, p, by, names=("ap",))


def auc_pr(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Trapezoids between neighbouring thresholds; the curve starts at recall 0 and precision 1."""
    return curve_metrics(df, y, p, by, names=("auc_pr",))


def precision_at_recall(df: DataFrame, recall: float = 0.8, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """The greatest precision at that recall or more; null without positives."""
    return curve_metrics(df, y, p, by, recall, ("precision",))


def macro(df: DataFrame, by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Means over labels that have both classes, and their number. One row always."""
    d = curve_metrics(df, y, p, (by,), names=("auroc", "ap", "precision")).where("auroc is not null")
    return d.agg(F.avg("auroc").alias("auroc"), F.avg("ap").alias("ap"), F.avg("precision").alias("precision"), F.count(F.lit(1)).alias("n_labels"))


def weighted_loss(df: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    return df.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def positive_probability(logits: str) -> Column:
    """Softmax of two logits, or the sigmoid of one."""
    z = F.when(F.size(logits) == 1, -F.get(logits, 0)).otherwise(F.get(logits, 0) - F.get(logits, 1))
    return 1 / (1 + F.exp(z))


def hard(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """confusion() and the area under the curve of hard predictions, which is the mean of both recalls; null with one class."""
    c = confusion(df, y, p, by, threshold)
    one_class = (F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0)
    return c.withColumn("auc", F.when(~one_class, F.col("balanced_accuracy")))


def micro(df: DataFrame, key: str, task: str, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Metrics of several labels pooled. df: a row for each key and label. precision, recall, f1 and auc count every cell alike;
    accuracy is the share of keys all of whose labels are right."""
    right = (F.col(p) >= threshold) == (F.col(y) == 1)
    whole = df.groupBy(key).agg(F.min(right.cast("int")).alias("all_right")).agg(F.avg("all_right").alias("accuracy"))
    return hard(df.dropDuplicates([key, task]), y, p, (), threshold).drop("accuracy").crossJoin(F.broadcast(whole))  # one row each


def fold_average(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each metric over folds, one row each; folds where it is null or NaN are left out of that mean."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return df.groupBy(*by).agg(*[F.avg(known(c)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_folds"))


def argmax(values: str) -> Column:
    return F.array_position(F.col(values), F.array_max(values)) - 1


def softmax(values: str, temperature: float = 1.0) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
