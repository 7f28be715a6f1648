"""Cohorts, splits and samples. Every random order is that of md5(seed:key), so samples are the same on every engine and run."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evseq import schema
from evseq.operators.ranks import DIGITS, shuffled


def min_visits(seqs: DataFrame, k: int) -> DataFrame:
    """Subjects with k visits or more; a null count is none. Repeated rows stay."""
    return seqs.where(F.col("num_visits") >= k)


def longer_than(seqs: DataFrame, n: int = 5) -> DataFrame:
    """Rows with more than n tokens; null arrays have none."""
    return seqs.where(F.size("event_tokens") > n)


def members(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose key is among ids, each once however often it stands there; null keys are never."""
    return df.join(ids.select(key), key, "left_semi")


def others(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose key is not among ids; rows with a null key stay."""
    return df.join(ids.select(key), key, "left_anti")


def distinct_ids(*frames: DataFrame, key: str = "subject_id") -> DataFrame:
    """The keys of all frames, each once, in order; nulls are left out."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.where(F.col(key).isNotNull()).distinct().orderBy(key)


def first_labels(df: DataFrame, label: str, order: tuple[str, ...], key: str = "subject_id") -> DataFrame:
    """Of each key its first valid label in the given order: nulls and -1 are passed over, keys without any have no row."""
    valid = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.col(label) != schema.MISSING)
    return df.where(valid).groupBy(key).agg(F.min_by(label, F.struct(*order, label)).alias(label))


def split(ids: DataFrame, test: float, key: str = "subject_id", seed: str = "23", names: tuple[str, str] = ("pretrain", "test")) -> DataFrame:
    """int(test * n) ids, first in hash order, are the test split."""
    r = shuffled(ids, key, seed)
    return r.withColumn("split", F.when(F.col("_rank") < F.floor(F.col("_total") * test), names[1]).otherwise(names[0])).drop("_rank", "_total")


def stratified(ids: DataFrame, label: str, test: float, key: str = "subject_id", seed: str = "23", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """round(test * n) of each label's ids."""
    r = shuffled(ids, key, seed, (label,))
    return r.withColumn("split", F.when(F.col("_rank") < F.floor(F.col("_total") * test + 0.5), names[1]).otherwise(names[0])).drop("_rank", "_total")


def combination(labels: list[str]) -> Column:
    """The labels' values as one, nulls as -1."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in labels])


def allotted(combos: list[str], sizes: list[int], test: float) -> list[int]:
    """Of each combination of labels how many rows go to the test split, by iterative stratification.

    The label (value 1) that has fewest rows left is dealt first, all its combinations that are open: of those rows the test split gets so
    many as it still wants of the label, each combination in proportion, by rounding the running total, so the label is met to half a
    row and each combination to one. What was dealt is taken off the wants of all labels that go with it. Rows without labels come last.
    """
    flags = [[k for k, v in enumerate(c.split(",")) if v == "1"] for c in combos]
    every = max((len(c.split(",")) for c in combos), default=0)  # the number of the label that all rows have
    of: list[list[int]] = [[] for _ in range(every + 1)]
    for i, f in enumerate(flags):
        f.append(every)
        for k in f:
            of[k].append(i)
    left = [sum(sizes[i] for i in at) for at in of]
    wants = [n * test for n in left]
    out = [-1] * len(combos)
    while left and left[every]:
        k = min((k for k in range(every) if left[k]), key=left.__getitem__, default=every)
        part, so_far, before = max(0.0, min(1.0, wants[k] / left[k])), 0, 0
        for i in of[k]:
            if out[i] < 0:
                so_far += sizes[i]
                upto = math.floor(so_far * part + 0.5)
                out[i], before = upto - before, upto
                for q in flags[i]:
                    left[q] -= sizes[i]
                    wants[q] -= out[i]
    return out


def multi_label_stratified(ids: DataFrame, labels: list[str], test: float | int, key: str = "subject_id", seed: str = "23", names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Iterative stratification: every label keeps its share in both splits, rare labels first. test: a part, or a number of rows.

    The sequential pass runs in one task over the combinations of labels that occur, a row each, never over ids; ids of one combination
    are alike to it, and take their places in hash order. Nulls are -1. Empty table: no rows.
    """
    d = ids.withColumn("_combo", combination(labels))
    n = d.groupBy("_combo").agg(F.count(F.lit(1)).alias("_n"))

    def deal(combos: pd.DataFrame) -> pd.DataFrame:
        combos = combos.sort_values("_combo")
        sizes = combos["_n"].tolist()
        return pd.DataFrame({"_c": combos["_combo"], "_test": allotted(combos["_combo"].tolist(), sizes, test if isinstance(test, float) else min(1.0, test / sum(sizes)))})

    quotas = n.withColumn("_one", F.lit(True)).groupBy("_one").applyInPandas(deal, "_c string, _test long")
    r = shuffled(d, key, seed, ("_combo",)).join(quotas, F.col("_combo") == F.col("_c"))
    return r.withColumn("split", F.when(F.col("_rank") < F.col("_test"), names[1]).otherwise(names[0])).drop("_rank", "_total", "_combo", "_c", "_n", "_test")


def balanced(ids: DataFrame, label: str, n: int, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """n // 2 ids with label 1 and as many with label 0, or all of a label that has fewer; other labels and nulls are left out."""
    r = shuffled(ids.where(F.col(label).isin(0, 1)), key, seed, (label,))
    return r.where(F.col("_rank") < n // 2).drop("_rank", "_total")


def sample(ids: DataFrame, n: int, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """The n rows first in hash order, or all if there are fewer; repeated keys count as rows, null keys come first. Each task keeps n rows
    at most, and only those travel."""
    return ids.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")).asc_nulls_first(), key).limit(n)


def downsampled(points: DataFrame, ratio: float, key: str = "patient_id", label: str = "label", seed: str = "23") -> DataFrame:
    """Positives, and int(positives / ratio) - positives negatives at most; other labels are dropped. Counts travel as one row."""
    n = points.agg(F.count_if(F.col(label) == 1).alias("_pos"))
    r = shuffled(points.where(F.col(label).isin(0, 1)), key, seed, (label,)).crossJoin(F.broadcast(n))
    return r.where((F.col(label) == 1) | (F.col("_rank") < F.floor(F.col("_pos") / ratio) - F.col("_pos"))).drop("_rank", "_total", "_pos")


def few_shot(ids: DataFrame, label: str | list[str], sizes: list[int], scheme: str, val: float = 0.2, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """Rows (split, scheme, key, subject_id) of training and validation subsets for each size. Schemes: balanced, stratified, and
    multi_label, for which label is a list: subsets and their validation parts are then dealt by iterative stratification."""
    out = None
    for n in sizes:
        if scheme == "multi_label":
            picked = multi_label_stratified(ids, label, n, key, seed).where("split = 'test'").drop("split")
        elif scheme == "balanced":
            picked = balanced(ids, label, n, key, seed)
        else:
            r = shuffled(ids.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "-1")), key, seed, (label,))
            of = r.agg(F.count(F.lit(1)).alias("_all"))
            picked = r.crossJoin(F.broadcast(of)).where(F.col("_rank") < F.floor(F.col("_total") * n / F.col("_all") + 0.5)).drop("_rank", "_total", "_all")
        part = (multi_label_stratified if scheme == "multi_label" else stratified)(picked, label, val, key, seed, ("train", "val"))
        part = part.select("split", F.lit(scheme).alias("scheme"), F.lit(str(n)).alias("key"), F.col(key).alias("subject_id"))
        out = part if out is None else out.unionByName(part)
    return out


def prefix(ids: DataFrame, sizes: list[int], key: str = "subject_id", seed: str = "23") -> DataFrame:
    """rank of each id, and the smallest size whose prefix has it: all subsets in one table. A column named rank is replaced."""
    r = shuffled(ids.drop("rank"), key, seed)
    first: Column = F.lit(None).cast("int")
    for n in sorted(sizes, reverse=True):
        first = F.when(F.col("_rank") < n, n).otherwise(first)
    return r.withColumn("in_prefix", first).withColumnRenamed("_rank", "rank").drop("_total")


def folds(ids: DataFrame, label: str, k: int = 10, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """Folds 0 to k - 1, each label dealt out in turn; null is a label of its own."""
    return shuffled(ids, key, seed, (label,)).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_total")


def train_val(df: DataFrame, val: float, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """A split by hash alone: no shuffle."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(u < val, "val").otherwise("train"))


def overlapping(ids: DataFrame, labels: list[str] | dict[str, int], per_value: int = 0, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """For each label in turn and each of its values 0 and 1, so many ids (per_value, or the label's own number), those already chosen
    first, then in hash order; ids chosen by any, each once. Values of other kinds and null ids are passed over. Empty table: no rows.

    What a label can choose afresh is among its first ids in hash order, so many as it asks for, whatever was chosen before: these are
    found for all labels and values together, by counts of hash buckets. The turns are then windows over those candidates alone, whose
    number the caller states; the input is read twice, however many labels there are.
    """
    most = labels if isinstance(labels, dict) else dict.fromkeys(labels, per_value)
    md5 = lambda c: F.md5(F.concat(F.lit(f"{seed}:{c}:"), F.col(key).cast("string")).cast("binary"))
    asked = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y"), F.lit(n).alias("most"), md5(c).alias("md5")) for c, n in most.items()])
    d = ids.where(F.col(key).isNotNull()).select(key, *most, F.explode(F.filter(asked, lambda x: x["y"].isin(0, 1))).alias("_a"))
    d = d.withColumn("_bucket", F.substring("_a.md5", 1, DIGITS))
    per = d.groupBy(F.col("_a.label").alias("_label"), F.col("_a.y").alias("_y"), "_a.most", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_so_far", F.sum("_n").over(Window.partitionBy("_label", "_y").orderBy("_bucket")))
    # Two rows for each label.
    last = F.broadcast(per.groupBy("_label", "_y").agg(F.min(F.when(F.col("_so_far") >= F.col("most"), F.col("_bucket"))).alias("_last")))
    near = d.join(last, (F.col("_a.label") == F.col("_label")) & (F.col("_a.y") == F.col("_y"))).where(F.col("_last").isNull() | (F.col("_bucket") <= F.col("_last")))
    near = near.withColumn("_place", F.row_number().over(Window.partitionBy("_label", "_y").orderBy("_a.md5", key))).where(F.col("_place") <= F.col("_a.most"))
    places = {f"_p{i}": F.min(F.when(F.col("_label") == c, F.col("_place"))) for i, c in enumerate(most)}
    out = near.groupBy(key, *most).agg(*[p.alias(n) for n, p in places.items()]).withColumn("_used", F.lit(False))
    for (c, n), p in zip(most.items(), places, strict=True):
        fresh, same = ~F.col("_used") & F.col(p).isNotNull(), Window.partitionBy(c)
        place = F.count_if(fresh).over(same.orderBy(F.asc_nulls_last(p), key).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_used", F.col("_used") | (fresh & (place <= F.lit(n) - F.count_if(F.col("_used")).over(same))))
    return out.where("_used").select(key).distinct()


def condition_weights(wide: DataFrame, labels: list[str], most: float = 50.0) -> DataFrame:
    """sqrt(negatives / positives), clipped, for each label."""
    counts = [F.struct(F.lit(c).alias("label"), F.count_if(F.col(c) == 1).alias("pos"), F.count_if(F.col(c) == 0).alias("neg")) for c in labels]
    d = wide.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return d.withColumn("weight", F.least(F.sqrt(F.col("neg") / F.greatest("pos", F.lit(1))), F.lit(most)))


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows by name; of a key in several frames, that of the first."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_frame", *[c for c in out.columns if c not in (key, "_frame")])
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_frame")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: equal, and how many ids only one side has."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    only = lambda c: F.count_if(F.col(c).isNull())
    return both.agg(only("_b").alias("only_left"), only("_a").alias("only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def others_sample(ids: DataFrame, without: int, n: int, key: str = "subject_id", seed: str = "23") -> DataFrame:
    """n ids in hash order, one id left out."""
    return sample(ids.where(F.col(key) != without), n, key, seed)
