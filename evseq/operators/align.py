"""Joins of events and studies to the stays in whose time they fall.

Keys are the subject and a bin of time: a stay stands in each bin that it touches, an event in its own, so a subject with many stays and many
events costs their sum and what matches, and is dealt out over as many tasks as it has bins. Stays without an end, or of more than MOST_BINS
bins, are joined by the subject alone; of those nearly every event that follows matches anyhow. Nothing is broadcast by hint.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import timecols
from evseq.operators.ranks import dealt, parts

#: Hours of a bin, and the most bins that a stay is spread over. A stay travels once for each of its bins, and is a candidate for what is in them.
BIN_HOURS, MOST_BINS = 336, 32


def time_bin(c: str | Column) -> Column:
    """Which bin of BIN_HOURS a time is in; null for null."""
    return F.floor(F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(c) if isinstance(c, str) else c) / (3600 * BIN_HOURS))


def spread(spans: DataFrame, low: str, high: str) -> tuple[DataFrame, DataFrame]:
    """Spans with _bin, a row for each bin they touch, and those that are joined without bins: open or very long ones. A span that ends
    before it begins, or begins nowhere, is in neither."""
    first, last = time_bin(low), time_bin(high)
    d = spans.where(F.col(low).isNotNull() & (F.col(high).isNull() | (F.col(high) >= F.col(low))))
    short = F.coalesce(last - first < MOST_BINS, F.lit(False))
    return d.where(short).withColumn("_bin", F.explode(F.sequence(first, last))), d.where(~short)


def inside(points: DataFrame, time: str, spans: DataFrame, low: str, high: str, on: Column, keys: dict[str, str], cut: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """points joined to the spans that hold their time, bounds included, where `on` holds. keys: what of it is equal columns, by which, with
    the bin, large tables are dealt out. Columns of both sides have names of their own. cut: leaves out rows of large tables by what a task
    has joined; it is given the columns by which these rows were dealt out, equal ones being in one task.

    Both joins ask the same of points, that there is a time: a bin that might be null would be asked for too, in one of them, and what
    points are made of would be shuffled twice. A point's bin is an expression in the exchange and in the join, so it doesn't travel."""
    binned, whole = spread(spans, low, high)
    on &= (F.col(time) >= F.col(low)) & (F.col(high).isNull() | (F.col(time) <= F.col(high)))
    n = parts(points, spans)
    points = points.where(F.col(time).isNotNull())
    binned = dealt(binned, n, *keys.values(), "_bin")
    at = F.coalesce(time_bin(time), F.lit(0))  # of null times, which there are none of any more
    near = dealt(points, n, *keys, at).join(binned, on & (at == F.col("_bin")))
    far = dealt(points, n, *keys).join(dealt(whole, n, *keys.values()), on)
    if cut and n:
        near, far = cut(near, [*keys.values(), "_bin"]), cut(far, [*keys.values()])
    return near.drop("_bin").unionByName(far)


def events_in_stays(events: DataFrame, stays: DataFrame, context_hours: int = 168, cut: Callable[[DataFrame, list[str]], DataFrame] | None = None) -> DataFrame:
    """Events from context_hours before a stay to its end, bounds included; an open stay has no end. Admissions must agree where
    both are known. An event may match several stays, and repeated rows of either side match each. Null subjects and times match nothing.
    cut: as of inside(); what it leaves of large tables is dealt out by the stay."""
    context, more = F.expr(f"interval {context_hours} hours"), [c for c in ("in_hosp_mortality", "mortality_28d") if c in stays.columns]
    s = stays.select(F.col("subject_id").alias("_subject"), "stay_id", F.col("hadm_id").alias("stay_hadm_id"), (F.col("intime") - context).alias("_low"), "outtime", *more)
    on = (F.col("subject_id") == F.col("_subject")) & (F.col("stay_hadm_id").isNull() | F.col("hadm_id").isNull() | (F.col("hadm_id") == F.col("stay_hadm_id")))
    d = inside(events, "time", s, "_low", "outtime", on, {"subject_id": "_subject"}, cut)
    # A stay stands in each of its bins, so what follows from the rest of it doesn't travel.
    d = d.select(*events.columns, "stay_id", "stay_hadm_id", (F.col("_low") + context).alias("intime"), "outtime", *more)
    return dealt(d, parts(events, stays), "stay_id") if cut else d


def studies_in_stays(studies: DataFrame, stays: DataFrame, null_keys_match: bool = False, first_hours_only: float | None = None, keep_all: bool = True) -> DataFrame:
    """Studies taken during a stay, with hours from its start, rank and flags within it, and both sides' other columns.

    first_hours_only: studies later than so many hours are left out before ranks are given. keep_all=False: each stay's first only.
    Studies without a time, an id or an image go; ranks' ties are broken by study_id, null times never match.
    """
    labels = [c for c in ("in_hosp_mortality", "mortality_28d") if c in stays.columns and c not in studies.columns]
    s = stays.select(F.col("subject_id").alias("_subject"), F.col("hadm_id").alias("_hadm"), "stay_id", "intime", "outtime", *labels)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b)) if null_keys_match else F.col(a) == F.col(b)
    keys = {"subject_id": "_subject"} | ({"hadm_id": "_hadm"} if "hadm_id" in studies.columns else {})
    on = reduce(operator.and_, [same(*k) for k in keys.items()])
    d = inside(studies.where("jpg_path_exists").dropna(subset=["StudyDateTime", "study_id"]), "StudyDateTime", s, "intime", "outtime", on, {} if null_keys_match else keys).drop("_subject", "_hadm")
    d = d.withColumn("hours_from_icu_intime", timecols.hours("intime", "StudyDateTime"))
    if first_hours_only is not None:
        d = d.where(F.col("hours_from_icu_intime") <= first_hours_only)
    rank = F.row_number().over(Window.partitionBy("stay_id").orderBy("StudyDateTime", "study_id")) - 1
    d = d.withColumn("image_rank_in_stay", rank)
    d = d.withColumns({"is_first_image": (F.col("image_rank_in_stay") == 0).cast("int"), "is_first_24h_image": (F.col("hours_from_icu_intime") <= 24).cast("int")})
    return d if keep_all else d.where("is_first_image = 1")


def image_index(index: DataFrame) -> DataFrame:
    """studies_in_stays() with the columns of schema.IMAGE, in order; those that there are not are null."""
    return schema.conform(index, schema.IMAGE)


def top_images(index: DataFrame, k: int) -> DataFrame:
    return index.where(F.col("image_rank_in_stay") < k)


def latest_study(studies: DataFrame) -> DataFrame:
    """Each subject's last study, ties by study_id; null times come last, null subjects are one. Empty table: no rows."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("StudyDateTime"), F.desc("study_id"))
    return studies.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_manifest(index: DataFrame, manifest: DataFrame) -> DataFrame:
    return index.join(manifest, "study_id", "left")


#: Images of a stay that are taken, the first by rank.
MOST_IMAGES = 32


def with_inputs(stays: DataFrame, coefficients: DataFrame, images: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """Stays with coefficients and images where there are any, and masks that say so. Of a stay's images the first `most` by rank, cut in
    each task before they travel; of a stay that has coefficients twice, the least. Stays stay as many as they are; null ids have neither."""
    c = coefficients.groupBy("stay_id").agg(F.min(F.struct(*[x for x in coefficients.columns if x != "stay_id"])).alias("_c"))
    first = images.where(F.col("stay_id").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("stay_id").orderBy("image_rank_in_stay", "image"))).where(F.col("_n") <= most)
    i = first.groupBy("stay_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "image"))), lambda x: x["image"]).alias("images"))
    d = stays.join(c, "stay_id", "left").join(i, "stay_id", "left")
    return d.withColumns({"has_coefficients": F.col("_c").isNotNull().cast("int"), "has_images": F.col("images").isNotNull().cast("int")}).select("*", "_c.*").drop("_c")


def fused_batches(stays: DataFrame, coefficients: DataFrame, images: DataFrame, batch: str, width: int, dim: int, most: int = MOST_IMAGES) -> DataFrame:
    """with_inputs() as a batch takes them: coefficients (rows of `width` numbers) and images (vectors of `dim`) padded by zero rows to the
    longest of the batch; n_coefficients and n_images say how many are real. A stay without any has zeros and the mask 0.

    coefficients: stay_id, coefficients as an array of rows; images: stay_id, image_rank_in_stay, image as a vector. Nulls inside are 0.
    Lengths of a batch come from one aggregate, so batches of any size are never in one task.
    """
    zero = lambda n: F.array_repeat(F.lit(0.0), n)
    rows = lambda c: F.coalesce(c, F.array().cast("array<array<double>>"))
    plain = lambda a: F.transform(a, lambda x: F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))
    d = with_inputs(stays, coefficients, images, most).withColumns({"coefficients": rows(plain("coefficients")), "images": rows(plain("images"))})
    d = d.withColumns({"n_coefficients": F.size("coefficients"), "n_images": F.size("images")})
    longest = d.groupBy(F.col(batch).alias("_b")).agg(F.greatest(F.max("n_coefficients"), F.lit(1)).alias("_c"), F.greatest(F.max("n_images"), F.lit(1)).alias("_i"))
    d = d.join(longest, F.col(batch).eqNullSafe(F.col("_b")))
    pad = lambda a, n, size: F.concat(a, F.array_repeat(zero(size), n - F.size(a)))
    return d.withColumns({"coefficients": pad(F.col("coefficients"), F.col("_c"), width), "images": pad(F.col("images"), F.col("_i"), dim)}).drop("_b", "_c", "_i")
