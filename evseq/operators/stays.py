"""Patients and stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import timecols
from evseq.operators.ranks import dealt, parts


def keep_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order. (dropDuplicates has none.)"""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def with_patients(events: DataFrame, patients: DataFrame) -> DataFrame:
    """events with their patient's columns; of several rows of a patient the first by year counts. Spark broadcasts patients if
    they are small."""
    one = keep_one(patients, ["subject_id"], ["anchor_year", "anchor_age", "year_of_birth"])
    return dealt(events, parts(events), "subject_id").join(one, "subject_id", "left")


def filled_age(df: DataFrame, age: str = "age", order: tuple[str, ...] = ("time", "code"), key: str = "subject_id") -> DataFrame:
    """age carried forward, then back, then 25."""
    w = Window.partitionBy(key).orderBy(*order)
    forth = F.last(age, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(age, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("age_filled", F.coalesce(forth, back, F.lit(schema.DEFAULT_AGE)))


def master_stays(stays: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """One row for each stay with the 20 columns of schema.STAY; several rows of an admission give several. Large tables are dealt out by
    the admission, in parts that don't grow with them."""
    n, admission = parts(stays, admissions), ["subject_id", "hadm_id"]
    dod = keep_one(patients, ["subject_id"], ["dod"]).select("subject_id", "dod")
    d = dealt(stays.dropna(subset=[*admission, "stay_id", "intime"]), n, *admission).join(dealt(admissions, n, *admission), admission, "left").join(dod, "subject_id", "left")
    d = d.withColumn("hospital_expire_flag", F.coalesce("hospital_expire_flag", F.lit(0)))
    d = d.withColumn("death_time", F.coalesce("deathtime", "dod"))
    d = d.withColumns({"in_hosp_mortality": F.col("hospital_expire_flag").cast("int"), "mortality_28d": timecols.died_within("death_time", "intime")})
    return schema.conform(d, schema.STAY)
