"""Profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_fractions(df: DataFrame) -> DataFrame:
    """column, fraction: one pass over the table."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("fraction")) for c in df.columns])
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def per_subject(df: DataFrame, key: str = "subject_id") -> DataFrame:
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n_subjects"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    b = F.least(F.greatest(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(1)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def hours_of_day(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.hour(time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def prevalence(df: DataFrame, labels: list[str]) -> DataFrame:
    known = lambda c: F.when(F.col(c) != -1, F.col(c))
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.avg(known(c)).alias("mean"), F.count_if(F.col(c) == 1).alias("positive"), F.count(known(c)).alias("n")) for c in labels])
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")
