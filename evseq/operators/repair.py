"""Repairs of sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evseq.functions import arrays, codes, timecols


def unnested(df: DataFrame) -> DataFrame:
    """Arrays of one array become that array; the schema says which."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType)]
    return df.withColumns({c: arrays.flat(c) for c in nested}) if nested else df


def with_ages(df: DataFrame) -> DataFrame:
    """Ages as years since the first event: a repair, not an age since birth."""
    return df.withColumn("age_tokens", timecols.age_from_elapsed("elapsed_tokens"))


def with_defaults(df: DataFrame, n: int) -> DataFrame:
    values = {"type_tokens": 0, "age_tokens": 25, "elapsed_tokens": 0.0, "visit_tokens": 0, "position_tokens": 0}
    return df.withColumns({c: arrays.or_default(c, v, n) if c in df.columns else F.array_repeat(F.lit(v), n) for c, v in values.items()})


def back_filled(df: DataFrame, max_len: int = 2048) -> DataFrame:
    """Columns that a sequence table lacks, from those it has: time_tokens from elapsed_tokens, type_tokens from the tokens, age_tokens
    as estimated ages, label_mortality_1month from the death offsets. Columns that are there stay as they are, nulls included."""
    have, new = set(df.columns), {}
    tokens = arrays.truncate("event_tokens", max_len)
    if "time_tokens" not in have and "elapsed_tokens" in have:
        new["time_tokens"] = F.col("elapsed_tokens")
    if "type_tokens" not in have:
        new["type_tokens"] = F.transform(tokens, codes.token_type)
    if "age_tokens" not in have and "elapsed_tokens" in have:
        new["age_tokens"] = arrays.truncate(timecols.estimated_age("event_tokens", "elapsed_tokens"), max_len)
    if "label_mortality_1month" not in have and {"death_after_start", "death_after_end"} <= have:
        n = lambda c: F.col(c).try_cast("double")
        new["label_mortality_1month"] = F.coalesce((n("death_after_start") >= 0) & (n("death_after_end") <= 32), F.lit(False)).cast("int")
    return df.withColumns(new) if new else df
