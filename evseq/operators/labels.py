"""Task labels from sequences. -1 stands for a label or cutoff that there is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import arrays, codes


def task_labels(seqs: DataFrame, truncated: bool = False) -> DataFrame:
    """Death and sepsis from the full history, or with truncated from the arrays alone."""
    died = F.exists("event_tokens", lambda x: codes.is_death(x)) if truncated else F.col("died")
    septic = F.exists("event_tokens", codes.is_sepsis_token) if truncated else F.col("septic")
    died, septic = F.coalesce(died, F.lit(False)), F.coalesce(septic, F.lit(False))
    none = F.array().cast("array<bigint>")
    d = seqs.withColumns({
        "death_after_start": F.when(died, 0).otherwise(-1), "death_after_end": F.when(died, 30).otherwise(-1), "label_mortality_2weeks": died.cast("int"), "label_mortality_1month": died.cast("int"),
        "label_sepsis": septic.cast("int"), "common_conditions": none, "rare_conditions": none,
    })
    return d.drop("died", "septic")


def mortality(seqs: DataFrame, days: dict[str, int] | None = None) -> DataFrame:
    known = F.col("death_after_start") >= 0
    return seqs.withColumns({f"label_mortality_{n}": (known & (F.col("death_after_end") <= d)).cast("int") for n, d in (days or {"2weeks": 15, "1month": 32}).items()})


def readmission(seqs: DataFrame, visit: str = "[VS]", within: tuple[str, ...] = tuple(schema.READMISSION_TOKENS)) -> DataFrame:
    """Of subjects with two visits or more: was the last one soon after the one before?"""
    known, new = readmission_columns(visit, within)
    return seqs.where(known).withColumns(new | {"num_visits": F.col("num_visits") - 1, "token_length": F.size("event_tokens")})


def readmission_columns(visit: str = "[VS]", within: tuple[str, ...] = tuple(schema.READMISSION_TOKENS)) -> tuple[Column, dict[str, Column]]:
    """Whether a subject is in the cohort, and its cutoff and label."""
    last = arrays.last_index("event_tokens", visit)
    before = F.when(last > 0, F.get("event_tokens", last - 1)).otherwise(F.try_element_at("event_tokens", F.lit(-1)))
    return (F.col("num_visits") >= 2) & last.isNotNull(), {"cutoff_readmission": last - 1, "label_readmission_1month": F.coalesce(before.isin(*within), F.lit(False)).cast("int")}


def length_of_stay(seqs: DataFrame, threshold: float = 7, minimum: float = 1, cutoff_hours: float = 24, first_event_hours: float | None = None, visit: str = "[VS]", end: str = "[VE]") -> DataFrame:
    """Of the last visit. length_of_stay counts tokens over 24, not hours; los_hours is the true length. Only subjects whose last visit
    has its first event before first_event_hours (minimum days, if not given)."""
    known, new = length_of_stay_columns(threshold, minimum, cutoff_hours, first_event_hours, visit, end)
    ends = {"last_vs": arrays.last_index("event_tokens", visit), "last_ve": arrays.last_index("event_tokens", end)}
    d = seqs.withColumns(ends).where(known).withColumns(new)
    return d.withColumns({"token_length": F.size("event_tokens"), "los_hours": F.get("elapsed_tokens", F.col("last_ve")) - F.get("elapsed_tokens", F.col("last_vs"))})


def length_of_stay_columns(threshold: float = 7, minimum: float = 1, cutoff_hours: float = 24, first_event_hours: float | None = None, visit: str = "[VS]", end: str = "[VE]") -> tuple[Column, dict[str, Column]]:
    """Whether a subject is in the cohort, and its length of stay, label and cutoff."""
    vs, ve = arrays.last_index("event_tokens", visit), arrays.last_index("event_tokens", end)
    stay = (ve - 1 - (vs + 1)) / F.lit(24.0)
    known = vs.isNotNull() & ve.isNotNull() & (stay >= minimum) & (F.get("elapsed_tokens", vs + 1) < (minimum * 24 if first_event_hours is None else first_event_hours))
    cutoff = arrays.first_index_where("elapsed_tokens", lambda x, i: (x > cutoff_hours) & (i > vs) & (i < ve))
    return known, {"length_of_stay": stay, "label_los_1week": (stay >= threshold).cast("int"), "cutoff_los": F.coalesce(cutoff, F.size("event_tokens"))}


def conditions(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("all_conditions", F.concat("common_conditions", "rare_conditions"))


def multi_task(original: DataFrame, condition: DataFrame, dead: DataFrame, readmitted: DataFrame, los: DataFrame, n_conditions: int = 20) -> DataFrame:
    """All tasks' labels and cutoffs beside the sequences, by patient_id."""
    labels = ["label_mortality_1month", "cutoff_readmission", "label_readmission_1month", "cutoff_los", "label_los_1week"]
    d = original.drop(*labels, "all_conditions")
    d = d.join(condition.select("patient_id", "all_conditions"), "patient_id", "left").join(dead.select("patient_id", "label_mortality_1month"), "patient_id", "left")
    d = d.join(readmitted.select("patient_id", "cutoff_readmission", "label_readmission_1month"), "patient_id", "left").join(los.select("patient_id", "cutoff_los", "label_los_1week"), "patient_id", "left")
    fill: dict[str, Column] = {c: F.coalesce(c, F.lit(schema.MISSING)).cast("int") for c in labels}
    rest = [c for c in d.columns if c not in (*labels, "all_conditions")]
    return d.select(*rest, *[v.alias(k) for k, v in fill.items()], *arrays.wide("all_conditions", [f"label_c{i}" for i in range(n_conditions)]))


def multi_task_of(seqs: DataFrame, n_conditions: int = 20, **stay) -> DataFrame:
    """multi_task() of sequences that have condition lists and death offsets, in one pass over them: cohorts are conditions, not tables
    that are joined again. stay: settings of length_of_stay()."""
    readmitted, r = readmission_columns()
    stays, s = length_of_stay_columns(**stay)
    new = {k: F.when(readmitted, c) for k, c in r.items()} | {k: F.when(stays, c) for k, c in s.items() if k != "length_of_stay"}
    d = conditions(mortality(seqs)).withColumns({k: F.coalesce(c, F.lit(schema.MISSING)).cast("int") for k, c in new.items()})
    return d.select(*[c for c in d.columns if c != "all_conditions"], *arrays.wide("all_conditions", [f"label_c{i}" for i in range(n_conditions)]))


def datapoints(wide: DataFrame, tasks: list[str], keep: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """One row for each subject and task that has a label. Of task x: label_x, and a cutoff column if one begins cutoff_ and the
    task's first word."""
    def cutoff(t: str) -> Column:
        names = [c for c in (f"cutoff_{t}", f"cutoff_{t.split('_')[0]}") if c in wide.columns]
        return F.col(names[0]).cast("int") if names else F.lit(None).cast("int")

    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"label_{t}").cast("int").alias("label"), cutoff(t).alias("cutoff")) for t in tasks])
    d = wide.select(*keep, F.explode(rows).alias("x")).select(*keep, "x.task", "x.label", "x.cutoff")
    return d.where(F.col("label").isNotNull() & (F.col("label") != schema.MISSING))


def scalar_or_missing(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("int"), F.lit(schema.MISSING))
