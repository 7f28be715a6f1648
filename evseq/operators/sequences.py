"""Ordered parallel arrays, one row for each subject or stay.

Two bounded phases. What is asked of all of a key's events (counts, flags, first times) comes from partial aggregates. The events that
enter arrays are the first max_len by a window limit, which Spark also applies in each task before the exchange: a key with a billion
events sends max_len rows from each task and is never sorted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import codes, timecols
from evseq.operators import align
from evseq.operators.ranks import dealt, parts


#: Order of a subject's and of a stay's events; nulls first.
EVENT_ORDER, STAY_ORDER = ("time", "seq", "code"), ("time", "code")


def first_events(events: DataFrame, max_len: int = 2048, key: str | list[str] = "subject_id", order: tuple = EVENT_ORDER) -> DataFrame:
    """events with _n, the place from 1, for each key's first max_len; ties of the whole order are placed anyhow. The session's threshold
    for window limits is raised to max_len where it is less, as the limit would not reach the tasks before the exchange otherwise."""
    conf, name = events.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(conf.get(name)) < max_len:
        conf.set(name, str(max_len))
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= max_len)


def event_tokens(events: DataFrame, max_len: int = 2048, preserve_bracketed: bool = True) -> DataFrame:
    """subject_id, pos, token, type of each subject's first max_len events: the sequences in long form, for what needs no arrays."""
    token = codes.sanitize("code", preserve_bracketed)
    return first_events(events, max_len).select("subject_id", (F.col("_n") - 1).alias("pos"), token.alias("token"), codes.token_type(token).alias("type"))


def patient_sequences(events: DataFrame, max_len: int = 2048, visit: str = "[VS]", preserve_bracketed: bool = True, null_time: str = "skip") -> DataFrame:
    """subject_id, event/type/age/elapsed/visit/position arrays of the first max_len events, num_visits of all.

    Order: time, nulls first, then seq. null_time 'propagate': a subject whose first time is null has null hours; 'skip': hours
    count from the first known time. Rows without a subject are left out. Empty table: no rows.
    """
    events = events.where(F.col("subject_id").isNotNull())
    token = codes.sanitize("code", preserve_bracketed)
    is_visit = F.col("code") == visit
    age = F.col("age") if "age" in events.columns else F.lit(None).cast("int")
    known = F.min("time") if null_time == "skip" else F.when(F.count("time") == F.count(F.lit(1)), F.min("time"))
    facts = events.groupBy("subject_id").agg(
        known.alias("start"), F.min_by(F.when(age.isNotNull(), age), F.when(age.isNotNull(), F.struct(*EVENT_ORDER))).alias("first_age"), F.greatest(F.count_if(is_visit), F.lit(1)).alias("num_visits"),
        F.bool_or(codes.is_death(token)).alias("died"), F.bool_or(codes.is_sepsis_token(token)).alias("septic"),
    )
    so_far = Window.partitionBy("subject_id").orderBy(*EVENT_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    d = first_events(events, max_len).withColumns({"_visit": F.sum(F.coalesce(is_visit, F.lit(False)).cast("int")).over(so_far), "_age": F.last(age, ignorenulls=True).over(so_far)})
    row = F.struct((F.col("_n") - 1).alias("pos"), token.alias("token"), codes.token_type(token).alias("type"), F.col("_age").alias("age"), F.col("time"), F.col("_visit").alias("visit"))
    out = d.groupBy("subject_id").agg(F.array_sort(F.collect_list(row)).alias("_e")).join(facts, "subject_id")
    field = lambda f: F.transform("_e", f)
    arrays = {
        "event_tokens": field(lambda x: x["token"]), "type_tokens": field(lambda x: x["type"]), "age_tokens": field(lambda x: F.coalesce(x["age"], F.col("first_age"), F.lit(schema.DEFAULT_AGE))),
        "elapsed_tokens": field(lambda x: timecols.whole_hours("start", x["time"])), "visit_tokens": field(lambda x: x["visit"]), "position_tokens": field(lambda x: x["pos"]),
    }
    return out.select("subject_id", F.col("subject_id").alias("patient_id"), *[c.alias(n) for n, c in arrays.items()], "num_visits", "died", "septic")


def suffixed(seqs: DataFrame, max_len: int) -> DataFrame:
    """Arrays named with their length, as files have them."""
    return seqs.withColumnsRenamed({c: f"{c}_{max_len}" for c in seqs.columns if c.endswith("_tokens")})


def unsuffixed(seqs: DataFrame, max_len: int) -> DataFrame:
    return seqs.withColumnsRenamed({c: c.removesuffix(f"_{max_len}") for c in seqs.columns if c.endswith(f"_tokens_{max_len}")})


def in_order(keep: str) -> tuple:
    """The order by which a stay's events are kept."""
    return STAY_ORDER if keep == "head" else tuple(F.desc(c) for c in STAY_ORDER)


def sequences_in_stays(events: DataFrame, stays: DataFrame, max_len: int = 2048, keep: str = "head") -> DataFrame:
    """stay_sequences() of events_in_stays(). Of large tables each task keeps max_len events of a stay by windows that need no exchange, and
    what is left is dealt out by the stay in parts that don't grow: Spark's own exchange would have its fixed number of parts."""
    cut = lambda d, by: first_events(d, max_len, [*by, "stay_id"], in_order(keep)).drop("_n")
    return stay_sequences(align.events_in_stays(events, stays), max_len, keep, align.events_in_stays(events, stays, cut=cut))


def stay_sequences(matched: DataFrame, max_len: int = 2048, keep: str = "head", among: DataFrame | None = None) -> DataFrame:
    """One row for each stay: arrays of its first (keep='tail': last) max_len events (hours from intime, negative before), labels of all.
    matched: events_in_stays(); rows without a stay are left out. among: those of matched that may be kept, dealt out by the stay; else all. Ages: the last known at the event; before any is known the first known; else from the birth event; else the
    default. Empty table: no rows."""
    age = F.col("age") if "age" in matched.columns else F.lit(None).cast("int")
    at = F.struct(*STAY_ORDER)
    matched = matched.where(F.col("stay_id").isNotNull())
    # What a stay has once travels with its facts. The events that are kept ask for the same columns of stays (`once`), although their facts
    # have them: with other columns than facts they would be matched to stays by an exchange of stays of their own.
    once = ("in_hosp_mortality", "mortality_28d")
    facts = matched.groupBy("stay_id").agg(
        F.first("subject_id").alias("subject_id"), F.first("stay_hadm_id").alias("hadm_id"), F.first("intime").alias("intime"), F.first("outtime").alias("outtime"),
        F.min(F.when(F.col("code") == "MEDS_BIRTH", F.col("time"))).alias("birth"), F.min_by(F.when(age.isNotNull(), age), F.when(age.isNotNull(), at)).alias("first_age"),
        F.max("in_hosp_mortality").alias("label_in_hosp_mortality"), F.max("mortality_28d").alias("label_mortality_28d"), F.max(codes.is_sepsis_code(F.col("code")).cast("int")).alias("label_sepsis"),
    )
    if among is not None:
        facts = dealt(facts, parts(matched), "stay_id")
    kept = first_events(matched if among is None else among.where(F.col("stay_id").isNotNull()), max_len, "stay_id", in_order(keep))
    so_far = Window.partitionBy("stay_id").orderBy(*STAY_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumns({"_age": F.last(age, ignorenulls=True).over(so_far), "_pos": F.row_number().over(so_far) - 1})
    token = codes.sanitize_stay("code")
    row = F.struct(F.col("_pos").alias("pos"), token.alias("token"), codes.token_type(token).alias("type"), F.col("_age").alias("age"), F.col("time"))
    out = kept.groupBy("stay_id").agg(F.array_sort(F.collect_list(row)).alias("_e"), F.min(at).alias("_from"), *[F.max(c).alias(f"_{c}") for c in once])
    out = out.join(facts, "stay_id")
    if keep == "tail":  # ages known before the events that are kept
        first = out.select(F.col("stay_id").alias("_s"), F.col("_from").alias("_f"))
        before = matched.where(age.isNotNull()).join(first, F.col("stay_id") == F.col("_s")).where(at < F.col("_f")).groupBy("_s").agg(F.max_by(age, at).alias("_before"))
        out = out.join(before, F.col("stay_id") == F.col("_s"), "left").withColumn("first_age", F.coalesce("_before", "first_age"))
    field = lambda f: F.transform("_e", f)
    born = lambda x: F.greatest(F.floor(timecols.hours("birth", x["time"]) / 24 / 365.25), F.lit(0)).cast("int")
    ages = field(lambda x: F.coalesce(x["age"], F.col("first_age"), F.when(F.col("birth").isNotNull(), born(x)), F.lit(schema.DEFAULT_AGE)))
    return out.select(
        "stay_id", "subject_id", "hadm_id", "intime", "outtime", field(lambda x: x["token"]).alias("event_tokens"), field(lambda x: x["type"]).alias("type_tokens"), ages.alias("age_tokens"), field(lambda x: timecols.hours("intime", x["time"])).alias("elapsed_tokens"),
        field(lambda x: timecols.in_icu(x["time"], "intime")).alias("visit_tokens"), F.transform("_e", lambda x, i: i).alias("position_tokens"), F.lit(1).alias("num_visits"),
        F.greatest("label_in_hosp_mortality", "_in_hosp_mortality").alias("label_in_hosp_mortality"), F.greatest("label_mortality_28d", "_mortality_28d").alias("label_mortality_28d"), "label_sepsis",
    )


def time_delta(df: DataFrame, key: str, time: str, order: tuple[str, ...]) -> DataFrame:
    """Hours since the row before; 0 for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("delta", F.coalesce(timecols.whole_hours(F.lag(time).over(w), time), F.lit(0.0)))


def visit_order(df: DataFrame, key: str, value: str, order: tuple[str, ...], n: int) -> DataFrame:
    """value less the key's first, kept between 0 and n - 1."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("visit_order", F.least(F.greatest(F.col(value) - F.first(value).over(w), F.lit(0)), F.lit(n - 1)))


def nucleus(df: DataFrame, key: str, p: str, item: str, mass: float = 0.9) -> DataFrame:
    """The likeliest items of each key up to and with the one that reaches the mass."""
    w = Window.partitionBy(key).orderBy(F.desc(p), item).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(p).over(w)).where(F.col("cumulative") - F.col(p) < mass)


def padded_batches(df: DataFrame, batch: str, column: str, value=0) -> DataFrame:
    """Arrays padded to the longest of their batch, and masks."""
    from evseq.functions import arrays

    longest = F.max(F.size(column)).over(Window.partitionBy(batch))
    d = df.withColumn("_n", longest)
    fill = lambda x: F.array_repeat(F.lit(x), F.col("_n") - F.size(column))
    return d.withColumns({column: F.concat(column, fill(value)), f"{column}_mask": F.concat(F.transform(arrays.truncate(column, F.col("_n")), lambda x: F.lit(1)), fill(0))}).drop("_n")


def by_length(df: DataFrame, column: str, max_len: int, tie: str) -> DataFrame:
    """Longest first by the whole length, so that neighbours need little padding; token_length is cut at max_len. A range exchange, no
    single sorted partition."""
    d = df.orderBy(F.desc(F.size(column)), tie)
    return d.withColumn("token_length", F.least(F.size(column), F.lit(max_len)))
