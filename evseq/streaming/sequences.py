"""Sequences that grow with their shards: each subject's first events and first valid label are kept state, so a new shard costs itself and
not the corpus, and any batching of the shards gives what one batch gives.

State is bounded: a subject holds its first max_len events by (time, seq, code), whatever order they arrive in, and a few facts of all its
events. Of each subject that a batch touches the whole sequence is given again; the table of results is appended, and `current` reads the
last of each subject. The state store must be RocksDB's, which `grow` sees to for its own query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evseq import schema
from evseq.functions import codes

EVENTS = "micros array<long>, seq array<long>, code array<string>, age array<int>"
FACTS = "n_events long, num_visits long, start long, died boolean, septic boolean, first_age int, age_micros long, age_seq long, age_code string, first_label int, label_micros long, label_seq long, label_code string"
OUT = f"subject_id long, n_events long, num_visits long, start long, died boolean, septic boolean, label int, {EVENTS}, visit array<int>"
#: Stands for a null time, which comes first, and for a null number.
NULL_TIME, NONE = -(1 << 62), -(1 << 31)
#: Rows that are taken up before they are sorted and cut.
CHUNK = 4096
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstEvents(StatefulProcessor):
    """A call for each subject and batch: what it costs is its rows and what is kept, in plain lists, as most subjects have few of them."""

    def __init__(self, max_len: int, visit: str):
        self.max_len, self.visit = max_len, visit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sequence", f"{FACTS}, {EVENTS}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        had = self.state.get()
        if had is None:
            n_events, num_visits, start, died, septic, first_age, first_label, kept = 0, 0, NULL_TIME, False, False, None, None, []
        else:
            n_events, num_visits, start, died, septic = had[:5]
            first_age, first_label = (None if at[0] == NONE else (*at[1:], at[0]) for at in (had[5:9], had[9:13]))
            kept = list(zip(*had[13:], strict=True))
        for r in rows:
            micros, seq, code, age, label = r["micros"], r["seq"], r["code"], r["age"], r["label"]
            n_events += 1
            num_visits += code == self.visit
            died, septic = died or bool(r["died"]), septic or bool(r["septic"])
            if micros != NULL_TIME and (start == NULL_TIME or micros < start):
                start = micros
            if age != NONE and (first_age is None or (micros, seq, code, age) < first_age):  # the first by order
                first_age = (micros, seq, code, age)
            if label != NONE and (first_label is None or (micros, seq, code, label) < first_label):
                first_label = (micros, seq, code, label)
            kept.append((micros, seq, code, age))
            if len(kept) >= self.max_len + CHUNK:  # memory is what is kept and a chunk
                kept = sorted(kept)[: self.max_len]
        kept = sorted(kept)[: self.max_len]
        columns = [list(c) for c in zip(*kept, strict=True)] or [[], [], [], []]
        facts = [(NONE, NONE, NONE, "") if at is None else (at[3], *at[:3]) for at in (first_age, first_label)]
        self.state.update((n_events, num_visits, start, died, septic, *facts[0], *facts[1], *columns))
        age, ages = first_age[3] if first_age else schema.DEFAULT_AGE, []
        for a in columns[3]:
            age = a if a != NONE else age
            ages.append(age)
        visits = list(accumulate(int(c == self.visit) for c in columns[2]))
        yield Row(
            subject_id=key[0], n_events=n_events, num_visits=max(1, num_visits), start=None if start == NULL_TIME else start, died=died, septic=septic, label=first_label[3] if first_label else None,
            micros=[None if m == NULL_TIME else m for m in columns[0]], seq=columns[1], code=columns[2], age=ages, visit=visits,
        )

    def close(self) -> None:
        pass


def growing(events: DataFrame, max_len: int = 2048, visit: str = "[VS]", label: str | None = None) -> DataFrame:
    """subject_id, n_events, num_visits, start (microseconds), died, septic, label and events of each subject that a batch touches. events:
    a stream of subject_id, time, seq, code and, if there are any, age and the label, whose nulls and -1 are passed over. Rows without
    subject or code are left out."""
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NONE)) if c in events.columns else F.lit(NONE)
    token = codes.sanitize("code", True)
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("time"))
    valid = F.when(number(label) != schema.MISSING, number(label)).otherwise(NONE) if label else F.lit(NONE)
    d = events.where(F.col("subject_id").isNotNull() & F.col("code").isNotNull()).select(
        F.col("subject_id").cast("long").alias("subject_id"), F.coalesce(micros, F.lit(NULL_TIME)).alias("micros"), F.coalesce(F.col("seq").cast("long"), F.lit(NULL_TIME)).alias("seq"), "code", number("age").alias("age"), valid.alias("label"),
        codes.is_death(token).alias("died"), codes.is_sepsis_token(token).alias("septic"),
    )
    out = d.groupBy("subject_id").transformWithState(FirstEvents(max_len, visit), OUT, "Update", "None")
    columns = ("micros", "seq", "code", "age", "visit")
    every = F.transform(F.arrays_zip(*columns), lambda x, i: F.struct(i.alias("pos"), *[x[c].alias(c) for c in columns]))
    return out.withColumn("events", every).drop(*columns)


def grow(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, **how) -> None:
    """Takes the shards that are new since the last run and appends the sequences of the subjects in them, with the batch's number; a batch
    that is run again after a failure replaces its own part."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")

    try:
        growing(events, **how).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """Each subject's sequence after the last batch that touched it, with token and type arrays as patient_sequences() has them."""
    d = spark.read.parquet(out).drop("part")
    last = d.groupBy("subject_id").agg(F.max_by(F.struct(*[c for c in d.columns if c != "subject_id"]), "batch").alias("x")).select("subject_id", "x.*").drop("batch")
    tokens = F.transform("events", lambda x: codes.sanitize(x["code"], True))
    elapsed = F.transform("events", lambda x: F.floor((x["micros"] - F.col("start")) / 1_000_000) / F.lit(3600.0))
    field = lambda n: F.transform("events", lambda x: x[n])
    return last.select("subject_id", tokens.alias("event_tokens"), F.transform(tokens, lambda t: codes.token_type(t)).alias("type_tokens"), field("age").alias("age_tokens"), elapsed.alias("elapsed_tokens"), field("visit").alias("visit_tokens"), field("pos").alias("position_tokens"), "n_events", "num_visits", "died", "septic", "label")
