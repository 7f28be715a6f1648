"""All queries of the library but those of the training-text subpackage, each with its SQL.

Arrays are returned as joined strings, floats rounded, so that engines compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import arrays, codes, timecols
from evseq.operators import align, cohort, features, labels, metrics, profile, ranks, repair, sequences, vocab
from evseq.operators import stays as stay_ops
from evseq.plans import proxies
from evseq.plans.proxies import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Events of a subject or stay that enter arrays, as in the operators.
MAX_LEN = 2048


def query(oracle: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    from evseq.plans import basics  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from evseq.plans import basics  # noqa: F401

    return dict(ORACLES)


def text(a: str | F.Column, digits: int | None = None) -> F.Column:
    c = F.col(a) if isinstance(a, str) else a
    return F.array_join(F.transform(c, lambda x: (F.format_string(f"%.{digits}f", x) if digits is not None else x.cast("string"))), ",")


def lists(a: str, digits: int | None = None) -> str:
    return f"array_to_string(list_transform({a}, lambda x: {f'printf({chr(39)}%.{digits}f{chr(39)}, CAST(x AS DOUBLE))' if digits is not None else 'CAST(x AS VARCHAR)'}), ',')"


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.patient_sequences(proxies.stream(spark, sf_dir), MAX_LEN)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences in long form: no arrays are built only to be exploded."""
    return sequences.event_tokens(proxies.stream(spark, sf_dir), MAX_LEN)


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)


# Events


@query(sql("SELECT subject_id, hadm_id, time, code, regexp_replace(code, '[^A-Za-z0-9_]', '', 'g') AS token, regexp_replace(code, '[^\\p{L}\\p{N}_]', '', 'g') AS stay_token FROM v_event WHERE subject_id IS NOT NULL AND time IS NOT NULL AND code IS NOT NULL", "v_event"))
def q_scan_clean(spark, sf_dir):
    e = proxies.events(spark, sf_dir).dropna(subset=["subject_id", "time", "code"])
    return e.select("subject_id", "hadm_id", "time", "code", codes.sanitize("code").alias("token"), codes.sanitize_stay("code").alias("stay_token"))


@query("SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS BIGINT) AS number, TRY_CAST(split_part(o_orderpriority, '-', 2) AS BIGINT) AS word, coalesce(lower(trim(o_orderstatus)) IN ('true', '1', 'yes', 'y', 'f'), false) AS flag FROM orders")
def q_tolerant_cast(spark, sf_dir):
    part = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i)).try_cast("long")
    return proxies.table(spark, sf_dir, "orders").select("o_orderkey", part(1).alias("number"), part(2).alias("word"), codes.truthy("o_orderstatus", ("f",)).alias("flag"))


@query(sql(f"SELECT CAST({proxies.TYPE_SQL.format('code')} AS BIGINT) AS type, count(*) AS n FROM v_event GROUP BY 1", "v_event"))
def q_token_type_counts(spark, sf_dir):
    return proxies.events(spark, sf_dir).groupBy(codes.token_type("code").cast("long").alias("type")).agg(F.count(F.lit(1)).alias("n"))


_AGED = "SELECT e.*, CASE WHEN code NOT LIKE 'MED%' THEN greatest(anchor_age + year(time) - anchor_year, 0) END AS age FROM v_event e LEFT JOIN v_patient USING (subject_id)"
_W = "PARTITION BY subject_id ORDER BY time, code"


@query(sql(f"SELECT subject_id, time, code, age, coalesce(last_value(age IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), first_value(age IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 25) AS age_filled FROM aged", "v_event", "v_patient", aged=_AGED))
def q_patient_enrich_age(spark, sf_dir):
    e = stay_ops.with_patients(proxies.events(spark, sf_dir), proxies.patients(spark, sf_dir))
    e = e.withColumn("age", F.when(~F.col("code").startswith("MED"), timecols.age_at("time")))
    return stay_ops.filled_age(e).select("subject_id", "time", "code", long("age"), long("age_filled"))


# Sequences


@query(sql(f"SELECT subject_id, {lists('tokens')} AS tokens, {lists('types')} AS types, {lists('elapsed', 4)} AS elapsed, {lists('visits')} AS visits, {lists('range(len(tokens))')} AS positions, CAST(num_visits AS BIGINT) AS num_visits FROM v_seq", "v_seq"))
def q_patient_sequences(spark, sf_dir):
    s = seqs(spark, sf_dir)
    return s.select("subject_id", text("event_tokens").alias("tokens"), text("type_tokens").alias("types"), text("elapsed_tokens", 4).alias("elapsed"), text("visit_tokens").alias("visits"), text("position_tokens").alias("positions"), long("num_visits"))


@query(sql("SELECT subject_id, CASE WHEN died THEN 0 ELSE -1 END AS death_after_start, CASE WHEN died THEN 30 ELSE -1 END AS death_after_end, CAST(died AS BIGINT) AS label_mortality_1month, CAST(septic AS BIGINT) AS label_sepsis, CAST(len(list_filter(tokens, lambda x: x LIKE '%DEATH%')) > 0 AS BIGINT) AS died_in_view FROM v_seq", "v_seq"))
def q_patient_labels(spark, sf_dir):
    s = seqs(spark, sf_dir)
    d = labels.task_labels(s.withColumn("died_in_view", F.exists("event_tokens", lambda x: codes.is_death(x)).cast("int")))
    return d.select("subject_id", long("death_after_start"), long("death_after_end"), long("label_mortality_1month"), long("label_sepsis"), long("died_in_view"))


@query(sql("SELECT stay_id, subject_id, hadm_id, intime, outtime, deathtime, d AS dod, death_time, CAST(in_hosp_mortality AS BIGINT) AS in_hosp_mortality, CAST(mortality_28d AS BIGINT) AS mortality_28d, admission_type FROM v_master LEFT JOIN (SELECT subject_id AS sid, dod AS d FROM v_patient) ON sid = subject_id", "v_master"))
def q_master_stays(spark, sf_dir):
    m = master(spark, sf_dir)
    return m.select("stay_id", "subject_id", "hadm_id", "intime", "outtime", "deathtime", "dod", "death_time", long("in_hosp_mortality"), long("mortality_28d"), "admission_type")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stay_ops.master_stays(proxies.stays(spark, sf_dir), proxies.admissions(spark, sf_dir), proxies.patients(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.events_in_stays(proxies.events(spark, sf_dir), master(spark, sf_dir))


@query(sql("SELECT subject_id, stay_id, time, code, CAST(time >= intime AS BIGINT) AS in_icu FROM v_match", "v_match"))
def q_event_stay_match(spark, sf_dir):
    return matched(spark, sf_dir).select("subject_id", "stay_id", "time", "code", timecols.in_icu("time", "intime").cast("long").alias("in_icu"))


@query(sql("SELECT stay_id, count(*) AS n_events, count(DISTINCT code) AS n_codes, CAST(max(mortality_28d) AS BIGINT) AS mortality_28d, CAST(max(CAST(regexp_matches(code, '(?i)^(DIAGNOSIS//)?(038|A40|A41)') AS INTEGER)) AS BIGINT) AS sepsis FROM v_match GROUP BY stay_id", "v_match"))
def q_event_stay_counts(spark, sf_dir):
    sepsis = F.max(codes.is_sepsis_code(F.col("code")).cast("int")).cast("long")
    return matched(spark, sf_dir).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("code").alias("n_codes"), F.max("mortality_28d").cast("long").alias("mortality_28d"), sepsis.alias("sepsis"))


_STAY = """SELECT stay_id, subject_id, list(regexp_replace(code, '[^\\p{L}\\p{N}_]', '', 'g') ORDER BY time, code)[1:2048] AS tokens, list(date_diff('microsecond', intime, time) / 3.6e9 ORDER BY time, code)[1:2048] AS elapsed,
    list(CAST(time >= intime AS INTEGER) ORDER BY time, code)[1:2048] AS visits, max(in_hosp_mortality) AS a, max(mortality_28d) AS b, max(CAST(regexp_matches(code, '(?i)^(DIAGNOSIS//)?(038|A40|A41)') AS INTEGER)) AS c FROM v_match GROUP BY stay_id, subject_id"""


@query(sql(f"SELECT stay_id, subject_id, {lists('tokens')} AS tokens, {lists('elapsed', 3)} AS elapsed, {lists('visits')} AS visits, CAST(a AS BIGINT) AS label_in_hosp_mortality, CAST(b AS BIGINT) AS label_mortality_28d, CAST(c AS BIGINT) AS label_sepsis FROM per_stay", "v_match", per_stay=_STAY))
def q_stay_sequences(spark, sf_dir):
    s = sequences.sequences_in_stays(proxies.events(spark, sf_dir), master(spark, sf_dir), MAX_LEN)
    return s.select("stay_id", "subject_id", text("event_tokens").alias("tokens"), text("elapsed_tokens", 3).alias("elapsed"), text("visit_tokens").alias("visits"), long("label_in_hosp_mortality"), long("label_mortality_28d"), long("label_sepsis"))


# Images


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = align.studies_in_stays(proxies.studies(spark, sf_dir), proxies.stays(spark, sf_dir))
    return i.select("stay_id", "subject_id", "study_id", F.round("hours_from_icu_intime", 4).alias("hours_from_icu_intime"), long("image_rank_in_stay"), long("is_first_image"), long("is_first_24h_image"))


_IMAGE = "SELECT stay_id, subject_id, study_id, round(hours, 4) AS hours_from_icu_intime, rank AS image_rank_in_stay, CAST(rank = 0 AS BIGINT) AS is_first_image, CAST(hours <= 24 AS BIGINT) AS is_first_24h_image FROM v_image"


@query(sql(_IMAGE, "v_image"))
def q_image_index(spark, sf_dir):
    return images(spark, sf_dir)


@query(sql(_IMAGE + " WHERE rank = 0", "v_image"))
def q_image_first(spark, sf_dir):
    return align.top_images(images(spark, sf_dir), 1)


@query(sql(_IMAGE + " WHERE rank < 2", "v_image"))
def q_image_topk(spark, sf_dir):
    return align.top_images(images(spark, sf_dir), 2)


@query(sql("SELECT subject_id, study_id, t AS StudyDateTime, 'p' || substr(CAST(subject_id AS VARCHAR), 1, 2) || '/p' || subject_id || '/s' || study_id || '/d' || hadm_id || '.jpg' AS path FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t DESC, study_id DESC) AS n FROM v_study) WHERE n = 1", "v_study"))
def q_latest_study(spark, sf_dir):
    s = align.latest_study(proxies.studies(spark, sf_dir))
    return s.select("subject_id", "study_id", "StudyDateTime", codes.image_path("subject_id", "study_id", F.concat(F.lit("d"), F.col("hadm_id").cast("string"))).alias("path"))


@query(sql("SELECT s.stay_id, CAST(count(rank) > 0 AS BIGINT) AS has_images, CAST(count(rank) AS BIGINT) AS n_images, CAST(s.stay_id % 3 = 0 AS BIGINT) AS has_coefficients FROM v_stay s LEFT JOIN v_image i ON s.stay_id = i.stay_id GROUP BY s.stay_id", "v_image"))
def q_presence_masks(spark, sf_dir):
    s = proxies.stays(spark, sf_dir)
    c = s.where("stay_id % 3 = 0").select("stay_id", F.array(F.lit(1.0)).alias("coefficients"))
    i = images(spark, sf_dir).select("stay_id", "image_rank_in_stay", F.col("study_id").alias("image"))
    d = align.with_inputs(s, c, i)
    return d.select("stay_id", long("has_images"), F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("n_images"), long("has_coefficients"))


_FUSED = """SELECT s.stay_id, s.stay_id % 7 AS batch, coalesce(n, 0) AS n_images, CASE WHEN s.stay_id % 3 = 0 THEN s.stay_id % 4 + 1 ELSE 0 END AS n_coefficients, coalesce(total, 0) AS total FROM v_stay s LEFT JOIN
    (SELECT stay_id, count(*) AS n, sum(study_id % 1000) AS total FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY rank) AS k FROM v_image) WHERE k <= 3 GROUP BY stay_id) i ON s.stay_id = i.stay_id"""


@query(sql("""SELECT stay_id, batch, n_images, CAST(n_coefficients AS BIGINT) AS n_coefficients, CAST(n_images > 0 AS BIGINT) AS has_images, CAST(n_coefficients > 0 AS BIGINT) AS has_coefficients, greatest(1, max(n_images) OVER w) AS images_long, CAST(greatest(1, max(n_coefficients) OVER w) AS BIGINT) AS coefficients_long,
    CAST(total AS DOUBLE) AS image_total, CAST(n_coefficients * (n_coefficients + 1) // 2 AS DOUBLE) AS coefficient_total FROM fused WINDOW w AS (PARTITION BY batch)""", "v_image", fused=_FUSED))
def q_fused_batches(spark, sf_dir):
    """Vectors of three numbers stand for images; sums over the padded arrays show that what is added is zero."""
    s = proxies.stays(spark, sf_dir).select("stay_id", (F.col("stay_id") % 7).alias("batch"))
    c = s.where("stay_id % 3 = 0").select("stay_id", F.transform(F.sequence(F.lit(1), (F.col("stay_id") % 4 + 1).cast("int")), lambda i: F.array(i.cast("double"), F.lit(0.0))).alias("coefficients"))
    i = images(spark, sf_dir).select("stay_id", "image_rank_in_stay", F.array((F.col("study_id") % 1000).cast("double"), F.lit(None).cast("double"), F.lit(0.0)).alias("image"))
    d = align.fused_batches(s, c, i, "batch", 2, 3, 3)
    total = lambda a: F.aggregate(F.flatten(a), F.lit(0.0), lambda x, y: x + y)
    return d.select("stay_id", "batch", long("n_images"), long("n_coefficients"), long("has_images"), long("has_coefficients"), F.size("images").cast("long").alias("images_long"), F.size("coefficients").cast("long").alias("coefficients_long"), total("images").alias("image_total"), total("coefficients").alias("coefficient_total"))


# Labels

_LOS = """SELECT *, (ve0 - 1 - (vs0 + 1)) / 24.0 AS los, coalesce(list_min(list_filter(range(len(tokens)), lambda i: elapsed[i + 1] > 24 AND i > vs0 AND i < ve0)), len(tokens)) AS cutoff FROM v_ends WHERE has_vs AND has_ve AND ve0 - vs0 - 2 >= 0 AND elapsed[vs0 + 2] < 4000"""


@query(sql("SELECT subject_id, round(los, 6) AS length_of_stay, CAST(los >= 0.25 AS BIGINT) AS label_los_1week, CAST(cutoff AS BIGINT) AS cutoff_los, CAST(len(tokens) AS BIGINT) AS token_length, round(elapsed[ve0 + 1] - elapsed[vs0 + 1], 4) AS los_hours FROM los", "v_ends", los=_LOS))
def q_los(spark, sf_dir):
    d = los(spark, sf_dir)
    return d.select("subject_id", F.round("length_of_stay", 6).alias("length_of_stay"), long("label_los_1week"), long("cutoff_los"), long("token_length"), F.round("los_hours", 4).alias("los_hours"))


def los(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxies' visits are short and begin late."""
    return labels.length_of_stay(seqs(spark, sf_dir), threshold=0.25, minimum=0, first_event_hours=4000)


_READ = "SELECT subject_id, num_visits - 1 AS num_visits, vs0 - 1 AS cutoff, CASE WHEN vs0 > 0 THEN tokens[vs0] ELSE tokens[len(tokens)] END IN ('[W_0]', '[W_1]', '[W_2]', '[W_3]', '[M_1]') AS soon, len(tokens) AS n FROM v_ends WHERE num_visits >= 2 AND has_vs"


@query(sql("SELECT subject_id, CAST(num_visits AS BIGINT) AS num_visits, CAST(cutoff AS BIGINT) AS cutoff_readmission, CAST(soon AS BIGINT) AS label_readmission_1month, CAST(n AS BIGINT) AS token_length FROM readm", "v_ends", readm=_READ))
def q_readmission(spark, sf_dir):
    d = labels.readmission(seqs(spark, sf_dir))
    return d.select("subject_id", long("num_visits"), long("cutoff_readmission"), long("label_readmission_1month"), long("token_length"))


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to death from the subject's number, so that all outcomes occur."""
    d = labels.task_labels(seqs(spark, sf_dir)).withColumn("death_after_end", F.when(F.col("death_after_start") >= 0, F.col("subject_id") % 40).otherwise(-1))
    return labels.mortality(d)


@query(sql("SELECT subject_id, CAST(died AND subject_id % 40 <= 15 AS BIGINT) AS label_mortality_2weeks, CAST(died AND subject_id % 40 <= 32 AS BIGINT) AS label_mortality_1month FROM v_seq", "v_seq"))
def q_mortality(spark, sf_dir):
    return dead(spark, sf_dir).select("subject_id", long("label_mortality_2weeks"), long("label_mortality_1month"))


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labels.task_labels(seqs(spark, sf_dir)).withColumns({"common_conditions": F.array((F.col("subject_id") % 2).cast("long"), (F.col("subject_id") % 3).cast("long")), "rare_conditions": F.array((F.col("subject_id") % 5).cast("long"))})
    return labels.multi_task(s, labels.conditions(s), dead(spark, sf_dir), labels.readmission(seqs(spark, sf_dir)), los(spark, sf_dir), 4)


_MULTI = """SELECT s.subject_id AS patient_id, CAST(s.died AND s.subject_id % 40 <= 32 AS BIGINT) AS label_mortality_1month, coalesce(r.cutoff, -1) AS cutoff_readmission, coalesce(CAST(r.soon AS BIGINT), -1) AS label_readmission_1month,
    coalesce(l.cutoff, -1) AS cutoff_los, coalesce(CAST(l.los >= 0.25 AS BIGINT), -1) AS label_los_1week, s.subject_id % 2 AS label_c0, s.subject_id % 3 AS label_c1, s.subject_id % 5 AS label_c2, -1 AS label_c3
    FROM v_seq s LEFT JOIN readm r ON s.subject_id = r.subject_id LEFT JOIN los l ON s.subject_id = l.subject_id"""
_MULTI_COLUMNS = ["label_mortality_1month", "cutoff_readmission", "label_readmission_1month", "cutoff_los", "label_los_1week", "label_c0", "label_c1", "label_c2", "label_c3"]


@query(sql(f"SELECT patient_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _MULTI_COLUMNS)} FROM multi", "v_ends", readm=_READ, los=_LOS, multi=_MULTI))
def q_multitask(spark, sf_dir):
    return multi(spark, sf_dir).select("patient_id", *map(long, _MULTI_COLUMNS))


_POINTS = " UNION ALL ".join(f"SELECT patient_id, '{t}' AS task, CAST(label_{t} AS BIGINT) AS label, CAST({c} AS BIGINT) AS cutoff FROM multi WHERE label_{t} <> -1" for t, c in (("mortality_1month", "NULL"), ("readmission_1month", "cutoff_readmission"), ("los_1week", "cutoff_los"), ("c0", "NULL")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labels.task_labels(seqs(spark, sf_dir)).withColumn("death_after_end", F.when(F.col("death_after_start") >= 0, F.col("subject_id") % 40).otherwise(-1))
    s = s.withColumns({"common_conditions": F.array((F.col("subject_id") % 2).cast("long"), (F.col("subject_id") % 3).cast("long")), "rare_conditions": F.array((F.col("subject_id") % 5).cast("long"))})
    return labels.datapoints(labels.multi_task_of(s, 4, threshold=0.25, minimum=0, first_event_hours=4000), ["mortality_1month", "readmission_1month", "los_1week", "c0"])


@query(sql(_POINTS, "v_ends", readm=_READ, los=_LOS, multi=_MULTI))
def q_datapoints(spark, sf_dir):
    return points(spark, sf_dir).select("patient_id", "task", long("label"), long("cutoff"))


@query(sql("SELECT doc_id, y FROM (SELECT doc_id, quality AS y, row_number() OVER (PARTITION BY quality ORDER BY md5('23:' || doc_id)) AS n, count(*) FILTER (quality = 0) OVER () AS neg FROM v_score WHERE quality <> -1) WHERE y = 0 OR n <= CAST(floor(neg / 0.25) AS BIGINT) - neg", "v_score"))
def q_balance_labels(spark, sf_dir):
    s = proxies.scores(spark, sf_dir).withColumn("label", F.when(F.col("quality") >= 0, 1 - F.col("quality")))
    return cohort.downsampled(s, 0.25, "doc_id").select("doc_id", (1 - F.col("label")).alias("y"))


# Splits

_IDS = "SELECT c_custkey AS subject_id, c_mktsegment AS segment, CAST(c_acctbal < 0 AS INTEGER) AS y FROM customer"


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).cast("int").alias("y"))


@query(sql("SELECT subject_id, CASE WHEN n < floor(t * 0.15) THEN 'test' ELSE 'pretrain' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5('23:' || subject_id)) - 1 AS n, count(*) OVER () AS t FROM ids)", ids=_IDS))
def q_split_ids(spark, sf_dir):
    return cohort.split(ids(spark, sf_dir), 0.15).select("subject_id", "split")


@query(sql("SELECT subject_id, segment, CASE WHEN n < floor(t * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5('23:' || subject_id)) - 1 AS n, count(*) OVER (PARTITION BY segment) AS t FROM ids)", ids=_IDS))
def q_stratified(spark, sf_dir):
    return cohort.stratified(ids(spark, sf_dir), "segment", 0.2).select("subject_id", "segment", "split")


@query(sql("""SELECT CASE WHEN m < floor(u * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS split, 'balanced' AS scheme, CAST(size AS VARCHAR) AS key, subject_id FROM (SELECT *, row_number() OVER (PARTITION BY size, y ORDER BY md5('23:' || subject_id)) - 1 AS m, count(*) OVER (PARTITION BY size, y) AS u
    FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('23:' || subject_id)) - 1 AS n FROM ids) CROSS JOIN (VALUES (20), (50), (100)) s(size) WHERE n < size // 2)""", ids=_IDS))
def q_fewshot(spark, sf_dir):
    return cohort.few_shot(ids(spark, sf_dir), "y", [20, 50, 100], "balanced")


@query(sql("SELECT subject_id, CAST(y AS BIGINT) AS y, CAST((row_number() OVER (PARTITION BY ids.y ORDER BY md5('23:' || subject_id)) - 1) % 10 AS BIGINT) AS fold FROM ids", ids=_IDS))
def q_kfold(spark, sf_dir):
    return cohort.folds(ids(spark, sf_dir), "y").select("subject_id", long("y"), long("fold"))


@query(sql("SELECT subject_id, CAST(CASE WHEN n < 100 THEN 100 WHEN n < 500 THEN 500 END AS BIGINT) AS in_prefix FROM (SELECT *, row_number() OVER (ORDER BY md5('23:' || subject_id)) - 1 AS n FROM ids)", ids=_IDS))
def q_prefix_subsets(spark, sf_dir):
    return cohort.prefix(ids(spark, sf_dir), [100, 500]).select("subject_id", long("in_prefix"))


_OVER = """SELECT subject_id FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('23:y:' || subject_id)) AS n FROM ids) WHERE n <= 45"""
_OVER2 = """SELECT subject_id FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY fresh, md5('23:z:' || subject_id)) AS n FROM (SELECT subject_id, subject_id % 2 AS z, CAST(subject_id NOT IN (SELECT subject_id FROM first_pass) AS INTEGER) AS fresh FROM ids)) WHERE n <= 45"""


@query(sql("SELECT DISTINCT subject_id FROM (SELECT * FROM first_pass UNION ALL SELECT * FROM second_pass)", ids=_IDS, first_pass=_OVER, second_pass=_OVER2))
def q_overlap_select(spark, sf_dir):
    d = ids(spark, sf_dir).withColumn("z", (F.col("subject_id") % 2).cast("int"))
    return cohort.overlapping(d, ["y", "z"], 45)


_SIX = {"a": ("subject_id % 2", 45), "b": ("subject_id % 3 = 0", 30), "c": ("subject_id % 5 = 1", 60), "d": ("subject_id % 7 < 3", 20), "e": ("subject_id % 11 = 4", 25), "f": ("y", 50)}


def _turns() -> dict[str, str]:
    """A chain of tables, one for each label: ids chosen so far."""
    out = {"six": f"SELECT subject_id, {', '.join(f'CAST({e} AS INTEGER) AS {c}' for c, (e, _) in _SIX.items())} FROM ids"}
    for i, (c, (_, n)) in enumerate(_SIX.items()):
        before = f"SELECT subject_id FROM t{i - 1}" if i else "SELECT subject_id FROM ids WHERE FALSE"
        picked = f"SELECT subject_id FROM (SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY fresh, md5('23:{c}:' || subject_id)) AS n FROM (SELECT *, CAST(subject_id NOT IN ({before}) AS INTEGER) AS fresh FROM six)) WHERE n <= {n}"
        out[f"t{i}"] = f"SELECT * FROM ({before} UNION {picked})"
    return out


@query(sql("SELECT subject_id FROM t5", ids=_IDS, **_turns()))
def q_overlap_six(spark, sf_dir):
    d = ids(spark, sf_dir).withColumns({c: F.expr(e).cast("int") for c, (e, _) in _SIX.items()})
    return cohort.overlapping(d, {c: n for c, (_, n) in _SIX.items()})


def dealt_sql(source: str, labels: int, name: str = "dealt") -> dict[str, str]:
    """Iterative stratification as a recursion with one state for each g: lists of combinations and of what the test split wants of each
    label, the last for all rows. source: a table of g, combo, n and share; the result: g, combo, n_test."""
    every, numbers = "range(1, len(cs) + 1)", f"range(1, {labels + 2})"
    total = "list_sum(list_transform({0}, lambda j: CASE WHEN {1} AND cs[j].f[q] THEN {2} ELSE 0 END))"
    whole = total.format(every, "TRUE", "cs[j].n")
    state = f"SELECT g, cs, list_transform({numbers}, lambda q: {whole} * share) AS te, list_transform(cs, lambda x: CAST(-1 AS BIGINT)) AS done FROM (SELECT g, any_value(CAST(share AS DOUBLE)) AS share, list(struct_pack(c := combo, n := n, f := list_append(list_transform(string_split(combo, ','), lambda v: v = '1'), TRUE)) ORDER BY combo) AS cs FROM {source} GROUP BY g)"
    rest = f"SELECT *, list_transform({numbers}, lambda q: {total.format(every, 'done[j] < 0', 'cs[j].n')}) AS rest FROM {name}_steps WHERE list_min(done) < 0"
    label = f"SELECT *, coalesce(list_filter(range(1, {labels + 1}), lambda q: rest[q] > 0 AND rest[q] = list_min(list_filter(rest[1 : {labels}], lambda v: v > 0)))[1], {labels + 1}) AS q FROM ({rest})"
    part = f"SELECT *, greatest(0, least(1, te[q] / rest[q])) AS part FROM ({label})"
    upto = f"SELECT *, list_prepend(0, list_transform({every}, lambda m: CAST(floor({total.format('range(1, m + 1)', 'done[j] < 0', 'cs[j].n')} * part + 0.5) AS BIGINT))) AS upto FROM ({part})"
    now = f"SELECT g, cs, te, done AS was, list_transform({every}, lambda j: CASE WHEN done[j] < 0 AND cs[j].f[q] THEN upto[j + 1] - upto[j] ELSE done[j] END) AS done FROM ({upto})"
    step = f"SELECT g, cs, list_transform({numbers}, lambda q: te[q] - {total.format(every, 'was[j] < 0 AND done[j] >= 0', 'done[j]')}), done FROM ({now})"
    return {f"{name}_steps(g, cs, te, done)": f"{state} UNION ALL {step}", name: f"SELECT g, cs[j].c AS combo, done[j] AS n_test FROM (SELECT *, unnest({every}) AS j FROM {name}_steps WHERE list_min(done) >= 0)"}


_COMBO = "SELECT subject_id, y, CAST(subject_id % 3 = 0 AS INTEGER) AS z, CAST(subject_id % 50 = 0 AS INTEGER) AS w, concat_ws(',', y, CAST(subject_id % 3 = 0 AS INTEGER), CAST(subject_id % 50 = 0 AS INTEGER)) AS combo FROM ids"


@query(sql("SELECT subject_id, y, z, w, CASE WHEN n < n_test THEN 'test' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY md5('23:' || subject_id)) - 1 AS n FROM combos) JOIN dealt USING (combo)", ids=_IDS, combos=_COMBO, counted="SELECT 0 AS g, combo, count(*) AS n, 0.2 AS share FROM combos GROUP BY combo", **dealt_sql("counted", 3)))
def q_multilabel_stratified(spark, sf_dir):
    d = ids(spark, sf_dir).withColumns({"z": (F.col("subject_id") % 3 == 0).cast("int"), "w": (F.col("subject_id") % 50 == 0).cast("int")})
    return cohort.multi_label_stratified(d, ["y", "z", "w"], 0.2).select("subject_id", "y", "z", "w", "split")


# Sets

_A, _B = "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'F'", "SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'P'"


def with_status(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    return proxies.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("subject_id")).distinct()


@query(sql("SELECT subject_id, segment FROM ids WHERE subject_id IN (SELECT subject_id FROM a)", ids=_IDS, a=_A))
def q_semi(spark, sf_dir):
    return cohort.members(ids(spark, sf_dir), with_status(spark, sf_dir, "F")).select("subject_id", "segment")


@query(sql("SELECT subject_id, segment FROM ids WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.subject_id = ids.subject_id)", ids=_IDS, a=_A))
def q_anti(spark, sf_dir):
    return cohort.others(ids(spark, sf_dir), with_status(spark, sf_dir, "F")).select("subject_id", "segment")


@query(sql("SELECT subject_id, min(origin) AS origin FROM (SELECT subject_id, 'a' AS origin FROM a UNION ALL SELECT subject_id, 'b' FROM b) GROUP BY subject_id", a=_A, b=_B))
def q_union_dedup(spark, sf_dir):
    a, b = with_status(spark, sf_dir, "F").withColumn("origin", F.lit("a")), with_status(spark, sf_dir, "P").withColumn("origin", F.lit("b"))
    return cohort.union_first([a, b], "subject_id")


@query(sql("SELECT count(*) FILTER (b.subject_id IS NULL) AS only_left, count(*) FILTER (a.subject_id IS NULL) AS only_right, count(*) FILTER (a.subject_id IS NULL OR b.subject_id IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.subject_id = b.subject_id", a=_A, b=_B))
def q_set_equal(spark, sf_dir):
    return cohort.same_ids(with_status(spark, sf_dir, "F"), with_status(spark, sf_dir, "P"), "subject_id")


# Vocabularies

_SPECIAL = ["[PAD]", "[UNK]", "[MASK]", "[CLS]", "[EOS]"]
_VOCAB = "SELECT row_number() OVER (ORDER BY tier, pos, token) - 1 AS id, token FROM (SELECT token, min(tier) AS tier, min(pos) AS pos FROM (SELECT 1 AS tier, 0 AS pos, unnest(tokens) AS token FROM v_seq UNION ALL SELECT 0, * FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[MASK]'), (3, '[CLS]'), (4, '[EOS]')) t(pos, token)) GROUP BY token)"


def vocab_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(tokens(spark, sf_dir).where("token is not null").select("token").distinct(), _SPECIAL)


@query(sql("SELECT id, token FROM vocab", "v_seq", vocab=_VOCAB))
def q_vocab(spark, sf_dir):
    return vocab_of(spark, sf_dir).select(long("id"), "token")


_ENCODED = "SELECT subject_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM (SELECT subject_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM v_seq) LEFT JOIN vocab_even USING (token) GROUP BY subject_id"
_EVEN = "SELECT * FROM vocab WHERE id % 7 <> 6"


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some tokens are left out of the vocabulary, so that there are unknown ones."""
    return vocab.encoded_rows(tokens(spark, sf_dir), vocab_of(spark, sf_dir).where("id % 7 <> 6"))


@query(sql(f"SELECT subject_id, {lists('ids')} AS ids FROM encoded", "v_seq", vocab=_VOCAB, vocab_even=_EVEN, encoded=_ENCODED))
def q_encode(spark, sf_dir):
    return encoded(spark, sf_dir).select("subject_id", text("ids").alias("ids"))


@query(sql("SELECT subject_id, array_to_string(list(token ORDER BY pos), ',') AS tokens FROM (SELECT subject_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded) JOIN vocab USING (id) GROUP BY subject_id", "v_seq", vocab=_VOCAB, vocab_even=_EVEN, encoded=_ENCODED))
def q_decode(spark, sf_dir):
    return vocab.decoded(encoded(spark, sf_dir), vocab_of(spark, sf_dir)).select("subject_id", text("tokens").alias("tokens"))


@query(sql("SELECT token, CAST(arg_min(type, (subject_id * 10000 + pos)) AS BIGINT) AS type FROM (SELECT subject_id, unnest(tokens) AS token, unnest(types) AS type, unnest(range(len(tokens))) AS pos FROM v_seq) GROUP BY token", "v_seq"))
def q_concept_type(spark, sf_dir):
    return vocab.concept_types_of(tokens(spark, sf_dir)).select("token", long("type"))


@query(sql(f"SELECT subject_id, {lists('ids[1:20] || list_transform(range(CAST(greatest(40 - len(ids[1:20]), 0) AS BIGINT)), lambda x: 0)')} AS padded, {lists('list_transform(ids[1:20], lambda x: 1) || list_transform(range(CAST(greatest(40 - len(ids[1:20]), 0) AS BIGINT)), lambda x: 0)')} AS mask FROM encoded", "v_seq", vocab=_VOCAB, vocab_even=_EVEN, encoded=_ENCODED))
def q_pad_mask(spark, sf_dir):
    e = encoded(spark, sf_dir).withColumn("ids", arrays.cut("ids", F.lit(20)))
    return e.select("subject_id", text(arrays.pad("ids", 40, 0)).alias("padded"), text(arrays.mask("ids", 40)).alias("mask"))


_U = "CAST(('0x' || substr(md5('mlm:' || '{}:' || subject_id || ':' || pos), 1, 8)) AS BIGINT) / 4294967296.0"


@query(sql("SELECT subject_id, array_to_string(list(CASE WHEN NOT chosen THEN id WHEN u2 < 0.8 THEN 2 WHEN u3 < 0.1 THEN 3 + CAST(floor(u4 * 196) AS BIGINT) ELSE id END ORDER BY pos), ',') AS masked, array_to_string(list(CASE WHEN chosen THEN id ELSE -100 END ORDER BY pos), ',') AS labels FROM mlm GROUP BY subject_id", "v_seq", vocab=_VOCAB, vocab_even=_EVEN, encoded=_ENCODED,
    mlm=f"SELECT *, id > 2 AND {_U.format('pick')} < 0.15 AS chosen, {_U.format('mask')} AS u2, {_U.format('swap')} AS u3, {_U.format('other')} AS u4 FROM (SELECT subject_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded)"))
def q_mlm_mask(spark, sf_dir):
    masked, label = arrays.mlm("ids", "subject_id", 2, 200)
    return encoded(spark, sf_dir).select("subject_id", text(masked).alias("masked"), text(label).alias("labels"))


# Features


@query(sql("SELECT doc_id, token, count(*) AS n FROM v_word GROUP BY doc_id, token", "v_word"))
def q_freq_matrix(spark, sf_dir):
    return features.frequencies(words(spark, sf_dir), "doc_id", "words")


_CELLS = """SELECT subject_id, token, count(*) AS n FROM (SELECT subject_id, unnest(tokens) AS token FROM v_seq) GROUP BY subject_id, token"""
_COLUMNS = "SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT token FROM cells WHERE subject_id % 5 <> 0 GROUP BY token ORDER BY count(*) DESC, token LIMIT 40)"
_SPARSE = "SELECT subject_id, id, CAST(n AS DOUBLE) AS value FROM cells JOIN feature USING (token) UNION ALL SELECT subject_id, (SELECT count(*) FROM feature), CAST(num_visits AS DOUBLE) FROM v_seq UNION ALL SELECT subject_id, (SELECT count(*) FROM feature) + 1, CAST(len(tokens) AS DOUBLE) FROM v_seq"


@query(sql("SELECT s.subject_id, (SELECT count(*) FROM feature) + 2 AS size, coalesce(string_agg(id, ',' ORDER BY id), '') AS indices, coalesce(string_agg(CAST(value AS BIGINT), ',' ORDER BY id), '') AS values FROM v_seq s LEFT JOIN filled f ON f.subject_id = s.subject_id AND value <> 0 GROUP BY s.subject_id", "v_seq", cells=_CELLS, feature=_COLUMNS, filled=_SPARSE))
def q_sparse_matrix(spark, sf_dir):
    """Compressed rows of all subjects against the 40 tokens in most training subjects; visits and length stand behind them."""
    f = features.frequencies(tokens(spark, sf_dir).select("subject_id", F.array("token").alias("event_tokens")))
    index = features.feature_index(features.top_features(f.where("subject_id % 5 <> 0"), 40))
    keys = seqs(spark, sf_dir).select("subject_id", "num_visits", F.size("event_tokens").alias("n_tokens"))
    d = features.sparse_rows(f, index, keys, dense=("num_visits", "n_tokens"))
    return d.select("subject_id", long("size"), text("indices").alias("indices"), text(F.transform("values", lambda x: x.cast("long"))).alias("values"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.table(spark, sf_dir, "documents").select("doc_id", vocab.words_of(F.col("text")).alias("words"))


@query(sql("SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM v_word GROUP BY token ORDER BY n_docs DESC, token LIMIT 100", "v_word"))
def q_doc_freq_topk(spark, sf_dir):
    return features.top_features(features.frequencies(words(spark, sf_dir), "doc_id", "words"), 100)


@query(sql("SELECT subject_id, coalesce(min(v) FILTER (v > 0), 0) AS min_age, CAST(max(v) AS BIGINT) AS max_age FROM (SELECT subject_id, CAST(floor(greatest(e, 0) / 24) AS BIGINT) AS v FROM (SELECT subject_id, unnest(elapsed) AS e FROM v_seq)) GROUP BY subject_id", "v_seq"))
def q_age_span(spark, sf_dir):
    d = seqs(spark, sf_dir).withColumn("age_tokens", F.transform("elapsed_tokens", lambda x: F.floor(x / 24)))
    return features.age_span(d).select("subject_id", long("min_age"), long("max_age"))


@query("SELECT label, dim, round(sum(x * m) / greatest(sum(m), 1), 5) AS value FROM (SELECT label, CAST(vec_id % 3 <> 0 AS INTEGER) AS m, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim")
def q_masked_pool(spark, sf_dir):
    e = proxies.table(spark, sf_dir, "embeddings").withColumn("m", (F.col("vec_id") % 3 != 0).cast("int"))
    return features.masked_mean(e, "label", "embedding", "m").select("label", long("dim"), F.round("value", 5).alias("value"))


@query(sql("SELECT CAST(type AS BIGINT) AS type, round(sum(abs(s)) / any_value(n), 6) AS mean FROM (SELECT unnest(types) AS type, sin(unnest(elapsed)) AS s, (SELECT count(*) FROM v_seq) AS n FROM v_seq) GROUP BY type", "v_seq"))
def q_attribution_type(spark, sf_dir):
    d = seqs(spark, sf_dir).withColumn("scores", F.transform("elapsed_tokens", lambda x: F.sin(x)))
    return features.attribution_by_type(d).select(long("type"), F.round("mean", 6).alias("mean"))


# Metrics


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.scores(spark, sf_dir).where("quality <> -1").withColumnRenamed("quality", "y")


@query(sql("SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (quality = 1 AND p >= 0.5) AS tp, count(*) FILTER (quality = 0 AND p >= 0.5) AS fp, count(*) FILTER (quality = 1 AND p < 0.5) AS fn, count(*) FILTER (quality = 0 AND p < 0.5) AS tn FROM v_score WHERE quality <> -1)", "v_score"))
def q_confusion(spark, sf_dir):
    c = metrics.confusion(scored(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@query(sql("SELECT round(sum(pos * (n_neg - fp + neg / 2.0)) / (any_value(n_pos) * any_value(n_neg)), 6) AS auroc FROM v_curve", "v_curve"))
def q_auroc(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir)).select(F.round("auroc", 6).alias("auroc"))


@query(sql("SELECT round(sum(pos * tp / (tp + fp)) / any_value(n_pos), 6) AS ap FROM v_curve", "v_curve"))
def q_ap(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query(sql("SELECT round(sum(pos / n_pos * (pr + coalesce(before, 1)) / 2), 6) AS auc_pr FROM (SELECT *, lag(pr) OVER (ORDER BY p DESC) AS before FROM (SELECT *, tp / (tp + fp) AS pr FROM v_curve))", "v_curve"))
def q_aucpr(spark, sf_dir):
    return metrics.auc_pr(scored(spark, sf_dir)).select(F.round("auc_pr", 6).alias("auc_pr"))


@query(sql("SELECT round(max(tp / (tp + fp)), 6) AS precision FROM v_curve WHERE tp / n_pos >= 0.8", "v_curve"))
def q_prec_at_recall(spark, sf_dir):
    return metrics.precision_at_recall(scored(spark, sf_dir)).select(F.round("precision", 6).alias("precision"))


_TASKS = "SELECT 'quality' AS task, quality AS y, p FROM v_score WHERE quality <> -1 UNION ALL SELECT 'toxic', toxic, p FROM v_score WHERE toxic <> -1"
_CURVES = "SELECT *, sum(pos) OVER (PARTITION BY task ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY task ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY task) AS n_pos, sum(neg) OVER (PARTITION BY task) AS n_neg FROM (SELECT task, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM tasks GROUP BY task, p)"


@query(sql("SELECT round(avg(auroc), 6) AS auroc, round(avg(ap), 6) AS ap, round(avg(precision), 6) AS precision, count(*) AS n_labels FROM (SELECT task, sum(pos * (n_neg - fp + neg / 2.0)) / (any_value(n_pos) * any_value(n_neg)) AS auroc, sum(pos * tp / (tp + fp)) / any_value(n_pos) AS ap, max(tp / (tp + fp)) FILTER (tp / n_pos >= 0.8) AS precision FROM curves GROUP BY task)", "v_score", tasks=_TASKS, curves=_CURVES))
def q_macro(spark, sf_dir):
    s = proxies.scores(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y")) for t in ("quality", "toxic")])
    long_form = s.select("p", F.explode(rows).alias("x")).select("p", "x.task", "x.y").where("y <> -1")
    m = metrics.macro(long_form, "task")
    return m.select(*[F.round(c, 6).alias(c) for c in ("auroc", "ap", "precision")], "n_labels")


# Profiles


@query("SELECT 'hadm_id' AS column, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END), 6) AS fraction FROM lineitem UNION ALL SELECT 'time', 0.0 UNION ALL SELECT 'code', 0.0 UNION ALL SELECT 'subject_id', 0.0")
def q_profile_nulls(spark, sf_dir):
    return profile.null_fractions(proxies.events(spark, sf_dir)).select("column", F.round("fraction", 6).alias("fraction"))


@query(sql("SELECT code, count(*) AS n FROM v_stream GROUP BY code ORDER BY n DESC, code LIMIT 10", "v_stream"))
def q_value_counts(spark, sf_dir):
    return profile.value_counts(proxies.stream(spark, sf_dir), "code")


@query("SELECT round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, count(*) AS n_subjects FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def q_records_per_subject(spark, sf_dir):
    return profile.per_subject(proxies.stream(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def q_hour_hist(spark, sf_dir):
    return profile.hours_of_day(proxies.stream(spark, sf_dir), "time").select(long("hour"), "n")


@query("SELECT CAST(least(floor(value / 2) + 1, 50) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def q_value_hist(spark, sf_dir):
    return profile.histogram(proxies.table(spark, sf_dir, "events"), "value", 0.0, 100.0, 50).select(long("bin"), "n")


@query(sql("SELECT 'quality' AS label, round(avg(quality), 6) AS mean, count(*) FILTER (quality = 1) AS positive, count(*) AS n FROM v_score WHERE quality <> -1 UNION ALL SELECT 'toxic', round(avg(toxic), 6), count(*) FILTER (toxic = 1), count(*) FROM v_score WHERE toxic <> -1", "v_score"))
def q_prevalence(spark, sf_dir):
    return profile.prevalence(proxies.scores(spark, sf_dir), ["quality", "toxic"]).withColumn("mean", F.round("mean", 6))


# Repairs, packing, windows


@query(sql(f"SELECT subject_id, {lists('list_transform(elapsed, lambda x: CAST(floor(greatest(x * 100, 0) / 8766) AS BIGINT))')} AS ages FROM v_seq", "v_seq"))
def q_repair_age(spark, sf_dir):
    s = seqs(spark, sf_dir).withColumn("elapsed_tokens", F.transform("elapsed_tokens", lambda x: x * 100))
    return repair.with_ages(s).select("subject_id", text("age_tokens").alias("ages"))


@query(sql(f"SELECT subject_id, {lists('tokens')} AS tokens FROM v_seq", "v_seq"))
def q_nested_flatten(spark, sf_dir):
    s = seqs(spark, sf_dir).select("subject_id", F.array("event_tokens").alias("event_tokens"))
    return repair.unnested(s).select("subject_id", text("event_tokens").alias("tokens"))


@query(sql("SELECT study_id, subject_id FROM v_study WHERE study_id NOT IN (SELECT study_id FROM v_study WHERE hadm_id % 3 = 0)", "v_study"))
def q_resume_antijoin(spark, sf_dir):
    s = proxies.studies(spark, sf_dir)
    return cohort.others(s, s.where("hadm_id % 3 = 0"), "study_id").select("study_id", "subject_id")


@query(sql("SELECT study_id, n // 1024 AS pack, n % 1024 AS index_in_pack FROM (SELECT study_id, row_number() OVER (ORDER BY study_id) - 1 AS n FROM v_study)", "v_study"))
def q_shard_number(spark, sf_dir):
    n = ranks.row_index(proxies.studies(spark, sf_dir).select("study_id"), ["study_id"], "n")
    return n.select("study_id", F.floor(F.col("n") / 1024).alias("pack"), (F.col("n") % 1024).alias("index_in_pack"))


@query(sql("SELECT subject_id, seq, round(coalesce(date_sub('second', lag(time) OVER (PARTITION BY subject_id ORDER BY time, seq), time) / 3600.0, 0), 5) AS delta FROM v_stream", "v_stream"))
def q_time_delta(spark, sf_dir):
    d = sequences.time_delta(proxies.stream(spark, sf_dir), "subject_id", "time", ("time", "seq"))
    return d.select("subject_id", "seq", F.round("delta", 5).alias("delta"))


@query(sql("SELECT subject_id, pos, CAST(least(greatest(visit - first_value(visit) OVER (PARTITION BY subject_id ORDER BY pos), 0), 4) AS BIGINT) AS visit_order FROM (SELECT subject_id, unnest(visits) AS visit, unnest(range(len(visits))) AS pos FROM v_seq)", "v_seq"))
def q_visit_clamp(spark, sf_dir):
    e = seqs(spark, sf_dir).select("subject_id", F.posexplode("visit_tokens").alias("pos", "visit"))
    return sequences.visit_order(e, "subject_id", "visit", ("pos",), 5).select("subject_id", long("pos"), long("visit_order"))


_PROBABILITY = "SELECT subject_id, token, count(*) AS n, sum(count(*)) OVER (PARTITION BY subject_id) AS t FROM (SELECT subject_id, unnest(tokens) AS token FROM v_seq) GROUP BY subject_id, token"


@query(sql("SELECT subject_id, token, round(n / t, 6) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY subject_id ORDER BY n DESC, token ROWS UNBOUNDED PRECEDING) - n AS before FROM probability) WHERE before < 0.55 * t", "v_seq", probability=_PROBABILITY))
def q_nucleus(spark, sf_dir):
    f = features.frequencies(seqs(spark, sf_dir))
    t = f.groupBy("subject_id").agg(F.sum("n").alias("t"))
    # In counts, so that sums are exact.
    d = sequences.nucleus(f.join(t, "subject_id").withColumn("p", F.col("n") * 1000000 / F.col("t")), "subject_id", "n", "token", 10**18)
    return d.where(F.col("cumulative") - F.col("n") < F.col("t") * 0.55).select("subject_id", "token", F.round(F.col("n") / F.col("t"), 6).alias("p"))


@query(sql(f"SELECT subject_id, {lists('tokens || list_transform(range(most - len(tokens)), lambda x: chr(91) || chr(80) || chr(65) || chr(68) || chr(93))')} AS tokens, len(tokens) AS n FROM (SELECT subject_id, tokens, max(len(tokens)) OVER (PARTITION BY subject_id % 4) AS most FROM short)", "v_seq", short="SELECT subject_id, tokens[1:CAST(5 + subject_id % 20 AS BIGINT)] AS tokens FROM v_seq"))
def q_batch_pad(spark, sf_dir):
    s = seqs(spark, sf_dir).select("subject_id", (F.col("subject_id") % 4).alias("batch"), arrays.truncate("event_tokens", (5 + F.col("subject_id") % 20).cast("int")).alias("tokens"))
    d = sequences.padded_batches(s, "batch", "tokens", "[PAD]")
    return d.select("subject_id", text("tokens").alias("tokens"), F.aggregate("tokens_mask", F.lit(0), lambda a, b: a + b).cast("long").alias("n"))


@query(sql("SELECT doc_id, CAST(least(len(words), 512) AS BIGINT) AS token_length FROM v_doc ORDER BY len(words) DESC, doc_id", "v_doc"))
def q_length_sort(spark, sf_dir):
    return sequences.by_length(words(spark, sf_dir), "words", 512, "doc_id").select("doc_id", long("token_length"))


@query(sql("SELECT token, CASE WHEN regexp_matches(token, '_[0-9]$') AND starts_with(token, 'bin') THEN 'Bin' || right(token, 2) WHEN token LIKE 'LAB%' AND length(token) = 5 THEN 'Lab ' || token ELSE token END AS label FROM (SELECT DISTINCT unnest(tokens) AS token FROM v_seq UNION SELECT 'bin_3' UNION SELECT 'other_4')", "v_seq"))
def q_decode_labels(spark, sf_dir):
    t = vocab.tokens(seqs(spark, sf_dir))
    t = t.union(spark.createDataFrame([("bin_3",), ("other_4",)], "token string"))
    lab = F.when(F.col("token").startswith("LAB") & (F.length("token") == 5), F.create_map(F.col("token"), F.concat(F.lit("Lab "), F.col("token")))).otherwise(F.create_map(F.lit("bin"), F.lit("Bin")))
    return t.select("token", codes.decode_label("token", lab).alias("label"))


@query(sql("SELECT i.stay_id, i.study_id, CASE WHEN i.study_id % 2 = 0 THEN '/packs/' || (i.study_id // 1024) || '.pt' WHEN i.study_id % 3 = 0 THEN '/root/jpg/' || i.study_id || '.jpg' END AS path FROM v_image i WHERE i.study_id % 2 = 0 OR i.study_id % 3 = 0", "v_image"))
def q_manifest_paths(spark, sf_dir):
    i = images(spark, sf_dir).select("stay_id", "study_id")
    m = proxies.studies(spark, sf_dir).where("study_id % 2 = 0").select("study_id", F.concat(F.lit("/packs/"), F.floor(F.col("study_id") / 1024).cast("string"), F.lit(".pt")).alias("tensor_path"))
    jpg = F.when(F.col("study_id") % 3 == 0, codes.resolve_path(F.concat(F.lit("jpg/"), F.col("study_id").cast("string"), F.lit(".jpg")), "/root"))
    d = align.with_manifest(i, m).withColumn("path", codes.preferred_path("tensor_path", jpg))
    return d.where("path is not null").select("stay_id", "study_id", "path")


__all__ = ["oracle_sql", "queries", "schema"]
