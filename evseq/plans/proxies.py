"""The test tables seen as clinical ones, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evseq.operators.ranks import dealt, parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


def days(n) -> F.Column:
    return F.make_dt_interval(n.cast("int") if not isinstance(n, int) else F.lit(n))


#: What codes of the third kind of row begin with, by part number: the types that are neither diagnosis nor lab, and one of none.
KINDS = ("MEDICATION//", "PROCEDURE//", "TRANSFER_TO//", "ICU_ADMISSION//", "INFUSION_START//", "MEDICATION//", "VITAL//")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    return c.select(
        F.col("c_custkey").alias("subject_id"), (F.lit(20) + F.col("c_custkey") % 60).cast("int").alias("anchor_age"), F.lit(1996).alias("anchor_year"), F.lit(None).cast("int").alias("year_of_birth"),
        F.when(F.col("c_acctbal") < 0, start + days(F.col("c_custkey") % 1000)).alias("dod"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"), ntz("o_orderdate").alias("intime"), F.when(F.col("o_orderstatus") != "P", ntz("o_orderdate") + days(30)).alias("outtime"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    died = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)
    return o.select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), ntz("o_orderdate").alias("admittime"), F.when(died, ntz("o_orderdate") + days(F.col("o_orderkey") % 60)).alias("deathtime"),
        (F.col("o_orderstatus") == "F").cast("int").alias("hospital_expire_flag"), F.col("o_orderpriority").alias("admission_type"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with their customer. Both tables are dealt out by the order, in parts that don't grow with them."""
    e, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = parts(e, o)
    return dealt(e, n, "l_orderkey").join(dealt(o, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    sepsis = F.when(part % 20 == 0, "A41").when(part % 20 == 1, "038").otherwise("I")
    code = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("DIAGNOSIS//"), sepsis, part.cast("string"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("LAB//"), part.cast("string"))).otherwise(F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (part % len(KINDS) + 1).cast("int")), part.cast("string")))
    code = F.when(part % 97 == 0, "MEDS_BIRTH").otherwise(code)
    return lines(spark, sf_dir).select(F.col("o_custkey").alias("subject_id"), F.when(F.col("l_linestatus") != "F", F.col("l_orderkey")).alias("hadm_id"), ntz("l_shipdate").alias("time"), code.alias("code"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    s = k.cast("string")
    rare = F.when((k % 10 == 7) & (F.col("value") > 60), "A41").otherwise("I")
    code = (
        F.when(F.col("event_type") == "signup", "[VS]").when(F.col("event_type") == "purchase", "[VE]").when(F.col("event_type") == "click", F.concat(F.lit("LAB//"), s)).when(F.col("event_type") == "view", F.concat(F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int")), s))
        .when((k % 10 == 0) & (F.col("value") > 20), "MEDS_DEATH").when((k % 10).between(1, 6), F.concat(F.lit("[W_"), (k % 4).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("DIAGNOSIS//"), rare, s))
    )
    return e.select(F.col("user_id").alias("subject_id"), ntz("ts").alias("time"), F.col("event_id").alias("seq"), code.alias("code"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id from the row's keys: equal keys would be one study, so the least price of equal keys counts."""
    key = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("study_id")
    e = lines(spark, sf_dir).select(F.col("o_custkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"), key, ntz("l_shipdate").alias("StudyDateTime"), (F.col("l_linestatus") == "O").alias("jpg_path_exists"))
    return e.groupBy("subject_id", "hadm_id", "study_id").agg(F.min("StudyDateTime").alias("StudyDateTime"), F.bool_or("jpg_path_exists").alias("jpg_path_exists"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("p"))


#: The type of a token or code.
TYPE_SQL = (
    "CASE WHEN {0} IN ('MEDS_BIRTH', 'MEDS_DEATH', '[CLS]', '[PAD]', '[BOS]', '[EOS]') THEN 0 WHEN starts_with({0}, 'DIAGNOSIS') THEN 1 WHEN starts_with({0}, 'LAB') THEN 2 WHEN starts_with({0}, 'MEDICATION') THEN 3 "
    "WHEN starts_with({0}, 'PROCEDURE') THEN 4 WHEN starts_with({0}, 'TRANSFER_TO') THEN 5 WHEN starts_with({0}, 'ICU') THEN 6 WHEN starts_with({0}, 'INFUSION') THEN 7 ELSE 8 END"
)
#: The same in SQL: common table expressions, by name.
SQL = {
    "v_patient": "SELECT c_custkey AS subject_id, CAST(20 + c_custkey % 60 AS INTEGER) AS anchor_age, 1996 AS anchor_year, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) END AS dod FROM customer",
    "v_stay": """SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS stay_id, CAST(o_orderdate AS TIMESTAMP) AS intime, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS outtime,
        CAST(o_orderstatus = 'F' AS INTEGER) AS hospital_expire_flag, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS deathtime, o_orderpriority AS admission_type FROM orders""",
    "v_master": """SELECT s.*, coalesce(deathtime, dod) AS death_time, hospital_expire_flag AS in_hosp_mortality,
        CAST(coalesce(coalesce(deathtime, dod) >= intime AND coalesce(deathtime, dod) <= intime + INTERVAL 28 DAY, false) AS INTEGER) AS mortality_28d FROM v_stay s LEFT JOIN v_patient USING (subject_id)""",
    "v_event": """SELECT o_custkey AS subject_id, CASE WHEN l_linestatus <> 'F' THEN l_orderkey END AS hadm_id, CAST(l_shipdate AS TIMESTAMP) AS time, CASE WHEN l_partkey % 97 = 0 THEN 'MEDS_BIRTH' ELSE CASE l_returnflag
        WHEN 'R' THEN 'DIAGNOSIS//' || CASE l_partkey % 20 WHEN 0 THEN 'A41' WHEN 1 THEN '038' ELSE 'I' END || l_partkey WHEN 'A' THEN 'LAB//' || l_partkey ELSE ['MEDICATION//', 'PROCEDURE//', 'TRANSFER_TO//', 'ICU_ADMISSION//', 'INFUSION_START//', 'MEDICATION//', 'VITAL//'][l_partkey % 7 + 1] || l_partkey END END AS code
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_match": """SELECT e.subject_id, e.hadm_id, e.time, e.code, s.stay_id, s.hadm_id AS stay_hadm_id, s.intime, s.outtime, s.in_hosp_mortality, s.mortality_28d FROM v_event e JOIN v_master s ON e.subject_id = s.subject_id
        AND e.time >= s.intime - INTERVAL 168 HOUR AND (s.outtime IS NULL OR e.time <= s.outtime) AND (s.hadm_id IS NULL OR e.hadm_id IS NULL OR e.hadm_id = s.hadm_id)""",
    "v_raw": "SELECT user_id AS subject_id, CAST(ts AS TIMESTAMP) AS time, event_id AS seq, event_type, value, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events",
    "v_stream": """SELECT subject_id, time, seq, CASE event_type WHEN 'signup' THEN '[VS]' WHEN 'purchase' THEN '[VE]' WHEN 'click' THEN 'LAB//' || k WHEN 'view' THEN ['MEDICATION//', 'PROCEDURE//', 'TRANSFER_TO//', 'ICU_ADMISSION//', 'INFUSION_START//', 'MEDICATION//', 'VITAL//'][k % 7 + 1] || k
        ELSE CASE WHEN k % 10 = 0 AND value > 20 THEN 'MEDS_DEATH' WHEN k % 10 BETWEEN 1 AND 6 THEN '[W_' || (k % 4) || ']' ELSE 'DIAGNOSIS//' || CASE WHEN k % 10 = 7 AND value > 60 THEN 'A41' ELSE 'I' END || k END END AS code FROM v_raw""",
    "v_clean": "SELECT *, CASE WHEN regexp_matches(code, '^\\[.*\\]$') THEN code ELSE regexp_replace(code, '[^A-Za-z0-9_]', '', 'g') END AS token FROM v_stream",
    "v_typed": f"""SELECT *, {TYPE_SQL.format('token')} AS type,
        row_number() OVER w - 1 AS pos, CAST(sum(CAST(code = '[VS]' AS INTEGER)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit, date_sub('second', first_value(time) OVER w, time) / 3600.0 AS elapsed
        FROM v_clean WINDOW w AS (PARTITION BY subject_id ORDER BY time, seq)""",
    "v_seq": """SELECT subject_id, list(token ORDER BY pos) FILTER (pos < 2048) AS tokens, list(type ORDER BY pos) FILTER (pos < 2048) AS types, list(elapsed ORDER BY pos) FILTER (pos < 2048) AS elapsed, list(visit ORDER BY pos) FILTER (pos < 2048) AS visits,
        greatest(sum(CAST(code = '[VS]' AS INTEGER)), 1) AS num_visits, bool_or(token LIKE '%DEATH%') AS died, bool_or(regexp_matches(token, '^DIAGNOSIS(038|A40|A41)')) AS septic FROM v_typed GROUP BY subject_id""",
    "v_ends": "SELECT *, len(tokens) - list_position(list_reverse(tokens), '[VS]') AS vs0, list_contains(tokens, '[VS]') AS has_vs, len(tokens) - list_position(list_reverse(tokens), '[VE]') AS ve0, list_contains(tokens, '[VE]') AS has_ve FROM v_seq",
    "v_study": """SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_orderkey * 100 + l_linenumber AS study_id, min(CAST(l_shipdate AS TIMESTAMP)) AS t, bool_or(l_linestatus = 'O') AS ok
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "v_image": """SELECT s.stay_id, i.subject_id, i.study_id, date_diff('microsecond', s.intime, i.t) / 3.6e9 AS hours, row_number() OVER (PARTITION BY s.stay_id ORDER BY i.t, i.study_id) - 1 AS rank
        FROM v_study i JOIN v_stay s ON i.subject_id = s.subject_id AND i.hadm_id = s.hadm_id AND i.t >= s.intime AND (s.outtime IS NULL OR i.t <= s.outtime) WHERE i.ok""",
    "v_score": "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, n_chars % 1000 / 1000.0 AS p FROM documents LEFT JOIN labels USING (doc_id)",
    "v_curve": """SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
        FROM (SELECT p, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM v_score WHERE quality <> -1 GROUP BY p)""",
    "v_doc": "SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents",
    "v_word": "SELECT doc_id, unnest(words) AS token FROM v_doc",
}
#: What each view is made of, in order.
NEEDS = {
    "v_master": ["v_patient", "v_stay"], "v_match": ["v_patient", "v_stay", "v_master", "v_event"], "v_stream": ["v_raw"], "v_clean": ["v_raw", "v_stream"], "v_typed": ["v_raw", "v_stream", "v_clean"],
    "v_seq": ["v_raw", "v_stream", "v_clean", "v_typed"], "v_ends": ["v_raw", "v_stream", "v_clean", "v_typed", "v_seq"], "v_image": ["v_stay", "v_study"], "v_curve": ["v_score"], "v_word": ["v_doc"],
}


def sql(body: str, *views: str, **more: str) -> str:
    """body with the views it needs in front, and further ones of its own."""
    names = list(dict.fromkeys(n for v in views for n in (*NEEDS.get(v, []), v)))
    ctes = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    recursive = "RECURSIVE " * any("(" in n for n in more)
    return f"WITH {recursive}{', '.join(ctes)} {body}" if ctes else body
