"""Operators on small tables: empty input, single rows, nulls, ties, bounds."""

import os
import sys
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import ROOT
from evseq import schema
from evseq.functions import arrays, codes, timecols
from evseq.operators import align, cohort, features, labels, metrics, profile, ranks, repair, sequences, stays, vocab
from evseq.sources import io

T0 = dt(2024, 1, 1)


def one(spark, ddl, *values, **exprs):
    return spark.createDataFrame([values], ddl).select(*[e.alias(n) for n, e in exprs.items()]).first()


def events(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, seq long, code string")


# Functions on codes


def test_codes(spark):
    rows = [("DIAGNOSIS//A41",), ("diagnosis//038",), ("LAB//é²",), ("[VS]",), (None,), ("a b",), ("MEDS_DEATH",), ("patient Deceased",), ("TRANSFER_TO//ICU",), ("ICU_ADMISSION",)]
    d = spark.createDataFrame(rows, "code string")
    got = d.select(codes.sanitize("code").alias("a"), codes.sanitize("code", True).alias("b"), codes.sanitize_stay("code").alias("c"), codes.token_type("code").alias("t"), codes.is_death(F.col("code")).alias("d"), codes.is_death(F.col("code"), True).alias("e"), codes.is_sepsis_code(F.col("code")).alias("s"), codes.is_sepsis_token(F.col("code")).alias("p")).collect()
    assert [r["a"] for r in got] == ["DIAGNOSISA41", "diagnosis038", "LAB", "VS", None, "ab", "MEDS_DEATH", "patientDeceased", "TRANSFER_TOICU", "ICU_ADMISSION"]
    assert got[3]["b"] == "[VS]" and got[2]["c"] == "LABé²" and got[4]["c"] == ""
    assert [r["t"] for r in got] == [1, 8, 2, 8, 8, 8, 0, 8, 5, 6]
    assert [bool(r["d"]) for r in got] == [False] * 6 + [True] + [False] * 3 and got[7]["e"]
    assert [bool(r["s"]) for r in got][:2] == [True, True] and got[0]["p"] and got[1]["p"]


def test_strings(spark):
    r = one(spark, "a string, m map<string,string>", " YES ", {"LAB": "Lab", "X_1": "x one"}, yes=codes.truthy("a"), no=codes.truthy(F.lit("t")), t=codes.truthy(F.lit("T"), ("t",)), null=codes.truthy(F.lit(None)), label=codes.decode_label(F.lit("LAB_3"), F.col("m")), plain=codes.decode_label(F.lit("other"), F.col("m")), same=codes.decode_label(F.lit("X_1"), F.col("m")), strip=codes.strip_label(F.lit("label_los")), kv=codes.key_values(F.lit("a=0.5, b = 2")), p=codes.resolve_path(F.lit("x/y"), "/root/"), q=codes.resolve_path(F.lit("/x"), "/root"), i=codes.image_path(F.lit(1234), F.lit(5), F.lit("d")))
    assert (r["yes"], r["no"], r["t"], r["null"]) == (True, False, True, False)
    assert (r["label"], r["plain"], r["same"], r["strip"]) == ("Lab_3", "other", "x one", "los")
    assert r["kv"] == {"a": 0.5, "b": 2.0} and r["p"] == "/root/x/y" and r["q"] == "/x" and r["i"] == "p12/p1234/s5/d.jpg"
    with pytest.raises(PySparkException):
        one(spark, "a string", "a b", x=codes.one_word("a"))


# Functions of arrays


def test_arrays(spark):
    r = one(
        spark, "a array<string>, e array<string>, n array<int>, h array<double>", ["x", "VS", "y", "VS", "z"], [], [3, -1, 0, 5], [0.0, 30.0, 10.0],
        last=arrays.last_index("a", "VS"), none=arrays.last_index("a", "q"), empty=arrays.last_index("e", "q"), pos=arrays.positions("a"), pos0=arrays.positions("e"), cut=arrays.truncate("a", -3), two=arrays.truncate_with("a", 3, "EOS"),
        pad=arrays.pad("n", 6, 0), left=arrays.pad("n", 6, 0, "left"), long=arrays.pad("n", 2, 0), mask=arrays.mask("n", 6), mask0=arrays.mask("e", 2), first=arrays.first_index_where("h", lambda x, i: x > 24), no=arrays.first_index_where("h", lambda x, i: x > 99),
        c1=arrays.cut("n", F.lit(-1)), c0=arrays.cut("n", F.lit(0)), cn=arrays.cut("n", F.lit(None).cast("int")), c9=arrays.cut("n", F.lit(9)), ends=arrays.with_ends("a", "A", "Z"), clip=arrays.clip("n", 0, 2), start=arrays.pad_start("n"), ext=arrays.extend("n", 2), ext0=arrays.extend("e", 2),
        minp=arrays.min_positive("n"), count=arrays.count_of("a", "VS"), listed=F.size(arrays.listed(F.lit(None).cast("int"))),
    )
    assert (r["last"], r["none"], r["empty"], r["pos"], r["pos0"]) == (3, None, None, [0, 1, 2, 3, 4], [])
    assert (r["cut"], r["two"]) == ([], ["x", "VS", "EOS"])
    assert (r["pad"], r["left"], r["long"]) == ([3, -1, 0, 5, 0, 0], [0, 0, 3, -1, 0, 5], [3, -1])
    assert (r["mask"], r["mask0"], r["first"], r["no"]) == ([1, 1, 1, 1, 0, 0], [0, 0], 1, None)
    assert (r["c1"], r["c0"], r["cn"], r["c9"]) == ([3, -1, 0, 5], [], [3, -1, 0, 5], [3, -1, 0, 5])
    assert r["ends"] == ["A", "VS", "y", "VS", "Z"] and r["clip"] == [2, 0, 0, 2] and r["start"] == 2 and r["ext"] == [3, -1, 0, 5, 5, 5] and r["ext0"] == []
    assert (r["minp"], r["count"], r["listed"]) == (3, 2, 0)


def test_mlm(spark):
    d = spark.createDataFrame([(i, list(range(200))) for i in range(40)], "id long, ids array<int>")
    masked, label = arrays.mlm("ids", "id", 4, 200)
    rows = d.select("ids", masked.alias("m"), label.alias("l")).collect()
    cells = [(x, m, y) for r in rows for x, m, y in zip(r["ids"], r["m"], r["l"], strict=True)]
    chosen = [c for c in cells if c[2] != -100]
    assert all(x > 4 and x == y for x, _, y in chosen) and all(x == m for x, m, y in cells if y == -100)
    assert 0.12 < len(chosen) / len(cells) < 0.18
    assert 0.7 < sum(m == 4 for _, m, _ in chosen) / len(chosen) < 0.9 and all(m < 199 or m == x for x, m, _ in chosen)


# Time


def test_times(spark):
    start = dt(2024, 3, 1)
    r = one(
        spark, "s timestamp_ntz, d timestamp_ntz, e array<double>, t array<string>", start, start + timedelta(seconds=5400, microseconds=900000), [-5.0, 8766.0, 20000.0], ["a", "MEDS_BIRTH", "b"],
        whole=timecols.whole_hours("s", "d"), frac=timecols.hours("s", "d"), null=timecols.hours("s", F.lit(None).cast("timestamp_ntz")), neg=timecols.hours("d", "s"), age=timecols.age_from_elapsed("e"), est=timecols.estimated_age("t", "e"),
        at=timecols.died_within("s", "s"), last=timecols.died_within(F.col("s") + F.expr("interval 28 days"), "s"), after=timecols.died_within(F.col("s") + F.expr("interval 28 days 1 second"), "s"), before=timecols.died_within(F.col("s") - F.expr("interval 1 second"), "s"), never=timecols.died_within(F.lit(None).cast("timestamp_ntz"), "s"),
        years=timecols.age_at("s", F.lit(30), F.lit(2030), F.lit(None).cast("int")), born=timecols.age_at("s", F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1990)),
    )
    assert r["whole"] == 1.5 and abs(r["frac"] - 1.50025) < 1e-9 and r["null"] == 0 and r["neg"] < 0
    assert r["age"] == [0, 1, 2] and r["est"] == [1, 2, 3]
    assert (r["at"], r["last"], r["after"], r["before"], r["never"]) == (1, 1, 0, 0, 0) and (r["years"], r["born"]) == (24, 34)


# Sequences


def test_sequences(spark):
    rows = [(1, T0, 0, "[VS]"), (1, T0 + timedelta(hours=1, milliseconds=900), 1, "LAB//b"), (1, T0 + timedelta(hours=1, milliseconds=900), 2, "LAB//a"), (1, T0 + timedelta(hours=2), 3, "[VS]"), (1, T0 + timedelta(hours=3), 4, "MEDS_DEATH"), (2, T0, 5, "LAB//x"), (3, None, 6, "LAB//n"), (3, T0, 7, "LAB//t")]
    got = {r["subject_id"]: r for r in sequences.patient_sequences(events(spark, rows), 4).collect()}
    assert got[1]["event_tokens"] == ["[VS]", "LABb", "LABa", "[VS]"] and got[1]["visit_tokens"] == [1, 1, 1, 2] and got[1]["elapsed_tokens"] == [0.0, 1.0, 1.0, 2.0]
    assert got[1]["num_visits"] == 2 and got[1]["died"] and got[1]["position_tokens"] == [0, 1, 2, 3] and got[1]["age_tokens"] == [25] * 4
    assert got[2]["num_visits"] == 1 and got[3]["elapsed_tokens"] == [None, 0.0]
    spread = sequences.patient_sequences(events(spark, rows), 4, null_time="propagate").where("subject_id = 3").first()
    assert spread["elapsed_tokens"] == [None, None]
    assert sequences.patient_sequences(events(spark, []), 4).count() == 0
    names = sequences.suffixed(sequences.patient_sequences(events(spark, rows), 4), 4).columns
    assert "event_tokens_4" in names and "num_visits" in names
    seqs = sequences.patient_sequences(events(spark, rows), 4)
    full, cut = labels.task_labels(seqs), labels.task_labels(seqs, truncated=True)
    assert full.where("subject_id = 1").first()["label_mortality_1month"] == 1 and cut.where("subject_id = 1").first()["label_mortality_1month"] == 0
    assert full.where("subject_id = 2").first()["death_after_end"] == -1


def test_two_exchanges(spark):
    plan = sequences.patient_sequences(events(spark, [(1, T0, 0, "a")]), 4)._jdf.queryExecution().executedPlan().toString()
    # One of the events that are kept, one of what the tasks have added up; the join needs none.
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


def test_alignment(spark):
    inn, out = T0, T0 + timedelta(days=2)
    us = timedelta(microseconds=1)
    s = spark.createDataFrame([(10, 1, 100, inn, out), (11, 1, None, inn, None), (12, 2, 200, inn, out)], "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    times = [inn - timedelta(hours=168), inn - timedelta(hours=168) - us, inn, out, out + us]
    e = spark.createDataFrame([(1, None, t, f"c{k}") for k, t in enumerate(times)] + [(1, 999, inn, "other"), (None, None, inn, "null"), (2, 200, inn, "same")], "subject_id long, hadm_id long, time timestamp_ntz, code string")
    got = sorted((r["stay_id"], r["code"]) for r in align.events_in_stays(e, s).collect())
    assert got == [(10, "c0"), (10, "c2"), (10, "c3"), (11, "c0"), (11, "c2"), (11, "c3"), (11, "c4"), (11, "other"), (12, "same")]
    st = sequences.stay_sequences(align.events_in_stays(e, s.withColumns({"in_hosp_mortality": F.lit(1), "mortality_28d": F.lit(0)})), 2)
    r = st.where("stay_id = 10").first()
    assert r["event_tokens"] == ["c0", "c2"] and r["elapsed_tokens"] == [-168.0, 0.0] and r["visit_tokens"] == [0, 1] and r["label_in_hosp_mortality"] == 1
    tail = sequences.stay_sequences(align.events_in_stays(e, s.withColumns({"in_hosp_mortality": F.lit(1), "mortality_28d": F.lit(0)})), 2, keep="tail").where("stay_id = 10").first()
    assert tail["event_tokens"] == ["c2", "c3"]
    x = spark.createDataFrame([(1, 100, 5, inn, True), (1, 100, 4, inn, True), (1, 100, 6, out, True), (1, 100, 7, out + us, True), (1, None, 8, inn, True), (1, 100, 9, inn, False)], "subject_id long, hadm_id long, study_id long, StudyDateTime timestamp_ntz, jpg_path_exists boolean")
    i = {r["study_id"]: r for r in align.studies_in_stays(x, s).collect()}
    assert sorted(i) == [4, 5, 6] and [i[k]["image_rank_in_stay"] for k in (4, 5, 6)] == [0, 1, 2] and i[4]["is_first_image"] == 1 and i[6]["is_first_24h_image"] == 0
    assert {r["study_id"] for r in align.studies_in_stays(x, s, null_keys_match=True).collect()} == {4, 5, 6, 8}
    assert align.latest_study(x).first()["study_id"] == 7


def test_master(spark):
    p = spark.createDataFrame([(1, None), (1, T0 + timedelta(days=3)), (2, T0)], "subject_id long, dod timestamp_ntz")
    s = spark.createDataFrame([(1, 10, 100, T0, None), (2, 20, 200, T0 + timedelta(hours=5), None), (None, 1, 1, T0, None)], schema.ICUSTAYS)
    a = schema.conform(spark.createDataFrame([(1, 10, 1)], "subject_id long, hadm_id long, hospital_expire_flag int"), schema.ADMISSIONS)
    m = {r["stay_id"]: r for r in stays.master_stays(s, a, p).collect()}
    assert len(m) == 2 and len(stays.master_stays(s, a, p).columns) == 20
    assert m[100]["in_hosp_mortality"] == 1 and m[200]["in_hosp_mortality"] == 0 and m[200]["mortality_28d"] == 0  # the date of death is before intime


def test_ages(spark):
    e = spark.createDataFrame([(1, T0, "a", None), (1, T0 + timedelta(1), "b", 40), (1, T0 + timedelta(2), "c", None), (2, T0, "a", None)], "subject_id long, time timestamp_ntz, code string, age int")
    assert [r["age_filled"] for r in stays.filled_age(e).orderBy("subject_id", "time").collect()] == [40, 40, 40, 25]


# Labels


def sequence(spark, rows):
    return spark.createDataFrame([(i, i, t, [float(x) for x in (e or range(len(t)))], n) for i, t, e, n in rows], "subject_id long, patient_id long, event_tokens array<string>, elapsed_tokens array<double>, num_visits long")


def test_cohorts(spark):
    s = sequence(spark, [(1, ["[VS]", "a", "[VE]", "[W_1]", "[VS]", "b", "c", "d", "[VE]"], [0, 1, 2, 3, 4, 5, 30, 31, 40], 2), (2, ["[VS]", "a"], None, 1), (3, ["a", "[VE]", "x", "[VS]", "b"], None, 2), (4, [], None, 2), (5, ["[VE]", "x", "[VS]"], None, 2)])
    r = {x["subject_id"]: x for x in labels.readmission(s).collect()}
    assert sorted(r) == [1, 3, 5] and r[1]["label_readmission_1month"] == 1 and r[1]["cutoff_readmission"] == 3 and r[1]["num_visits"] == 1 and r[3]["label_readmission_1month"] == 0
    los = {x["subject_id"]: x for x in labels.length_of_stay(s, threshold=0.05, minimum=0, first_event_hours=100).collect()}
    assert sorted(los) == [1] and abs(los[1]["length_of_stay"] - 2 / 24) < 1e-9 and los[1]["cutoff_los"] == 6 and los[1]["label_los_1week"] == 1 and los[1]["los_hours"] == 36
    assert labels.length_of_stay(s).count() == 0


def test_datapoints(spark):
    d = spark.createDataFrame([(1, 0, -1, 2), (2, 1, 0, 2)], "patient_id long, label_mortality_1month int, label_readmission_1month int, cutoff_readmission int")
    p = labels.datapoints(d, ["mortality_1month", "readmission_1month"])
    assert sorted((r["patient_id"], r["task"], r["label"], r["cutoff"]) for r in p.collect()) == [(1, "mortality_1month", 0, None), (2, "mortality_1month", 1, None), (2, "readmission_1month", 0, 2)]
    b = spark.createDataFrame([(i, int(i < 2)) for i in range(10)] + [(99, -1)], "patient_id long, label int")
    kept = cohort.downsampled(b, 0.5).collect()
    assert sorted(r["label"] for r in kept) == [0, 0, 1, 1]


# Splits


def test_splits(spark):
    d = spark.range(1000).select(F.col("id").alias("subject_id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 7 == 0).cast("int").alias("z"))
    s = cohort.split(d, 0.15)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 150, "pretrain": 850} and s.select("subject_id").distinct().count() == 1000
    assert s.exceptAll(cohort.split(d.repartition(7), 0.15)).count() == 0
    st = {(r["y"], r["split"]): r["count"] for r in cohort.stratified(d, "y", 0.2).groupBy("y", "split").count().collect()}
    assert st == {(0, "test"): 150, (0, "train"): 600, (1, "test"): 50, (1, "train"): 200}
    ml = cohort.multi_label_stratified(d, ["y", "z"], 0.2).where("split = 'test'")
    assert abs(ml.where("y = 1").count() - 50) <= 2 and abs(ml.where("z = 1").count() - 28.6) <= 2
    b = cohort.balanced(d, "y", 60)
    assert b.where("y = 1").count() == 30 == b.where("y = 0").count()
    f = cohort.few_shot(d, "y", [20, 40], "stratified")
    assert {(r["key"]): r["count"] for r in f.groupBy("key").count().collect()} == {"20": 20, "40": 40}
    k = cohort.folds(d, "y", 10).groupBy("fold", "y").count().collect()
    assert len(k) == 20 and {r["count"] for r in k} == {25, 75}
    assert cohort.sample(d, 17).count() == 17 and cohort.sample(d.limit(0), 17).count() == 0
    assert 150 < cohort.train_val(d, 0.2).where("split = 'val'").count() < 250
    o = cohort.overlapping(d, ["y", "z"], 100)
    assert o.join(d, "subject_id").where("z = 1").count() >= 100 and o.count() < 400


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "n")], "k long, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "k long, v string")
    assert [r["v"] for r in cohort.members(a, b, "k").collect()] == ["x"]
    assert [r["v"] for r in cohort.others(a, b, "k").collect()] == ["n"]
    assert {(r["k"], r["v"]) for r in cohort.union_first([a, b], "k").collect()} == {(1, "x"), (2, "z"), (None, "n")}
    assert cohort.same_ids(a, a.where("k is not null").union(a.where("k is null")), "v").first()["equal"]


def test_ranks(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    n = ranks.row_index(d, ["x"], "n")
    assert n.where("n <> x").count() == 0
    assert io.packed(d, ["x"], 1024).where("pack <> floor(x / 1024) or index_in_pack <> x % 1024").count() == 0


def test_row_index_reads_one_exchange(spark):
    """More rows than the ranges' sample, and columns that only one side needs."""
    d = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("string").alias("x"), F.md5(F.col("id").cast("string").cast("binary")).alias("y"), F.create_map(F.lit("a"), F.col("id")).alias("m"))
    n = ranks.row_index(d, ["x"], "n").collect()
    assert [r["x"] for r in sorted(n, key=lambda r: r["n"])] == sorted(str(k) for k in range(200_000)) and len({r["n"] for r in n}) == 200_000


def test_row_index_whichever_columns_are_wanted(spark):
    d = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("string").alias("x"), F.md5(F.col("id").cast("string").cast("binary")).alias("y"))
    n = ranks.row_index(d, ["x"], "n")
    assert [r["x"] for r in sorted(n.select("x", "n").collect(), key=lambda r: r["n"])] == sorted(str(k) for k in range(200_000))
    assert n.select("n").distinct().count() == 200_000
    words = d.select(F.col("y").alias("token"))
    v = vocab.vocabulary(words, ["[PAD]", "[UNK]"]).select("id", "token").collect()
    assert [r["token"] for r in sorted(v, key=lambda r: r["id"])] == ["[PAD]", "[UNK]", *sorted(r["token"] for r in words.collect())]


def test_ranks_of_ties_nulls_and_names(spark):
    d = spark.createDataFrame([(k % 3, None if k % 5 == 0 else f"k{k % 7}", k) for k in range(60)], "total long, rank string, k long")
    n = ranks.row_index(d, ["rank", "total"], "n").collect()
    assert sorted(r["n"] for r in n) == list(range(60)) and [r["rank"] for r in sorted(n, key=lambda r: r["n"])][:12] == [None] * 12
    assert ranks.row_index(d.limit(0), ["rank"], "n").count() == 0
    s = cohort.split(d.withColumnRenamed("k", "subject_id"), 0.5)
    assert s.columns == ["total", "rank", "subject_id", "split"] and s.where("split = 'test'").count() == 30
    assert cohort.stratified(d.withColumnRenamed("k", "subject_id"), "total", 0.5).count() == 60
    r = ranks.ranges(spark.range(5000).select((F.col("id") * 10.0 - 7).alias("x")), "x").groupBy("_bucket").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert r["n"] > 900 and r["most"] < 20


def test_first_labels_and_ids(spark):
    d = spark.createDataFrame([(1, 5, -1), (1, 6, 1), (1, 7, 0), (2, 1, None), (None, 1, 1), (3, 2, 0), (3, 2, 0)], "subject_id long, seq long, y int")
    assert {r["subject_id"]: r["y"] for r in cohort.first_labels(d, "y", ("seq",)).collect()} == {1: 1, 3: 0}
    assert [r[0] for r in cohort.distinct_ids(d, d).collect()] == [1, 2, 3]
    assert cohort.first_labels(d.limit(0), "y", ("seq",)).count() == 0


# Vocabularies, features, metrics


def test_unknown_tokens(spark):
    s = sequence(spark, [(1, ["b", "a"], None, 1), (2, None, [1.0], 1)])
    known = spark.createDataFrame([(0, "a"), (1, "b")], "id int, token string")
    assert {r["subject_id"]: r["ids"] for r in vocab.encoded(s, known).collect()} == {1: [1, 0], 2: []}
    with pytest.raises(PySparkException):
        vocab.encoded(s, known.where("id = 0")).collect()


def test_curve_of_any_scores(spark):
    """Scores far from 0 to 1 and crowded ones, against pairs."""
    ys = [(k % 3 == 0, -50.0 + k % 11 * 1e-9) for k in range(60)] + [(k % 2 == 0, k * 3.5) for k in range(40)] + [(True, 1e12), (False, 1e12)]
    d = spark.createDataFrame([(int(y), p) for y, p in ys], "y int, p double")
    pairs = [(a > b) + (a == b) / 2 for y, a in ys if y for z, b in ys if not z]
    assert abs(metrics.auroc(d).first()["auroc"] - sum(pairs) / len(pairs)) < 1e-12
    assert metrics.auroc(d.limit(0)).first()["auroc"] is None


def test_pooled_metrics(spark):
    cells = [(1, "a", 1, 0.9), (1, "b", 0, 0.1), (2, "a", 0, 0.8), (2, "b", 1, 0.7)]
    m = metrics.micro(spark.createDataFrame(cells, "k long, t string, y int, p double"), "k", "t").first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"], m["accuracy"], m["auc"]) == (2, 1, 0, 1, 0.5, 0.75)
    f = metrics.fold_average(spark.createDataFrame([(0, 1.0, None), (1, 0.5, 0.25)], "fold int, a double, b double"), ["a", "b"]).first()
    assert (f["a"], f["b"], f["n_folds"]) == (0.75, 0.25, 2)


def test_vocab(spark):
    s = sequence(spark, [(1, ["b", "a", "[UNK]"], None, 1), (2, [], None, 1), (3, ["a", "q" * 2000, None], None, 1)])
    v = vocab.vocabulary(vocab.tokens(s).where("length(token) < 10"), ["[PAD]", "[UNK]"], ["[T]"])
    assert [(r["id"], r["token"], r["kind"]) for r in v.orderBy("id").collect()] == [(0, "[PAD]", "special"), (1, "[UNK]", "special"), (2, "a", "word"), (3, "b", "word"), (4, "[T]", "task")]
    e = vocab.encoded(s, v)
    assert {r["subject_id"]: r["ids"] for r in e.collect()} == {1: [3, 2, 1], 2: [], 3: [2, 1, 1]}
    assert {r["subject_id"]: r["tokens"] for r in vocab.decoded(e, v).collect()}[1] == ["b", "a", "[UNK]"]
    t = s.withColumn("type_tokens", F.transform("event_tokens", lambda x, i: i))
    assert {r["token"]: r["type"] for r in vocab.concept_types(t).collect()}["a"] == 1


def test_saved_tokenizer(spark, tmp_path):
    v = spark.createDataFrame([(0, "a")], "id int, token string")
    vocab.save(v, v.withColumn("type", F.lit(1)), str(tmp_path), max_len=32, unknown="[UNK]")
    a, b, settings = vocab.load(spark, str(tmp_path))
    assert a.count() == 1 and b.first()["type"] == 1 and settings == {"max_len": "32", "unknown": "[UNK]"}


def test_paths_and_batches(spark):
    r = one(spark, "a string, b string", "", "/y.jpg", p=codes.preferred_path("a", "b"), q=codes.preferred_path("b", "a"), n=codes.preferred_path("a", "a"))
    assert (r["p"], r["q"], r["n"]) == ("/y.jpg", "/y.jpg", None)
    d = spark.createDataFrame([(1, [5, 6, 7]), (1, [8]), (2, [])], "b int, x array<int>")
    got = sorted((r["b"], r["x"], r["x_mask"]) for r in sequences.padded_batches(d, "b", "x").collect())
    assert got == [(1, [5, 6, 7], [1, 1, 1]), (1, [8, 0, 0], [1, 0, 0]), (2, [], [])]
    assert cohort.others_sample(spark.range(10).withColumnRenamed("id", "subject_id"), 3, 9).where("subject_id = 3").count() == 0


def test_features(spark):
    s = sequence(spark, [(1, ["a", "a", "b"], None, 1), (2, ["b", "[PAD]"], None, 1)])
    f = features.frequencies(s, without=["[PAD]"])
    assert {(r["subject_id"], r["token"]): r["n"] for r in f.collect()} == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1}
    assert [r["token"] for r in features.top_features(f, 1).collect()] == ["b"] and features.frequent_features(f, 2).count() == 1
    v = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 0), (2, [5.0, 6.0], 0)], "k int, v array<double>, m int")
    assert {(r["k"], r["dim"]): r["value"] for r in features.masked_mean(v, "k", "v", "m").collect()} == {(1, 0): 1.0, (1, 1): 2.0, (2, 0): 0.0, (2, 1): 0.0}
    x = features.top_elements(spark.createDataFrame([(1, [[1.0, 9.0], [3.0]])], "k int, m array<array<double>>"), "k", "m", 2).collect()
    assert [(r["i"], r["j"], r["value"]) for r in x] == [(0, 1, 9.0), (1, 0, 3.0)]


def test_metrics(spark):
    ys = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.4), (0, 0.4), (0, 0.1), (0, 0.1)]
    d = spark.createDataFrame(ys, "y int, p double")
    pairs = [(a > b) + (a == b) / 2 for y, a in ys if y for z, b in ys if not z]
    assert abs(metrics.auroc(d).first()["auroc"] - sum(pairs) / len(pairs)) < 1e-12
    assert abs(metrics.average_precision(d).first()["ap"] - (1 / 3 + 2 / 3 / 3 + 3 / 5 / 3)) < 1e-12
    assert abs(metrics.auc_pr(d).first()["auc_pr"] - (1 / 3 + (2 / 3 + 1) / 2 / 3 + (3 / 5 + 2 / 3) / 2 / 3)) < 1e-12
    assert metrics.precision_at_recall(d).first()["precision"] == 0.6
    assert metrics.auroc(d.where("y = 1")).first()["auroc"] is None
    c = metrics.confusion(d).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 3)
    m = metrics.macro(d.withColumn("t", F.lit("a")).union(d.where("y = 1").withColumn("t", F.lit("b"))), "t").first()
    assert m["n_labels"] == 1
    r = one(spark, "z array<double>", [1.0, 3.0], p=metrics.positive_probability("z"), a=metrics.argmax("z"), s=metrics.softmax("z"))
    assert abs(r["p"] - 0.880797) < 1e-6 and r["a"] == 1 and abs(sum(r["s"]) - 1) < 1e-12
    assert metrics.weighted_loss(spark.createDataFrame([(1.0, 1), (4.0, 2)], "loss double, n int")).first()["loss"] == 3.0


def test_windows(spark):
    e = events(spark, [(1, T0, 0, "a"), (1, T0 + timedelta(hours=3), 1, "b"), (2, T0, 2, "c")])
    assert [r["delta"] for r in sequences.time_delta(e, "subject_id", "time", ("time", "seq")).orderBy("seq").collect()] == [0.0, 3.0, 0.0]
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.3), (1, "c", 0.2), (2, "x", 1.0)], "k int, item string, p double")
    assert {(r["k"], r["item"]) for r in sequences.nucleus(p, "k", "p", "item", 0.6).collect()} == {(1, "a"), (1, "b"), (2, "x")}


def test_back_filled(spark):
    d = spark.createDataFrame([(["LAB//a", "MEDS_BIRTH"], [0.0, 9000.0], 0, 40)], "event_tokens array<string>, elapsed_tokens array<double>, death_after_start int, death_after_end int")
    r = repair.back_filled(d, 8).first()
    assert r["type_tokens"] == [2, 0] and r["time_tokens"] == [0.0, 9000.0] and r["age_tokens"] == [1, 2] and r["label_mortality_1month"] == 0
    assert repair.back_filled(d.withColumn("type_tokens", F.lit(None))).first()["type_tokens"] is None


def test_repair_and_profile(spark):
    d = spark.createDataFrame([([[1, 2]], [8766.0, 0.0]), ([[3]], None)], "n array<array<int>>, elapsed_tokens array<double>")
    assert [r["n"] for r in repair.unnested(d).collect()] == [[1, 2], [3]]
    assert repair.with_ages(d).first()["age_tokens"] == [1, 0]
    assert repair.with_defaults(d.select("elapsed_tokens"), 2).collect()[1]["elapsed_tokens"] == [0.0, 0.0]
    n = {r["column"]: r["fraction"] for r in profile.null_fractions(d).collect()}
    assert n == {"n": 0.0, "elapsed_tokens": 0.5}
    assert [r["bin"] for r in profile.histogram(spark.createDataFrame([(-1.0,), (10.0,)], "x double"), "x", 0.0, 10.0, 5).orderBy("bin").collect()] == [1, 5]


# Sources and sinks


def test_io(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "t.csv").write_text("Subject_ID,Intime,Unnamed: 3,hadm_id\n1,2024-01-01 00:00:00,x,7\nbad,never,y,\n")
    t = io.read_table(spark, f"{p}/t.csv", schema.ICUSTAYS)
    rows = {r["subject_id"]: r for r in t.collect()}
    assert rows[1]["intime"] == T0 and rows[1]["hadm_id"] == 7 and rows[None]["intime"] is None and t.columns[2] == "stay_id"
    events(spark, [(1, T0, 0, "a"), (2, None, 1, "b")]).write.parquet(f"{p}/shards/x")
    assert io.read_events(spark, f"{p}/shards").count() == 1
    assert io.row_counts(spark, f"{p}/shards/x").agg(F.sum("n_rows")).first()[0] == 2
    made = []
    for _ in range(2):
        io.stage(spark, f"{p}/stage", lambda: made.append(1) or spark.range(3), needs=("id",))
    assert made == [1] and io.stage(spark, f"{p}/stage", lambda: spark.range(3).withColumn("y", F.lit(1)), needs=("y",)).columns == ["id", "y"]
    io.replace_table(spark, f"{p}/stage", lambda d: d.where("id > 0"))
    assert spark.read.parquet(f"{p}/stage").count() == 2
    (tmp_path / "stage").rename(tmp_path / "stage.old")  # as if lost between both moves
    io.replace_table(spark, f"{p}/stage", lambda d: d.where("id > 1"))
    assert spark.read.parquet(f"{p}/stage").count() == 1 and not (tmp_path / "stage.old").exists()
    io.write_table(spark.createDataFrame([("pretrain", 1), ("test", 2), ("test", 2)], "split string, subject_id long"), f"{p}/splits", partition_by=("split",))
    assert [tuple(r) for r in io.read_splits(spark, f"{p}/splits", "test").collect()] == [("test", None, None, 2)]
    assert io.append_new(spark.range(3), spark, f"{p}/manifest", "id").count() == 3
    new = spark.range(5)
    io.append_new(new, spark, f"{p}/manifest", "id")
    assert sorted(r[0] for r in spark.read.parquet(f"{p}/manifest").collect()) == [0, 1, 2, 3, 4]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a_vocab.json").write_text('["x", "y"]')
    (tmp_path / "v" / "b_vocab.json").write_text('[\n    "y",\n    "z"\n]')
    assert [(r["rank"], r["token"]) for r in io.read_vocab_files(spark, f"{p}/v").orderBy("rank").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text('{"a": "old", "b": "B"}')
    (tmp_path / "m" / "2.json").write_text('{"a": "new"}')
    assert {r["code"]: r["label"] for r in io.read_code_labels(spark, f"{p}/m").collect()} == {"a": "new", "b": "B"}
    io.write_json_list(spark.createDataFrame([("b",), ("a",)], "t string"), f"{p}/out.json")
    assert (tmp_path / "out.json").read_text().split() == ["[", '"a",', '"b"', "]"]
    s = io.summary(spark.range(4), small=F.col("id") < 1, large=F.col("id") >= 1).first()
    assert (s["small"], s["large"]) == (1, 3)
    with pytest.raises(ValueError):
        schema.require(spark.range(1), "id", ["a", "b"])
    with pytest.raises(ValueError):
        io.keep_available(spark.range(1), ["id", "x"], "id")


def test_ingest(spark, tmp_path):
    from evseq.streaming import ingest

    p = str(tmp_path)
    shard = lambda rows: schema.conform(events(spark, rows), schema.EVENT)
    shard([(1, T0, 0, "LAB//a"), (1, None, 1, "x")]).write.parquet(f"{p}/in", mode="append")
    for n in (1, 1, 2):
        if n == 2:
            shard([(2, T0, 0, "[VS]")]).write.parquet(f"{p}/in", mode="append")
        ingest.ingest(spark, f"{p}/in", f"{p}/out", f"{p}/ck").awaitTermination()
        assert spark.read.parquet(f"{p}/out").count() == n
    assert ingest.hourly_counts(spark.read.parquet(f"{p}/out").drop("type")).count() == 2


# The registered queries


def test_entry_without_what_the_rest_needs():
    """Where a package that only the training-text operators need is absent, the core's queries stay."""
    import subprocess
    import sys

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; assert {'q_vocab', 'q_patient_sequences'} <= set(e.queries()) and not [q for q in e.queries() if q.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, timeout=120).returncode == 0


def test_queries_and_sql_agree(spark):
    """Each query against its SQL on the smallest tables."""
    import decimal
    import os

    duckdb = pytest.importorskip("duckdb")
    from evseq.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{t}')")

    def plain(x):
        return "" if x is None else "%.6g" % x if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else str(x)

    def rows(columns, values):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(tuple(plain(r[i]) for i in order) for r in values)

    oracles = catalog.oracle_sql()
    assert set(oracles) <= set(catalog.queries())
    for name, sql in oracles.items():
        d = catalog.queries()[name](spark, sf)
        c = con.execute(sql)
        assert rows(d.columns, d.collect()) == rows([x[0] for x in c.description], c.fetchall()), name


def test_parts_grow_with_the_files(spark, monkeypatch):
    """Tables of many parts are joined, grouped, ranked and windowed in as many, with the results of their SQL."""
    import duckdb

    from evseq.plans import catalog

    sf = "/root/testdata/sf0.001"
    lineitem, orders = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    assert ranks.parts(lineitem) == 0 and ranks.parts(spark.range(5)) == 0
    monkeypatch.setattr(ranks, "PART_BYTES", sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ("lineitem", "orders")) // 8)
    assert ranks.parts(lineitem.crossJoin(orders)) == 9
    con = duckdb.connect()
    for t in ("customer", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for q in ("q_latest_study", "q_patient_enrich_age", "q_multi_key_order", "q_shard_number", "q_image_first_hours", "q_event_stay_match"):
        got = catalog.queries()[q](spark, sf)
        assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and ", 9)" in got._jdf.queryExecution().executedPlan().toString()
        want = con.execute(catalog.oracle_sql()[q])
        at = [d[0] for d in want.description]
        assert sorted(map(str, (tuple(r[c] for c in at) for r in got.collect()))) == sorted(map(str, want.fetchall())), q


def test_iterative_stratification(spark):
    import random

    rng = random.Random(5)
    for _ in range(200):
        combos = sorted({",".join(rng.choice(["0", "0", "1", "-1"]) for _ in range(4)) for _ in range(rng.randint(0, 12))})
        sizes, test = [rng.choice([1, 2, 3, 10, 37]) for _ in combos], rng.choice([0.1, 0.2, 0.25, 0.5])
        got, of = cohort.allotted(combos, sizes, test), lambda k: [i for i, c in enumerate(combos) if c.split(",")[k] == "1"]
        assert all(0 <= g <= n for g, n in zip(got, sizes, strict=True))
        rare = min((k for k in range(4) if of(k)), key=lambda k: sum(sizes[i] for i in of(k)), default=None)
        if rare is not None:  # dealt first: met to half a row, each of its combinations to one
            assert abs(sum(got[i] for i in of(rare)) - test * sum(sizes[i] for i in of(rare))) <= 0.5 and all(abs(got[i] - test * sizes[i]) <= 1 for i in of(rare))
        assert all(abs(sum(got[i] for i in of(k)) - test * sum(sizes[i] for i in of(k))) <= 3 for k in range(4)) and abs(sum(got) - test * sum(sizes)) <= 3
    assert cohort.allotted(["0,1", "1,0", "1,1"], [10, 10, 10], 0.5) == [5, 5, 5] and cohort.allotted(["0", "1"], [3, 1], 0.5) == [1, 1]
    # A label with 10 positives spread over other labels keeps its share, and so does what goes with it.
    d = spark.range(5000).select(F.col("id").alias("subject_id"), (F.col("id") % 2).alias("a"), (F.col("id") % 3 == 0).cast("int").alias("b"), (F.col("id") % 500 == 7).cast("int").alias("rare"), F.when(F.col("id") % 9 > 0, F.col("id") % 4).alias("nulls"))
    for test in (0.2, 0.1, 500):
        s = cohort.multi_label_stratified(d, ["a", "b", "rare", "nulls"], test)
        share = test if isinstance(test, float) else test / 5000
        got = s.where("split = 'test'").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 1).alias(c) for c in ("a", "b", "rare", "nulls")]).first()
        assert abs(got["rare"] - 10 * share) <= 1 and abs(got["n"] - 5000 * share) <= 4
        assert all(abs(got[c] - d.where(F.col(c) == 1).count() * share) <= 3 for c in ("a", "b", "nulls"))
    assert cohort.multi_label_stratified(d.limit(0), ["a", "b"], 0.2).count() == 0
    few = cohort.few_shot(d, ["a", "b", "rare"], [100, 1000], "multi_label").join(d, "subject_id").groupBy("key").agg(F.count("*").alias("n"), F.sum("rare").alias("rare")).collect()
    assert {r["key"]: (abs(r["n"] - int(r["key"])) <= 3, r["rare"]) for r in few} == {"100": (True, 0), "1000": (True, 2)}


def test_overlapping_against_turns(spark):
    import hashlib

    n = 600
    labels = {f"l{k}": 5 + 3 * k for k in range(20)}
    rows = [(i, *[None if (i * 7 + k) % 13 == 0 else (i // (k + 1)) % 3 % 2 for k in range(20)]) for i in range(n)] + [(None, *[1] * 20)]
    d = spark.createDataFrame(rows, "subject_id long, " + ", ".join(f"{c} int" for c in labels))
    chosen = set()
    for k, (c, most) in enumerate(labels.items()):
        for y in (0, 1):
            of = sorted((i for i, *v in rows if i is not None and v[k] == y), key=lambda i: hashlib.md5(f"23:{c}:{i}".encode()).hexdigest())
            used = [i for i in of if i in chosen]
            chosen |= {i for i in of if i not in chosen and len(used) < most and [j for j in of if j not in used].index(i) < most - len(used)}
    out = cohort.overlapping(d, labels)
    assert {r["subject_id"] for r in out.collect()} == chosen and out.count() == len(chosen)
    assert cohort.overlapping(d.limit(0), labels).count() == 0
    # The input is read twice, however many labels there are.
    plan = lambda k: cohort.overlapping(d, dict(list(labels.items())[:k]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(20).count("LogicalRDD") == plan(2).count("LogicalRDD") == 2


def test_sequences_bounded_and_against_brute_force(spark):
    """Ages known late or never, null times, ties, more events than are kept, and one subject with most of the events."""
    import random

    rng = random.Random(9)
    rows = [(s, None if rng.random() < 0.1 else dt(2020, 1, 1) + timedelta(hours=rng.randint(0, 50)), k, rng.choice(["[VS]", "LAB//1", "MEDS_DEATH", "DIAGNOSIS//A41"] if s != 3 else ["LAB//2"]), rng.choice([None, None, 40 + s])) for s in (1, 2, 3) for k in range(400 if s == 1 else 30)]
    rows += [(4, None, 0, "LAB//9", None)]
    d = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, seq long, code string, age int")
    for null_time in ("skip", "propagate"):
        got = {r["subject_id"]: r for r in sequences.patient_sequences(d, 25, null_time=null_time).collect()}
        assert set(got) == {1, 2, 3, 4}
        for s, r in got.items():
            e = sorted((x for x in rows if x[0] == s), key=lambda x: (x[1] is not None, x[1] or dt.min, x[2]))
            known = [x[1] for x in e if x[1]]
            start = (known[0] if known else None) if null_time == "skip" else e[0][1]
            ages = [x[4] for x in e]
            want = [next((a for a in reversed(ages[: i + 1]) if a is not None), next((a for a in ages if a is not None), schema.DEFAULT_AGE)) for i in range(min(25, len(e)))]
            assert r["age_tokens"] == want and r["num_visits"] == max(1, sum(x[3] == "[VS]" for x in e)) and len(r["event_tokens"]) == min(25, len(e))
            assert r["elapsed_tokens"] == [None if start is None or x[1] is None else (x[1] - start).total_seconds() / 3600 for x in e[:25]]
            assert r["visit_tokens"] == [sum(y[3] == "[VS]" for y in e[: i + 1]) for i in range(min(25, len(e)))]
            assert r["died"] == any(x[3] == "MEDS_DEATH" for x in e)
    plan = sequences.patient_sequences(d, 2048)._jdf.queryExecution().executedPlan().toString()
    limit, exchange = plan.rindex("WindowGroupLimit"), plan.rindex("Exchange hashpartitioning")
    assert "Partial" in plan[limit : limit + 400] and any("WindowGroupLimit" in x and "Partial" in x for x in plan[plan.index("Exchange hashpartitioning") :].splitlines()), (limit, exchange)


def test_stay_sequences_tail(spark):
    import random

    rng = random.Random(2)
    t0 = dt(2021, 5, 1)
    rows = [(s, 1, 7, t0, None, 0, 1, t0 + timedelta(hours=k), f"LAB//{k:02d}", rng.choice([None, None, 50 + k])) for s in (1, 2) for k in range(20)]
    d = spark.createDataFrame(rows, "stay_id long, subject_id long, stay_hadm_id long, intime timestamp_ntz, outtime timestamp_ntz, in_hosp_mortality int, mortality_28d int, time timestamp_ntz, code string, age int")
    for r in sequences.stay_sequences(d, 5, "tail").collect():
        ages = [x[-1] for x in rows if x[0] == r["stay_id"]]
        assert r["elapsed_tokens"] == [15.0, 16.0, 17.0, 18.0, 19.0] and r["position_tokens"] == [0, 1, 2, 3, 4]
        assert r["age_tokens"] == [next((a for a in reversed(ages[: i + 1]) if a is not None), next((a for a in ages if a is not None), schema.DEFAULT_AGE)) for i in range(15, 20)]


def test_decoded_and_encoded_keep_every_key(spark):
    v = spark.createDataFrame([(0, "[PAD]"), (1, "[UNK]"), (2, "a")], "id int, token string")
    ids = spark.createDataFrame([(1, [2, 1, 9, None]), (2, []), (3, None)], "subject_id long, ids array<int>")
    assert {r[0]: r[1] for r in vocab.decoded(ids, v).collect()} == {1: ["a", "[UNK]", None, None], 2: [], 3: []}
    seqs = spark.createDataFrame([(1, ["a", "b", None]), (2, []), (3, None)], "subject_id long, event_tokens array<string>")
    assert {r[0]: r[1] for r in vocab.encoded(seqs, v).collect()} == {1: [2, 1, 1], 2: [], 3: []}


def test_packs(spark, tmp_path):
    import numpy as np

    from evseq.sources import packs

    path = str(tmp_path / "packs")
    rows = [(i, None if i == 5 else bytes([i % 256]) * (i % 7)) for i in range(1000, 0, -3)] + [(None, b"x")]
    d = spark.createDataFrame(rows, "k long, r binary")
    packs.write(d, path, "k", "r", 50)
    want = {(i // 50, i % 50): (k, r or b"") for i, (k, r) in enumerate(sorted(x for x in rows if x[0] is not None))}
    back = packs.read(spark, path)
    assert {(r["pack"], r["index"]): (r["key"], bytes(r["record"])) for r in back.collect()} == want
    part = back.where("pack = 2 and index in (1, 3)")
    assert {(r["pack"], r["index"]) for r in part.collect()} == {(2, 1), (2, 3)}
    # The filter reaches the reader: a damaged pack that isn't asked for isn't opened, and one record is read without the rest.
    (tmp_path / "packs" / packs.name(0)).write_bytes(b"damaged")
    assert part.count() == 2
    files, at = packs.opened(path)
    whole = (tmp_path / "packs" / packs.name(3)).read_bytes()
    (tmp_path / "packs" / packs.name(3)).write_bytes(whole[: 12 + 20 * 50 + len(want[3, 0][1])])
    key, i, record = next(packs.read_pack(files, f"{at}/{packs.name(3)}", [0]))
    assert (key, record) == want[3, 0]
    ask = spark.createDataFrame([(2, 1, "a"), (2, 99, "b"), (77, 0, "c"), (None, 0, "d"), (4, 0, "e"), (4, 0, "f")], "pack long, index int, tag string")
    got = {r["tag"]: r["record"] and bytes(r["record"]) for r in packs.fetched(ask, path).collect()}
    assert got == {"a": want[2, 1][1], "b": None, "c": None, "d": None, "e": want[4, 0][1], "f": want[4, 0][1]}
    # A job that is broken off leaves no pack by its name; taken up again, only what is missing is written.
    for n in (0, 3):
        (tmp_path / "packs" / packs.name(n)).unlink()
    stood = (tmp_path / "packs" / packs.name(2)).stat().st_mtime_ns
    packs.write(d, path, "k", "r", 50, resume=True)
    assert {(r["pack"], r["index"]): (r["key"], bytes(r["record"])) for r in packs.read(spark, path).collect()} == want
    assert (tmp_path / "packs" / packs.name(2)).stat().st_mtime_ns == stood and not list((tmp_path / "packs").glob("_writing*"))
    packs.write(d.limit(0), path, "k", "r", 50)
    assert packs.present(path) == []
    v = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, [])], "k long, v array<float>")
    assert {r["k"]: r["vector"] for r in packs.to_floats(packs.from_floats(v, "v")).collect()} == {1: [1.5, -2.0], 2: None, 3: []}
    assert np.frombuffer(packs.from_floats(v, "v").where("k = 1").first()["record"], "<f4").tolist() == [1.5, -2.0]


def test_interval_joins_against_residual(spark):
    """Open, very long, backward and null stays, bounds, null admissions; bins cost the sum of both sides."""
    import random

    rng = random.Random(13)
    t0 = dt(2019, 12, 30)
    stays_ = [(rng.choice([1, 2, None]), k, rng.choice([None, 7, 8]), a, None if k % 11 == 0 else a + timedelta(hours=rng.choice([-300, 0, 5, 400, 30000]))) for k in range(60) for a in [t0 + timedelta(hours=rng.randint(0, 3000))]]
    stays_ += [(1, 900, 7, None, t0), (1, 901, 7, t0, t0 + timedelta(hours=168))]
    events_ = [(rng.choice([1, 2, None]), k, rng.choice([None, 7, 8]), None if k % 17 == 0 else t0 + timedelta(hours=rng.randint(-400, 3500))) for k in range(300)]
    events_ += [(1, 901, 7, t0 - timedelta(hours=168)), (1, 902, 7, t0 + timedelta(hours=168))]
    s = spark.createDataFrame(stays_, "subject_id long, stay_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz")
    e = spark.createDataFrame(events_, "subject_id long, id long, hadm_id long, time timestamp_ntz")
    ok = lambda a, b: a[0] is not None and a[0] == b[0] and a[3] and b[3] and a[3] >= b[3] - timedelta(hours=168) and (b[4] is None or a[3] <= b[4]) and (a[2] is None or b[2] is None or a[2] == b[2])
    got = sorted((r["id"], r["stay_id"]) for r in align.events_in_stays(e, s).collect())
    assert got == sorted((a[1], b[1]) for a in events_ for b in stays_ if ok(a, b)) and (901, 901) in got and (902, 901) in got
    n = 10_000
    hot = spark.range(n).select(F.lit(1).alias("subject_id"), F.col("id").alias("stay_id"), F.lit(None).cast("long").alias("hadm_id"), (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id") * 100)).alias("intime"))
    hot = hot.withColumn("outtime", F.col("intime") + F.expr("interval 24 hours"))
    points = spark.range(n).select(F.lit(1).alias("subject_id"), F.col("id"), F.lit(None).cast("long").alias("hadm_id"), (F.lit(t0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id") * 100 + 50)).alias("time"))
    binned, whole = align.spread(hot.withColumn("_low", F.col("intime") - F.expr("interval 168 hours")), "_low", "outtime")
    pairs = points.join(binned, align.time_bin("time") == F.col("_bin")).count()
    assert whole.count() == 0 and pairs < 6 * n  # 100 million by the subject alone
    assert align.events_in_stays(points, hot).count() == sum(1 for k in range(n) for j in (k - 1, k, k + 1, k + 2) if 0 <= j < n and -168 <= (100 * k + 50) - 100 * j <= 24)


def test_curve_reads_its_input_once(spark):
    d = spark.range(200).select((F.col("id") % 3).alias("task"), (F.col("id") % 2).alias("y"), (F.col("id") % 17 / 17.0).alias("p"))
    d = d.unionByName(spark.createDataFrame([(None, 1, 0.5), (None, 0, 0.25), (9, 1, None), (0, None, 0.1)], "task long, y long, p double"))
    rows = [tuple(r) for r in d.collect()]
    got = {r["task"]: r for r in metrics.curve_metrics(d, by=("task",)).collect()}
    for t in {r[0] for r in rows}:
        e = [(y, -1.0 if p is None else p) for k, y, p in rows if k == t and y in (0, 1)]
        pos, neg = [p for y, p in e if y == 1], [p for y, p in e if y == 0]
        want = None if not pos or not neg else sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
        assert got[t]["auroc"] == (None if want is None else pytest.approx(want))
        at = sorted(set(p for _, p in e), reverse=True)
        tp, n = [sum(p >= a for p in pos) for a in at], [sum(p >= a for _, p in e) for a in at]
        assert got[t]["ap"] == (pytest.approx(sum((x - w) / len(pos) * x / m for x, w, m in zip(tp, [0, *tp], n))) if pos else None)
        assert got[t]["precision"] == (pytest.approx(max(x / m for x, m in zip(tp, n) if x >= 0.8 * len(pos))) if pos else None)
    m = metrics.macro(d, "task")
    m.collect()
    plan = m._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert final.count("Range (0, 200") == 1, final
    assert metrics.auroc(d.limit(0)).first()["auroc"] is None and metrics.macro(d.limit(0), "task").first()["n_labels"] == 0


def test_sparse_rows_round_trip(spark):
    rows = [(1, ["b", "a", "b", "new"]), (2, []), (3, ["c", None, "a"]), (4, None)]
    seqs = spark.createDataFrame(rows, "subject_id long, event_tokens array<string>").withColumns({"visits": F.when(F.col("subject_id") < 3, F.col("subject_id") * 10), "zero": F.lit(0)})
    freq = features.frequencies(seqs)
    index = features.feature_index(spark.createDataFrame([("c",), ("a",), ("b",), ("b",), (None,)], "token string"))
    got = {r["subject_id"]: (r["size"], r["indices"], r["values"]) for r in features.sparse_rows(freq, index, seqs, dense=("visits", "zero")).collect()}
    assert got == {1: (5, [0, 1, 3], [1.0, 2.0, 10.0]), 2: (5, [3], [20.0]), 3: (5, [0, 2], [1.0, 1.0]), 4: (5, [], [])}
    back = features.long_rows(features.sparse_rows(freq, index, seqs)).join(index, "id").select("subject_id", "token", F.col("value").cast("long"))
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], r[2]) for r in freq.where("token <> 'new'").collect())
    assert features.sparse_rows(freq, index.limit(0), seqs, dense=("visits",)).where("size <> 1").count() == 0 and features.sparse_rows(freq, index, seqs.limit(0)).count() == 0


def test_fused_batches(spark):
    s = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "stay_id long, batch string")
    c = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, None]]), (1, [[9.0, 9.0]]), (9, [[1.0, 1.0]])], "stay_id long, coefficients array<array<double>>")
    i = spark.createDataFrame([(2, k, [float(k)] * 3) for k in range(5)] + [(None, 0, [1.0] * 3)], "stay_id long, image_rank_in_stay int, image array<double>")
    got = {r["stay_id"]: r for r in align.fused_batches(s, c, i, "batch", 2, 3, 4).collect()}
    assert len(got) == 4 and got[1]["coefficients"] == [[1.0, 2.0], [3.0, 0.0]] and got[2]["coefficients"] == [[0.0, 0.0]] * 2 and got[3]["coefficients"] == [[0.0, 0.0]]
    assert got[2]["images"] == [[float(k)] * 3 for k in range(4)] and got[1]["images"] == [[0.0] * 3] * 4 and got[3]["images"] == got[None]["images"] == [[0.0] * 3]
    assert [(got[k]["has_coefficients"], got[k]["has_images"], got[k]["n_images"]) for k in (1, 2, 3, None)] == [(1, 0, 0), (0, 1, 4), (0, 0, 0), (0, 0, 0)]


def test_key_values_last_wins(spark):
    d = spark.createDataFrame([("a=1, b = 2,a=3, c=x, ",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(codes.key_values("t")).collect()] == [{"b": 2.0, "a": 3.0, "c": None}, None, {}]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("a",)], "t string").select(codes.key_values("t")).collect()


def test_sequences_grown_over_any_batching(spark, tmp_path):
    """Shards one at a time in two orders, with a run in between and without, against all at once by the batch operator."""
    import random

    from evseq.streaming import sequences as grown

    rng = random.Random(21)
    rows = [(rng.choice([1, 2, 3]), None if rng.random() < 0.1 else dt(2020, 1, 1) + timedelta(seconds=rng.randint(0, 90000)), k, rng.choice(["[VS]", "LAB//1", "MEDS_DEATH"] if k % 5 else ["DIAGNOSIS//A41"]), rng.choice([None, 50 + k]), rng.choice([None, -1, k])) for k in range(120)] + [(None, dt(2020, 1, 1), 0, "LAB//1", 1, 1), (3, dt(2020, 1, 1), 500, None, 1, 1)]
    ddl = "subject_id long, time timestamp_ntz, seq long, code string, age int, outcome int"
    d = spark.createDataFrame(rows, ddl)
    clean = d.dropna(subset=["subject_id", "code"])
    want = {r["subject_id"]: r for r in sequences.patient_sequences(clean, 12).collect()}
    labels_ = {r["subject_id"]: r["outcome"] for r in cohort.first_labels(clean, "outcome", ("time", "seq")).collect()}
    for name, batching in (("a", [[0, 1, 2, 3]]), ("b", [[3, 1], [0], [2]])):
        p = tmp_path / name
        for shards in batching:
            for k in shards:
                d.where(F.pmod("seq", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(p / "in"))
            events = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(p / "in"))
            grown.grow(spark, events, str(p / "out"), str(p / "ck"), max_len=12, label="outcome")
        got = {r["subject_id"]: r for r in grown.current(spark, str(p / "out")).collect()}
        assert set(got) == set(want)
        for s, r in got.items():
            for c in ("event_tokens", "type_tokens", "age_tokens", "elapsed_tokens", "visit_tokens", "position_tokens", "num_visits", "died", "septic"):
                assert r[c] == want[s][c], (name, s, c)
            assert r["label"] == labels_.get(s) and r["n_events"] == clean.where(F.col("subject_id") == s).count()


def test_shards_of_grown_sequences_are_written_by_as_many_tasks_as_read_them(spark, tmp_path, monkeypatch):
    """No shard is one task's: each is one batch of several files, taken when it is there."""
    from pyspark.sql import Row

    from evseq.plans import basics, catalog
    from evseq.streaming import sequences as grown

    rows = [(k, dt(2024, 1, 1) + timedelta(minutes=k * 37 % 991), k % 7, ["signup", "click", "view", "purchase", "other"][k % 5], 30.0, f'{{"k": {k % 23}}}') for k in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    grow, seen = grown.grow, []

    def counted(s, events, out, checkpoint, **how):
        folder = str(out).removeprefix("file:").removesuffix("/out") + "/in"
        seen.append(sum(f.endswith(".parquet") for f in os.listdir(folder)))
        grow(s, events, out, checkpoint, **how)

    monkeypatch.setattr(grown, "grow", counted)
    with monkeypatch.context() as m:
        m.setattr(basics.proxies, "table", lambda s, d, n: spark.read.parquet(f"{d}/{n}.parquet").repartition(4, "event_id"))
        got = {r["subject_id"]: r for r in basics.q_sequences_grown(spark, str(tmp_path)).collect()}
        want = {r["subject_id"]: r for r in catalog.q_patient_sequences(spark, str(tmp_path)).collect()}
    assert len(seen) == 3 and seen[0] > 1 and seen[1] > seen[0] + 1 and seen[2] > seen[1] + 1
    assert set(got) == set(want) == set(range(7)) and all(got[s][c] == want[s][c] for s in got for c in ("tokens", "types", "visits", "elapsed", "num_visits"))

    class State:  # of one subject
        def __init__(self):
            self.value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state = State()
    first = grown.FirstEvents(5, "[VS]")
    first.init(type("Handle", (), {"getValueState": lambda self, name, ddl: state})())
    at = [(k * 7919) % 10007 for k in range(10007)]  # more than a chunk
    for part in (at[:9000], at[9000:]):
        events = (Row(subject_id=1, micros=m, seq=-m, code="[VS]" if m % 2 else "LAB", age=40 + m if m > 2 else grown.NONE, label=grown.NONE, died=False, septic=m == 9999) for m in part)
        (out,) = first.handleInputRows((1,), events, None)
    assert (out.n_events, out.num_visits, out.start, out.died, out.septic, out.label) == (10007, 5003, 0, False, True, None)
    assert (out.micros, out.seq, out.age, out.visit) == ([0, 1, 2, 3, 4], [0, -1, -2, -3, -4], [43, 43, 43, 43, 44], [0, 1, 1, 2, 2])


def test_facts_and_kept_events_of_stays_are_matched_by_the_same_exchanges(spark):
    """Lines, events and stays are each dealt out once for a join, not once for each reading and each way to join."""
    lines = spark.createDataFrame([(k, 7 * k % 5, dt(2020, 1, 1) + timedelta(hours=9 * k), f"LAB//{k % 3}") for k in range(60)] + [(60, 1, None, "LAB//9")], "k long, h long, time timestamp_ntz, code string")
    keys = spark.createDataFrame([(k, k % 4) for k in range(60)], "j long, subject_id long")
    e = lines.join(keys, F.col("k") == F.col("j")).select("subject_id", F.when(F.col("h") > 1, F.col("h")).alias("hadm_id"), "time", "code")
    s = spark.createDataFrame([(k % 4, k, k % 5 if k % 3 else None, dt(2020, 1, 2) + timedelta(hours=31 * k), dt(2020, 1, 9) + timedelta(hours=31 * k) if k % 2 else None, k % 2, int(k > 6)) for k in range(12)], "subject_id long, stay_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz, in_hosp_mortality int, mortality_28d int")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        d = sequences.stay_sequences(align.events_in_stays(e, s, 24)).select("stay_id", "subject_id", "intime", "event_tokens", "elapsed_tokens", "label_in_hosp_mortality", "label_mortality_28d", "label_sepsis")
        plan = d._jdf.queryExecution().executedPlan().toString()
        made = lambda what: sum(f"- Exchange hashpartitioning({what}#" in x for x in plan.splitlines())
        assert (made("k"), made("j"), made("subject_id"), made("_subject")) == (1, 1, 2, 2), plan
        got = {r["stay_id"]: r for r in d.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    ev, want = e.collect(), {}
    for t in s.collect():
        m = sorted((x["time"], x["code"]) for x in ev if x["time"] and x["subject_id"] == t["subject_id"] and t["intime"] - timedelta(hours=24) <= x["time"] and (t["outtime"] is None or x["time"] <= t["outtime"]) and (None in (x["hadm_id"], t["hadm_id"]) or x["hadm_id"] == t["hadm_id"]))
        if m:
            want[t["stay_id"]] = (t["subject_id"], t["intime"], [c.replace("/", "") for _, c in m], [(x - t["intime"]).total_seconds() / 3600 for x, _ in m], t["in_hosp_mortality"], t["mortality_28d"], 0)
    assert len(want) > 6 and {k: tuple(r)[1:] for k, r in got.items()} == want


def test_stays_of_large_tables_are_cut_in_tasks_and_dealt_out_by_the_stay(spark, tmp_path, monkeypatch):
    """Few copies of a stay travel, bins of events don't, and the parts of the last step don't depend on Spark's number of them."""
    base = dt(2020, 1, 1)
    spark.range(4000).select(
        (F.col("id") % 7).alias("subject_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 90).alias("hadm_id"), F.when(F.col("id") % 501 > 0, F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 37 % 9000).cast("int"))).alias("time"),
        F.when(F.col("id") % 97 == 0, "MEDS_BIRTH").otherwise(F.concat(F.lit("LAB//"), F.col("id").cast("string"))).alias("code"),
    ).repartition(3).write.parquet(f"{tmp_path}/e")
    at = F.lit(base).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 31 % 380).cast("int"))
    spark.range(90).select((F.col("id") % 7).alias("subject_id"), F.col("id").alias("stay_id"), F.col("id").alias("hadm_id"), at.alias("intime"), F.when(F.col("id") % 3 > 0, at + F.expr("interval 30 days")).alias("outtime"), F.lit(1).alias("in_hosp_mortality"), F.lit(0).alias("mortality_28d")).write.parquet(f"{tmp_path}/s")
    e, s = spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/s")
    binned, whole = align.spread(s, "intime", "outtime")
    assert whole.count() == 30 and binned.count() <= 3.5 * 60
    want = {k: sorted(map(str, sequences.stay_sequences(align.events_in_stays(e, s), 20, k).collect())) for k in ("head", "tail")}
    assert len(want["head"]) > 80 and want["head"] != want["tail"] and ranks.parts(e, s) == 0
    files = sum(f.stat().st_size for t in "es" for f in (tmp_path / t).glob("*.parquet"))
    monkeypatch.setattr(ranks, "PART_BYTES", -(-files // 9))
    n = ranks.parts(e, s)
    assert n > 4
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        for k in want:
            d = sequences.sequences_in_stays(e, s, 20, k)
            assert sorted(map(str, d.collect())) == want[k]
        plan = sequences.sequences_in_stays(e, s, 20).select("stay_id", "age_tokens")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    made = [x for x in plan if "- Exchange hashpartitioning(" in x]
    assert sum("(subject_id#" in x for x in made) == sum("(_subject#" in x for x in made) == 2, made  # facts and kept events share them
    assert not any("(subject_id#" in x and "_at#" in x for x in made)
    (last,) = [i for i, x in enumerate(plan) if "- Exchange hashpartitioning(stay_id#" in x and any("WindowGroupLimit" in y for y in plan[i : i + 12])]
    assert f", {n}), REPARTITION_BY_NUM" in plan[last] and sum("WindowGroupLimit" in x for x in plan[last:]) == 2
    # Nothing is dealt out anew between a join and the cut of what it gave.
    assert sum("- Exchange hashpartitioning(stay_id#" in x for x in made) == 3 and len(made) == 7, made


def test_frequencies_send_a_row_once_and_not_its_tokens(spark):
    """Tokens are counted before rows travel; rows of a key, null keys, empty and null arrays and null tokens as ever."""
    from collections import Counter

    rows = [(1, ["b", "a", "b", None, ""]), (1, ["a"]), (2, []), (3, None), (None, ["a", "a"]), (None, ["c"]), (4, [None]), (5, [f"t{k * k % 17}" for k in range(60)])]
    d = spark.createDataFrame(rows, "subject_id long, event_tokens array<string>")
    for without in ((), ("a", "[PAD]")):
        f = features.frequencies(d, without=without)
        want = Counter((k, t) for k, a in rows for t in a or [] if t is not None and t not in without)
        got = f.collect()
        assert len(got) == len(want) and {(r["subject_id"], r["token"]): r["n"] for r in got} == want
    plan = f._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and 0 <= plan.find("Generate") < plan.find("Exchange"), plan  # the plan is read from below


def test_versions(spark, tmp_path, monkeypatch):
    from evseq.sources import versions

    path = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    rows_ = lambda n=None: sorted(map(tuple, versions.read(spark, path, n).collect()))
    with pytest.raises(ValueError):
        versions.read(spark, path)
    assert versions.append_new(table((1, "a"), (1, "a"), (None, "n")), path, "k") == 1 and rows_() == [(1, "a")]
    assert versions.append_new(table((1, "other"), (2, "b")), path, "k") == 2 and rows_() == [(1, "a"), (2, "b")]
    assert versions.append_new(table((1, "x")), path, "k") == 2 == versions.append_new(table((2, "y")), path, "k")
    wider = spark.createDataFrame([(3, "c", 1.5)], "k long, v string, more double")
    assert versions.append_new(wider, path, "k") == 3 and rows_() == [(1, "a", None), (2, "b", None), (3, "c", 1.5)]
    assert versions.replace(spark, path, lambda d: d.where("k > 1").drop("more")) == 4 and rows_() == [(2, "b"), (3, "c")] and rows_(2) == [(1, "a"), (2, "b")]
    # Killed at each step: before its data are whole, before the commit, and inside it; the last version stays, and the next writer goes on.
    class Killed(BaseException):
        pass

    def dies(*a, **b):
        raise Killed

    for name in ("_written", "commit", "_ddl"):
        with monkeypatch.context() as m, pytest.raises(Killed):
            m.setattr(versions, name, dies)
            versions.replace(spark, path, lambda d: d.limit(0))
        assert rows_() == [(2, "b"), (3, "c")]
    # Another writer is first: it wins, and the second starts anew from what it left.
    commit, done = versions.commit, []

    def beaten(*a):
        if not done:
            done.append(1)
            versions.append_new(table((8, "h")), path, "k")
        commit(*a)

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", beaten)
        assert versions.append_new(table((8, "mine"), (9, "i")), path, "k") == 6
    assert rows_() == [(2, "b"), (3, "c"), (8, "h"), (9, "i")]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, 6, [], "k long")
    assert versions.replace(spark, path, lambda d: d.limit(0)) == 7 and rows_() == []
    assert versions.clean(spark, path, keep=2) >= 4 and versions.versions(spark, path) == [6, 7] and len(rows_(6)) == 4


def test_entry_warns_of_what_is_left_out_and_hides_no_other_error(tmp_path):
    """Without the subpackage, with its empty folder, and with a name in it that isn't there."""
    import shutil
    import subprocess

    root = tmp_path / "r"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.parquet"))
    run = lambda: subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True)
    out = run()
    assert out.returncode == 0 and int(out.stdout) > 100 and "without" in out.stderr
    (root / "evseq" / "llm").mkdir()
    assert run().returncode == 0
    (root / "evseq" / "llm" / "__init__.py").write_text("")
    (root / "evseq" / "llm" / "queries.py").write_text("from evseq.schema import no_such_name")
    assert run().returncode != 0
