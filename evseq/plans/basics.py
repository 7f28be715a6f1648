"""Registered queries of readers, writers, projections, array functions, samples and metrics that the catalogue's others don't reach."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions import arrays, codes, timecols
from evseq.operators import align, cohort, features, metrics, ranks, repair, sequences, vocab
from evseq.plans import proxies
from evseq.plans.catalog import _IDS, dealt_sql, ids, lists, long, master, points, query, scored, seqs, text, with_status, words
from evseq.plans.catalog import _LOS, _MULTI, _POINTS, _READ
from evseq.plans.proxies import sql
from evseq.sources import io, packs, versions
from evseq.streaming import sequences as grown


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for queries that write and read again, written anew each time: below the checkpoint folder that the cluster names, which driver
    and executors share; in local mode, where none is named, in the warehouse; elsewhere that is an error. It is deleted when the process
    ends, as results read it until then."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/scratch/{context.applicationId}"
    if top not in _tops:
        _tops[top] = spark
    return f"{top}/{name}"


_tops: dict[str, SparkSession] = {}


@atexit.register
def forget_scratch() -> None:
    """Deletes what this process's queries wrote."""
    for top, spark in _tops.items():
        if spark.sparkContext._jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _tops.clear()


# Readers and writers


@query(sql("SELECT subject_id, time, seq, code FROM v_stream WHERE subject_id IS NOT NULL AND code IS NOT NULL", "v_stream"))
def q_read_shards(spark, sf_dir):
    """Written as shards in folders of folders, read with the event schema."""
    path = scratch(spark, "q_read_shards")
    e = proxies.stream(spark, sf_dir).withColumns({"a": F.col("subject_id") % 2, "b": F.col("subject_id") % 3})
    io.write_table(e, path, partition_by=("a", "b"))
    return io.read_events(spark, path).select("subject_id", "time", "seq", "code")


@query("SELECT count(*) AS n_rows, CAST(1 AS BIGINT) AS has_rows FROM orders")
def q_row_counts(spark, sf_dir):
    return io.row_counts(spark, f"{sf_dir}/orders.parquet").agg(F.sum("n_rows").alias("n_rows"), F.min((F.col("n_rows") > 0).cast("long")).alias("has_rows"))


@query(sql("SELECT subject_id, hadm_id, stay_id, intime, outtime FROM v_stay", "v_stay"))
def q_csv_stays(spark, sf_dir):
    """Gzip CSV with upper-case headers and a column more; its header is lowered and its columns cast to the schema."""
    path = scratch(spark, "stays.csv.gz")
    s = proxies.stays(spark, sf_dir)
    io.write_table(s.select(*[F.col(c).alias(c.upper()) for c in s.columns], F.lit("x").alias("Unnamed: 5")), path)
    return io.read_table(spark, path, schema.ICUSTAYS)


@query(sql("SELECT subject_id, hadm_id, study_id, t AS StudyDateTime, CASE WHEN study_id % 5 <> 0 THEN 'p/' || study_id || '.jpg' END AS jpg_path, ok AS jpg_path_exists FROM v_study", "v_study"))
def q_csv_studies(spark, sf_dir):
    """Metadata of images as CSV: an unnamed column, words for true and false."""
    path = scratch(spark, "studies.csv")
    s = proxies.studies(spark, sf_dir)
    word = F.when(F.col("jpg_path_exists"), F.element_at(F.array(F.lit(" True"), F.lit("T"), F.lit("yes"), F.lit("1")), (F.col("study_id") % 4 + 1).cast("int"))).otherwise("no")
    jpg = F.when(F.col("study_id") % 5 != 0, F.concat(F.lit("p/"), F.col("study_id").cast("string"), F.lit(".jpg")))
    io.write_table(s.select(F.lit(0).alias("Unnamed: 0"), "subject_id", "hadm_id", "study_id", "StudyDateTime", jpg.alias("jpg_path"), word.alias("jpg_path_exists")), path)
    return io.read_studies(spark, path).select("subject_id", "hadm_id", "study_id", "StudyDateTime", "jpg_path", "jpg_path_exists")


@query(sql("SELECT row_number() OVER (ORDER BY f, token) - 1 AS rank, token FROM (SELECT token, min(f) AS f FROM (SELECT DISTINCT c_mktsegment AS token, 'a' AS f FROM customer UNION ALL SELECT DISTINCT o_orderpriority, 'b' FROM orders UNION ALL SELECT DISTINCT c_mktsegment, 'b' FROM customer) GROUP BY token)"))
def q_vocab_files(spark, sf_dir):
    """JSON lists, sorted; a token in two files is the first's."""
    path, segments = scratch(spark, "vocabs"), proxies.table(spark, sf_dir, "customer").select("c_mktsegment")
    io.write_json_list(segments, f"{path}/a_vocab.json")
    io.write_json_list(proxies.table(spark, sf_dir, "orders").select("o_orderpriority").union(segments), f"{path}/b_vocab.json")
    return io.read_vocab_files(spark, path).select(long("rank"), "token")


@query("SELECT 'code' || n_regionkey AS code, max(n_name) AS label FROM nation GROUP BY n_regionkey UNION ALL SELECT 'nation' || n_nationkey, 'Nation ' || n_name FROM nation")
def q_code_labels(spark, sf_dir):
    """JSON maps in two files: of a code in both, the second's label."""
    path, n = scratch(spark, "labels"), proxies.table(spark, sf_dir, "nation")
    of = lambda a, k, v: a.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m")).select(F.to_json("m").alias("m")).first()["m"]  # noqa: E731  25 rows
    region = n.groupBy("n_regionkey").agg(F.max("n_name").alias("name"), F.min("n_name").alias("least"))
    code = F.concat(F.lit("code"), F.col("n_regionkey").cast("string")).alias("k")
    own = n.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("k"), F.concat(F.lit("Nation "), F.col("n_name")).alias("v"))
    io.write_text(spark, of(region.select(code, F.col("least").alias("v")).union(own), "k", "v"), f"{path}/1.json")
    io.write_text(spark, of(region.select(code, F.col("name").alias("v")), "k", "v"), f"{path}/2.json")
    return io.read_code_labels(spark, path)


@query(sql("SELECT CASE WHEN n < floor(t * 0.15) THEN 'test' ELSE 'pretrain' END AS split, 'random' AS scheme, subject_id FROM (SELECT *, row_number() OVER (ORDER BY md5('23:' || subject_id)) - 1 AS n, count(*) OVER () AS t FROM ids)", ids=_IDS))
def q_split_table(spark, sf_dir):
    """Splits written by split, read back as ids."""
    path = scratch(spark, "splits")
    s = cohort.split(ids(spark, sf_dir), 0.15).select("split", F.lit("random").alias("scheme"), F.lit(None).cast("string").alias("key"), "subject_id")
    io.write_table(s.unionByName(s.withColumn("scheme", F.lit("other"))), path, partition_by=("split",))
    return io.read_splits(spark, path, scheme="random").select("split", "scheme", "subject_id")


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM customer)")
def q_schema_probe(spark, sf_dir):
    """Names from the file's footer, with what has to be there."""
    c = schema.require(proxies.table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment", "segment"])
    return spark.createDataFrame([(n,) for n in c.columns], "name string")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def q_staged(spark, sf_dir):
    """A stage that lacks a column is made anew; one that has it is read."""
    path, n = scratch(spark, "stage"), proxies.table(spark, sf_dir, "nation")
    io.stage(spark, path, lambda: n.select(F.col("n_nationkey").alias("id")), refresh=True)
    io.stage(spark, path, lambda: n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), needs=("id", "name"))
    return io.stage(spark, path, lambda: n.limit(0), needs=("name",)).select("id", "name")


@query("SELECT n_nationkey AS id, n_name || '!' AS name FROM nation WHERE n_regionkey < 3")
def q_replaced(spark, sf_dir):
    """A table overwritten by a function of itself."""
    path = scratch(spark, "replace")
    io.write_table(proxies.table(spark, sf_dir, "nation"), path)
    io.replace_table(spark, path, lambda d: d.where("n_regionkey < 3").withColumn("n_name", F.concat("n_name", F.lit("!"))))
    return spark.read.parquet(path).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query(sql(f"SELECT subject_id, {lists('list_transform(elapsed, lambda x: CAST(floor(greatest(x, 0) / 8766) AS BIGINT))')} AS ages FROM v_seq", "v_seq"))
def q_repair_copy(spark, sf_dir):
    """A repaired copy at another path."""
    path = scratch(spark, "repaired")
    io.write_table(repair.with_ages(seqs(spark, sf_dir)).select("subject_id", "age_tokens"), path)
    return spark.read.parquet(path).select("subject_id", text("age_tokens").alias("ages"))


@query("SELECT row_number() OVER (ORDER BY token) - 1 AS pos, token FROM (SELECT DISTINCT o_orderpriority AS token FROM orders)")
def q_vocab_json(spark, sf_dir):
    path = scratch(spark, "own_vocab.json")
    io.write_json_list(proxies.table(spark, sf_dir, "orders").select("o_orderpriority"), path)
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "token"))
    return d.select(long("pos"), "token")


@query(sql("SELECT token, row_number() OVER (ORDER BY token) + 1 AS id, 'max_len=2048' AS setting FROM (SELECT DISTINCT c_mktsegment AS token FROM customer) UNION ALL SELECT '[PAD]', 0, 'max_len=2048' UNION ALL SELECT '[UNK]', 1, 'max_len=2048'"))
def q_tokenizer_saved(spark, sf_dir):
    path = scratch(spark, "tokenizer")
    v = vocab.vocabulary(proxies.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("token")).distinct(), ["[PAD]", "[UNK]"])
    vocab.save(v, v.select("token", F.lit(8).alias("type")), path, max_len=2048)
    back, _, settings = vocab.load(spark, path)
    return back.select("token", long("id"), F.lit(f"max_len={settings['max_len']}").alias("setting"))


@query(sql("SELECT study_id, CAST(hadm_id % 3 = 0 AS BIGINT) AS first_run FROM v_study", "v_study"))
def q_manifest_appended(spark, sf_dir):
    """Two runs: the second appends what the first had not."""
    path, s = scratch(spark, "manifest"), proxies.studies(spark, sf_dir).select("study_id", "hadm_id")
    io.write_table(s.limit(0).withColumn("first_run", F.lit(0)), path)
    io.append_new(s.where("hadm_id % 3 = 0").withColumn("first_run", F.lit(1)), spark, path, "study_id")
    io.append_new(s.withColumn("first_run", F.lit(0)), spark, path, "study_id")
    return spark.read.parquet(path).select("study_id", long("first_run"))


@query("SELECT count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS cached, count(*) FILTER (o_orderstatus = 'P') AS missing FROM orders")
def q_summary(spark, sf_dir):
    o = proxies.table(spark, sf_dir, "orders")
    return io.summary(o, requested=F.lit(True), cached=F.col("o_orderstatus") == "F", missing=F.col("o_orderstatus") == "P")


@query(sql("SELECT doc_id, CAST(p >= 0.5 AS BIGINT) AS predicted, n FROM v_score, (SELECT count(*) AS n FROM v_score WHERE quality <> -1) WHERE quality <> -1", "v_score"))
def q_predictions(spark, sf_dir):
    """Predictions as a table and metrics as JSON, read again."""
    path, d = scratch(spark, "predictions"), scored(spark, sf_dir)
    io.write_table(d.select("doc_id", (F.col("p") >= 0.5).cast("long").alias("predicted")), f"{path}/table")
    io.write_json_row(metrics.confusion(d).select((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")), f"{path}/metrics.json")
    n = spark.read.text(f"{path}/metrics.json", wholetext=True).select(F.from_json("value", "n long")["n"].alias("n"))
    return spark.read.parquet(f"{path}/table").crossJoin(F.broadcast(n))  # one row


# Projections


@query("SELECT c_custkey AS subject_id, c_custkey AS patient_id, c_name AS name, CAST(1 AS BIGINT) AS num_visits, CAST(0 AS BIGINT) AS n_conditions FROM customer")
def q_projected(spark, sf_dir):
    """Lower-case headers, what there is of a wanted list, renames, a mirrored key, constant columns."""
    c = proxies.table(spark, sf_dir, "customer")
    c = io.lower_headers(c.select(*[F.col(x).alias(x.upper()) for x in c.columns]))
    c = io.keep_available(c, ["c_custkey", "c_name", "c_not_there"], "c_custkey").withColumnsRenamed({"c_custkey": "subject_id", "c_name": "name_tokens_2048"})
    c = sequences.unsuffixed(c, 2048).withColumnRenamed("name_tokens", "name")
    return c.select("subject_id", F.col("subject_id").alias("patient_id"), "name", F.lit(1).cast("long").alias("num_visits"), F.size(F.array().cast("array<bigint>")).cast("long").alias("n_conditions"))


@query(sql("SELECT subject_id, CAST(num_visits AS BIGINT) AS num_visits, len(tokens) AS n FROM v_seq WHERE num_visits >= 2 AND len(tokens) > 5", "v_seq"))
def q_thresholds(spark, sf_dir):
    return cohort.longer_than(cohort.min_visits(seqs(spark, sf_dir), 2)).select("subject_id", long("num_visits"), F.size("event_tokens").cast("long").alias("n"))


_SIX = "list_transform(tokens, lambda x: CASE WHEN x LIKE 'MEDS_%' THEN 0 WHEN x LIKE 'DIAGNOSIS%' THEN 1 WHEN x LIKE 'LAB%' THEN 2 WHEN x LIKE 'MEDICATION%' THEN 3 WHEN x LIKE 'PROCEDURE%' THEN 4 WHEN x LIKE 'TRANSFER_TO%' THEN 5 WHEN x LIKE 'ICU%' THEN 6 WHEN x LIKE 'INFUSION%' THEN 7 ELSE 8 END)"


@query(sql(f"SELECT subject_id, {lists(_SIX)} AS types, {lists('elapsed', 4)} AS times, {lists('list_transform(elapsed, lambda x: 25 + CAST(floor(greatest(x, 0) / 8766) AS BIGINT))')} AS ages, CAST(died AND subject_id % 40 <= 32 AS BIGINT) AS label_mortality_1month FROM v_seq", "v_seq"))
def q_back_filled(spark, sf_dir):
    """A table that has tokens, hours and death offsets alone."""
    s = seqs(spark, sf_dir).select("subject_id", "event_tokens", "elapsed_tokens", F.when(F.col("died"), 0).otherwise(-1).alias("death_after_start"), (F.col("subject_id") % 40).alias("death_after_end"))
    d = repair.back_filled(s)
    return d.select("subject_id", text("type_tokens").alias("types"), text("time_tokens", 4).alias("times"), text("age_tokens").alias("ages"), long("label_mortality_1month"))


@query(sql("SELECT stay_id, array_to_string(list_transform(list(CASE WHEN birth IS NULL THEN 25 ELSE greatest(CAST(floor(date_diff('microsecond', birth, time) / 3.6e9 / 24 / 365.25) AS BIGINT), 0) END ORDER BY time, code), lambda x: CAST(x AS VARCHAR)), ',') AS ages FROM (SELECT *, min(CASE WHEN code = 'MEDS_BIRTH' THEN time END) OVER (PARTITION BY stay_id) AS birth FROM v_match) GROUP BY stay_id", "v_match"))
def q_stay_ages(spark, sf_dir):
    """Years since birth where a stay has that event, else 25."""
    s = sequences.sequences_in_stays(proxies.events(spark, sf_dir), master(spark, sf_dir))
    return s.select("stay_id", text("age_tokens").alias("ages"))


@query(sql(f"SELECT subject_id, {lists('list_transform(elapsed, lambda x: CAST(floor(greatest(x, 0) / 8766) AS BIGINT) + base)')} AS ages FROM (SELECT *, coalesce(CAST(floor(elapsed[list_position(tokens, 'LAB3')] / 8766) AS BIGINT), 25) AS base FROM (SELECT subject_id, list_transform(tokens, lambda x: x) AS tokens, list_transform(elapsed, lambda x: x * 500) AS elapsed FROM v_seq))", "v_seq"))
def q_estimated_ages(spark, sf_dir):
    """Ages above that at birth; one token plays the birth."""
    s = seqs(spark, sf_dir).withColumns({"event_tokens": F.transform("event_tokens", lambda x: F.when(x == "LAB3", "MEDS_BIRTH").otherwise(x)), "elapsed_tokens": F.transform("elapsed_tokens", lambda x: x * 500)})
    return s.select("subject_id", text(timecols.estimated_age("event_tokens", "elapsed_tokens")).alias("ages"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '/abs/' || o_orderkey ELSE '/root/rel/' || o_orderkey END AS path, 'p' || substr(CAST(o_custkey AS VARCHAR), 1, 2) || '/p' || o_custkey || '/s' || o_orderkey || '/' || o_orderstatus || '.jpg' AS image FROM orders")
def q_paths(spark, sf_dir):
    o = proxies.table(spark, sf_dir, "orders")
    path = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/abs/").otherwise("rel/"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", codes.resolve_path(path, "/root").alias("path"), codes.image_path("o_custkey", "o_orderkey", "o_orderstatus").alias("image"))


@query(sql("SELECT stay_id, study_id, round(hours, 4) AS hours_from_icu_intime, row_number() OVER (PARTITION BY stay_id ORDER BY rank) - 1 AS image_rank_in_stay, CAST(hours <= 24 AS BIGINT) AS is_first_24h_image, CAST(m AS BIGINT) AS mortality_28d FROM (SELECT i.*, mortality_28d AS m FROM v_image i JOIN v_master USING (stay_id)) WHERE hours <= 240 QUALIFY image_rank_in_stay = 0", "v_patient", "v_stay", "v_master", "v_image"))
def q_image_first_hours(spark, sf_dir):
    """Each stay's first image of its first ten days, with the stay's labels, as an index has it."""
    i = align.image_index(align.studies_in_stays(proxies.studies(spark, sf_dir), master(spark, sf_dir), first_hours_only=240, keep_all=False))
    return i.select("stay_id", "study_id", F.round("hours_from_icu_intime", 4).alias("hours_from_icu_intime"), long("image_rank_in_stay"), long("is_first_24h_image"), long("mortality_28d"))


# Aggregates and orders


@query("SELECT subject_id FROM (SELECT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY subject_id")
def q_sorted_ids(spark, sf_dir):
    return cohort.distinct_ids(with_status(spark, sf_dir, "F"), with_status(spark, sf_dir, "P"))


@query("SELECT o_custkey AS subject_id, CAST(arg_min(y, o_orderkey) AS BIGINT) AS y FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderstatus = 'F' AS INTEGER) END AS y FROM orders) WHERE y <> -1 GROUP BY o_custkey")
def q_first_labels(spark, sf_dir):
    """Of each subject the first label that isn't null or -1."""
    o = proxies.table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderkey") % 3 == 0, -1).when(F.col("o_orderkey") % 5 == 0, None).otherwise((F.col("o_orderstatus") == "F").cast("int"))
    return cohort.first_labels(o.select(F.col("o_custkey").alias("subject_id"), "o_orderkey", y.alias("y")), "y", ("o_orderkey",)).select("subject_id", long("y"))


@query(sql("SELECT subject_id, study_id, row_number() OVER (ORDER BY subject_id, t, study_id) - 1 AS place FROM v_study", "v_study"))
def q_multi_key_order(spark, sf_dir):
    """Places in an order by several keys, over all rows."""
    s = proxies.studies(spark, sf_dir).select("subject_id", "study_id", "StudyDateTime")
    return ranks.row_index(s, ["subject_id", "StudyDateTime", "study_id"], "place").select("subject_id", "study_id", "place")


@query(sql("SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM v_word GROUP BY token HAVING n_docs >= 20", "v_word"))
def q_frequent_features(spark, sf_dir):
    return features.frequent_features(features.frequencies(words(spark, sf_dir), "doc_id", "words").withColumnRenamed("doc_id", "subject_id"), 20)


@query(sql("SELECT round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1), 6) AS weight FROM v_score", "v_score"))
def q_class_weight(spark, sf_dir):
    return features.class_weight(proxies.scores(spark, sf_dir), "quality").select(F.round("weight", 6).alias("weight"))


@query(sql("SELECT 'quality' AS label, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg, round(least(sqrt(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1)), 50), 6) AS weight FROM v_score UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0), round(least(sqrt(count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)), 50), 6) FROM v_score", "v_score"))
def q_condition_weights(spark, sf_dir):
    return cohort.condition_weights(proxies.scores(spark, sf_dir), ["quality", "toxic"]).withColumn("weight", F.round("weight", 6))


@query(sql("SELECT row_number() OVER (ORDER BY token DESC) - 1 AS id, token FROM (SELECT DISTINCT unnest(tokens) AS token FROM v_seq)", "v_seq"))
def q_reverse_vocab(spark, sf_dir):
    return vocab.reversed_words(vocab.tokens(seqs(spark, sf_dir))).select(long("id"), "token")


@query("SELECT vec_id, CAST(0 AS BIGINT) AS i, j, value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(len(embedding))) AS j FROM embeddings) ORDER BY value DESC, vec_id, j LIMIT 50")
def q_top_elements(spark, sf_dir):
    e = proxies.table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("m"))
    return features.top_elements(e, "vec_id", "m", 50).select("vec_id", long("i"), long("j"), "value")


@query(sql("SELECT subject_id FROM (SELECT * FROM ids ORDER BY md5('23:' || subject_id) LIMIT 150)", ids=_IDS))
def q_sample(spark, sf_dir):
    return cohort.sample(ids(spark, sf_dir), 150).select("subject_id")


@query(sql("SELECT subject_id FROM (SELECT * FROM ids WHERE subject_id <> 7 ORDER BY md5('23:' || subject_id) LIMIT 10)", ids=_IDS))
def q_sample_others(spark, sf_dir):
    return cohort.others_sample(ids(spark, sf_dir), 7, 10).select("subject_id")


@query(sql("SELECT subject_id, CASE WHEN CAST('0x' || substr(md5('23:' || subject_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'val' ELSE 'train' END AS split FROM ids", ids=_IDS))
def q_train_val(spark, sf_dir):
    return cohort.train_val(ids(spark, sf_dir), 0.2).select("subject_id", "split")


_STRATA = "SELECT subject_id, concat_ws(',', y, CAST(subject_id % 3 = 0 AS INTEGER)) AS combo FROM ids"
_PLACES = "row_number() OVER (PARTITION BY {0} ORDER BY md5('23:' || subject_id)) - 1"


@query(sql("SELECT CASE WHEN m < d.n_test THEN 'val' ELSE 'train' END AS split, 'multi_label' AS scheme, CAST(g AS VARCHAR) AS key, subject_id FROM (SELECT *, " + _PLACES.format("g, combo") + " AS m FROM picked) JOIN validated d USING (g, combo)", ids=_IDS, strata=_STRATA,
    sized="SELECT g, combo, count(*) AS n, g / (SELECT count(*) FROM ids) AS share FROM strata CROSS JOIN (VALUES (30), (90)) s(g) GROUP BY g, combo", **dealt_sql("sized", 2),
    picked="SELECT g, combo, subject_id FROM (SELECT *, " + _PLACES.format("combo") + " AS n FROM strata) JOIN dealt USING (combo) WHERE n < n_test", again="SELECT g, combo, count(*) AS n, 0.2 AS share FROM picked GROUP BY g, combo", **dealt_sql("again", 2, "validated")))
def q_fewshot_multilabel(spark, sf_dir):
    d = ids(spark, sf_dir).withColumn("z", (F.col("subject_id") % 3 == 0).cast("int"))
    return cohort.few_shot(d, ["y", "z"], [30, 90], "multi_label")


# Functions on codes


@query(sql("SELECT subject_id, array_to_string(tokens, ' ') AS joined, CAST(len(list_filter(tokens, lambda x: x LIKE 'LAB%')) AS BIGINT) AS n_labs, CAST(len(list_filter(tokens, lambda x: x = '[VS]')) AS BIGINT) AS n_visits FROM v_seq", "v_seq"))
def q_joined_tokens(spark, sf_dir):
    s = seqs(spark, sf_dir)
    t = F.transform("event_tokens", lambda x: codes.one_word(x))
    return s.select("subject_id", codes.joined(t).alias("joined"), F.size(F.filter("event_tokens", lambda x: x.startswith("LAB"))).cast("long").alias("n_labs"), arrays.count_of("event_tokens", "[VS]").cast("long").alias("n_visits"))


_TEXT_VOCAB = "SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT token FROM v_word GROUP BY token HAVING count(DISTINCT doc_id) >= 50) WHERE length(token) <= 1000"


@query(sql("SELECT doc_id, md5(array_to_string(list(CAST(coalesce(id, 1) AS VARCHAR) ORDER BY pos), ',')) AS ids, count(*) AS n FROM (SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM v_doc) LEFT JOIN text_vocab USING (token) GROUP BY doc_id", "v_doc", "v_word", text_vocab=_TEXT_VOCAB))
def q_text_ids(spark, sf_dir):
    """Words at white space, looked up whole: any other is unknown."""
    w = words(spark, sf_dir)
    frequent = features.frequent_features(features.frequencies(w, "doc_id", "words").withColumnRenamed("doc_id", "subject_id"), 50).where("length(token) <= 1000")
    e = vocab.encoded(w, vocab.vocabulary(frequent.select("token"), ["[PAD]", "[UNK]"]), "doc_id", "words").where("size(ids) > 0")
    return e.select("doc_id", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary")).alias("ids"), F.size("ids").cast("long").alias("n"))


@query("SELECT c_custkey, regexp_replace('label_' || lower(c_mktsegment), '^label_', '') AS task, round(c_acctbal / 100, 4) AS a, 0.5 AS b FROM customer")
def q_parsed_labels(spark, sf_dir):
    """A label's name without its prefix; key=value lists as maps."""
    c = proxies.table(spark, sf_dir, "customer")
    pairs = codes.key_values(F.concat(F.lit(" a="), F.round(F.col("c_acctbal") / 100, 4).cast("string"), F.lit(", b = 0.5,")))
    return c.select("c_custkey", codes.strip_label(F.concat(F.lit("label_"), F.lower("c_mktsegment"))).alias("task"), pairs["a"].alias("a"), pairs["b"].alias("b"))


_TOKEN_MAP = "SELECT row_number() OVER (ORDER BY token) + 1 AS id, token FROM (SELECT DISTINCT unnest(tokens) AS token FROM v_seq UNION SELECT 'BIN_3')"


@query(sql("SELECT id, token, CASE WHEN token = 'BIN_3' THEN 'Bin_3' WHEN token LIKE 'LAB%' THEN 'Lab ' || substr(token, 4) ELSE token END AS label FROM token_map UNION ALL SELECT 0, '[PAD]', '[PAD]' UNION ALL SELECT 1, '[UNK]', '[UNK]'", "v_seq", token_map=_TOKEN_MAP))
def q_token_maps(spark, sf_dir):
    t = vocab.tokens(seqs(spark, sf_dir)).union(spark.createDataFrame([("BIN_3",)], "token string"))
    names = t.where(F.col("token").startswith("LAB")).select(F.col("token").alias("code"), F.concat(F.lit("Lab "), F.expr("substr(token, 4)")).alias("label")).union(spark.createDataFrame([("BIN", "Bin")], "code string, label string"))
    return vocab.token_maps(vocab.vocabulary(t, ["[PAD]", "[UNK]"]), names).select(long("id"), "token", "label")


# Functions of arrays


_EOS = "tokens[1:7] || ['[EOS]']"
_FIRST = "['[TASK]'] || tokens[2:len(tokens)]"
_BOTH = "['[TASK]'] || tokens[2:len(tokens) - 1] || ['[TASK]']"


@query(sql(f"SELECT subject_id, {lists(_EOS)} AS with_eos, {lists('CASE WHEN len(tokens) > 0 THEN ' + _FIRST + ' ELSE tokens END')} AS with_task, {lists('CASE WHEN len(tokens) > 1 THEN ' + _BOTH + ' ELSE tokens END')} AS decoder, {lists('tokens || types')} AS both, {lists('tokens || [tokens[len(tokens)], tokens[len(tokens)]]')} AS extended FROM (SELECT subject_id, tokens, list_transform(types, lambda x: CAST(x AS VARCHAR)) AS types FROM v_seq WHERE len(tokens) > 1)", "v_seq"))
def q_array_edits(spark, sf_dir):
    """End tokens, task tokens, concatenation, the last element repeated."""
    s = seqs(spark, sf_dir).where("size(event_tokens) > 1")
    return s.select(
        "subject_id", text(arrays.truncate_with("event_tokens", 8, "[EOS]")).alias("with_eos"), text(arrays.with_task("event_tokens", "[TASK]")).alias("with_task"), text(arrays.with_task("event_tokens", "[TASK]", encoder=False)).alias("decoder"),
        text(F.concat("event_tokens", F.col("type_tokens").cast("array<string>"))).alias("both"), text(arrays.extend("event_tokens", 2)).alias("extended"),
    )


@query(sql(f"SELECT subject_id, {lists('list_transform(visits, lambda x: least(greatest(x, 0), 2))')} AS clipped, {lists('CASE WHEN subject_id % 3 = 0 THEN list_transform(range(8), lambda x: 25) ELSE types END')} AS ages, CAST(least(len(tokens), 40) AS BIGINT) AS pad_start, CAST(CASE WHEN subject_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_listed FROM v_seq", "v_seq"))
def q_array_defaults(spark, sf_dir):
    """Clipped segments, default arrays, where padding starts, scalars as lists."""
    s = seqs(spark, sf_dir).withColumns({"a": F.when(F.col("subject_id") % 3 != 0, F.col("type_tokens")), "n": F.when(F.col("subject_id") % 4 != 0, F.col("subject_id"))})
    padded = arrays.pad(F.transform("event_tokens", lambda x, i: i + 1), 40, 0)
    return s.select("subject_id", text(arrays.clip("visit_tokens", 0, 2)).alias("clipped"), text(arrays.or_default("a", 25, 8)).alias("ages"), arrays.pad_start(padded).cast("long").alias("pad_start"), F.size(arrays.listed("n")).cast("long").alias("n_listed"))


@query(sql("SELECT subject_id, 'a' AS source, CAST(0 AS BIGINT) AS type FROM v_seq WHERE subject_id % 2 = 0 UNION ALL SELECT subject_id, 'b', CAST(types[1] AS BIGINT) FROM v_seq WHERE subject_id % 2 = 1", "v_seq"))
def q_sequence_defaults(spark, sf_dir):
    """Tables with and without arrays in one: defaults where they are null."""
    s = seqs(spark, sf_dir).withColumn("type_tokens", F.when(F.col("subject_id") % 2 == 1, F.col("type_tokens")))
    d = repair.with_defaults(s, 16)
    return d.select("subject_id", F.when(F.col("subject_id") % 2 == 0, "a").otherwise("b").alias("source"), F.get("type_tokens", 0).cast("long").alias("type"))


# Metrics


@query(sql("SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (quality = 1 AND p >= 0.5) AS tp, count(*) FILTER (quality = 0 AND p >= 0.5) AS fp, count(*) FILTER (quality = 1 AND p < 0.5) AS fn, count(*) FILTER (quality = 0 AND p < 0.5) AS tn FROM v_score WHERE quality <> -1)", "v_score"))
def q_hard_metrics(spark, sf_dir):
    c = metrics.hard(scored(spark, sf_dir))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "auc", "f1")])


_CELLS = "SELECT doc_id, 'quality' AS task, quality AS y, p FROM v_score WHERE quality <> -1 AND toxic <> -1 UNION ALL SELECT doc_id, 'toxic', toxic, p FROM v_score WHERE quality <> -1 AND toxic <> -1"


@query(sql("SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc, round((SELECT avg(r) FROM (SELECT min(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS r FROM cells GROUP BY doc_id)), 6) AS accuracy FROM (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM cells)", "v_score", cells=_CELLS))
def q_micro_metrics(spark, sf_dir):
    s = proxies.scores(spark, sf_dir).where("quality <> -1 and toxic <> -1")
    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y")) for t in ("quality", "toxic")])
    m = metrics.micro(s.select("doc_id", "p", F.explode(rows).alias("x")).select("doc_id", "p", "x.task", "x.y"), "doc_id", "task")
    return m.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "auc", "accuracy")])


_FOLDS = "SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY md5('23:' || doc_id)) - 1) % 5 AS fold FROM v_score WHERE quality <> -1"


@query(sql("SELECT round(avg(accuracy), 6) AS accuracy, round(avg(recall), 6) AS recall, count(*) AS n_folds FROM (SELECT fold, avg(CAST((p >= 0.5) = (quality = 1) AS INTEGER)) AS accuracy, count(*) FILTER (quality = 1 AND p >= 0.5) / greatest(count(*) FILTER (quality = 1), 1) AS recall FROM folds GROUP BY fold)", "v_score", folds=_FOLDS))
def q_fold_average(spark, sf_dir):
    d = cohort.folds(scored(spark, sf_dir), "y", 5, "doc_id")
    m = metrics.fold_average(metrics.confusion(d, by=("fold",)), ["accuracy", "recall"])
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"), "n_folds")


@query("SELECT round(sum(o_totalprice * o_shippriority_n) / sum(o_shippriority_n), 2) AS loss FROM (SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, 1 + o_orderkey % 7 AS o_shippriority_n FROM orders)")
def q_weighted_loss(spark, sf_dir):
    o = proxies.table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("double").alias("loss"), (1 + F.col("o_orderkey") % 7).alias("n"))
    return metrics.weighted_loss(o).select(F.round("loss", 2).alias("loss"))


@query("SELECT vec_id, round(1 / (1 + exp(embedding[1] - embedding[2])), 5) AS p, list_position(embedding, list_max(embedding)) - 1 AS best, round(exp(embedding[1]) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 5) AS soft FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def q_logits(spark, sf_dir):
    e = proxies.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z")).withColumn("two", F.slice("z", 1, 2))
    return e.select("vec_id", F.round(metrics.positive_probability("two"), 5).alias("p"), metrics.argmax("z").alias("best"), F.round(F.get(metrics.softmax("z"), 0), 5).alias("soft"))


@query(sql(f"SELECT task, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM ({_POINTS}) GROUP BY task", "v_ends", readm=_READ, los=_LOS, multi=_MULTI))
def q_datapoint_counts(spark, sf_dir):
    return points(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positive"))




# Versions


@query("SELECT c_custkey, v AS version, CASE WHEN v = 3 AND c_custkey % 2 = 0 THEN -1 ELSE c_nationkey END AS nation FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS one FROM customer) CROSS JOIN (VALUES (1), (2), (3)) t(v) WHERE v > 1 OR one = 1")
def q_versions(spark, sf_dir):
    """Appended twice, the second time with what is there already, then replaced by a function of itself; all three versions read back."""
    path = scratch(spark, f"versions-{uuid.uuid4().hex}")
    c = proxies.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("nation"))
    versions.append_new(c.where("c_custkey % 3 = 0"), path, "c_custkey")
    versions.append_new(c, path, "c_custkey")
    versions.replace(spark, path, lambda d: d.withColumn("nation", F.when(F.col("c_custkey") % 2 == 0, -1).otherwise(F.col("nation"))))
    every = [versions.read(spark, path, n).withColumn("version", F.lit(n)) for n in (1, 2, 3)]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("c_custkey", "version", "nation")


# Packs


@query("SELECT vec_id, place // 1024 AS pack, place % 1024 AS index, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) WHERE vec_id % 3 = 0")
def q_packs_fetched(spark, sf_dir):
    """All vectors written in packs, every third read back by its place, the places from an index of keys."""
    path, e = scratch(spark, "packs"), proxies.table(spark, sf_dir, "embeddings")
    packs.write(packs.from_floats(e.select("vec_id", "embedding"), "embedding"), path, "vec_id", "record")
    index = packs.placed(e.select("vec_id"), "vec_id").where("vec_id % 3 = 0")
    got = packs.to_floats(packs.fetched(index, path))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("vec_id", "pack", F.col("index").cast("long").alias("index"), F.size("vector").cast("long").alias("n"), F.round(total, 5).alias("total"))


@query("SELECT vec_id AS key, place // 256 AS pack, place % 256 AS index, CAST(4 * len(embedding) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings) WHERE place // 256 IN (0, 2) AND place % 256 < 7")
def q_packs_filtered(spark, sf_dir):
    """Two packs read by a filter that reaches the files."""
    path, e = scratch(spark, "packs-256"), proxies.table(spark, sf_dir, "embeddings")
    packs.write(packs.from_floats(e.select("vec_id", "embedding"), "embedding"), path, "vec_id", "record", 256)
    d = packs.read(spark, path).where(F.col("pack").isin(0, 2) & F.col("index").isin(*range(7)))
    return d.select("key", "pack", F.col("index").cast("long").alias("index"), F.length("record").cast("long").alias("n"))


# Streams


@query(sql(f"SELECT subject_id, {lists('tokens')} AS tokens, {lists('types')} AS types, {lists('visits')} AS visits, {lists('elapsed', 4)} AS elapsed, CAST(num_visits AS BIGINT) AS num_visits, died, septic FROM v_seq", "v_seq"))
def q_sequences_grown(spark, sf_dir):
    """The events as shards that are taken one at a time, out of order, by a query with keyed state; the sequences after the last."""
    path = scratch(spark, f"grown-{uuid.uuid4().hex}")
    e = proxies.stream(spark, sf_dir).withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(3)))
    for k in range(3):  # a shard has as many files as tasks that write it, and is one batch
        e.where(F.col("shard") == k).drop("shard").write.mode("append").parquet(f"{path}/in")
        grown.grow(spark, spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    d = grown.current(spark, f"{path}/out")
    return d.select("subject_id", text("event_tokens").alias("tokens"), text("type_tokens").alias("types"), text("visit_tokens").alias("visits"), text("elapsed_tokens", 4).alias("elapsed"), long("num_visits"), "died", "septic")
