"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule w(t) over the run, 0 <= t <= 1. Its integral is the source's cumulative token demand; a
document before which c words of its source stand (in a random but fixed order, the source repeated as often as its target
needs) is due where the demand reaches c, so inverting the integral gives its training position. Documents are then
range-sorted by position. Sums run over buckets of documents, so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evseq.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Most times that a source may be repeated.
CAP = 3
#: Weights, repeating by source in order of code points, null last.
WEIGHTS = (1, 2, 3)
#: Slopes of the schedules, repeating: 0.5 starts at 1.5 times the mean and ends at 0.5 times.
SLOPES = (0.5, -0.5, 0.0)
#: Documents with more than this part of their source's words are placed one by one, so none of them is cut.
LARGE = 100
#: Documents of a source that share a bucket, on average.
BUCKET_ROWS = 2_000


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, n_docs -> with weight, slope and target.

    All sizes are shared by weight; a target stops at CAP times its source's size and the excess goes to the others by weight
    until none is above. In closed form: by size / weight, sources fill up in that order, so the level at which the rest share
    what remains is found by running sums. One row for each source, never documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = per_source.withColumn("rank", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    s = s.withColumns({"weight": pick(WEIGHTS).cast("double"), "slope": pick(SLOPES).cast("double"), "cap": F.col("source_size") * F.lit(float(CAP))})
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    s = s.withColumns({"filled": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)), "total": F.sum("source_size").over(every)})
    s = s.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    # The level holds from the first source on that is not filled at it.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("by"), "rank", "level"))).over(every)["level"])
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap"))).select("source", "source_size", "n_docs", "weight", "slope", "target")


def placed(docs: DataFrame) -> DataFrame:
    """A row for each document, without its text: doc_id, source, row_hash, size, source_size, target, taken, positions, and
    first_position and last_position, the least and greatest of those (null where there are none).

    A source whose target is f times its size is repeated whole floor(f) times; the words that remain come from some of its
    documents once more. positions: the places in training, 0 to 1, at which the document is due, CAP at most; taken: its words
    times those. Documents without words are never due. Null text: size 0. Null source: a source of its own, the last. Equal rows
    are placed one after the other, and of those any may be the one that comes once more; every run agrees, as the order is by a hash
    of id and text. Empty table: no rows.
    """
    d = docs.select("doc_id", "source", F.xxhash64(F.lit("order"), "doc_id", "text").alias("row_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Texts are read once; equal rows are one class from here on, however many they are.
    d = common.checkpoint(d.groupBy("doc_id", "source", "row_hash", "size").agg(F.count(F.lit(1)).alias("_m")))
    per_source = d.groupBy("source").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size"), F.sum("_m").alias("n_docs"))
    t = targets(per_source).withColumn("_rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = t.withColumn("_rest", F.col("target") - F.col("_rounds") * F.col("source_size"))
    t = t.select(F.col("source").alias("_s"), "source_size", "target", "_rounds", "_rest", F.col("slope").alias("_slope"), (F.floor(F.col("n_docs") / BUCKET_ROWS) + 1).alias("_buckets"))
    same = F.col("source").eqNullSafe(F.col("_s"))
    d = d.join(t, same).drop("_s")
    large = F.col("size") * LARGE > F.col("source_size")
    big = _large(d.where(large))
    # What the large documents leave of the rest.
    spent = big.groupBy("source").agg(F.sum("size").alias("_big"), F.sum(F.when(F.col("_extra"), F.col("size"))).alias("_spent")).withColumnRenamed("source", "_s")
    small = d.where(~large).join(spent, same, "left").drop("_s")
    small = small.withColumn("_of", F.col("source_size") - F.coalesce("_big", F.lit(0)))
    small = small.withColumn("_part", F.least(F.greatest(F.col("_rest") - F.coalesce("_spent", F.lit(0)), F.lit(0.0)), F.col("_of").cast("double")))
    small = small.withColumn("_bucket", F.pmod("row_hash", "_buckets"))
    # Rows of this window are buckets: a source's documents in thousands.
    words = F.col("size") * F.col("_m")
    sums = small.groupBy("source", "_bucket").agg(F.sum(words).alias("_sum"))
    before = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inside = F.sum(words).over(Window.partitionBy("source", "_bucket").orderBy("row_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - words
    small = small.withColumn("_in", inside).join(before, same & (F.col("_bucket") == F.col("_b")))
    small = _each(small).withColumn("_c", F.col("_before") + F.col("_in") + F.col("_copy") * F.col("size"))
    small = small.withColumn("_extra", F.col("_c") + F.col("size") / 2 < F.col("_part"))
    every = small.select(*big.columns).unionByName(big)
    out = positions(every).withColumns({"first_position": F.array_min("positions"), "last_position": F.array_max("positions")})
    return out.select("doc_id", "source", "row_hash", "size", "source_size", "target", "taken", "positions", "first_position", "last_position")


def _each(d: DataFrame) -> DataFrame:
    """A row for each copy of a class, with its number: in two steps, so that no array is long."""
    step = 1 << 15
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / step))))
    return d.withColumn("_copy", F.explode(F.sequence(F.col("_k") * step, F.least((F.col("_k") + 1) * step, F.col("_m")) - 1))).drop("_k")


def _large(d: DataFrame) -> DataFrame:
    """Documents of more than a LARGEth of their source, fewer than LARGE in each: in hash order, each that fits into its share of
    the rest comes once more, so that the cut falls between documents. Of those that don't fit one comes after all if that leaves the source
    nearer to its target than all of its small documents could: the one that leaves it nearest, of equals the smallest. (Small documents
    are cut where the rest ends, in the middle of one at most, which is near enough for them and for no others.)"""
    d = _each(d).drop("_m", "_copy")
    source = [c for c in d.columns if c not in ("doc_id", "row_hash", "size")]
    doc = "struct<row_hash:bigint,doc_id:bigint,size:bigint,c:bigint,extra:boolean>"
    g = d.groupBy(*source).agg(F.sort_array(F.collect_list(F.struct("row_hash", "doc_id", "size"))).alias("_docs"), F.sum("size").alias("_of"))
    g = g.withColumn("_part", F.col("_rest") * F.col("_of") / F.col("source_size"))
    start = F.struct(F.col("_part").alias("left"), F.lit(0).cast("long").alias("c"), F.array().cast(f"array<{doc}>").alias("out"))

    def take(acc, x):
        fits = x["size"] <= acc["left"]
        row = F.struct(x["row_hash"].alias("row_hash"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), acc["c"].alias("c"), fits.alias("extra"))
        return F.struct((acc["left"] - F.when(fits, x["size"]).otherwise(0)).alias("left"), (acc["c"] + x["size"]).alias("c"), F.concat(acc["out"], F.array(row)).alias("out"))

    g = g.withColumn("_out", F.aggregate("_docs", start, take)["out"])
    g = g.withColumn("_left", F.col("_rest") - F.aggregate("_out", F.lit(0).cast("long"), lambda a, x: a + F.when(x["extra"], x["size"]).otherwise(0)))
    small = F.col("source_size") - F.col("_of")
    off = lambda r: F.when(r < 0, -r).when(r > small, r - small).otherwise(0.0)  # noqa: E731  how far from the target, small documents given
    best = F.array_min(F.transform(F.filter("_out", lambda x: ~x["extra"] & (x["size"] > 0)), lambda x: F.struct(off(F.col("_left") - x["size"]).alias("off"), x["size"].alias("size"), x["c"].alias("c"))))
    g = g.withColumn("_best", F.when(best["off"] < off(F.col("_left")), best))
    after = lambda x: x.withField("extra", x["extra"] | F.coalesce((x["c"] == F.col("_best.c")) & (x["size"] == F.col("_best.size")), F.lit(False)))
    rows = g.select(*source, "_of", "_part", F.explode(F.transform("_out", after)).alias("x"))
    return rows.select("x.doc_id", "x.row_hash", "x.size", *source, F.col("_of").cast("long").alias("_of"), F.col("_part").cast("double").alias("_part"), F.col("x.c").cast("long").alias("_c"), F.col("x.extra").alias("_extra"))


def due(share, slope):
    """Where in training, 0 to 1, a source has had this share of its demand: the inverse of the integral (1 + a) t - a t ** 2 of its
    schedule 1 + a - 2 a t, in the form that stays exact for small a."""
    up = 1 + slope
    return 2 * share / (up + F.sqrt(F.greatest(up * up - 4 * slope * share, F.lit(0.0))))


def positions(d: DataFrame) -> DataFrame:
    """Copy k of a document is due where k rounds of its source's demand, and what comes before it in this round, are met."""
    f = F.col("target") / F.col("source_size")
    share = lambda k: (k + F.col("_c") / F.col("_of")) / f
    # The last round is shorter: its documents share what is left of the demand in the same order.
    last = (F.col("_rounds") + (f - F.col("_rounds")) * F.least(F.col("_c") / F.greatest(F.col("_part"), F.lit(1.0)), F.lit(1.0))) / f
    at = lambda y: due(y, F.col("_slope"))
    copies = F.array(*(F.when(F.lit(k) < F.col("_rounds"), at(share(k))) for k in range(CAP)), F.when(F.col("_extra"), at(last)))
    d = d.withColumn("positions", F.when(F.col("size") > 0, F.filter(copies, lambda x: x.isNotNull())).otherwise(F.array().cast("array<double>")))
    return d.withColumn("taken", F.size("positions") * F.col("size"))


def in_order(places: DataFrame) -> DataFrame:
    """placed() range-sorted by where in training each document is first due; those that never are come last, ties by doc_id, nulls first."""
    return places.orderBy(F.asc_nulls_last("first_position"), "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents in training order, each as often as it is due, with docs' columns only, whatever their names.

    Ties of positions are in order of doc_id, nulls first. Documents without words, null texts included, are never due and go. Rows
    equal in id and text share their class's places, each as many as the others or one more. Empty table: no rows.
    """
    places = common.checkpoint(placed(docs).select("row_hash", "positions"))
    repeated = common.checkpoint(places.groupBy("row_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    key = F.xxhash64(F.lit("order"), "doc_id", "text").alias("_key")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key)
    # Most rows are alone in their class; those that aren't are numbered, as are their places, by parts, so that no part is large.
    alone = places.join(repeated.select("row_hash"), "row_hash", "left_anti")
    at = d.join(alone, F.col("_key") == F.col("row_hash")).select("_doc", "positions")
    if not repeated.isEmpty():  # else texts needn't be shuffled once more
        at = at.unionByName(repeats(d, places, repeated))
    at = at.select("_doc", F.explode("positions").alias("_at"))
    return at.repartitionByRange("_at", "_doc.doc_id").sortWithinPartitions("_at", "_doc.doc_id").select("_doc.*")


def repeats(d: DataFrame, places: DataFrame, repeated: DataFrame) -> DataFrame:
    """_doc, positions of the rows that share their class with others."""
    same = numbered(common.checkpoint(d.join(repeated, F.col("_key") == F.col("row_hash"), "left_semi")), "_key")
    of = numbered(common.checkpoint(places.join(repeated.select("row_hash"), "row_hash", "left_semi")), "row_hash")
    return same.join(of.withColumnRenamed("_number", "_at"), (F.col("_key") == F.col("row_hash")) & (F.col("_number") == F.col("_at"))).select("_doc", "positions")


def numbered(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """Rows of a table, which reads the same each time, numbered from 0 within each key: in parts, then shifted by the parts before."""
    d = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.pmod("_row", F.lit(parts)).cast("int"))
    per = d.groupBy(F.col(key).alias("_of"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = per.select("_of", "_p", (F.sum("_c").over(Window.partitionBy("_of").orderBy("_p")) - F.col("_c")).alias("_before"))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_part").orderBy("_row")) - 1)
    d = d.join(before, (F.col(key) == F.col("_of")) & (F.col("_part") == F.col("_p")))
    return d.withColumn("_number", F.col("_in") + F.col("_before")).drop("_row", "_part", "_of", "_p", "_before", "_in")
