"""Vocabularies, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.operators.ranks import row_index

#: Longest word that is looked up.
MOST_CHARS = 1000


def tokens(seqs: DataFrame, column: str = "event_tokens") -> DataFrame:
    return seqs.select(F.explode(column).alias("token")).where("token is not null").distinct()


def vocabulary(words: DataFrame, special: list[str], tasks: list[str] = ()) -> DataFrame:
    """id, token, kind: special tokens, then words in order, then task tokens; each token once, ids without gaps."""
    from functools import reduce

    spark = words.sparkSession
    fixed = lambda names, kind, tier: spark.createDataFrame([(tier, i, n, kind) for i, n in enumerate(names)], "tier int, pos int, token string, kind string")
    parts = [fixed(special, "special", 0), words.select(F.lit(1).alias("tier"), F.lit(0).alias("pos"), "token", F.lit("word").alias("kind"))] + ([fixed(tasks, "task", 2)] if tasks else [])
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("token").agg(F.min(F.struct("tier", "pos", "kind")).alias("at"))
    first = first.select(F.col("at.tier").alias("tier"), F.col("at.pos").alias("pos"), "token", F.col("at.kind").alias("kind"))
    return row_index(first, ["tier", "pos", "token"], "id").select(F.col("id").cast("int").alias("id"), "token", "kind")


def reversed_words(words: DataFrame) -> DataFrame:
    """id, token: each token once, in reverse order of code points, as the columns of a frequency matrix; nulls are left out."""
    d = words.where("token is not null").select("token").distinct()
    n = row_index(d, ["token"], "_at")
    last = d.agg(F.count(F.lit(1)).alias("_n"))
    return n.crossJoin(F.broadcast(last)).select((F.col("_n") - 1 - F.col("_at")).cast("int").alias("id"), "token")  # one row


def token_maps(vocab: DataFrame, labels: DataFrame) -> DataFrame:
    """id, token, label: each token of the vocabulary with the label of its code, or of the code before a bin's ending, or itself.
    labels: code, label, of any size; of a code that stands twice, the least label."""
    of = labels.groupBy("code").agg(F.min("label").alias("label"))
    d = vocab.select("id", "token", F.regexp_extract("token", r"^(.*?)(_\d)$", 1).alias("base"), F.regexp_extract("token", r"^(.*?)(_\d)$", 2).alias("ending"))
    d = d.join(of.select(F.col("code").alias("base"), F.col("label").alias("of_base")), "base", "left").join(of.select(F.col("code").alias("token"), F.col("label").alias("of_token")), "token", "left")
    return d.select("id", "token", F.coalesce(F.when(F.col("ending") != "", F.concat("of_base", "ending")), "of_token", "token").alias("label"))


def encoded(seqs: DataFrame, vocab: DataFrame, key: str = "subject_id", column: str = "event_tokens", unknown: str = "[UNK]") -> DataFrame:
    """key and ids; rows of one key are one. Empty and null arrays have no ids; a null token is an unknown one. A token that isn't in a
    vocabulary without the unknown token is an error."""
    return encoded_rows(seqs.select(key, F.posexplode_outer(column).alias("pos", "token")), vocab, key, unknown)


def encoded_rows(rows: DataFrame, vocab: DataFrame, key: str = "subject_id", unknown: str = "[UNK]") -> DataFrame:
    """encoded() of tokens in long form: key, pos, token; a null pos stands for a key without tokens. Tokens are joined, so the vocabulary
    may be of any size; Spark broadcasts a small one. Tokens of over MOST_CHARS characters are unknown."""
    unk = vocab.where(F.col("token") == unknown).agg(F.min("id").alias("_unk"))  # one row, null if there is no such token
    e = rows.select(key, "pos", F.when(F.length("token") <= MOST_CHARS, F.col("token")).alias("token"))
    e = e.join(vocab.select("id", "token"), "token", "left").crossJoin(F.broadcast(unk))
    id_ = F.coalesce("id", "_unk", F.raise_error(F.lit(f"the vocabulary has no {unknown}")).cast("int"))
    ids = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", id_.alias("id")))))
    return e.groupBy(key).agg(F.transform(ids, lambda x: x["id"]).alias("ids"))


def words_of(text: str) -> F.Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def decoded(ids: DataFrame, vocab: DataFrame, key: str = "subject_id") -> DataFrame:
    """key and tokens; rows of one key are one. Empty and null ids have no tokens, an id that the vocabulary lacks, or a null one, is a null
    token. Empty table: no rows."""
    e = ids.select(key, F.posexplode_outer("ids").alias("pos", "id")).join(vocab.select("id", "token"), "id", "left")
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "token")))), lambda x: x["token"]).alias("tokens"))


def concept_types(seqs: DataFrame, key: str = "subject_id") -> DataFrame:
    """token and the type it has where it comes first: the first row by key, the first place in it. Null tokens are one; rows with null or
    empty arrays count for nothing. Empty table: no rows."""
    e = seqs.select(key, F.posexplode(F.arrays_zip("event_tokens", "type_tokens")).alias("pos", "x"))
    return concept_types_of(e.select(key, "pos", F.col("x.event_tokens").alias("token"), F.col("x.type_tokens").alias("type")), key)


def concept_types_of(rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """concept_types() of key, pos, token, type in long form."""
    return rows.groupBy("token").agg(F.min_by("type", F.struct(key, "pos")).alias("type"))


def save(vocab: DataFrame, types: DataFrame, path: str, **settings) -> None:
    """A tokenizer: tokens and types as tables, settings as one row of JSON."""
    spark = vocab.sparkSession
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    types.write.mode("overwrite").parquet(f"{path}/types")
    spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def load(spark, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    settings = spark.read.schema("name string, value string").json(f"{path}/settings").collect()  # a handful of rows
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/types"), {r["name"]: r["value"] for r in settings}
