"""Token counts and pooled vectors, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.functions import arrays
from evseq.operators.ranks import dealt, parts, row_index


def frequencies(seqs: DataFrame, key: str = "subject_id", column: str = "event_tokens", without: list[str] = ()) -> DataFrame:
    """key, token, n: how often a key's arrays have each token; null tokens are left out, rows of one key are added up.

    Tokens are counted inside each row first, and a row travels as one, by its key, with each token once; rows of a key are added up where
    they meet, in parts that don't grow with the files.
    """
    wanted = lambda x: x.isNotNull() & ~x.isin(list(without)) if without else x.isNotNull()
    d = seqs.select(key, F.sort_array(F.filter(column, wanted)).alias("_sorted"))
    at = F.sequence(F.lit(0), F.size("_sorted") - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))
    d = d.where(F.size("_sorted") > 0).withColumn("_first", first)
    counts = F.transform("_first", lambda i, k: F.coalesce(F.get("_first", k + 1), F.size("_sorted")) - i)
    d = d.select(key, F.transform("_first", lambda i: F.get("_sorted", i)).alias("token"), counts.alias("n"))
    n = parts(seqs)
    d = dealt(d, n, key) if n else d.repartition(key)
    return d.select(key, F.explode(F.arrays_zip("token", "n")).alias("x")).groupBy(key, F.col("x.token").alias("token")).agg(F.sum("x.n").alias("n"))


def document_frequencies(freq: DataFrame, key: str = "subject_id") -> DataFrame:
    """token, n_docs, n_total of frequencies()."""
    return freq.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_total"))


def top_features(freq: DataFrame, k: int = 20_001) -> DataFrame:
    """The k tokens in most documents; ties by token."""
    return document_frequencies(freq).orderBy(F.desc("n_docs"), "token").limit(k)


def frequent_features(freq: DataFrame, least: int) -> DataFrame:
    """Tokens in `least` documents or more."""
    return document_frequencies(freq).where(F.col("n_docs") >= least)


def age_span(seqs: DataFrame) -> DataFrame:
    """min_age, the least positive age, and max_age of each row; 0 where there is none."""
    return seqs.withColumns({"min_age": arrays.min_positive("age_tokens"), "max_age": F.coalesce(F.array_max("age_tokens"), F.lit(0))})


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives for each positive; without positives, the negatives. Other labels and nulls count for nothing. One row always."""
    return df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("weight"))


def masked_mean(df: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """key, dim, value: the mean over rows with mask 1; 0 without any."""
    e = df.select(key, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    return e.groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("value"))


def attribution_by_type(df: DataFrame, types: str = "type_tokens", scores: str = "scores", absolute: bool = True) -> DataFrame:
    """Sum of attributions of each type over the number of rows."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    e = df.select(F.explode(F.arrays_zip(F.col(types).alias("t"), F.col(scores).alias("s"))).alias("x")).select("x.t", "x.s")
    s = F.abs("s") if absolute else F.col("s")
    return e.groupBy(F.col("t").alias("type")).agg(F.sum(s).alias("_sum")).crossJoin(F.broadcast(n)).select("type", (F.col("_sum") / F.col("_n")).alias("mean"))


def top_elements(df: DataFrame, key: str, matrix: str, k: int) -> DataFrame:
    """key, i, j, value of the k greatest elements of all rows' matrices; ties by key, i, j; nulls last."""
    e = df.select(key, F.posexplode(matrix).alias("i", "row")).select(key, "i", F.posexplode("row").alias("j", "value"))
    return e.orderBy(F.desc("value"), key, "i", "j").limit(k)


def feature_index(tokens: DataFrame) -> DataFrame:
    """id and token of the columns of a matrix, from 0, in order of code points; each token once, nulls left out. Made once, of the training
    rows, it is the same for every table that is encoded by it."""
    d = tokens.where("token is not null").select("token").distinct()
    return row_index(d, ["token"], "id").select(F.col("id").cast("int").alias("id"), "token")


def sparse_rows(freq: DataFrame, index: DataFrame, keys: DataFrame, key: str = "subject_id", dense: tuple[str, ...] = ()) -> DataFrame:
    """Compressed rows, one for each of keys: key, size, indices (ascending) and values, none of which is 0.

    freq: key, token, n; index: feature_index(). keys: each key once, with the dense columns, which stand behind the tokens; a null is 0.
    Tokens that the index lacks have no column, keys without tokens have their dense columns alone, and keys of freq that keys lacks no row.
    Empty table of keys: no rows.
    """
    n = index.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("_n"))  # one row
    cells = freq.join(index, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", F.col("n").cast("double").alias("value")))).alias("_cells"))
    d = keys.select(key, *dense).join(cells, key, "left").crossJoin(F.broadcast(n))
    own = F.array(*[F.struct((F.col("_n") + i).alias("id"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for i, c in enumerate(dense)])
    every = F.coalesce("_cells", F.array().cast("array<struct<id:int,value:double>>"))
    d = d.withColumn("_all", F.filter(F.concat(every, own) if dense else every, lambda x: x["value"] != 0))
    return d.select(key, (F.col("_n") + len(dense)).alias("size"), F.transform("_all", lambda x: x["id"]).alias("indices"), F.transform("_all", lambda x: x["value"]).alias("values"))


def long_rows(rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """key, id, value of each cell of sparse_rows() that isn't 0."""
    return rows.select(key, F.explode(F.arrays_zip("indices", "values")).alias("x")).select(key, F.col("x.indices").alias("id"), F.col("x.values").alias("value"))
