"""Toxicity by weak supervision.

1. Many voters: terms (words, and prefixes of words, for inflected forms) that a bounded sample of labelled rows associates with
   toxic texts, and fixed patterns.
2. A generative label model, fitted by EM: how often each voter fires given either class, and how voters hang together beyond what the
   class explains. In each round the correlations are estimated anew from the posterior, and a voter's evidence counts the less the
   more it repeats others': c copies of a voter count as one. The given label is one more voter whose accuracy is estimated.
3. A linear classifier, trained on the posterior labels, scores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evseq.llm import common
from evseq.llm.licenses import WORD_BYTES

#: Labelled rows that the model is fitted on at most, chosen by hash over all of them: the bound of the sample.
SAMPLE_ROWS = 20_000
#: What of the sample's terms votes, and with it the model's size, which every worker holds: the best so many, by log-odds times the root
#: of the number of toxic rows; each in so many toxic rows and with such log-odds at least. They bound the classifier, not the corpus.
MOST_VOTERS, LEAST_TOXIC, LEAST_ODDS = 400, 3, 2.0
PREFIXES = (4, 5, 6)
#: Correlations within so many standard errors of none count as none.
NOISE = 4.0
#: Rows of the sample that numpy multiplies at once.
ROWS_AT_ONCE = 2000
#: Fixed patterns, on lower-cased text.
PATTERNS = [rb"\b[a-z]+\*{2,}[a-z]*\b", rb"\b(?:you|u) (?:are|r) (?:a |an |such |so )?[a-z]+", rb"!{3,}", rb"\b(?:shut up|go away|hate you)\b"]
#: Terms for a table without labels.
SEEDS = [b"idiot", b"moron", b"stupid", b"scum", b"loser", b"worthless", b"pathetic", b"disgusting"]


def terms(text: bytes) -> set[bytes]:
    """Words as they are, and longer words' prefixes, marked by a `-`."""
    found = set(text.translate(WORD_BYTES).split())
    return found.union([w[:n] + b"-" for w in found for n in PREFIXES if len(w) > n])


def fires(text: bytes) -> list[int]:
    low = text.translate(common.LOWER_ASCII)
    return [k for k, p in enumerate(PATTERNS) if re.search(p, low)]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and toxic of at most `most` labelled rows that are not held out, by hash of id and text; of a doc_id with several
    labels, the greatest. Rows equal in id and text are one; null ids and labels are left out."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Of the labels' ids those that documents have: labels may cover far more.
    n = y.join(docs.select("doc_id"), "doc_id", "left_semi").count()
    if n > most:  # somewhat more than wanted, so that what the limit below sorts is as small
        y = y.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 60)) < int((1 << 60) * min(1.0, 1.5 * most / n)))
    rows = docs.select("doc_id", "text").join(y, "doc_id").withColumn("_h", F.xxhash64("text"))
    # Ids and hashes alone are ordered; an id that stands a million times gives no more rows than others may.
    chosen = rows.select("doc_id", "_h").distinct().orderBy(F.xxhash64(F.lit("sample"), "doc_id", "_h"), "doc_id", "_h").limit(most)
    return rows.join(chosen, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"]).select("doc_id", "text", "toxic")


def choose_terms(rows: DataFrame, n_toxic: int, n_clean: int) -> list[bytes]:
    def counted(batch: pa.RecordBatch) -> dict:
        counts: dict[bytes, list[int]] = {}
        for text, y in zip(common.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            for t in terms(text):
                counts.setdefault(t, [0, 0])[1 if y == 1 else 0] += 1
        return {"term": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    c = common.map_rows(rows.select("text", "toxic"), counted, "term binary, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    best = c.where(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return [bytes(r["term"]) for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(MOST_VOTERS).collect()]


def correlations(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of voters, given the class (positive ones discount votes; voters that avoid each other count in full): of what is left of votes when each class's mean is taken away, rows weighted by the posterior q."""
    on = np.stack([(v.T @ r) / max(r.sum(), 1e-9) for r in (1 - q, q)]).astype(np.float32)
    both = np.column_stack([1 - q, q]).astype(np.float32)
    rest = np.zeros((v.shape[1], v.shape[1]))
    for i in range(0, len(v), ROWS_AT_ONCE):
        part = v[i : i + ROWS_AT_ONCE] - both[i : i + ROWS_AT_ONCE] @ on
        rest += part.T @ part
    sd = np.sqrt(np.diag(rest)) + 1e-9
    return rest / sd[:, None] / sd[None, :]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row. votes: rows by voters, 0 or 1; given: 0 or 1, the label as one more voter, the last.

    The likelihood of a row is that of its votes, each to the power 1 / (1 + the voter's correlations with others, given the class):
    what voters say in common counts once. The given label isn't made from the text, so it repeats none of them and counts whole;
    its errors are estimated like theirs. Rates, correlations and posteriors are estimated in turn.
    """
    v = np.column_stack([votes, given]).astype(np.float32)
    q = np.clip(given.astype(np.float64), 0.05, 0.95)
    on, share, rho = [], np.ones(v.shape[1]), np.eye(votes.shape[1])
    for k in range(rounds):
        if k % 4 == 0:
            rho = correlations(v[:, :-1], q)
            real = np.where(rho > NOISE / np.sqrt(max(len(v), 1)), rho, 0.0)
            np.fill_diagonal(real, 1.0)
            share = np.r_[1 / real.sum(axis=1), 1.0]
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        on = [np.clip((v.T @ r + 0.1) / (r.sum() + 0.2), 1e-6, 1 - 1e-6) for r in (1 - q, q)]
        evidence = v @ (share * (np.log(on[1]) - np.log(on[0]))) + (1 - v) @ (share * (np.log1p(-on[1]) - np.log1p(-on[0])))
        q = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -30, 30)))
    return q, {"prior": float(q.mean()), "fires": on, "correlation": rho, "share": share}


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the bias, unpenalised, is last."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    w = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = np.diag(pull + 1e-9)
        for i in range(0, len(x), ROWS_AT_ONCE):
            part = x[i : i + ROWS_AT_ONCE].astype(np.float64)
            bend += (part * (p * (1 - p))[i : i + ROWS_AT_ONCE, None]).T @ part
        step = np.linalg.solve(bend, x.T @ (q - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    voters: dict[bytes, int]
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        z = self.weights[-1]
        known = self.voters
        for t in terms(text):
            if (k := known.get(t)) is not None:
                z += self.weights[k]
        for k in fires(text):
            z += self.weights[len(known) + k]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Fitted in one task from the voters' marks of at most `most` rows; texts stay where they are, and only weights come to the driver.
    Without rows of both classes: SEEDS, each of which alone gives a score over one half. Order and repeats of rows don't matter."""
    rows = common.checkpoint(training_rows(docs, labels, most))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic = n.get(1, 0)
    n_clean = sum(n.values()) - n_toxic
    chosen = choose_terms(rows, n_toxic, n_clean) if n_toxic and n_clean else []
    if not chosen:
        return Model({t: k for k, t in enumerate(SEEDS)}, np.r_[np.full(len(SEEDS), 4.0), np.zeros(len(PATTERNS)), -3.0])
    voters = {t: k for k, t in enumerate(chosen)}

    def marks(batch: pa.RecordBatch) -> dict:
        out = [sorted({voters[t] for t in terms(x) if t in voters} | {len(voters) + k for k in fires(x)}) for x in common.texts(batch.column(1))]
        return {"doc_id": batch.column(0), "toxic": batch.column(2), "marks": out}

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        x = np.zeros((len(table), len(voters) + len(PATTERNS)), np.float32)
        for i, m in enumerate(table["marks"].to_pylist()):
            x[i, m] = 1
        q, _ = label_model(x, np.array([int(y == 1) for y in table["toxic"].to_pylist()]))
        return pa.table({"weights": pa.array([linear(x, q)], pa.list_(pa.float64()))})

    got = common.map_rows(rows, marks, "doc_id long, toxic int, marks array<int>").withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fitted, "weights array<double>").first()
    return Model(voters, np.array(got["weights"]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null or empty text: the score of a text in which no voter fires. A null
    doc_id counts as not held out. Rows are independent; the model's size is bounded by MOST_VOTERS."""
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> dict:
        m = sent.value
        s = [m.score(t) for t in common.texts(batch.column(2))]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": [int(x >= 0.5) for x in s]}

    return common.map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), one, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, columns as they are; null and empty texts are kept, and repeated rows stay or go
    alike. Empty table: no rows."""
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        common.occupy(__name__)
        for batch in batches:
            keep = pa.array([sent.value.score(t) < 0.5 for t in common.texts(batch.column(at))], type=pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
