"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are the hashed words of a text (runs of letters, lower-cased, present or not). A bounded sample of labelled
rows (``SAMPLE`` of either class, by hash of doc_id) fits the model: words that tell the classes apart by their
log-odds are kept, at most ``WORDS``. Severity grades: 0 for toxic = 0; toxic rows are graded 1 to 3 by how many of
the words most indicative of toxicity they hold (one, two or three, more). One weight vector serves all thresholds:
P(grade > k) = sigmoid(w x - b_k) with b_0 < b_1 < b_2. The score is the expected severity; toxic is P(grade > 0) >= 0.5.

Every whole text is scored. Defined results: a null text is an empty one; without labels of both classes nothing is
toxic and every severity is 0; null labels are left out; rows that share a doc_id are scored separately; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytekit
from tessera.llm.common import documents, stored

NAME = "op8_toxicity"
SAMPLE = 8_000  # labelled rows of either class
WORDS = 2_048
BUCKETS = 1 << 20
GRADES = 4
CUTS = (2, 4)  # indicative words from which a toxic row has grade 2, 3
SUPPORT, LOG_ODDS, STEPS, PENALTY = 8, 2.0, 300, 1e-4
STRENGTH = 6.0  # least |log-odds| * sqrt(rows with the word) of a kept word: rarer or weaker ones are noise

_INSIDE = np.zeros(256, bool)
_INSIDE[ord("a") : ord("z") + 1] = True
_INSIDE[128:] = True


def word_ids(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word of a chunk."""
    raw = bytekit.lowered(raw)
    start, end, doc = bytekit.words(raw, at, _INSIDE[raw])
    return (bytekit.Spans(raw)(start, end) & np.uint64(BUCKETS - 1)).astype(np.int64), doc


class Model:
    """Kept buckets with their weights, and the ordered thresholds."""

    def __init__(self, buckets=(), weights=(), thresholds=(30.0, 31.0, 32.0)):
        self.buckets, self.weights, self.thresholds = np.asarray(buckets, np.int64), np.asarray(weights, float), np.asarray(thresholds, float)

    def margins(self, ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        if not len(self.buckets) or not len(ids):
            return np.zeros(n_docs)
        place = np.minimum(np.searchsorted(self.buckets, ids), len(self.buckets) - 1)
        known = self.buckets[place] == ids
        pair = np.unique(doc[known] * len(self.buckets) + place[known])
        return np.bincount(pair // len(self.buckets), weights=self.weights[pair % len(self.buckets)], minlength=n_docs)

    def over(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, one row per document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -40, 40)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, ids): distinct word buckets of the sampled labelled rows."""
    y = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    by_hash = [y.where(F.col("y") == c).orderBy(F.xxhash64("_id", F.lit(8)), "_id").limit(SAMPLE) for c in (0, 1)]
    # at most 2 * SAMPLE ids of a few bytes
    chosen = F.broadcast(stored(by_hash[0].union(by_hash[1]), "toxicity-sample"))

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches):
            ids, doc = word_ids(raw, at)
            pair = np.unique(doc * BUCKETS + ids)
            cut = np.searchsorted(pair, np.arange(len(at)) * BUCKETS)
            yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array([(pair[a:b] % BUCKETS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32()))], names=["y", "ids"])

    return docs.join(chosen, docs["doc_id"] == chosen["_id"]).select("y", "text").mapInArrow(run, "y int, ids array<int>")


def telling(sampled: DataFrame) -> DataFrame:
    """The sampled rows with those of their buckets only that fit can keep: at most WORDS kinds, so that what goes to the
    driver is bounded however long the texts are."""
    n, toxic = sampled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    each = sampled.select("y", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.ln((F.col("t") + 0.5) / (toxic + 1)) - F.ln((F.col("n") - F.col("t") + 0.5) / (n - toxic + 1))
    strength = F.abs(odds) * F.sqrt("n")
    # a little below what fit asks for, as its logarithms are its own
    able = each.withColumn("s", strength).where((F.col("n") >= SUPPORT) & (F.col("s") >= STRENGTH - 1e-6))
    kept = np.sort(np.array([r.id for r in able.orderBy(F.desc("s"), "id").limit(WORDS).collect()], np.int32))

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, of = ids.flatten().to_numpy(), np.repeat(np.arange(len(batch)), np.diff(ids.offsets.to_numpy()))
            known = np.isin(flat, kept)
            cut = np.searchsorted(of[known], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat[known]))], names=["y", "ids"])

    return sampled.mapInArrow(run, "y int, ids array<int>")


def fit(rows: list) -> Model:
    """rows: (y, bucket array) of the sample."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes()))
    y = np.array([r[0] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model()
    ids = np.concatenate([r[1] for r in rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    buckets, place = np.unique(ids, return_inverse=True)
    in_toxic = np.bincount(place, weights=y[row], minlength=len(buckets))
    in_all = np.bincount(place, minlength=len(buckets))
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_all - in_toxic + 0.5) / (len(y) - y.sum() + 1))
    strength = np.abs(odds) * np.sqrt(in_all)
    able = np.flatnonzero((in_all >= SUPPORT) & (strength >= STRENGTH))
    kept = np.sort(able[np.argsort(-strength[able], kind="stable")][:WORDS])
    if not len(kept):
        return Model()
    to = np.full(len(buckets), -1)
    to[kept] = np.arange(len(kept))
    use = to[place] >= 0
    row, col = row[use], to[place[use]]
    indicative = (odds[kept] >= LOG_ODDS) & (in_toxic[kept] >= SUPPORT)
    hits = np.bincount(row, weights=indicative[col], minlength=len(rows))
    grade = np.where(y == 1, 1 + (hits >= CUTS[0]) + (hits >= CUTS[1]), 0)
    # all thresholds share the weights; steps of Adam on the likelihood of every "grade > k"
    w, b, gaps = np.zeros(len(kept)), 0.0, np.zeros(GRADES - 2)
    moments = [np.zeros(len(kept) + GRADES - 1), np.zeros(len(kept) + GRADES - 1)]
    target = (grade[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for step in range(1, STEPS + 1):
        thresholds = b + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        margin = np.bincount(row, weights=w[col], minlength=len(rows))
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - margin[:, None], -40, 40)))
        e = (p - target) * weight[:, None]
        g_w = np.bincount(col, weights=e.sum(1)[row], minlength=len(kept)) + PENALTY * w
        g_t = -e.sum(0)
        g_gaps = np.array([g_t[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)])
        g = np.concatenate([g_w, [g_t.sum()], g_gaps])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.999 * moments[1] + 0.001 * g * g
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, b, gaps = w - move[: len(kept)], b - move[len(kept)], gaps - move[len(kept) + 1 :]
    return Model(buckets[kept], w, b + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (likeliest), p_toxic and toxic of every document."""
    sampled = stored(sample(docs.select("doc_id", "text"), labels), "toxicity-words")
    model = fit([(r.y, np.array(r.ids, np.int32)) for r in telling(sampled).toLocalIterator()])

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches):
            over = model.over(model.margins(*word_ids(raw, at), len(at) - 1))
            each = np.concatenate([np.ones((len(over), 1)), over], axis=1) - np.concatenate([over, np.zeros((len(over), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(over.sum(1)), pa.array(each.argmax(1).astype(np.int32)), pa.array(over[:, 0]), pa.array(over[:, 0] >= 0.5)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = None
