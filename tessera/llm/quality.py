"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics of each whole text (lengths, shares of character classes, repetition of words and lines) are standardised with
partition-summed moments. Random Fourier features approximate a Gaussian kernel over them; the normal equations are
summed over partitions cell by cell and solved once (``FEATURES`` squared cells, whatever the corpus). A fifth of the
labelled rows, by hash, is kept from the fit: its scores, counted by bin and label, give the isotonic calibration
(pool adjacent violators over ``BINS`` bins), read off by linear interpolation.

Learned from rows of ``labels`` whose crc32(doc_id) mod 3 is not 1; label, lang, source and doc_id are no inputs.
Defined results: a null text is an empty one and is scored like any other; null labels are left out; with no or one
class of labels every score is that class's share (0.5 without labels); a label given twice counts twice; rows that share
a doc_id are scored separately; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytekit
from tessera.llm.common import crc_mod, documents, stored

NAME = "op4_quality"
FEATURES, SEED, RIDGE, BINS = 256, 4, 1e-3, 400
FOLDS, HELD_OUT = 3, 1

# fixed classes of bytes: lower, upper, digit, blank, line end, full stop or comma, bar, symbol, exclamation, other, beyond ASCII
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "|", "#$%&*@=<>\\^~{}[]", "!?")
_LUT = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _LUT[np.frombuffer(_chars.encode(), np.uint8)] = _i
_LUT[128:] = len(_CLASSES) + 1
N_CLASSES = len(_CLASSES) + 2


def _repetition(raw, spans, at, inside):
    """Per document: units, distinct share, share of the commonest, share equal to the one before, mean length."""
    start, end, doc = bytekit.words(raw, at, inside)
    n_docs = len(at) - 1
    n = np.bincount(doc, minlength=n_docs).astype(np.float64)
    h = spans(start, end)
    _, first, count = np.unique(bytekit.mixed(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, doc[first], count)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[1:][same], minlength=n_docs)
    length = np.bincount(doc, weights=(end - start), minlength=n_docs)
    one = np.maximum(n, 1)
    return n, distinct / one, top / one, again / one, length / one


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics per document of a chunk."""
    n_docs = len(at) - 1
    size = np.diff(at).astype(np.float64)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(at))
    shares = np.bincount(doc * N_CLASSES + _LUT[raw], minlength=n_docs * N_CLASSES).reshape(n_docs, N_CLASSES) / np.maximum(size, 1)[:, None]
    spans = bytekit.Spans(raw)
    w = _repetition(raw, spans, at, None)
    lines = _repetition(raw, spans, at, raw != 10)
    columns = [np.log1p(size), np.log1p(w[0]), *w[1:4], np.log1p(w[4]), np.log1p(lines[0]), *lines[1:4], np.log1p(lines[4])]
    return np.concatenate([np.stack(columns, 1), np.sqrt(shares)], axis=1)


N_STATISTICS = 11 + N_CLASSES


def described(docs: DataFrame) -> DataFrame:
    """doc_id, f (statistics) of every document."""

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(statistics(raw, at)), pa.list_(pa.float64()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f array<double>")


class Model:
    """Standardisation, Fourier features, weights and calibration."""

    def __init__(self, mean, scale, seed: int = SEED):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(seed)
        p = len(mean)
        self.w = rng.normal(0, 1 / np.sqrt(p), (p, FEATURES - 1))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES - 1)
        self.weights, self.x, self.y = np.zeros(FEATURES), np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(f), 1))], axis=1)

    def raw(self, f: np.ndarray) -> np.ndarray:
        return self.features(f) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        r = self.raw(f)
        # a trace of the raw score orders what one isotonic step holds
        return np.clip(0.99 * np.interp(r, self.x, self.y) + 0.01 * np.clip(r, 0, 1), 0, 1)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, N_STATISTICS))


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to ones / n, weighted by n: pool adjacent violators."""
    blocks: list[list[float]] = []
    for i in range(len(n)):
        blocks.append([ones[i], n[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, k, m = blocks.pop()
            blocks[-1][0] += o
            blocks[-1][1] += k
            blocks[-1][2] += m
    return np.concatenate([np.full(int(m), o / k) for o, k, m in blocks])


def fit(labelled: DataFrame) -> Model:
    """labelled: f, y (0 or 1), calibrate (boolean)."""
    moments = labelled.where(~F.col("calibrate")).select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
    for r in moments:
        mean[r.i], scale[r.i] = r.m, max(r.s or 0.0, 1e-6)
    model = Model(mean, scale)

    def sums(batches):
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column("f")))
            total += z.T @ np.concatenate([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "x"])

    cells = labelled.where(~F.col("calibrate")).select("f", "y").mapInArrow(sums, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(FEATURES * (FEATURES + 1))
    for r in cells:
        total[r.cell] = r.x
    total = total.reshape(FEATURES, FEATURES + 1)
    rows = total[-1, -2]  # the constant feature's square, summed
    if not rows:
        return model
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * rows * np.eye(FEATURES) / FEATURES, total[:, -1])
    share = total[-1, -1] / rows
    model.x, model.y = np.array([0.0, 1.0]), np.array([share, share])
    if share in (0.0, 1.0):
        model.weights = np.zeros(FEATURES)
        model.weights[-1] = share
        return model

    def binned(batches):
        for batch in batches:
            r = np.clip((model.raw(_matrix(batch.column("f"))) + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r), batch.column("y")], names=["bin", "y"])

    counts = labelled.where("calibrate").select("f", F.col("y").cast("double").alias("y")).mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    if counts:
        n, ones = np.array([c.n for c in counts], float), np.array([c.ones for c in counts], float)
        model.x = (np.array([c.bin for c in counts]) + 0.5) * 2 / BINS - 0.5
        model.y = isotonic(n, ones)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    f = stored(described(docs), "quality-statistics")
    y = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    y = y.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    labelled = stored(f.join(y, "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0), "quality-labelled")
    model = fit(labelled)

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column("f")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = f.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = None
