"""Media columns: chroma audio fingerprints, and alignment of recordings by them.

PCM audio is cut into overlapping frames; the spectrum of each gives the energy of the twelve pitch classes. Sixteen
filters, read off an integral image over (frame, pitch class), compare areas of up to ``WIDEST`` frames; each gives two
Gray-coded bits, so every frame has a packed 32-bit integer. Two recordings are aligned by the histogram of offsets
between equal integers; at the best offset the share of different bits over the overlap is their bit error.

Recordings with equal fingerprints are one class, so that copies are compared once. Queries meet all classes in a join
on the integers, each class counting an integer once an offset; candidates need ``SHARED`` equal integers at one
offset, then the bit error decides. A class whose integers are all frequent is found like any other: nothing is capped.

The query op5 has no recordings to read, so it makes them: a vector of ``embeddings`` is played as a melody, one note a
component. Defined results: null audio, or audio shorter than WIDEST frames, has an empty fingerprint, its own class
by vec_id, and aligns with nothing; rows that share a vec_id are fingerprinted separately; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored

NAME = "op5_audio"
RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0
FILTERS, WIDEST = 16, 16
SHARED, ERROR = 3, 0.2
TILE = 64
QUERY_EVERY = 50
NOTE = 512  # samples of a note of a rendered melody

_hz = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_hz >= LOWEST) & (_hz <= HIGHEST))
_class = np.round(12 * np.log2(_hz[_used] / 440.0)).astype(int) % 12
_FOLD = np.zeros((len(_used), 12))
_FOLD[np.arange(len(_used)), _class] = 1
_WINDOW = np.hanning(FRAME)


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Pitch-class energies, one unit row a frame."""
    n = (len(pcm) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    out = []
    for i in range(0, n, 4096):  # bounded memory for long recordings
        at = HOP * np.arange(i, min(n, i + 4096))
        spectrum = np.abs(np.fft.rfft(pcm[at[:, None] + np.arange(FRAME)] * _WINDOW, axis=1))[:, _used]
        out.append((spectrum**2) @ _FOLD)
    energy = np.concatenate(out)
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


def _filters():
    """(kind, first pitch class, height, width) by rule: four kinds over four widths, places spread over the octave."""
    for k in range(FILTERS):
        height = 4 + 2 * (k % 3)
        yield k % 4, (5 * k) % (13 - height), height, WIDEST * (k // 4 + 1) // 4


def fingerprint(pcm: np.ndarray) -> np.ndarray:
    """One uint32 a frame position with WIDEST frames from it."""
    c = chroma(pcm)
    n = len(c) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(c) + 1, 13))
    integral[1:, 1:] = c.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(left, right, low, high):
        return integral[t + right, high] - integral[t + left, high] - integral[t + right, low] + integral[t + left, low]

    out = np.zeros(n, np.uint32)
    for kind, low, height, width in _filters():
        high, middle, half = low + height, low + height // 2, width // 2
        if kind == 0:
            a, b = area(0, width, low, high), area(0, width, 0, 12) - area(0, width, low, high)
        elif kind == 1:
            a, b = area(0, width, low, middle), area(0, width, middle, high)
        elif kind == 2:
            a, b = area(0, half, low, high), area(half, width, low, high)
        else:
            a = area(0, half, low, middle) + area(half, width, middle, high)
            b = area(0, half, middle, high) + area(half, width, low, middle)
        level = np.searchsorted([-0.35, 0.0, 0.35], np.log((1 + a) / (1 + b)))
        out = (out << np.uint32(2)) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(offset of b's start in a, bit error over the overlap) at the commonest offset of equal integers."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    if not (hi > lo).any():
        return 0, 1.0
    i = np.repeat(np.arange(len(a)), hi - lo)
    j = order[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi, strict=True) if y > x])]
    offsets, n = np.unique(i - j, return_counts=True)
    offset = int(offsets[np.argmax(n)])
    return offset, bit_error(a, b, offset)


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    m = min(len(x), len(y))
    return float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m) if m else 1.0


def melody(vector) -> bytes:
    """A vector as 16-bit PCM: one note a component, its pitch by the component's size."""
    v = np.asarray([0.0 if x is None else x for x in vector], float)
    v = np.nan_to_num(v / max(1e-9, np.abs(v).max()) if len(v) else v)
    pitch = 220.0 * 2 ** (np.round(18 * (v + 1) / 2) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(pitch, NOTE)) / RATE
    return (12000 * np.sin(phase)).astype(np.int16).tobytes()


def fingerprinted(media: DataFrame, key: str = "id", audio: str = "audio") -> DataFrame:
    """(key, codes): fingerprints of binary 16-bit mono PCM at RATE."""

    def run(batches):
        for batch in batches:
            codes = [fingerprint(np.frombuffer(x.as_py() or b"", np.int16, count=len(x.as_py() or b"") // 2).astype(float)).astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    return media.select(F.col(key).cast("long").alias("id"), audio).mapInArrow(run, "id long, codes array<long>")


def rendered(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, audio): a media column made from vectors."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([melody(x) if x is not None else None for x in part.column(1).to_pylist()], pa.binary())], names=["id", "audio"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id long, audio binary")


def _best_offsets(batches):
    """Rows (print, pos, places) sorted by print -> for each query met in SHARED integers at one offset, that offset:
    the commonest, then the one nearest to 0."""
    now, counts = None, Counter()

    def result():
        best = {}
        for (q, offset), n in counts.items():
            if q != now and n >= SHARED:
                best[q] = max(best.get(q, (0, 0, 0)), (n, -abs(offset), offset))
        rows = sorted(best.items())
        return pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.string()), pa.array([now] * len(rows), pa.string()), pa.array([x[2] for _, x in rows], pa.int32())], names=["q", "print", "offset"])

    for batch in batches:
        for p, pos, places in zip(batch.column("print").to_pylist(), batch.column("pos").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if p != now:
                if now is not None:
                    yield result()
                now, counts = p, Counter()
            counts.update((x["q"], x["at"] - pos) for x in places)
    if now is not None:
        yield result()


def search(prints: DataFrame, is_query) -> DataFrame:
    """prints (id, codes) -> (id, cls, n_queries, best_query, best_offset, best_error), one row a row. Queries are the
    classes with a row for which ``is_query`` holds; a class doesn't count itself."""
    empty = F.size("codes") == 0
    p = prints.withColumn("print", F.when(empty, F.concat(F.lit("id:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.sha2(F.to_json("codes").cast("binary"), 256)))
    p = stored(p, "audio-prints")
    classes = stored(p.groupBy("print").agg(F.min("id").alias("cls"), F.max(is_query).alias("asks"), F.first("codes").alias("codes")), "audio-classes")
    # each integer once a class and place; what all share meets only the queries
    spread = classes.where(F.size("codes") > 0).select("print", "asks", F.posexplode("codes").alias("pos", "code"))
    asked = spread.where("asks").select(F.col("print").alias("q"), F.col("pos").alias("at"), "code")
    # places of the queries by integer, in lists of about TILE, so that a pair of recordings isn't a row for each integer
    tiles = asked.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    tiled = asked.join(tiles, "code").withColumn("tile", F.pmod(F.xxhash64("q", "at"), F.col("tiles")))
    listed = tiled.groupBy("code", "tile").agg(F.collect_list(F.struct("q", "at")).alias("places"))
    n = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = spread.select("print", "pos", "code").join(listed, "code").select("print", "pos", "places").repartition(n, "print").sortWithinPartitions("print")
    best = met.mapInArrow(_best_offsets, "q string, print string, offset int")
    both = best.join(classes.select(F.col("print").alias("q"), F.col("cls").alias("query"), F.col("codes").alias("x")), "q").join(classes.select("print", F.col("codes").alias("y")), "print")

    def errors(batches):
        for batch in batches:
            e = [bit_error(np.array(x, np.int64), np.array(y, np.int64), o) for x, y, o in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("query"), batch.column("offset"), pa.array(e, pa.float64())], names=["print", "query", "offset", "error"])

    links = both.select("print", "query", "offset", "x", "y").mapInArrow(errors, "print string, query long, offset int, error double").where(F.col("error") <= ERROR)
    per = links.groupBy("print").agg(F.count(F.lit(1)).alias("n_queries"), F.min(F.struct("error", "query", "offset")).alias("b"))
    out = p.select("id", "print").join(classes.select("print", "cls"), "print").join(per, "print", "left")
    return out.select("id", "cls", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), F.col("b.query").alias("best_query"), F.col("b.offset").alias("best_offset"), F.round("b.error", 6).alias("best_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = fingerprinted(rendered(vectors, "vec_id", "embedding"))
    return search(prints, F.coalesce(F.col("id") % QUERY_EVERY == 0, F.lit(False))).withColumnRenamed("id", "vec_id")


ORACLE_SQL = None
