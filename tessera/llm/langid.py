"""Language identification by hyperdimensional profiles.

Every character has a random vector of +-1 (seeded by its code point). A trigram's vector binds (multiplies) its
characters' vectors, permuted by their place; a text's vector bundles (adds) those of all its trigrams; a language's
prototype bundles its training texts, each at unit length. A text is compared with the prototypes by cosine.

Characters are lower-cased letters; every run of others counts as one blank, and trigrams of a text that has a letter
are taken over the text with a blank at either end. Trigrams are kept as hashes with their vectors in a small cache per
task and added a slice at a time, so memory grows neither with the corpus nor with the trigrams of one text; prototypes
are sums over tasks, one row per language and task.

Learned from rows whose crc32(doc_id) mod 5 is not 0 and whose lang isn't null. Defined results: a null text, or one
without a letter, is ``und`` with score 0; so is every text where nothing could be learned; the score is the cosine
with the best prototype, cut at 0; ties go to the first language by name; rows that share a doc_id are scored
separately; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, documents

NAME = "op6_language"
DIMENSIONS = 256
SEED = 6
CACHE = 50_000  # trigram vectors a task keeps; others are made again at each text
SLICE = 8192  # vectors added at once
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"


class Vectors:
    """Trigram vectors by a 63-bit code of three code points: a table of those met first, the others made when needed."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED, cache: int = CACHE):
        self.dimensions, self.seed, self.cache = dimensions, seed, cache
        self.places: dict[int, int] = {}
        self.letters = np.zeros((3, 0, dimensions), np.int8)  # as the first, second and third of a trigram
        self.codes, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted codes and their rows of the table
        self.table = np.zeros((0, dimensions), np.float32)

    def _letters(self, c: np.ndarray) -> np.ndarray:
        """Places of code points among the letters; new ones are added."""
        kinds, at = np.unique(c, return_inverse=True)
        new = [int(x) for x in kinds if int(x) not in self.places]
        if new:
            bits = np.stack([np.random.default_rng((self.seed, x)).integers(0, 2, self.dimensions) for x in new])
            own = (2 * bits - 1).astype(np.int8)
            self.letters = np.concatenate([self.letters, np.stack([np.roll(own, 2, 1), np.roll(own, 1, 1), own])], axis=1)
            self.places.update({x: len(self.places) + i for i, x in enumerate(new)})
        return np.array([self.places[int(x)] for x in kinds], np.int64)[at]

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        at = self._letters(np.concatenate([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF])).reshape(3, -1)
        return (self.letters[0, at[0]] * self.letters[1, at[1]] * self.letters[2, at[2]]).astype(np.float32)

    def _known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes have a row, and the rows of those."""
        if not len(self.codes):
            return np.zeros(len(codes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return known, self.rows[at[known]]

    def bundle(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct codes, n times each; SLICE vectors at a time."""
        known, rows = self._known(codes)
        new = codes[~known][: max(0, self.cache - len(self.codes))]
        if len(new):
            size = len(self.codes) + len(new)
            if size > len(self.table):
                more = np.zeros((min(self.cache, max(1024, 2 * size)), self.dimensions), np.float32)
                more[: len(self.codes)] = self.table[: len(self.codes)]
                self.table = more
            for i in range(0, len(new), SLICE):
                part = new[i : i + SLICE]
                self.table[len(self.codes) + i : len(self.codes) + i + len(part)] = self._bound(part)
            at = np.searchsorted(self.codes, new)
            self.rows = np.insert(self.rows, at, np.arange(len(self.codes), size))
            self.codes = np.insert(self.codes, at, new)
            known, rows = self._known(codes)
        out, count = np.zeros(self.dimensions, np.float32), n.astype(np.float32)
        own, rest, rest_count = count[known], codes[~known], count[~known]
        for i in range(0, len(rows), SLICE):
            out += own[i : i + SLICE] @ self.table[rows[i : i + SLICE]]
        for i in range(0, len(rest), SLICE):
            out += rest_count[i : i + SLICE] @ self._bound(rest[i : i + SLICE])
        return out


class _Fold(dict):
    """str.translate table: letters stay, everything else is a blank."""

    def __missing__(self, c: int) -> int:
        self[c] = out = c if chr(c).isalpha() else 32
        return out


_fold = _Fold()


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams; none for a text without a letter."""
    text = " ".join((text or "").lower().translate(_fold).split())
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def bundle(text: str | None, vectors: Vectors) -> np.ndarray | None:
    codes = trigrams(text)
    if not len(codes):
        return None
    codes, n = np.unique(codes, return_counts=True)
    return vectors.bundle(codes, n)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes of all languages in docs (text, lang); sums of unit bundles, added up over the tasks."""

    def partial(batches):
        vectors, sums = Vectors(), {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                v = bundle(text.as_py(), vectors)
                if v is not None:
                    norm = np.linalg.norm(v)
                    if norm > 0:
                        key = lang.as_py()
                        sums[key] = sums.get(key, 0) + v.astype(np.float64) / norm
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": [s.tolist() for s in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    learned = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(partial, "lang string, v array<double>")
    added = learned.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.lang):
        v = np.array([e.x for e in r.v])
        if np.linalg.norm(v) > 0:
            out[r.lang] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


def predict(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """docs with the columns lang_pred and score."""
    names = list(learned)
    matrix = np.stack(list(learned.values())) if learned else np.zeros((0, DIMENSIONS), np.float32)

    def scored(batches):
        vectors = Vectors()
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text"):
                v = bundle(text.as_py(), vectors) if names else None
                norm = 0.0 if v is None else float(np.linalg.norm(v))
                if norm > 0:
                    cosine = matrix @ v / norm
                    best = int(np.argmax(cosine))
                    pred.append(names[best])
                    score.append(min(1.0, max(0.0, float(cosine[best]))))
                else:
                    pred.append(UNKNOWN)
                    score.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "lang_pred string", "score double"])
    return kept.mapInArrow(scored, schema)


def identify(docs: DataFrame) -> DataFrame:
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    learned = prototypes(docs.where(~held))
    return predict(docs.select("doc_id", "text"), learned).select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


ORACLE_SQL = None
