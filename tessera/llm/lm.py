"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, normalised, over whole texts.

Tokens are lower-cased (A-Z) words of non-blanks and an end after each text. All training texts are counted: every
distinct token has its count, as a table that grows with the corpus. The neural model speaks ``SYMBOLS`` symbols: the
commonest tokens and the end have their own, all others share one of ``ENDINGS`` symbols by their last two bytes, within
which a token's probability is (count + 1) over the symbol's tokens, kinds and one for what was never seen. A token's
context is the symbol before it, the end at a text's start. How often each symbol follows each is summed over all training
texts into one bounded table; noise-contrastive estimation fits the log-bilinear parameters to the whole table (numpy, on
the driver): each step takes the expected gradient over all its counts and all noise, nothing is drawn; then batched matrix
products give the normalised log-probabilities of all symbols in all contexts, and texts are scored by looking them up.

Counts of the ``FREQUENT`` commonest tokens are sent to the tasks; those of the others meet their occurrences in one
shuffle, pre-aggregated by text. Learned from rows whose crc32(doc_id) mod 7 is not 2. Defined results: a null text is
empty, its only token the end; rows that share a doc_id are scored separately; an empty table gives no rows; nothing to
learn from gives every token the base's probability for the unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytekit
from tessera.llm.common import crc_mod, documents, release, stored

NAME = "op9_lm_score"
FOLDS, HELD_OUT = 7, 2
OWN, ENDINGS = 2047, 256
SYMBOLS = OWN + 1 + ENDINGS  # the commonest tokens, the end, endings
END = OWN
FREQUENT = 100_000
DIMENSIONS, NOISE, STEPS, RATE, SEED = 24, 10, 200, 0.2, 9
PRIOR = 64  # occurrences below which a parameter is held back; their share vanishes as the corpus grows
END_HASH = -1  # stands for the end among token hashes


def tokens(raw: np.ndarray, at: np.ndarray):
    """(hash, ending, document) of every word and, last in each text, the end; in order."""
    raw = bytekit.lowered(raw)
    start, end, doc = bytekit.words(raw, at)
    n_docs = len(at) - 1
    h = bytekit.Spans(raw)(start, end).view(np.int64)
    h[h == END_HASH] = 0
    ending = (raw[end - 1].astype(np.int64) * 31 + np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0).astype(np.int64) * 17) % ENDINGS
    place = np.arange(len(h)) + doc
    out = [np.full(len(h) + n_docs, v, np.int64) for v in (END_HASH, 0, 0)]
    out[0][place], out[1][place] = h, ending
    sizes = np.bincount(doc, minlength=n_docs) + 1
    out[2][:] = np.repeat(np.arange(n_docs), sizes)
    return out[0], out[1], out[2], sizes


class Symbols:
    """Own symbols of the commonest tokens; the rest by ending."""

    def __init__(self, commonest: np.ndarray):
        self.order = np.argsort(commonest)
        self.sorted = commonest[self.order]

    def __call__(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = OWN + 1 + ending
        if len(self.sorted):
            place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            known = self.sorted[place] == h
            out = np.where(known, self.order[place], out)
        return np.where(h == END_HASH, END, out)


def contexts(symbol: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The context of each token: the symbol before; before a text stands an end."""
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return before


def counted(docs: DataFrame) -> DataFrame:
    """(h, ending, c): every distinct token of docs with its count."""

    def run(batches):
        for _, raw, at in bytekit.chunks(batches):
            h, ending, _, _ = tokens(raw, at)
            u, i, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(ending[i].astype(np.int32)), pa.array(n)], names=["h", "ending", "c"])

    return docs.select("text").mapInArrow(run, "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


def transitions(docs: DataFrame, symbols: Symbols) -> np.ndarray:
    """How often each symbol follows each context in docs; bounded, summed over the tasks."""

    def run(batches):
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for _, raw, at in bytekit.chunks(batches):
            h, ending, _, sizes = tokens(raw, at)
            s = symbols(h, ending)
            np.add.at(total, contexts(s, sizes) * SYMBOLS + s, 1)
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 100_000].astype(np.int32)), pa.array(total[cell[i : i + 100_000]])], names=["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS * SYMBOLS)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS)


def train(follows: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context), one normalised row a context.

    score(w | c) = (R[c] * A) . Q[w] + b[w], fitted to tell the corpus from draws of the unigram distribution, by the exact
    expectation over both.
    """
    rng = np.random.default_rng(SEED)
    unigram = follows.sum(0) + 0.5
    unigram /= unigram.sum()
    r, q = rng.normal(0, 0.1, (SYMBOLS, DIMENSIONS)), rng.normal(0, 0.1, (SYMBOLS, DIMENSIONS))
    r, q, a, b = (x.astype(np.float32) for x in (r, q, np.ones(DIMENSIONS), np.log(unigram)))
    total = follows.sum()
    if total > 0:
        seen = np.flatnonzero(follows.sum(1))
        true = (follows[seen] / total).astype(np.float32)
        both = true + (NOISE * (follows[seen].sum(1, keepdims=True) / total) * unigram).astype(np.float32)
        shift = np.log(NOISE * unigram).astype(np.float32)
        squares = [np.full(x.shape, (PRIOR / total) ** 2) for x in (r, q, a, b)]
        for _ in range(STEPS):
            context = r[seen] * a
            z = context @ q.T + (b - shift)
            e = both / (1 + np.exp(-np.clip(z, -30, 30))) - true
            d_context = e @ q
            grads = [np.zeros_like(r), e.T @ context, (d_context * r[seen]).sum(0), e.sum(0)]
            grads[0][seen] = d_context * a
            for x, s, d in zip((r, q, a, b), squares, grads, strict=True):
                s += d.astype(float) ** 2
                x -= (RATE * d / np.sqrt(s)).astype(np.float32)
    out = np.empty((SYMBOLS, SYMBOLS), np.float32)
    for i in range(0, SYMBOLS, 256):  # a block of contexts a time
        z = (r[i : i + 256] * a) @ q.T + b
        z -= z.max(1, keepdims=True)
        out[i : i + 256] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = given.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = stored(counted(learned), "lm-counts")
    release(spark)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    base_total = total + kinds + 1
    top = counts.where(F.col("h") != END_HASH).orderBy(F.desc("c"), "h").limit(FREQUENT).select("h", "c").toArrow()
    end_count = (counts.where(F.col("h") == END_HASH).agg(F.sum("c")).first()[0]) or 0
    common_h, common_c = (top.column(x).to_numpy() for x in ("h", "c"))
    symbols = Symbols(common_h[:OWN])
    own = [int(x) for x in common_h[:OWN]]
    shared = counts.where((F.col("h") != END_HASH) & ~F.col("h").isin(own or [0])).groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    within = np.ones(ENDINGS)
    for x in shared:
        within[x.ending] = x.n + x.k + 1
    table = spark.sparkContext.broadcast(train(transitions(learned, symbols)))
    order = np.argsort(common_h)
    known = spark.sparkContext.broadcast((common_h[order], common_c[order]))
    schema = "doc_id long, row long, n_tokens long, n_known long, base double, model double, rest array<struct<h:long,n:int>>"

    def run(batches):
        from pyspark import TaskContext

        h_known, c_known = known.value
        log_p = table.value.ravel()
        row = TaskContext.get().partitionId() << 40
        log_within = np.log10(within)
        for rows, raw, at in bytekit.chunks(batches):
            h, ending, doc, sizes = tokens(raw, at)
            s = symbols(h, ending)
            model = log_p[contexts(s, sizes) * SYMBOLS + s].astype(float)
            count = np.zeros(len(h), np.int64)
            count[h == END_HASH] = end_count
            found = h == END_HASH
            if len(h_known):
                place = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
                hit = h_known[place] == h
                count[hit] = c_known[place[hit]]
                found |= hit
            shared_symbol = s > END
            # a token of a shared symbol: its symbol's share, by its count where that is known here already
            model -= np.where(shared_symbol, log_within[np.maximum(s - END - 1, 0)], 0)
            model += np.where(shared_symbol & found, np.log10(count + 1), 0)
            base = np.where(found, np.log10(count + 1), 0) - np.log10(base_total)
            n_docs = len(sizes)
            sums = [np.bincount(doc, weights=x, minlength=n_docs) for x in ((found & (count > 0)).astype(float), base, model)]
            late = np.flatnonzero(~found)
            key = np.lexsort((h[late], doc[late]))
            late_h, late_doc = h[late][key], doc[late][key]
            new = np.flatnonzero(np.concatenate([[True], (late_h[1:] != late_h[:-1]) | (late_doc[1:] != late_doc[:-1])])) if len(late) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(late)))
            cut = np.searchsorted(late_doc[new], np.arange(n_docs + 1))
            inner = pa.StructArray.from_arrays([pa.array(late_h[new]), pa.array(n.astype(np.int32))], names=["h", "n"])
            rest = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), inner)
            ids = row + np.arange(n_docs)
            row += n_docs
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids), pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest], names=["doc_id", "row", "n_tokens", "n_known", "base", "model", "rest"])

    first = stored(given.mapInArrow(run, schema), "lm-first")
    late = first.select("row", F.explode("rest").alias("t")).select("row", "t.h", "t.n")
    # rare tokens only, so no key is hot
    gained = late.join(counts.select("h", "c"), "h").select("row", "n", (F.col("n") * F.log10(F.col("c") + 1)).alias("g"))
    gained = gained.groupBy("row").agg(F.sum("g").alias("g"), F.sum("n").alias("more"))
    out = first.drop("rest").join(gained, "row", "left")
    g = F.coalesce("g", F.lit(0.0))
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + g).alias("base_score"),
        (F.col("model") + g).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


ORACLE_SQL = None
