"""Repeated passages by prefix doubling over sampled suffixes.

A passage is ``LENGTH`` = 2 * ``HALF`` bytes. Doubling ranks positions by their first HALF bytes, drops those whose rank
is unique, pairs each rank with the rank HALF bytes on and reranks: the pair is the rank of LENGTH bytes, and there the
threshold is reached. Ranks are names (64-bit hashes of the bytes): equal ranks stand for equal bytes, which is all that
deduplication asks of the order.

Sorting every position would cost many times the corpus, so round one sorts a sample that loses nothing: every LENGTH-byte
window elects the position whose HALF-byte rank has the least hash, the leftmost if several have; equal windows elect
the same place. Each elected position comes with the stretch of windows that elected it and that stretch's hash.
Spark sorts (rank, stretch, document): where the whole stretch is also in a document with a smaller id, all its windows
are repeats. Where one rank has several different stretches, only some of their windows may repeat. A window that holds a
rank's bytes also holds the ``SIDE`` bytes before them or those after them, so only the windows of a side that another
stretch of the rank has as well (of each stretch's smallest document) go to round two; a rank that only one stretch has
is unique and drops out. Round two sorts those parts of stretches by (rank and side, document), their bytes with them, a
row a part, and makes and compares the windows after the shuffle: a window is first where its least document has it.
Before the sort of round one, every task
settles repeats among its own documents and passes on one row a stretch, so a passage that a third of all documents
share becomes a few rows a task; a stretch that comes again within a document is an alias of its first place there and
shares its fate; round one takes the ranks in ``PASSES`` parts, by hash, so that its shuffle holds one part at a time; equal texts are settled first: all but the first of them is a repeat from end to end.
A rank and side that more than ``HELD`` rows have is not held by one task: its windows are sorted by the rank pair (rank
here, rank HALF bytes on), each row on its own.

Defined results: a null text is empty; texts shorter than LENGTH keep everything; only a smaller doc_id counts, so rows
that share a doc_id don't remove from each other; a null doc_id is smaller than none and removes nothing, and loses
what any other has; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bytekit
from tessera.llm.common import discard, documents, mapped, release
from tessera.llm.common import stored_by_python as stored

NAME = "op3_suffix_dedup"
HALF = 25
LENGTH = 2 * HALF
PASSES = 2
SIDE = (LENGTH - HALF + 1) // 2
HELD = 50_000  # rows of one rank, or of one rank and side, that a task looks through; a larger group goes on whole
STEP = 8_000  # rows whose windows are compared at once
CHUNK = 1 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id: after all others


def ranks(raw: np.ndarray) -> tuple[bytekit.Spans, np.ndarray]:
    """Hashes of stretches, and the rank of HALF bytes at every position that has as many."""
    spans = bytekit.Spans(raw)
    return spans, spans.every(HALF)


def elected(rank: np.ndarray, at: np.ndarray):
    """(document, first window, windows, elected position) of every stretch of windows with one elected position."""
    n = len(rank) - HALF  # windows of a chunk, those across documents included
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = np.uint64((1 << 24) - 1)
    least = (rank & ~low) | (np.arange(len(rank)).astype(np.uint64) & low) if len(rank) <= 1 << 24 else None
    if least is None:
        # a very long document: order by hash, then by place, without packing both
        order = np.lexsort((np.arange(len(rank)), rank & ~low))
        least = np.empty(len(rank), np.uint64)
        least[order] = np.arange(len(rank)).astype(np.uint64)
    # the least of HALF + 1 = 26 neighbours, by doubling
    key, width = least, 1
    while 2 * width <= HALF + 1:
        key, width = np.minimum(key[:-width], key[width:]), 2 * width
    rest = HALF + 1 - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    place = (key & low).astype(np.int64) if len(rank) <= 1 << 24 else order[key.astype(np.int64)]
    # a stretch ends where the place changes, at a document's first window, and after its last whole one
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    for edge in (at[:-1], np.maximum(at[:-1], at[1:] - LENGTH + 1)):
        new[edge[edge < n]] = True
    new = np.flatnonzero(new)
    count = np.diff(np.append(new, n))
    doc = np.searchsorted(at, new, side="right") - 1
    whole = new + LENGTH <= at[doc + 1]
    new, count, doc = new[whole], count[whole], doc[whole]
    return doc, new, count, place[new]


_ROW = "rank long, stretch int, doc long, start long, meta long, kind int"
_OUT = "doc long, start long, windows int, tid int, kind int, head long"
LIVE, COVERED, ALIAS = 0, 1, 2
_NONE = 0xFFFF  # a side that has too few bytes in its document


def _batch(columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])


def _settled_batch(columns, kind: int) -> pa.RecordBatch:
    rank, _, doc, start, meta = columns[:5]
    return _settled_rows(doc, start, meta & 63, meta >> 6 & 0xFFFF, kind, rank if kind == ALIAS else rank * 0)


def _settled_rows(doc, start, windows, tid, kind: int, head) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(start), pa.array(windows.astype(np.int32)), pa.array(tid.astype(np.int32)), pa.array(np.full(len(doc), kind, np.int32)), pa.array(head)], names=[x.split()[0] for x in _OUT.split(", ")]
    )


def _stretches(texts: DataFrame, part: int) -> DataFrame:
    """Round one's rows of one part of the ranks: what is settled within a chunk (covered), aliases (their rank is the
    head's start), and one live row a stretch of each chunk. meta packs the
    number of windows, 16 bits of the text's id, 16 bits of the bytes before and after the rank's, and the rank's place
    after the first window's."""

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            spans, rank = ranks(raw)
            d, first, count, place = elected(rank, at)
            own = (rank[place] >> np.uint64(5)) % np.uint64(PASSES) == part
            d, first, count, place = d[own], first[own], count[own], place[own]
            if not len(d):
                continue
            ids = rows.column("doc").to_numpy()[d]
            tid = rows.column("tid").to_numpy()[d].astype(np.int64)
            left, right = place - SIDE, place + HALF + SIDE
            sides = []
            for ok, a, b in ((left >= at[d], np.maximum(left, 0), place), (right <= at[d + 1], place + HALF, np.minimum(right, len(raw)))):
                h = (spans(a, np.maximum(a, b)) >> np.uint64(49)).astype(np.int64)
                sides.append(np.where(ok, h, _NONE))
            meta = count | tid << 6 | sides[0] << 22 | sides[1] << 38 | (place - first) << 54
            r = rank[place].view(np.int64)
            s = (spans(first, first + count - 1 + LENGTH) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            # brings equal (r, s) together, by doc, and keeps the order of places; a chance tie only costs a row
            order = np.lexsort((ids, r + s * np.int64(0x2545F4914F6CDD1D)))
            columns = [c[order] for c in (r, s, ids, first - at[d], meta)]
            r, s, ids, start, meta = columns
            d = d[order]
            head = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])
            again = ids > ids[np.flatnonzero(head)][np.cumsum(head) - 1]
            first_here = head | np.concatenate([[True], d[1:] != d[:-1]])
            alias = ~again & ~first_here
            live = ~again & first_here
            yield _batch([*(c[live] for c in columns), np.full(live.sum(), LIVE)])
            short = meta & ((1 << 22) - 1)
            for kind, which, key in ((COVERED, again, r * 0), (ALIAS, alias, start[np.flatnonzero(first_here)][np.cumsum(first_here) - 1])):
                if which.any():
                    yield _batch([key[which], s[which] * 0, ids[which], start[which], short[which], np.full(which.sum(), kind)])

    return texts.select("doc", "tid", "text").mapInArrow(run, _ROW)


def _alike(columns) -> list[np.ndarray]:
    """Which of the open rows share their rank and the side before it with another row, and which the side after it."""
    rank, meta = columns[0], columns[4]
    sides = []
    for shift in (22, 38):
        out = np.zeros(len(rank), bool)
        side = meta >> shift & 0xFFFF
        order = np.lexsort((side, rank))
        same = (rank[order][1:] == rank[order][:-1]) & (side[order][1:] == side[order][:-1]) & (side[order][1:] != _NONE)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        sides.append(out)
    return sides


def _open(columns, alike):
    """The windows of open rows that hold a side marked in alike, a row a side; head is the rank's place after the start."""
    _, _, doc, start, meta = columns
    count, place = meta & 63, meta >> 54
    left = np.clip(place - SIDE + 1, 0, count)  # the first windows hold the side before the rank, the others the one after it
    for keep, skip, windows in ((alike[0] & (left > 0), left * 0, left), (alike[1] & (left < count), left, count - left)):
        if keep.any():
            yield _settled_rows(doc[keep], (start + skip)[keep], windows[keep], (meta >> 6 & 0xFFFF)[keep], LIVE, (place - skip)[keep])


def _settled(sorted_rows: DataFrame) -> DataFrame:
    """Sorted by (rank, stretch, doc): covered rows, and parts of open ones whose rank has several stretches (those of each
    stretch's least document). State between batches: the last row, and the open rows of the current rank."""

    def run(batches):
        rank_now = stretch_now = least_now = None
        held, several_now, whole = [], False, False  # open rows of the current rank; whether it has several stretches

        def given(columns, all_of_them):
            every = np.ones(len(columns[0]), bool)
            yield from _open(columns, [every, every] if all_of_them else _alike(columns))

        def joined(parts):
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            kind = columns[5]
            for k in (COVERED, ALIAS):
                if (kind == k).any():
                    yield _settled_batch([c[kind == k] for c in columns], k)
            columns = [c[kind == LIVE] for c in columns[:5]]
            r, s, d = columns[:3]
            if not len(r):
                continue
            new_rank = np.concatenate([[rank_now is None or r[0] != rank_now], r[1:] != r[:-1]])
            new_stretch = new_rank | np.concatenate([[s[0] != stretch_now], s[1:] != s[:-1]])
            # group 0 continues the last batch's rank and stretch
            group = np.cumsum(new_stretch)
            least = np.concatenate([[d[0] if least_now is None else least_now], d[new_stretch]])[group]
            covered = d > least
            if covered.any():
                yield _settled_batch([c[covered] for c in columns], COVERED)
            of_rank = np.cumsum(new_rank)
            last = of_rank[-1]
            stretches = np.bincount(of_rank[new_stretch], minlength=last + 1)
            several = stretches > 1
            several[0] = several_now or (rank_now is not None and stretches[0] > 0) or stretches[0] > 1
            mine = of_rank == 0
            if mine.any():
                held.append([c[mine & ~covered] for c in columns])
            if last > 0:
                if several[0] and held:
                    yield from given(joined(held), whole)
                middle = ~covered & ~mine & several[of_rank] & (of_rank < last)
                if middle.any():
                    yield from given([c[middle] for c in columns], False)
                held, whole = [[c[~covered & (of_rank == last)] for c in columns]], False
            several_now = bool(several[last])
            if several_now and sum(len(x[0]) for x in held) > HELD:
                yield from given(joined(held), True)
                held, whole = [], True
            rank_now, stretch_now, least_now = r[-1], s[-1], least[-1]
        if several_now and held:
            yield from given(joined(held), whole)

    return mapped(sorted_rows, run, _OUT)


_PART = "key long, doc long, tid int, start long, body binary"
_FOUND = "doc long, start long, windows int, tid int, body binary"


def _parts(texts: DataFrame) -> DataFrame:
    """Round two's rows: every open part of a stretch with its bytes, which have LENGTH - 1 more than windows. The key is a
    hash of the rank's bytes and those of the side that all its windows hold."""

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            spans = bytekit.Spans(raw)
            open_ = rows.column("open")
            of, flat = np.repeat(np.arange(len(rows)), np.diff(open_.offsets.to_numpy())), open_.flatten()
            start, count, head = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "windows", "head"))
            size = count - 1 + LENGTH
            fits = start + size <= np.diff(at)[of]  # rows that share a doc_id may share a tid as well
            of, start, size, head = of[fits], start[fits], size[fits], head[fits]
            begin = at[of] + start
            left = begin + head - np.where(head >= SIDE, SIDE, 0)
            key = spans(left, left + HALF + SIDE).view(np.int64)
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cut), pa.py_buffer(raw[_each(begin, size)])])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(rows.column(c).take(pa.array(of)) for c in ("doc", "tid")), pa.array(start), body], names=["key", "doc", "tid", "start", "body"])

    return texts.mapInArrow(run, _PART)


def _bodies(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all bodies on end, where each window starts in them, its row, its place in the row's body)."""
    body = rows.column("body")
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    _, raw, at = next(bytekit.chunks([pa.RecordBatch.from_arrays([body], names=["text"])], limit=1 << 62))
    windows = np.diff(at) - LENGTH + 1
    row = np.repeat(np.arange(len(windows)), windows)
    begin = _each(at[:-1], windows)
    return raw, begin, row, begin - at[row]


def _compared(sorted_parts: DataFrame) -> DataFrame:
    """Sorted by (key, doc): stretches of windows that a smaller document has as well, without a body. Rows of a key that
    more than HELD rows have come back as they are, with theirs. State between batches: the rows not compared yet."""

    def settled(rows):
        raw, begin, row, place = _bodies(rows)
        name = bytekit.Spans(raw)(begin, begin + LENGTH)
        key, doc = (rows.column(c).to_numpy() for c in ("key", "doc"))
        order = np.argsort(name, kind="stable")  # equal windows have one key, whose documents ascend
        new = np.ones(len(order), bool)
        new[1:] = (name[order][1:] != name[order][:-1]) | (key[row[order]][1:] != key[row[order]][:-1])
        first = doc[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        covered = np.zeros(len(order) + 1, bool)
        covered[order] = doc[row[order]] > first
        inner = np.concatenate([[False], row[1:] == row[:-1], [False]])  # goes on from the window before it
        begins, ends = np.flatnonzero(covered[:-1] & ~(inner[:-1] & np.roll(covered, 1)[:-1])), np.flatnonzero(covered[:-1] & ~(inner[1:] & covered[1:])) + 1
        of = row[begins]
        if len(of):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[of]), pa.array(rows.column("start").to_numpy()[of] + place[begins]), pa.array((ends - begins).astype(np.int32)), pa.array(rows.column("tid").to_numpy()[of]), pa.nulls(len(of), pa.binary())],
                names=["doc", "start", "windows", "tid", "body"],
            )

    def passed(rows):
        for b in rows.select(["doc", "start", "tid", "body"]).to_batches(max_chunksize=STEP):
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("start"), pa.array(np.zeros(len(b), np.int32)), b.column("tid"), b.column("body")], names=["doc", "start", "windows", "tid", "body"])

    def run(batches):
        held, hot = None, None
        for batch in batches:
            if not len(batch):
                continue
            batch = pa.Table.from_batches([batch])
            held = batch if held is None else pa.concat_tables([held, batch])
            if len(held) < STEP:
                continue
            key = held.column("key").to_numpy()
            cut, last = int(np.searchsorted(key, key[-1])), key[-1]
            out, held = held.slice(0, cut), held.slice(cut)
            if hot is not None and cut:
                n = int(np.searchsorted(key[:cut], hot, side="right"))
                yield from passed(out.slice(0, n))
                out = out.slice(n)
            if len(out):
                yield from settled(out)
            if hot is not None and hot != last:
                hot = None
            if len(held) > HELD or hot is not None:
                yield from passed(held)
                held, hot = None, last
        if held is not None:
            n = int(np.searchsorted(held.column("key").to_numpy(), hot, side="right")) if hot is not None else 0
            yield from passed(held.slice(0, n))
            if n < len(held):
                yield from settled(held.slice(n))

    return mapped(sorted_parts.select("key", "doc", "tid", "start", "body"), run, _FOUND)


def _windows(parts: DataFrame) -> DataFrame:
    """The rank pair of every window."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw, begin, row, place = _bodies(batch)
            _, rank = ranks(raw)
            doc, tid, start = (batch.column(c).to_numpy()[row] for c in ("doc", "tid", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(rank[begin].view(np.int64)), pa.array(rank[begin + HALF].view(np.int64)), pa.array(doc), pa.array(start + place), pa.array(tid)], names=["a", "b", "doc", "start", "tid"])

    return mapped(parts, run, "a long, b long, doc long, start long, tid int")


def _by_pairs(parts: DataFrame) -> DataFrame:
    """What _compared finds, for keys of any number of rows: windows are sorted by their rank pair."""
    pairs = stored(_windows(parts.select("doc", "tid", "start", "body")), "suffix-pairs")
    least = stored(pairs.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).select("a", "b", "first"), "suffix-least")
    found = stored(pairs.join(least, ["a", "b"]).where(F.col("doc") > F.col("first")).select("doc", "start", F.lit(1).alias("windows"), "tid"), "suffix-second")
    discard(pairs, least)
    return found


def _each(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch."""
    return np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _kept(texts: DataFrame) -> DataFrame:
    """What is left of every text: whole marks repeats from end to end, spans has the covered stretches of the others."""

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            n, size = len(raw), np.diff(at)
            hit = np.zeros(n, bool)  # windows by their start
            whole = np.flatnonzero(rows.column("whole").to_numpy(zero_copy_only=False).astype(bool) & (size >= LENGTH))
            hit[_each(at[whole], size[whole] - LENGTH + 1)] = True
            spans = rows.column("spans")
            of, flat = np.repeat(np.arange(len(size)), np.diff(spans.offsets.to_numpy())), spans.flatten()
            s, w, h = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "windows", "head"))
            fits = s + w - 1 + LENGTH <= size[of]  # rows that share a doc_id may share a tid as well
            base, s, w, h = at[of][fits], s[fits], w[fits], h[fits]
            direct = h < 0
            hit[_each((base + s)[direct], w[direct])] = True
            # heads are no aliases themselves
            of_alias, of_head = _each((base + s)[~direct], w[~direct]), _each((base + h)[~direct], w[~direct])
            hit[of_alias[hit[of_head]]] = True
            gone = np.zeros(n + 1, np.int32)
            gone[:n] = hit
            if n >= LENGTH:
                gone[LENGTH:] -= hit[: n + 1 - LENGTH]
            removed = np.cumsum(gone)[:n] > 0
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            edge = at[at < n]
            begins[edge] = removed[edge]
            so_far, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, begins))
            kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at - so_far[at]).astype(np.int32)), pa.py_buffer(raw[~removed])])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(size), pa.array(np.diff(so_far[at])), pa.array(np.diff(runs[at])), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return mapped(texts, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _given(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (an id for all rows), hash of the text, and tid, which tells apart the texts of rows that share a doc_id."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return given.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("hash", F.xxhash64("text")).withColumn("tid", (F.col("hash").bitwiseAND(0xFFFF)).cast("int"))


def _marked(given: DataFrame, marks: DataFrame) -> DataFrame:
    marked = given.join(marks, ["doc", "tid"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return _kept(marked.select("doc_id", "text", "whole", "spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    spark = docs.sparkSession
    given = _given(docs)
    # equal texts: the first is looked at, the others are repeats of it from end to end
    ids = stored(given.select("doc", "tid", "hash"), "suffix-ids")
    first = ids.groupBy("hash").agg(F.min("doc").alias("first"))
    repeats = stored(ids.join(first, "hash").where(F.col("doc") > F.col("first")).select("doc", "tid").distinct(), "suffix-repeats")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = []
    for part in range(PASSES):
        rows = _stretches(given, part)
        # what is settled goes where its place sends it, the rest to its rank
        rows = rows.repartition(n, F.when(F.col("kind") != LIVE, F.xxhash64("doc", "start")).otherwise(F.col("rank"))).sortWithinPartitions("rank", "stretch", "doc")
        parts.append(stored(_settled(rows), "suffix-settled"))
        release(spark)
    settled = reduce(DataFrame.unionByName, parts).join(repeats, ["doc", "tid"], "left_anti")
    open_rows = settled.where(F.col("kind") == LIVE)
    opened = open_rows.groupBy("doc", "tid").agg(F.collect_set(F.struct("start", "windows", "head")).alias("open"))
    texts = given.join(opened, ["doc", "tid"]).select("doc", "tid", "text", "open")
    second = stored(_compared(_parts(texts).repartition(n, "key").sortWithinPartitions("key", "doc")), "suffix-second")
    release(spark)
    found = second.where(F.col("body").isNull()).select("doc", "start", "windows", "tid")
    hot = second.where(F.col("body").isNotNull())
    if hot.limit(1).count():
        found = found.unionByName(_by_pairs(hot))
    head = F.when(F.col("kind") == ALIAS, F.col("head")).otherwise(F.lit(-1)).alias("head")
    spans = settled.where(F.col("kind") != LIVE).select("doc", "tid", "start", "windows", head).unionByName(found.withColumn("head", F.lit(-1).cast("long")))
    spans = spans.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", "windows", "head")).alias("spans"))
    marks = stored(repeats.withColumn("whole", F.lit(True)).join(spans, ["doc", "tid"], "full"), "suffix-marks")
    discard(second, *parts)
    return _marked(given, marks)


# --- the same over every position ---------------------------------------------------------------------------------------
FIRST = 7  # bytes of the first ranks, packed


def _packed(texts: DataFrame) -> DataFrame:
    """(doc, tid, start, a): the first FIRST bytes at every position that has as many."""

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            n = max(0, len(raw) - FIRST + 1)
            rank = np.zeros(n, np.int64)
            for i in range(FIRST):
                rank = rank << 8 | raw[i : i + n]
            p = np.arange(n)
            d = np.searchsorted(at, p, side="right") - 1
            fits = p + FIRST <= at[d + 1]
            p, d = p[fits], d[fits]
            doc, tid = rows.column("doc").to_numpy(), rows.column("tid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc[d]), pa.array(tid[d]), pa.array(p - at[d]), pa.array(rank[p])], names=["doc", "tid", "start", "a"])

    return mapped(texts.select("doc", "tid", "text"), run, "doc long, tid int, start long, a long")


def _reranked(sorted_pairs: DataFrame, last: bool) -> DataFrame:
    """Sorted by (a, b, doc): each run of equal pairs has a new rank, runs of one row drop out. last: the rows of a run that
    aren't of its least document."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held = None  # the last row, whether the one before it has its pair, and its run's least document
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if not len(columns[0]):
                continue
            before, least = False, columns[0][0]
            if held is not None:
                before, least = held[1], held[2]
                columns = [np.concatenate([[h], c]) for h, c in zip(held[0], columns, strict=True)]
            doc, tid, start, a, b = columns
            new = np.concatenate([[not before], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            run_of = np.cumsum(new) - (not before)
            firsts = np.concatenate([[least], doc[new][(0 if before else 1) :]])[run_of]
            twice = ~new | np.concatenate([~new[1:], [False]])
            out = doc > firsts if last else twice
            out[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(tid[out]), pa.array(start[out]), pa.array(number + run_of[out])], names=["doc", "tid", "start", "a"])
            number += int(run_of[-1])
            held = [c[-1] for c in columns], bool(~new[-1]), firsts[-1]
        if held is not None:
            (doc, tid, start, _, _), before, least = held
            if doc > least if last else before:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (doc, tid, start, np.int64(number))], names=["doc", "tid", "start", "a"])

    return mapped(sorted_pairs.select("doc", "tid", "start", "a", "b"), run, "doc long, tid int, start long, a long")


def dedup_by_sorting(docs: DataFrame) -> DataFrame:
    """What dedup returns, by prefix doubling over every position: Spark sorts all pairs of the rank here and the rank at a
    growing offset, reranks them and drops the unique ones, until LENGTH bytes are ranked. A row a byte and round: for
    tables far smaller than the disk."""
    n = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = _given(docs)
    ranked, width = stored(_packed(given.dropDuplicates(["doc", "hash"])), "suffix-ranks"), FIRST
    while width < LENGTH:
        step = min(width, LENGTH - width)
        further = ranked.select("doc", "tid", (F.col("start") - step).alias("start"), F.col("a").alias("b"))
        pairs = ranked.join(further, ["doc", "tid", "start"]).repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b", "doc")
        width += step
        done = ranked
        ranked = stored(_reranked(pairs, width == LENGTH), "suffix-ranks")
        discard(done)
    spans = ranked.groupBy("doc", "tid").agg(F.collect_list(F.struct("start", F.lit(1).alias("windows"), F.lit(-1).cast("long").alias("head"))).alias("spans"))
    return _marked(given, spans.withColumn("whole", F.lit(False)))


def digested(result: DataFrame) -> DataFrame:
    """kept as its SHA-256, lowercase hex."""

    def run(batches):
        for batch in batches:
            hashes = [sha256(kept.as_buffer()).hexdigest() for kept in batch.column("kept")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return mapped(result, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(digested(dedup(documents(spark, sf_dir))), "suffix-digests")


ORACLE_SQL = None
