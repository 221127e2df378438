"""N-gram Jaccard join by parity sketches, exact.

A document's set holds its distinct word shingles, as 64-bit hashes. Equal sets are one class from the start. A class of
size n is hashed into a sketch of K blocks of BITS bits by XOR: every shingle flips one bit of one block. Two sets whose
symmetric difference is d differ in at most d bits, hence in at most d blocks. Sizes fall into bands whose ratio is the
threshold, so a pair within it is of one band g or of g and g + 1, and its difference is at most
``D_g = (1 - t) / t * largest size of g``. Of K blocks, K - D_g or more are equal. The pigeonhole join is on (g, block,
bits), and each class gives its D_g + 1 first blocks only, in one order that all classes share: blocks that no other class
has come first, then those that fewer rows have. The first block in that order which two similar classes share is among
the D_g + 1 first of both (K - D_g of a class's blocks stand at or after it), so no similar pair is lost; classes that
merely share a common passage meet only if it fills most of their blocks, as each leaves out its K - D_g - 1 commonest.

Room: a class's blocks are not kept. They are made from the text again for each of a few slices of the keys, counted and
joined with their counts a slice at a time; only blocks that several classes have are stored.

Candidates are verified on the whole sets, after a check that their parity sketches, folded to the same length, differ in
no more bits than the sets may. Of buckets with the same members one is kept. In a bucket, all classes are first compared
with one of them, then, for a few rounds, those still in another component with the class of the bucket whose comparisons
so far linked most often. A class that all others were compared with leaves the bucket, which settles small buckets soon.
What is linked is in one component, and only the pairs of a bucket that are still in different components are compared in
the end, all of them: buckets are cut into tiles of about ``TILE`` classes, a row for each two tiles, and only pairs whose
check sketches are near enough leave it as rows. So a group of near copies costs comparisons in proportion to its size.

No window runs over a bucket: counts and centres are aggregates that combine before their shuffle, and are joined back, so
that a bucket with a third of all classes is split by the skew join.

Defined results: a null text or one without words has the empty set, linked with nothing; with fewer words than a
shingle has, the whole sequence is the only shingle; rows that share a doc_id are separate documents; a null doc_id is
never a component's id unless the component has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bytekit
from tessera.llm.common import discard, documents, stored
from tessera.operators.components import connected_components

NAME = "op10_jaccard_join"
WIDTH, NUM, DEN = 3, 90, 100
SPARE = 1.3  # blocks over D + 1
BITS = 1 << 16  # of a block
KEYS = 0.15  # of a slice, for each shingle: a slice of the keys takes less room than the text
CHECK_WORDS = 8  # at least; sketches have a bit a shingle or more
TILE_WORDS = 8  # words of a sketch as tiles carry it
TILE = 64  # classes of a bucket compared at once
BITMAP = 1 << 23  # bits
CHUNK = 1 << 19  # bytes of text worked on at once
SEEN = 1 << 20  # classes a task remembers; forgetting them costs repeated rows, no result
ROUNDS = 1  # at most, of comparing with a bucket's best linked class; what they leave is compared tile by tile


class Bands:
    """Size bands for the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1, 2]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * self.den // self.num + 1))
        return bisect.bisect_right(self.starts, n) - 1

    def differ(self, g: int) -> int:
        """The largest symmetric difference of a pair whose smaller set is in band g."""
        while len(self.starts) <= g + 1:
            self.of(self.starts[-1])
        return (self.starts[g + 1] - 1) * (self.den - self.num) // self.num


class Sets:
    """The sorted distinct shingle hashes of each document of a chunk, end to end: those of d are u[at[d]:at[d + 1]]."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, width: int):
        raw = bytekit.lowered(raw)
        start, end, doc = bytekit.words(raw, at)
        h = bytekit.Spans(raw)(start, end)
        n_docs = len(at) - 1
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        words = np.diff(first)
        salts = bytekit.mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        sizes = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        u = np.zeros(cut[-1], np.uint64)
        short = np.flatnonzero((words > 0) & (words < width))
        whole = np.ones(len(u), bool)
        whole[cut[short]] = False
        m = max(0, len(h) - width + 1)
        if m:
            rolled = np.zeros(m, np.uint64)
            for k in range(width):
                rolled += h[k : k + m] * salts[k]
            u[whole] = bytekit.mixed(rolled[doc[:m] == doc[width - 1 :]])
        for d in short:
            a, b = first[d], first[d + 1]
            u[cut[d]] = bytekit.mixed((h[a:b] * salts[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(b - a)))[0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            u[a:b].sort()
        owner = np.repeat(np.arange(n_docs), sizes)
        keep = np.ones(len(u), bool)
        keep[1:] = (u[1:] != u[:-1]) | (owner[1:] != owner[:-1])
        self.u, self.owner = u[keep], owner[keep]
        self.n = np.bincount(self.owner, minlength=n_docs).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])

    def __iter__(self):
        return (self.u[a:b] for a, b in zip(self.at[:-1], self.at[1:], strict=True))

    def classes(self) -> np.ndarray:
        """A hash of each whole set; 0 for the empty one."""
        out = np.zeros(len(self.n), np.uint64)
        some = np.flatnonzero(self.n)
        if len(some):
            out[some] = np.maximum(bytekit.mixed(np.add.reduceat(bytekit.mixed(self.u + np.uint64(0x51ED)), self.at[some])), np.uint64(1))
        return out.astype(np.int64)

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, place in chosen of their document) of the chosen documents."""
        place = np.full(len(self.n), -1)
        place[chosen] = np.arange(len(chosen))
        at = place[self.owner]
        return self.u[at >= 0], at[at >= 0]


_bit_hashes = bytekit.mixed(np.arange(1, BITS + 1, dtype=np.uint64))


def keys(u: np.ndarray, owner: np.ndarray, g: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, spare) of the blocks that classes give in their band groups g; u are their shingles, owner says whose.
    A block's parity bits are named by the XOR of a hash of each bit that is set. Empty blocks come last in the common
    order and are given only as far as the D + 1 first reach them. spare: how many of its blocks a class may leave out."""
    differ = np.array([bands.differ(int(x)) for x in g], np.int64)
    blocks = np.where(differ > 0, np.ceil(SPARE * (differ + 1)).astype(np.int64), 0)  # without a difference only equal sets qualify, and those are one class
    start = np.cumsum(blocks) - blocks
    live = blocks[owner] > 0
    u, owner = u[live], owner[live]
    sketch = np.zeros(int(blocks.sum()), np.uint64)
    np.bitwise_xor.at(sketch, start[owner] + ((u >> np.uint64(17)) % blocks[owner].astype(np.uint64)).astype(np.int64), _bit_hashes[(u & np.uint64(BITS - 1)).astype(np.int64)])
    whose = np.repeat(np.arange(len(g)), blocks)
    block = np.arange(len(sketch)) - start[whose]
    full = sketch != 0
    spare = np.bincount(whose[full], minlength=len(g)) - (differ + 1)
    empty_before = np.cumsum(~full)
    base = np.concatenate([[0], empty_before])[start[whose]] if len(sketch) else empty_before
    given = full | (empty_before - base <= -spare[whose])
    whose, block = whose[given], block[given]
    key = bytekit.mixed(sketch[given] ^ bytekit.mixed(block.astype(np.uint64) + (g[whose].astype(np.uint64) << np.uint64(32))))
    return key.astype(np.int64), whose, np.maximum(spare, 0)


def check_sketches(u: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """A parity sketch of each whole set, for comparing two candidates: a power of two of words, a bit a shingle or more."""
    words = CHECK_WORDS << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (64 * CHECK_WORDS))).astype(np.int64))
    start = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, start[owner] + ((u >> np.uint64(7)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (u >> np.uint64(58)))
    return np.split(out.view(np.int64), start[1:]) if len(n) else []


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A longer sketch as one of fewer words: word i of the shorter is the XOR of all words i modulo its length."""
    return np.bitwise_xor.reduce(sketch.view(np.uint64).reshape(-1, words), axis=0)


def _unseen(cls: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places of classes that this task has not met yet."""
    if len(seen) > SEEN:
        seen.clear()
    out = []
    for i in np.flatnonzero(n):
        c = int(cls[i])
        if c not in seen:
            seen.add(c)
            out.append(i)
    return np.array(out, np.int64)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, cls and check, which a class gives once a task."""

    def run(batches):
        seen = set()
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            sets = Sets(raw, at, width)
            cls = sets.classes()
            new = _unseen(cls, sets.n, seen)
            check = [None] * len(cls)
            for i, sketch in zip(new, check_sketches(*sets.of(new), sets.n[new]), strict=True):
                check[i] = sketch
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sets.n), pa.array(cls), pa.array(check, pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "check"])

    return _numbered(docs).mapInArrow(run, "doc_id long, n long, cls long, check array<long>")


def _slice(docs: DataFrame, width: int, num: int, den: int, part: int, parts: int) -> DataFrame:
    """(key, cls, n, up, spare): the blocks of every class in one slice of the keys; up: as the larger of a pair of bands."""

    def run(batches):
        bands, seen = Bands(num, den), set()
        for _, raw, at in bytekit.chunks(batches, limit=CHUNK):
            sets = Sets(raw, at, width)
            cls = sets.classes()
            new = _unseen(cls, sets.n, seen)
            band = np.array([bands.of(int(n)) for n in sets.n[new]], np.int64)
            for up in (False, True):
                chosen, g = (new[band > 0], band[band > 0] - 1) if up else (new, band)
                if not len(chosen):
                    continue
                key, whose, spare = keys(*sets.of(chosen), g, bands)
                here = (key.view(np.uint64) >> np.uint64(40)) % np.uint64(parts) == part
                key, doc = key[here], chosen[whose[here]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(cls[doc]), pa.array(sets.n[doc]), pa.array(np.full(len(key), up)), pa.array(spare[whose[here]])], names=["key", "cls", "n", "up", "spare"]
                )

    return _numbered(docs).mapInArrow(run, "key long, cls long, n long, up boolean, spare long")


def _buckets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, cls, n, up): for each class and band group the D + 1 first of its blocks, of those only that others have too."""
    parts = max(1, round(2 * SPARE * (den - num) / num / KEYS))
    slices = []
    for part in range(parts):
        given = stored(_slice(docs, width, num, den, part, parts), "jaccard-blocks")
        counts = given.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("up").alias("all_up"))
        counts = counts.where("lo <> hi AND NOT all_up").select("key", "c")
        met = stored(given.join(counts, "key"), "jaccard-shared")
        discard(given)
        slices.append(met)
    shared = reduce(DataFrame.union, slices)
    commonest = Window.partitionBy("cls", "up").orderBy(F.desc("c"), "key")
    # several tasks may give a class
    rest = shared.withColumn("place", F.dense_rank().over(commonest)).where("place > spare").select("key", "cls", "n", "up").distinct()
    buckets = stored(rest, "jaccard-buckets")
    discard(*slices)
    return buckets


def place(x: str) -> tuple[Column, Column]:
    """(word, bit) of the hash of a long column in a bitmap."""
    return F.expr(f"cast(pmod(xxhash64({x}), {BITMAP}) div 64 as int)"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({x}), {BITMAP}) % 64 as int))")


def bitmap(ids: DataFrame) -> DataFrame:
    """(word, bits): BITMAP bits, set at the hashes of ids (_id long): of one size however many ids there are."""
    word, bit = place("_id")
    return ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _bitmap(ids: DataFrame) -> np.ndarray:
    words = bitmap(ids).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, u): the whole set of every wanted class (cls, doc_id), from one of its documents. Texts aren't shuffled: those
    whose id is not in a bitmap of the wanted ids are passed over, and sets that still aren't wanted drop out by their class."""
    bits = _bitmap(wanted.select(F.col("doc_id").alias("_id")))

    def run(batches):
        def flagged():
            for batch in batches:
                p = batch.column("place").to_numpy().astype(np.uint64)
                yield batch.filter(pa.array((bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)))

        for _, raw, at in bytekit.chunks(flagged(), limit=CHUNK):
            sets = Sets(raw, at, width)
            yield pa.RecordBatch.from_arrays([pa.array(sets.classes()), pa.ListArray.from_arrays(pa.array(sets.at, pa.int32()), pa.array(sets.u.astype(np.int64)))], names=["cls", "u"])

    found = _numbered(docs).select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("place")).mapInArrow(run, "cls long, u array<long>")
    # rows that share a doc_id or its bit may hold other classes
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _links(docs: DataFrame, width: int, pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, stored. Sets are made again from the texts of those classes only
    whose sketches leave it open."""
    side = lambda t, x: t.select(*[F.col(c).alias(x if c == "cls" else f"{c}_{x}") for c in t.columns])
    checks = classes.select("cls", "n", "check")
    both = pairs.join(side(checks, "a"), "a").join(side(checks, "b"), "b")

    def compare(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b")), batch.column("check_a"), batch.column("check_b"), strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                words = min(len(x), len(y))
                bits = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64))
                keep.append(den * min(n, m) >= num * max(n, m) and bits * (den + num) <= (den - num) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = stored(both.select("a", "b", "n_a", "n_b", "check_a", "check_b").mapInArrow(compare, "a long, b long"), "jaccard-near")
    needed = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "cls")
    wanted = stored(classes.select("cls", "doc_id").join(needed, "cls"), "jaccard-wanted")
    sets = stored(_sets(docs, wanted, width), "jaccard-sets")
    full = near.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    common = F.size(F.array_intersect("u_a", "u_b"))
    union = F.size("u_a") + F.size("u_b") - common
    links = stored(full.where(F.lit(den).cast("long") * common >= F.lit(num).cast("long") * union).select("a", "b"), "jaccard-links")
    discard(near, wanted, sets)
    return links


def _close(n: str, m: str, num: int, den: int):
    return (F.lit(den) * F.least(n, m)) >= (F.lit(num) * F.greatest(n, m))


def _xor_of(word: int):
    """A step of aggregate(): XOR with one word of each stretch of TILE_WORDS words."""
    return lambda acc, j: acc.bitwiseXOR(F.element_at("check", j * TILE_WORDS + word + 1))


def _near_pairs(members: DataFrame, checks: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of a bucket, of different components, whose sizes and check sketches may be similar."""
    step = F.size("check") / TILE_WORDS
    at = F.sequence(F.lit(0), (step - 1).cast("int"))
    short = F.array(*[F.aggregate(at, F.lit(0).cast("long"), _xor_of(w)) for w in range(TILE_WORDS)])
    many = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    numbered = members.join(many, "key").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles"))).drop("tiles").join(checks.select("cls", short.alias("check")), "cls")
    tiles = numbered.groupBy("key", "tile").agg(F.collect_list(F.struct("cls", "root", "n", "up", "check")).alias("m"))
    tiles = stored(tiles, "jaccard-tiles")
    # most buckets have one tile and need no join
    large = many.where("tiles > 1").select("key")
    x = tiles.join(large, "key", "left_semi").select("key", F.col("tile").alias("tx"), F.col("m").alias("x"))
    y = x.select("key", F.col("tx").alias("ty"), F.col("x").alias("y"))
    one = tiles.join(large, "key", "left_anti").select(F.col("m").alias("x"), F.col("m").alias("y"))
    two = one.unionAll(x.join(y, "key").where("tx <= ty").select("x", "y"))

    def unpack(column):
        flat, at = column.flatten(), column.offsets.to_numpy()
        get = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
        check = flat.field("check")
        cut = check.offsets.to_numpy()
        return at - at[0], get("cls"), get("root"), get("n"), get("up"), check.flatten().to_numpy(), cut - cut[0]

    def sketches(values, cut, tile, words):
        return np.stack([folded(values[cut[k] : cut[k + 1]], words) for k in range(tile.start, tile.stop)])

    def run(batches):
        for batch in batches:
            (ax, cx, rx, nx, ux, kx, vx), (ay, cy, ry, ny, uy, ky, vy) = unpack(batch.column("x")), unpack(batch.column("y"))
            pairs = [np.zeros((0, 2), np.int64)]
            for i in range(len(batch)):
                s, t = slice(int(ax[i]), int(ax[i + 1])), slice(int(ay[i]), int(ay[i + 1]))
                words = int(min(np.diff(vx[s.start : s.stop + 1]).min(), np.diff(vy[t.start : t.stop + 1]).min()))
                n, m = nx[s][:, None], ny[t][None, :]
                near = (rx[s][:, None] != ry[t][None, :]) & ~(ux[s][:, None] & uy[t][None, :]) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
                i_x, i_y = np.nonzero(near)
                if not len(i_x):
                    continue
                bits = np.bitwise_count(sketches(kx, vx, s, words)[i_x] ^ sketches(ky, vy, t, words)[i_y]).sum(1, dtype=np.int64)
                ok = bits * (den + num) <= (den - num) * (nx[s][i_x] + ny[t][i_y])
                pairs.append(np.sort(np.stack([cx[s][i_x[ok]], cy[t][i_y[ok]]], 1), axis=1))
            found = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return two.mapInArrow(run, "a long, b long").distinct()


def _apart(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """Members of buckets that hold more than one component, with their root; and how many there are. Components only
    grow, so a bucket that left stays out."""
    members = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed_keys = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    members = stored(members.join(mixed_keys, "key", "left_semi"), "jaccard-mixed")
    return members, members.count()


def join(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, cls (equal sets), component_id and root, one row per row. The root is the
    component's own also where ids repeat or are null; 0 for all empty sets."""
    sketches = stored(_rows(docs, width), "jaccard-rows")
    rows = sketches.select("doc_id", "n", "cls")
    given = _buckets(docs, width, num, den)
    # of buckets with the same members one is enough; its least class is compared with all others first
    member = lambda salt: F.bit_xor(F.xxhash64("cls", "up", F.lit(salt)))
    centre = F.min(F.struct("up", "cls", "n"))
    alike = given.groupBy("key").agg(F.count(F.lit(1)).alias("c"), member(1).alias("x"), member(2).alias("y"), centre.alias("f"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    alike = alike.where("lo <> hi AND NOT f.up").groupBy("c", "x", "y", "lo", "hi").agg(F.min_by("f", "key").alias("f"), F.min("key").alias("key"))
    live = given.join(alike.select("key", "f"), "key").select("key", "cls", "n", "up", F.col("f.cls").alias("f"), F.col("f.n").alias("fn"))
    live = stored(live, "jaccard-buckets")
    discard(given)
    # every class of a live bucket may be compared
    own = sketches.join(live.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("check", ignorenulls=True).alias("check"))
    wanted = stored(own, "jaccard-wanted")
    pairs = live.where((F.col("cls") != F.col("f")) & _close("n", "fn", num, den))
    tested = stored(pairs.select(F.least("f", "cls").alias("a"), F.greatest("f", "cls").alias("b")).distinct(), "jaccard-pairs")
    links = _links(docs, width, tested, wanted, num, den)
    roots = connected_components(links, stored)
    # the class that all others of a bucket were compared with has no pair left there: it leaves the bucket
    members, left = _apart(live.where("cls <> f").select("key", "cls", "n", "up"), roots)
    discard(live)
    for _ in range(ROUNDS):
        if left <= 0:
            break
        # the middle of a group is similar to most of it; the share of its comparisons that linked shows that early
        ends = lambda t, x: t.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias(x))
        ranked = members.join(ends(tested, "tests"), "cls", "left").join(ends(links, "hits"), "cls", "left")
        rate = (F.coalesce("hits", F.lit(0)) + 0.5) / (F.coalesce("tests", F.lit(0)) + 2)
        best = ranked.groupBy("key").agg(F.max_by(F.struct("cls", "n", "up", "root"), F.struct(rate, F.col("cls"))).alias("c"))
        rest = stored(members.join(best, "key").where(F.col("cls") != F.col("c.cls")), "jaccard-rest")
        discard(members)
        star = rest.where((F.col("root") != F.col("c.root")) & ~(F.col("up") & F.col("c.up")) & _close("n", "c.n", num, den))
        star = star.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        star = stored(star, "jaccard-pairs")
        found = _links(docs, width, star, wanted, num, den)
        tested = tested.union(star)
        if found.limit(1).count():
            links = links.union(found)
            roots = connected_components(links, stored)
        members, left = _apart(rest.select("key", "cls", "n", "up"), roots)
        discard(rest)
    # what is left: pairs of a bucket in different components
    if left > 0:
        more = stored(_near_pairs(members, wanted, num, den).join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        found = _links(docs, width, more, wanted, num, den)
        if found.limit(1).count():
            roots = connected_components(links.union(found), stored)
    labelled = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    out = labelled.join(ids, "root", "left")
    return out.select("doc_id", "n_shingles", "cls", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def classed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the column cls of join."""
    kept = docs.drop("cls")

    def run(batches):
        for rows, raw, at in bytekit.chunks(batches, limit=CHUNK):
            cls = Sets(raw, at, width).classes()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cls)], names=[*rows.schema.names, "cls"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "cls long"])
    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""
