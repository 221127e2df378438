"""Benchmark decontamination: a positional inverted index over the training documents, phrase and proximity matches.

``build_index`` tokenises every document once and stores the postings (term, row, position) of all terms that the test
set uses. Phrases are matched the way search engines do it: for each test window the terms are ordered by their corpus
frequency, the postings of the rarest one give candidate starts (position minus the term's offset in the window), the
offset-adjusted postings of the next two rarest terms are intersected with them, and what is left is compared with the
document's own words at that place, by a 64-bit hash of the stretch. A window is ``WINDOW`` consecutive item words; a
shorter item is one window.

Test terms, anchors and windows are broadcast only if their counted rows and characters are small (``TERMS``,
``CHARACTERS``); beyond that the same joins run as shuffles. Candidates are spread by row, so a term or document that is
frequent in the corpus meets in no task.

Defined results: a null text has no words, hence no hits; an item without words has no window and never occurs; equal
items are told apart by item_id; a row is known by a hash of its doc_id (null or not) and text, so rows that share a
doc_id are judged separately; empty tables give no rows (an empty benchmark: no hits). All columns of docs are returned,
whatever their names, but for n_words, n_hit and items, which are replaced; other columns of the benchmark are ignored.
A null item_id sorts as the text ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, discard, documents, stored

NAME = "op1_decontaminate"
WINDOW = 13
RARE_TERMS = 3
SHARE = 20  # contaminated from one hit word in SHARE
TERMS = 200_000  # broadcast: at most so many test terms,
CHARACTERS = 32 << 20  # and tables of the windows of at most so many characters of phrases and item ids
# the contract's complement of ASCII non-words, written as the characters it leaves: the regex engine is some 30 times faster on it
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII; null or blank: none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, item_words -> one row per distinct window text: window_id, terms, phrase, width, items (sorted ids)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))
    each = items.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.expr(f"slice(w, s, {width})").alias("terms"))
    each = each.withColumn("phrase", F.array_join("terms", " "))
    return each.groupBy("phrase").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("width", F.size("terms")).withColumn("window_id", F.xxhash64("phrase", F.lit(1)))


class Tests:
    """The stored windows of a benchmark and their distinct terms, with what may be broadcast of them."""

    def __init__(self, benchmark: DataFrame, width: int):
        self.windows = stored(windows(benchmark, width), "test-windows")
        self.terms = stored(self.windows.select(F.explode("terms").alias("term")).distinct().withColumn("term_id", F.xxhash64("term")), "test-terms")
        letters = F.char_length("phrase") + F.aggregate("items", F.lit(0), lambda n, x: n + F.char_length(x))
        self.small = self.terms.count() <= TERMS
        self.few = (self.windows.agg(F.sum(letters.cast("long"))).first()[0] or 0) <= CHARACTERS

    def held(self, terms: DataFrame) -> DataFrame:
        """A table with a row a term."""
        return F.broadcast(terms) if self.small else terms

    def near(self, table: DataFrame) -> DataFrame:
        """A table with at most RARE_TERMS rows a window, none of them longer than the window."""
        return F.broadcast(table) if self.few else table


def _row_id(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def build_index(docs: DataFrame, tests: Tests) -> DataFrame:
    """Postings (term_id, row, pos) of the tests' terms in all documents; pos counts words from 0."""
    tokens = docs.select(_row_id(docs).alias("row"), F.posexplode(words(docs["text"])).alias("pos", "term"))
    return stored(tokens.join(tests.held(tests.terms), "term").select("term_id", "row", "pos"), "postings")


def _candidates(index: DataFrame, anchors: DataFrame, tests: Tests) -> DataFrame:
    """(window_id, row, start) at which the rarest terms of a window stand at their offsets."""
    found = None
    for k in range(RARE_TERMS):
        own = tests.near(anchors.where(F.col("rarity") == k + 1).select("term_id", "window_id", "offset", "used"))
        hits = index.join(own, "term_id").where(F.col("pos") >= F.col("offset")).select("row", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "used")
        if found is None:
            found = hits
        else:
            # windows of fewer than k + 1 terms have nothing more to intersect
            kept = found.where(F.col("used") <= k)
            more = found.where(F.col("used") > k).join(hits.drop("used"), ["row", "window_id", "start"], "left_semi")
            found = kept.unionByName(more)
    return found.select("row", "window_id", "start")


def _anchors(index: DataFrame, tests: Tests) -> DataFrame:
    """The RARE_TERMS rarest terms of every window (ties by offset), by their counts in the corpus."""
    counts = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    counted = tests.terms.join(counts, "term_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = tests.windows.select("window_id", F.posexplode("terms").alias("offset", "term")).join(tests.held(counted), "term")
    order = Window.partitionBy("window_id").orderBy("n", "offset")
    each = each.withColumn("rarity", F.row_number().over(order)).withColumn("used", F.least(F.lit(RARE_TERMS), F.count(F.lit(1)).over(Window.partitionBy("window_id"))))
    return stored(each.where(F.col("rarity") <= RARE_TERMS), "test-anchors")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with the columns n_words, n_hit and items (sorted ids of the items with a window in the document)."""
    tests = Tests(benchmark, width)
    index = build_index(docs, tests)
    found = _candidates(index, _anchors(index, tests), tests)
    found = found.join(tests.near(tests.windows.select("window_id", "width", "items")), "window_id")
    # a window's items stand once a row, however often it occurs there
    places, owners = F.collect_set(F.struct("start", "width", "window_id")), F.collect_set(F.struct("window_id", "items"))
    per_row = stored(found.groupBy("row").agg(places.alias("places"), owners.alias("owners")), "test-candidates")
    discard(index)
    # a merge join at every size: what is joined grows with the documents
    d = docs.select(_row_id(docs).alias("row"), F.struct("*").alias("doc")).join(per_row.hint("merge"), "row", "left")

    def judged(w: Column) -> Column:
        hits = F.filter("places", lambda c: F.xxhash64(F.array_join(F.slice(w, c["start"] + 1, c["width"]), " "), F.lit(1)) == c["window_id"])
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array_sort(hits).alias("hits"))

    # the one-element array binds the words to a lambda variable: they are made once a document, not once a candidate
    d = d.withColumn("judged", F.transform(F.array(words(F.col("doc")["text"])), judged)[0])
    # covered words: starts are sorted, so each window adds what lies beyond the furthest end so far
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "judged.hits",
        zero,
        lambda acc, c: F.struct(
            F.greatest(acc["end"], c["start"] + c["width"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), c["start"] + c["width"] - F.greatest(acc["end"], c["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    there = F.array_distinct(F.transform("judged.hits", lambda c: c["window_id"]))
    items = F.flatten(F.transform(F.filter("owners", lambda o: F.array_contains("there", o["window_id"])), lambda o: o["items"]))
    d = d.withColumn("there", there).select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_hit", "items")],
        F.col("judged.n_words").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(items)), F.array().cast("array<string>")).alias("items"),
    )
    return d


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 8, width: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, at, start, end), distinct: the places (at) of the rarest term of one of an item's windows at which
    each other of the window's rarest terms has a posting, in any order, at most their spread in the window plus ``slop``
    words away. start and end bound the nearest postings (the earlier one of a tie)."""
    tests = Tests(benchmark, width)
    index = build_index(docs, tests)
    anchors = _anchors(index, tests)
    spread = anchors.groupBy("window_id").agg((F.max("offset") - F.min("offset") + slop).alias("reach"), F.countDistinct("term_id").alias("need"))
    first = anchors.where("rarity = 1").select("window_id", "term_id").join(spread, "window_id")
    centre = index.join(tests.near(first), "term_id").select("row", "window_id", F.col("pos").alias("at"), "reach", "need")
    own = anchors.select("window_id", "term_id").distinct().join(spread.select("window_id", "reach"), "window_id")
    near = index.join(tests.near(own), "term_id").select("row", "window_id", "pos", "term_id", F.expr("pos div (reach + 1)").alias("cell"))
    # a place meets the postings of its own cell and the next ones on either side, which hold all within reach
    cells = centre.withColumn("cell", F.explode(F.expr("transform(array(-1, 0, 1), k -> k + at div (reach + 1))")))
    both = cells.join(near, ["row", "window_id", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= F.col("reach"))
    distance = F.struct(F.abs(F.col("pos") - F.col("at")), F.col("pos"))
    nearest = both.groupBy("row", "window_id", "at", "need", "term_id").agg(F.min_by("pos", distance).alias("pos"))
    met = nearest.groupBy("row", "window_id", "at", "need").agg(F.count(F.lit(1)).alias("have"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    met = met.where(F.col("have") == F.col("need")).join(tests.windows.select("window_id", F.explode("items").alias("item_id")), "window_id")
    ids = docs.select(_row_id(docs).alias("row"), docs["doc_id"].alias("doc_id")).distinct()
    return met.join(ids, "row").select("doc_id", "item_id", "at", "start", "end").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_matches(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(13, len(w)) AS width, array_to_string(w[s:s + 12], ' ') AS phrase
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(s) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM win),
dw AS (
  SELECT doc_id, width, s, array_to_string(w[s:s + width - 1], ' ') AS phrase
  FROM d, widths, unnest(generate_series(1, len(w) - width + 1)) AS t(s)
), hit AS (
  SELECT dw.doc_id, dw.s, dw.width, win.item_id FROM dw JOIN win USING (phrase, width)
), covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + width - 1)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
