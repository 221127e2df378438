"""Mixing sources to target weights: random keys, per-source range order, distributed prefix sums, exact cuts.

Every document gets a hash-random key. Within its source, documents are taken in key order until the source's
budget of words is used; a budget above the source's size repeats the source (whole epochs first, then the cut).
The prefix sums are distributed: keys fall into ranges of about ``RANGE_ROWS`` rows per source, or the square root of its
rows if that is more; one sum per (source, range) gives each range its offset, and a running sum inside a range does the
rest, so neither the ranges of a source nor the rows of a range are many for one task.

Defined results: a null or blank text has size 0 and is taken 0 times; rows that share a doc_id are mixed
separately (equal rows are interchangeable); an empty table gives no rows; a null source is one source, ordered last;
columns of the input other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored

NAME = "op7_mix_sources"
WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 2_000
SHARE, EPOCHS = 1.5, 2
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs) -> also target: share * all sizes split by weight, each stopped at epochs * size.

    Splitting again what capped sources leave is water-filling: the target is min(cap, level * weight) for one
    level, found by going through the sources in order of cap / weight. One row per source, so one small window.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    whole = Window.partitionBy()
    up = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", F.lit(share) * F.sum("source_size").over(whole))
    # level if every source before this one (in order of cap / weight) is capped and none from here on
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))
    weight_left = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(up), F.lit(0.0))
    s = s.withColumn("_level", left / weight_left)
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole)
    s = s.withColumn("target", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")))
    return s.select("source", "source_size", "n_docs", "target")


def random_key(seed: int):
    """40 hash-random bits of the id (without one: of the text) and the seed: the first ten hex digits of an md5."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights=WEIGHTS, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, taken; reruns agree."""
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        random_key(seed).alias("_key"),
    )
    sized = stored(sized, "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = targets(per, share, epochs, weights).withColumn("_ranges", F.ceil(F.col("n_docs") / F.greatest(F.lit(float(range_rows)), F.sqrt("n_docs"))).cast("long"))
    goals = stored(goals, "mix-targets")
    # one row per source; joined by a hint-free equi-join that Spark broadcasts only under its own size threshold
    d = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    d = d.withColumn("_range", F.floor(F.col("_key") * F.col("_ranges") / F.lit(1 << 40)).cast("long"))
    sums = d.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_src"), F.col("_range").alias("_rng"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    d = d.join(offsets, d["source"].eqNullSafe(offsets["_src"]) & (d["_range"] == offsets["_rng"])).drop("_src", "_rng")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - full * F.col("source_size")
    taken = full * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '') || ':17'), 1, 10))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM w
), t AS (
  SELECT source, source_size, coalesce(least(cap, (max(lvl) FILTER (WHERE lvl <= cap / w) OVER ()) * w), cap) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM r
"""
