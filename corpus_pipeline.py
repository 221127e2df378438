"""The corpus pipeline: language ID, near duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of documents; the last one
returns the mix. Rows that share a doc_id are kept or dropped together only where a stage says so.

Defined results, all stages: a null text is an empty one and stays null; columns of docs other than those of documents are
left out, whatever their names; rows that share a doc_id, null ids included, are separate documents; an empty table gives
an empty one; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, mixing, pii
from tessera.llm.common import crc_mod, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR = {"width": 5, "num": 80, "den": 100}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents but those without a language (und): null texts and those without a letter. lang becomes the
    prediction; ties go to the first language by name. If nothing could be learned, no document has a language."""
    learned = langid.prototypes(docs.where(crc_mod(F.col("doc_id"), langid.FOLDS) != langid.HELD_OUT))
    found = langid.predict(docs.select(*COLUMNS), learned)
    found = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def _with_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose id is in kept (_id long). Most are: a bitmap of the other ids tells which rows can't be one of
    those, and only the rest is joined, so that few texts are shuffled."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    gone = ids.join(kept.select(F.col("_id").alias("_kept")), F.col("_id").eqNullSafe(F.col("_kept")), "left_anti")
    words = stored(jaccard.bitmap(gone), "pipeline-gone")
    word, bit = jaccard.place("_id")
    rows = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_id")).withColumn("_word", word)
    rows = rows.join(F.broadcast(words), F.col("_word") == F.col("word"), "left")
    may_go = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    rest = rows.where(may_go).withColumnRenamed("_id", "_own")
    rest = rest.join(kept, F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    return rows.where(~may_go).select(*COLUMNS).union(rest.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of similar ones: that of the smallest doc_id, null ids last (of rows that share it,
    the first by class and text). Rows without words are like no other and stay."""
    joined = jaccard.join(docs, **NEAR)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "cls")).alias("f")
    kept = joined.where("n_shingles > 0").groupBy("root").agg(least).select(F.col("f.doc_id").alias("_id"), F.col("f.cls").alias("_cls"))
    twice = joined.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not twice:
        alone = joined.where("n_shingles = 0").select("doc_id")
        kept = stored(kept.select("_id").union(alone), "pipeline-kept")
        return _with_ids(docs, kept)
    # an id doesn't tell rows apart: a row is found by its id and class, and rows of both are equal sets
    kept = stored(kept, "pipeline-kept")
    rows = jaccard.classed(docs.select(*COLUMNS), NEAR["width"])
    same = rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["cls"] == kept["_cls"])
    one = rows.join(kept, same, "left_semi").groupBy("doc_id", "cls").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("r"))
    return one.select("doc_id", "r.*").union(rows.where("cls = 0").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule condemns; those without words have no hits and stay."""
    found = decontaminate.phrase_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by a mark of its kind; n_chars follows the new text where one was found. No row is dropped."""
    spans = pii.candidates(F.col("text"))
    model = pii.fit(docs.select(spans.alias("c")).where(F.size("c") > 0))
    text = pii.redacted(F.col("text"), pii.decided(F.col("_c"), model))
    changed = docs.select(*COLUMNS).withColumn("_c", spans).withColumn("_t", F.when(F.col("text").isNull(), F.col("text")).otherwise(text))
    return changed.select("doc_id", F.col("_t").alias("text"), "lang", "source", F.when(F.size("_c") > 0, F.char_length("_t").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a document without words is taken 0 times."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_to_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
