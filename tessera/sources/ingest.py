"""Corpora as they come, brought to the common columns: one entry of ``CORPORA`` a corpus.

Fetching is the caller's: ``fetch(name, folder)`` puts the files there (a hub snapshot, an archive); without one the
folder has to hold them already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import tables as S


@dataclass(frozen=True)
class Corpus:
    read: Callable[[SparkSession, str], DataFrame]
    by_language: bool = False  # whether it is written as one folder a language


def _parquet(spark: SparkSession, folder: str) -> DataFrame:
    return S.renamed(spark.read.option("recursiveFileLookup", True).parquet(folder))


def _gzipped_json(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of gzipped JSON; files that can't be read are skipped, the others go on."""
    read = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", True).json(folder)
    return S.renamed(S.lifted(read))


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    files = S.read_zip(spark, f"{folder}/*.zip")
    return files.select(F.col("name").alias("path"), F.decode("content", "utf-8").alias("code"))


CORPORA = {
    "starcoder": Corpus(_parquet),
    "commonpile": Corpus(_gzipped_json, by_language=True),
    "opencoder": Corpus(_parquet),
    "nemotron": Corpus(_parquet),
    "kaggle": Corpus(_archives),
}


def ingest(spark: SparkSession, name: str, folder: str, out: str, fetch: Callable[[str, str], None] | None = None) -> DataFrame:
    """Fetch (if asked), read, bring to the common columns, write to ``out``; the written table."""
    if name not in CORPORA:
        raise ValueError(f"no corpus {name!r}; there are {', '.join(CORPORA)}")
    if fetch is not None:
        fetch(name, folder)
    corpus = CORPORA[name]
    found = corpus.read(spark, folder)
    if corpus.by_language:
        S.write_by_language(found, out)
    else:
        found.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
