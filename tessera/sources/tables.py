"""Readers, writers, the catalogue of problem tables and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; where the session names none, in a local session a temporary one, on a cluster one in
    the warehouse, which executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob in whatever store Spark reads, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(x.getPath().toString() for x in found)


def read_parquet(spark: SparkSession, pattern: str, limit: int | None = None, provenance: bool = False) -> DataFrame:
    """All files of a glob, or the first ``limit`` by name; with provenance, their path as the column source_file."""
    paths = _files(spark, pattern)[:limit]
    if not paths:
        raise FileNotFoundError(pattern)
    df = spark.read.parquet(*paths)
    return df.withColumn("source_file", F.col("_metadata.file_path")) if provenance else df


def read_json(spark: SparkSession, path: str, schema=None, whole_file: bool = False) -> DataFrame:
    """JSON lines (also gzipped), or one JSON array or object per file. Control characters in strings are accepted."""
    reader = spark.read.option("allowUnquotedControlChars", True).option("multiLine", whole_file)
    return (reader.schema(schema) if schema else reader).json(path)


def read_seed_list(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds a JSON array of bare strings -> (position, seed)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "seed"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A relational table; with a numeric key and its bounds the read is split into parts."""
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return spark.read.jdbc(url, table)


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of every file in zip archives. An archive is one row of Spark's binary reader (2 GB at
    most), held by one task; its files are unpacked one at a time."""
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            yield pd.DataFrame([(archive, member.filename, z.read(member))], columns=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def inline_rows(spark: SparkSession, rows, schema, lookup: bool = False) -> DataFrame:
    """Rows given by the caller: a list for a scan, one mapping for a lookup; the wrong kind is refused."""
    if lookup != isinstance(rows, dict):
        raise ValueError("provided data must be a mapping for a lookup and a list for a scan")
    return spark.createDataFrame([rows] if lookup else rows, schema)


class Catalog:
    """Named problem tables, their classes and cached copies."""

    def __init__(self, spark: SparkSession):
        self.spark, self.classes, self.cached = spark, {}, {}

    def register(self, name: str, df: DataFrame, evaluator: str | None = None) -> None:
        df.createOrReplaceTempView(self.table(name))
        if evaluator:
            self.classes[name] = evaluator

    def register_jsonl_dir(self, folder: str) -> list[str]:
        """One view a file, named after the file's stem."""
        names = []
        for path in _files(self.spark, f"{folder}/*.jsonl"):
            stem = path.rsplit("/", 1)[-1].removesuffix(".jsonl")
            read_json(self.spark, path).createOrReplaceTempView(stem)
            names.append(stem)
        return names

    @staticmethod
    def table(name: str) -> str:
        return name if name.startswith("code_eval_") else f"code_eval_{name}"

    def evaluator(self, name: str) -> str:
        if name not in self.classes:
            raise RuntimeError(f"no evaluator is registered for {name}")
        return self.classes[name]

    def list(self) -> list[str]:
        return sorted(self.classes)

    def ids(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name)).select("id")

    def use_cache(self, name: str, columns: set[str]) -> bool:
        """Whether the cached copy holds all that is asked for."""
        return name in self.cached and columns <= self.cached[name]

    def page(self, name: str, offset: int = 0, limit: int = 1_000_000, columns: list[str] | None = None) -> DataFrame:
        return page(self.spark.table(self.table(name)), "id", offset, limit, columns)

    def row(self, name: str, key) -> DataFrame:
        return point_lookup(self.spark.table(self.table(name)), "id", key)


def page(df: DataFrame, key: str, offset: int = 0, limit: int = 1_000_000, columns: list[str] | None = None) -> DataFrame:
    return df.select(*(columns or ["*"])).orderBy(key).offset(offset).limit(limit)


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key; an error where there are fewer."""
    first = df.orderBy(key).limit(n)
    if first.count() < n:
        raise ValueError(f"fewer than {n} rows")
    return first


def renamed(df: DataFrame) -> DataFrame:
    """Corpus columns under their common names."""
    return df.withColumnsRenamed({"content": "code", "text": "code", "lang": "language"})


def lifted(df: DataFrame) -> DataFrame:
    return df.withColumn("language", F.col("metadata.language"))


def language_folder(language: Column) -> Column:
    return F.lower(F.when(language == "C++", "cpp").when(language == "C#", "c-sharp").otherwise(language))


def write_by_language(df: DataFrame, path: str) -> None:
    """One scan, one folder a language."""
    df.withColumn("folder", language_folder(F.col("language"))).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_by_source(df: DataFrame, path: str) -> None:
    """One folder for each file the rows came from (source_file of read_parquet), under the file's own name."""
    named = df.withColumn("file", F.substring_index("source_file", "/", -1)).drop("source_file")
    named.repartition("file").write.mode("overwrite").partitionBy("file").parquet(path)


def write_json(df: DataFrame, path: str, pretty_limit: int | None = None) -> None:
    """JSON lines; or, for at most pretty_limit rows, one indented array. The array goes through the driver as one text: it is for
    reports, so the limit has to be one that the driver can hold."""
    if pretty_limit is None:
        df.write.mode("overwrite").json(path)
        return
    import json

    rows = [json.loads(x) for x in df.limit(pretty_limit + 1).toJSON().collect()]
    if len(rows) > pretty_limit:
        raise ValueError(f"more than {pretty_limit} rows")
    df.sparkSession.createDataFrame([(json.dumps(rows, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def unify(spark: SparkSession, folders: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The column ``code`` of all shards; folders that can't be read are named with their error."""
    out, errors = None, {}
    for folder in sorted(folders):
        try:
            df = spark.read.parquet(folder).select("code")
        except Exception as e:  # a broken folder doesn't stop the others
            errors[folder] = str(e).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df)
    return out, errors


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """A dense index over a total order, by a range sort and one count a partition: no single task sees all rows."""
    parts = stored(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "indexed")
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    first = F.shiftleft(F.col("_p").cast("long"), 33)
    return parts.join(before, "_p").withColumn(name, F.col("_m") - first + F.col("_before")).drop("_p", "_m", "_before")


def split_repo(code: Column) -> tuple[Column, Column]:
    """(repo, code): the first line and the rest; without a line end all is the repo."""
    at = F.instr(code, "\n")
    return F.substring_index(code, "\n", 1), F.when(at == 0, F.lit("")).otherwise(code.substr(at + 1, F.char_length(code)))


def hash_split(key: Column, share: float, seed: int = 42) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return h < int(share * 2**32)


def exact_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with the column train, true for exactly int(rows * share) of them: the first by the hash of key and seed, equal
    hashes by key. Shuffled rows are those in the order of ``place``."""
    n = df.count()
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    placed = with_row_index(df.withColumn("_h", order), ["_h", key], "place").drop("_h")
    return placed.withColumn("train", F.col("place") < int(n * share))
