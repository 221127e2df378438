"""What the training-data operators share: the durable folder, stored tables, hash splits."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 1000  # rows that a task hands to Python at once
GROUP_ROWS, GROUP_BYTES = 1 << 17, 8 << 20  # a row group of a table written from Python has about as many, or less


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``); a folder of our own only where none is set: in a local
    session a temporary one, on a cluster one in the warehouse, which executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def _storing(spark: SparkSession):
    """Nothing reads a finished write's shuffle files again; texts go to Python a few megabytes at a time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _storing(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema); if df comes from here as well, both run in one Python process, without the JVM between."""
    source, first = getattr(df, "_mapped", (df, None))
    both = run if first is None else lambda batches: run(first(batches))
    out = source.mapInArrow(both, schema)
    out._mapped = source, both
    return out


def stored_by_python(df: DataFrame, name: str) -> DataFrame:
    """What stored does, without a process start on a local shared folder. There Spark's writer starts chmod three times a
    task (file, checksum file, folder), and until chmod runs the new process counts as large as the executor. So Python writes
    the files, each task into a folder that readers skip; the driver moves those of the attempts that ended well. On any other
    file system stored does it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() != "file":
        return stored(df, name)
    folder, schema = at.toUri().getPath(), to_arrow_schema(df.schema)
    os.makedirs(f"{folder}/_tasks")

    def write(batches):
        from pyarrow import parquet

        file, writer, held, rows, size = f"part-{uuid.uuid4().hex}.parquet", None, [], 0, 0

        def flush():
            nonlocal writer, held, rows, size
            writer = writer or parquet.ParquetWriter(f"{folder}/_tasks/{file}", schema)
            writer.write_table(pa.Table.from_batches(held).combine_chunks().cast(schema))
            held, rows, size = [], 0, 0

        try:
            for batch in batches:
                if len(batch):
                    held.append(batch)
                    rows, size = rows + len(batch), size + batch.nbytes
                if rows >= GROUP_ROWS or size >= GROUP_BYTES:
                    flush()
            if held:
                flush()
        finally:
            if writer:
                writer.close()
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([file])], names=["file"])

    with _storing(spark):
        for row in mapped(df, write, "file string").collect():
            os.rename(f"{folder}/_tasks/{row.file}", f"{folder}/{row.file}")
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them has been stored as well."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished stages, which it does once the driver's JVM has collected garbage."""
    spark.sparkContext._jvm.System.gc()


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte-wise path of lower()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
