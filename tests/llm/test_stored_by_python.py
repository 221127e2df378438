import hashlib
import os

from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import suffix_dedup as S

TINY = "/root/testdata/sf0.001"


def test_suffix_dedup_starts_no_process_for_its_tables(spark, tmp_path):
    """Before, each task that wrote one started chmod three times; the new process counts as large as the executor at first."""
    jvm = spark.sparkContext._jvm
    recording = jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart")
    recording.start()
    try:
        assert S.query(spark, TINY).count()
        recording.stop()
        at = jvm.java.io.File(str(tmp_path / "starts.jfr")).toPath()
        recording.dump(at)
    finally:
        recording.close()
    commands = [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(at) if e.getEventType().getName() == "jdk.ProcessStart"]
    assert [c for c in commands if "suffix-" in c] == []


def test_digests_are_those_of_the_kept_bytes(spark):
    kept = S.dedup(common.documents(spark, TINY))
    expected = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in kept.collect())
    found = S.query(spark, TINY)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect())) == expected
    plain = spark.createDataFrame(kept.collect(), kept.schema)  # rows that come from the JVM
    assert sorted(map(tuple, S.digested(plain).collect())) == expected


def odd(spark):
    rows = [(1, None, None, b"\x00\xff", True), (None, "é", [(1, -1)], None, None), (3, "", [], b"", False), (4, "x" * 5000, [(2, 7), (None, 3)], b"q", True)]
    return spark.createDataFrame(rows * 50, "a long, b string, c array<struct<d:long,e:int>>, f binary, g boolean").repartition(7)


def sorted_rows(df):
    return sorted(map(str, df.collect()))


def test_odd_rows_come_back(spark, monkeypatch):
    df = odd(spark)
    for group in (3, 1 << 17):  # many row groups, and one
        monkeypatch.setattr(common, "GROUP_ROWS", group)
        out = common.stored_by_python(df, "odd")
        assert out.schema == df.schema and sorted_rows(out) == sorted_rows(df)
    assert common.stored_by_python(df.limit(0), "odd").collect() == []
    assert common.stored_by_python(df.where("a = 9"), "odd").schema == df.schema


def test_attempts_that_failed_are_not_read(spark):
    out = common.stored_by_python(spark.range(10).repartition(2), "attempts")
    folder = out._stored_at.removeprefix("file://")
    done = next(n for n in os.listdir(folder) if n.startswith("part-"))
    with open(f"{folder}/{done}", "rb") as whole, open(f"{folder}/_tasks/part-late.parquet", "wb") as late:
        late.write(whole.read())
    assert sorted(r.id for r in spark.read.parquet(out._stored_at).collect()) == list(range(10))
    common.discard(out)
    assert not os.path.exists(folder)


def test_another_file_system_is_written_by_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: "viewfs://elsewhere/in")
    link = "fs.viewfs.mounttable.elsewhere.link./in"
    spark.conf.set(link, f"file://{tmp_path}")
    try:
        df = odd(spark)
        out = common.stored_by_python(df, "odd")
        assert out._stored_at.startswith("viewfs://elsewhere/in/odd-") and sorted_rows(out) == sorted_rows(df)
    finally:
        spark.conf.unset(link)


def test_mapped_tables_share_a_process(spark):
    def twice(batches):
        for b in batches:
            yield b
            yield b

    four = common.mapped(common.mapped(spark.range(5), twice, "id long"), twice, "id long")
    assert four._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1
    assert sorted(r.id for r in four.collect()) == sorted(list(range(5)) * 4)
    assert common.stored_by_python(four, "four").agg(F.sum("id")).first()[0] == 40
