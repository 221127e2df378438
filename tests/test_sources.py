import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import ingest as I
from tessera.sources import tables as S


def test_archives_and_gzipped_json(spark, tmp_path):
    (tmp_path / "zips").mkdir()

    def fetch(name, folder):
        with zipfile.ZipFile(f"{folder}/{name}.zip", "w") as z:
            z.writestr("a/one.py", "x = 1\n")
            z.writestr("two.py", "é")

    got = I.ingest(spark, "kaggle", str(tmp_path / "zips"), str(tmp_path / "kaggle"), fetch)
    assert {tuple(r) for r in got.collect()} == {("a/one.py", "x = 1\n"), ("two.py", "é")}
    folder = tmp_path / "edu"
    folder.mkdir()
    lines = [{"text": "int x;", "metadata": {"language": "C++"}}, {"text": "x", "metadata": {"language": "Python"}}]
    with gzip.open(folder / "a.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    (folder / "broken.json.gz").write_bytes(gzip.compress(b'{"text": "lost"}' * 500)[:40])
    got = I.ingest(spark, "commonpile", str(folder), str(tmp_path / "commonpile"))
    assert {(r.folder, r.code) for r in got.collect()} == {("cpp", "int x;"), ("python", "x")}
    with pytest.raises(ValueError):
        I.ingest(spark, "unknown", "", "")


def test_catalogue(spark, tmp_path):
    c = S.Catalog(spark)
    c.register("toy", S.inline_rows(spark, [(3, "c"), (1, "a"), (2, "b")], "id int, text string"), "CommonOJDataset")
    assert c.list() == ["toy"] and c.evaluator("toy") == "CommonOJDataset"
    assert [r.id for r in c.page("toy", 1, 1).collect()] == [2] and c.row("toy", 3).first().text == "c"
    assert sorted(r.id for r in c.ids("toy").collect()) == [1, 2, 3]
    with pytest.raises(RuntimeError):
        c.evaluator("other")
    with pytest.raises(ValueError):
        S.inline_rows(spark, [(1,)], "id int", lookup=True)
    (tmp_path / "one.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert c.register_jsonl_dir(str(tmp_path)) == ["one"] and spark.table("one").count() == 2


def test_rows_asked_for_have_to_be_there(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert [r.k for r in S.head(df, "k", 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        S.head(df, "k", 6)


def test_output_keeps_the_names_of_its_sources(spark, tmp_path):
    spark.range(30).withColumn("p", F.col("id") % 3).write.partitionBy("p").parquet(str(tmp_path / "in"))
    df = S.read_parquet(spark, f"{tmp_path}/in/*/*.parquet", provenance=True)
    names = {r[0].rsplit("/", 1)[-1] for r in df.select("source_file").distinct().collect()}
    S.write_by_source(df.where("id % 2 = 0"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r[0] for r in got.select("file").distinct().collect()} == names and got.count() == 15 and "source_file" not in got.columns


def test_pretty_json_is_limited(spark, tmp_path):
    S.write_json(spark.range(2), str(tmp_path / "j"), pretty_limit=2)
    assert S.read_json(spark, str(tmp_path / "j"), whole_file=True).count() == 2
    with pytest.raises(ValueError):
        S.write_json(spark.range(3), str(tmp_path / "k"), pretty_limit=2)
