import pytest
from pyspark.sql import functions as F

from tessera.operators.regressor import TextRegressor
from tessera.sources import tables as S


def test_held_out_scores(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_chars < 4000").withColumn("train", S.hash_split(F.col("doc_id"), 0.7))
    regressor = TextRegressor(label="toxic").train(rows.where("train"))
    metrics, confusion = regressor.test(rows.where("NOT train"))
    m = metrics.first()
    spread, toxic = rows.where("NOT train").agg(F.var_pop("toxic"), F.avg("toxic")).first()
    assert m.n > 300 and m.mse < 0.8 * spread and m.accuracy > 1 - toxic
    assert sum(r.n for r in confusion.collect()) == m.n
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5)], "doc_id long, text string, score int")
    before = regressor.annotate(odd, "rated").collect()
    assert len(before) == 2 and before[0].rated == before[1].rated and before[0].score == 5
    regressor.save(str(tmp_path / "model"))
    assert TextRegressor().load(str(tmp_path / "model")).annotate(odd, "rated").collect() == before
    with pytest.raises(RuntimeError):
        TextRegressor().annotate(odd)
