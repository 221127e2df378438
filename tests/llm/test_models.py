"""Held-out accuracy of the fitted operators and odd rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, quality, toxicity

D = "/root/testdata/sf0.01"
ROWS = [(1, None, None), (2, "", "b"), (None, "plain words here", "a"), (3, "word " * 50_000, "a"), (3, "word " * 50_000, "a")]


def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


def test_quality_held_out(spark):
    got = quality.query(spark, D).where("held_out").join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 80 and right / n > 0.93
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.scored(odd(spark), none).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(odd(spark).limit(0), none).count() == 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = toxicity.score(docs, labels.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 3 = 0"), "doc_id")
    both, said, toxic = got.agg(F.count_if(F.col("said") & (F.col("toxic") == 1)), F.count_if("said"), F.count_if(F.col("toxic") == 1)).first()
    assert both / said > 0.9 and both / toxic > 0.8
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxic for r in toxicity.score(odd(spark), none).collect()] == [False] * len(ROWS)




def test_mixing_sums_and_odd_rows(spark):
    got = mixing.mix(odd(spark))
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 1
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_mixing_with_small_ranges_and_null_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.expr("if(doc_id % 3 = 0, null, doc_id)"))
    whole, small = (sorted((tuple(r) for r in mixing.mix(docs, range_rows=n).collect()), key=str) for n in (10**6, 3))
    assert whole == small
    named = docs.withColumn("target", F.lit("x")).withColumn("size", F.lit(1)).withColumn("_key", F.lit(0))
    assert sorted((tuple(r) for r in mixing.mix(named).collect()), key=str) == whole


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "Plain WORDS"), (2, None), (3, "..."), (4, "plain words"), (5, "word " * 20)], "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.phrase_matches(odd(spark), bench).collect()}
    assert got == {(1, 0, 0, ()), (2, 0, 0, ()), (None, 3, 2, ("1", "4")), (3, 50_000, 50_000, ("5",))}
    assert decontaminate.phrase_matches(odd(spark), bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_with_clashing_columns(spark):
    rows = [(7, "plain words", "x", 1, "y", 5, "p", "q"), (7, "other", "x", 1, "y", 5, "p", "q")]
    names = "doc_id long, text string, places string, n_words int, items string, row int, judged string, _c string"
    bench = spark.createDataFrame([(1, "Plain WORDS", 3)], "item_id long, text string, width int")
    got = decontaminate.phrase_matches(spark.createDataFrame(rows, names), bench)
    assert sorted((r.doc_id, r.text, r.places, r.row, r["_c"], r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == [(7, "other", "x", 5, "q", 1, 0, ()), (7, "plain words", "x", 5, "q", 2, 2, ("1",))]


def test_decontamination_without_broadcasts(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    want = sorted(decontaminate.query(spark, d).collect())
    monkeypatch.setattr(decontaminate, "TERMS", 0)
    monkeypatch.setattr(decontaminate, "CHARACTERS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(decontaminate.query(spark, d).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def near_by_brute_force(docs, items, slop, width):
    """Proximity by its definition, over every place of every text."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    windows = {}
    for item, text in items:
        w = cut(text)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + width]), set()).add(str(item))
    counts = Counter(t for _, text in docs for t in cut(text))
    out = set()
    for terms, owners in windows.items():
        rare = sorted(range(len(terms)), key=lambda i: (counts[terms[i]], i))[: decontaminate.RARE_TERMS]
        reach = max(rare) - min(rare) + slop
        for doc, text in docs:
            w = cut(text)
            for at in (i for i, x in enumerate(w) if x == terms[rare[0]]):
                nearest = [min((p for p, x in enumerate(w) if x == terms[i]), key=lambda p: (abs(p - at), p), default=None) for i in rare]
                if all(p is not None and abs(p - at) <= reach for p in nearest):
                    out |= {(doc, owner, at, min(nearest), max(nearest)) for owner in owners}
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(n))
    docs = [(rng.choice([None, 5, i]), text(rng.choice([2, 20, 90]))) for i in range(30)]
    docs += [(5, "plain a"), (5, "b words"), (None, "plain b c words"), (9, "word " * 300), (9, None), docs[3]]
    items = [(i, text(rng.choice([1, 2, 4, 9]))) for i in range(12)] + [(77, "Plain WORDS"), (78, "plain words"), (79, None), (80, "word word word")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.proximity_matches(df, bench, slop=1, width=5).collect()}
    assert got == near_by_brute_force(docs, items, 1, 5)
    assert not any(d == 5 and i in ("77", "78") for d, i, *_ in got) and any(d is None and i == "77" for d, i, *_ in near_by_brute_force(docs, items, 2, 5))
