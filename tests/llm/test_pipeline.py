import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, mixing
from tests.llm import test_jaccard, test_pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_keeps_short_and_repetitive_texts(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    held = [i for i in range(10**6, 10**6 + 5000) if zlib.crc32(str(i).encode()) % 5 == 0]
    cuts = [(" ".join((t or "").split()[:5]), lang) for _, t, lang, _, _ in rows if any(c.isalpha() for c in " ".join((t or "").split()[:5]))]
    cuts += [("Was " * 600, "en"), ("a", "en")]
    more = [(i, t, lang, "s", len(t)) for i, (t, lang) in zip(held, cuts, strict=False)]
    odd = [(2 * 10**6, "12 !!", "en", "s", 5), (2 * 10**6 + 1, None, "en", "s", 0)]
    got = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(rows + more + odd, SCHEMA), d).collect()}
    assert len(more) > 100 and {r[0] for r in more} <= got
    assert not got & {r[0] for r in odd}


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    rows = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (None, text["c"]), (None, text["d"]), (None, text["d"] + " more"), (None, text["a"]), (7, text["e"]), (7, text["e"]), (8, text["e"] + " more"), (5, None), (None, ""), (9, text["f"])]
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()), key=str)
    got = kept(rows)
    d = [r for r in got if r[1] and r[1].startswith(text["d"])]
    assert len(d) == 1 and d[0][0] is None
    want = [(3, text["a"]), (5, text["b"]), (None, text["c"]), *d, (7, text["e"]), (5, None), (None, ""), (9, text["f"])]
    assert got == sorted(want, key=str)
    # without repeated ids
    assert kept([(4, text["a"]), (2, text["a"]), (None, text["a"]), (6, ""), (1, text["b"])]) == sorted([(2, text["a"]), (6, ""), (1, text["b"])], key=str)


CLASHING = {"cls": "x", "root": 1, "row": "x", "size": 0.5, "taken": "x", "spans": 1, "_c": "x", "_t": 1, "score": "x", "place": 1, "key": "x", "lang_pred": "x"}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    rows = [(1, "the cat and the dog sat there " * 3, "en", "a"), (None, "el gato y el perro comen pan " * 3, "es", None), (1, None, "en", "a"), (2, "", None, "b"), (3, "long words here " * 20_000, "en", "a"), (3, "long words here " * 20_000, "en", "a"), (4, " 12 !! ", "en", "b")]
    docs = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)
    wide = docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    got, plain = stage(spark, wide, "/root/testdata/sf0.001"), stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    if stage is not corpus_pipeline.mixing_to_weights:
        assert got.columns == list(corpus_pipeline.COLUMNS)
    kept = {"language": 4, "near_duplicates": 6}.get(stage.__name__, 7)
    assert plain.count() == kept
    assert stage(spark, wide.limit(0), "/root/testdata/sf0.001").count() == 0


def contaminated(text, items):
    """By the contract's rule, one window after the other."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit = cut(text), set()
    for item in items:
        v = cut(item)
        for s in range(max(1, len(v) - 12)) if v else ():
            window = v[s : s + 13]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_each_stage_against_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    kept = corpus_pipeline.stored(corpus_pipeline.language(spark, docs, d), "test")
    rows = kept.collect()
    # one of each component: the smallest id
    labelled = test_jaccard.brute([(r.doc_id, r.text) for r in rows], 5, 80, 100)
    want = {i for i, n, component in labelled if n == 0 or i == component}
    kept = corpus_pipeline.stored(corpus_pipeline.near_duplicates(spark, kept, d), "test")
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want) < len(labelled)
    want = {r.doc_id for r in rows if not contaminated(r.text, items)}
    kept = corpus_pipeline.stored(corpus_pipeline.decontamination(spark, kept, d), "test")
    before = {r.doc_id: r for r in kept.collect()}
    assert before.keys() == want and len(want) < len(rows)
    kept = corpus_pipeline.stored(corpus_pipeline.personal_data(spark, kept, d), "test")
    changed = 0
    for r in kept.collect():
        old = before[r.doc_id]
        spans = sorted((s, e, kind) for kind, s, e in test_pii.base(old.text))
        assert r.text == old.text or "<" in r.text
        assert all(f"<{kind.upper()}>" in r.text for _, _, kind in spans[:1])
        if not spans and r.text == old.text:
            assert r == old
        changed += r.text != old.text
    assert changed
    path = f"{tmp_path}/documents.parquet"
    kept.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    mix = con.execute(f"SELECT doc_id, size, source_size, round(target, 3), taken FROM ({mixing.ORACLE_SQL})").fetchall()
    got = corpus_pipeline.mixing_to_weights(spark, kept, d).select("doc_id", "size", "source_size", F.round("target", 3), "taken").collect()
    assert sorted(map(tuple, got)) == sorted(mix)
    # run() is these stages in turn
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "size", "taken").collect()) == sorted((r[0], r[1], r[4]) for r in mix)


def shuffled(spark):
    """Bytes that tasks have given to shuffles so far."""
    time.sleep(1)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_near_duplicates_shuffle_few_texts(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))
    rows = [(i, text(), "en", "s", 1) for i in range(300)]
    rows += [(300 + i, rows[i][1], "en", "s", 1) for i in range(20)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, SCHEMA), "test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        before = shuffled(spark)
        ids = sorted(r.doc_id for r in kept.collect())
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ids == list(range(300))
    assert moved < 0.25 * sum(len(r[1]) for r in rows)


def test_near_duplicates_with_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITMAP", 64)
    rows = [(i, f"a{i % 90} b{i % 90} c{i % 90} d{i % 90} e{i % 90} f{i % 90}", "en", "s", 1) for i in range(300)] + [(None, "x y z", "en", "s", 1), (900, None, "en", "s", 1)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([*range(90), None, 900], key=str)
