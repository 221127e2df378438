import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.query(spark, d)
    both = got.join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.95
    assert got.count() == 1000


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog " * 5, "en", 7), (2, "el gato y el perro " * 5, "es", 7), (None, None, None, 7), (5, "12 !!", "en", 7), (6, "x" * 300_000, None, 7), (1, "the cat and the dog " * 5, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in langid.identify(docs).collect()]
    assert len(got) == 6
    und = [r for r in got if r[2] == "und"]
    assert {r[0] for r in und} == {None, 5} and all(r[3] == 0 for r in und)
    assert all(0 <= r[3] <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0


def profile(text, dimensions=langid.DIMENSIONS):
    """A bundle by its definition, one trigram at a time."""
    letter = lambda c: 2 * np.random.default_rng((langid.SEED, ord(c))).integers(0, 2, dimensions) - 1
    kept = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    out, line = np.zeros(dimensions), f" {kept} "
    for i in range(len(line) - 2 if kept else 0):
        out += np.roll(letter(line[i]), 2) * np.roll(letter(line[i + 1]), 1) * letter(line[i + 2])
    return out


def test_scores_against_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("The cat and the dog.", "en"), ("El gato y el perro", "es"), ("A DOG, a cat; a bird", "en"), ("los perros y los gatos", "es"), ("der Hund und die Katze", "de"), ("ünd ein Vogel", "de"), ("perro dog Hund", None), ("the the the", "en"), ("", "en"), ("gato", "zz")] * 3)]
    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5 != 0 and profile(t).any():
            sums[lang] = sums.get(lang, 0) + unit(profile(t))
    names = sorted(sums)
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        v = profile(rows[r.doc_id][1])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosine = [float(unit(sums[x]) @ unit(v)) for x in names]
        assert abs(r.score - max(0, max(cosine))) < 1e-5 and cosine[names.index(r.lang_pred)] > max(cosine) - 1e-5


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "same words here", "ba"[i % 2]) for i in range(40) if zlib.crc32(str(i).encode()) % 5][:20]
    even = [r for r in rows if r[0] % 2 == 0][:5] + [r for r in rows if r[0] % 2][:5]
    got = langid.identify(spark.createDataFrame(even, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"}


def test_bundles_do_not_depend_on_the_cache():
    text = "".join(chr(0x4E00 + x) for x in np.random.default_rng(1).integers(0, 20_000, 60_000))
    whole, small, none = (langid.Vectors(cache=n) for n in (10**6, 700, 0))
    for t in ("plain words", text, "more plain words", text[:3000]):
        a, b, c = (langid.bundle(t, v) for v in (whole, small, none))
        assert np.array_equal(a, b) and np.array_equal(a, c)
    assert len(small.codes) <= 700 and len(small.table) <= 700 and len(none.table) == 0
