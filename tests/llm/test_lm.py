import math
import re
import zlib

from tessera.llm import lm


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def base(rows):
    train = [w for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2 for w in words(t)]
    count = {}
    for w in train:
        count[w] = count.get(w, 0) + 1
    bottom = len(train) + len(count) + 1
    out = []
    for d, t in rows:
        w = words(t)
        out.append((d, len(w), sum(x in count for x in w), len(train), sum(math.log10((count.get(x, 0) + 1) / bottom) for x in w)))
    return out


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) <= 1e-6 * max(1, abs(b[4])), (a, b)


def test_base_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = lm.query(spark, d).collect()
    close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], base(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, "a B a"), (2, None), (3, ""), (None, "b"), (4, "x" * 100_000), (5, "y " * 50_000), (1, "a B a")]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.scored(df).collect()], base(rows))
    assert lm.scored(df.limit(0)).count() == 0


def test_rare_and_frequent_counts_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r for r in lm.scored(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", lm.OWN)
    for r in lm.scored(docs).collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (w.n_tokens, w.n_known)
        assert abs(r.base_score - w.base_score) < 1e-6 * abs(w.base_score) and abs(r.score - w.score) < 1e-6 * abs(w.score)
