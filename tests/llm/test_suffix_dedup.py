import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup as S

L = S.LENGTH


def brute(rows):
    first = {}
    key = lambda d: S.LAST if d is None else d
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - L + 1):
            w = b[i : i + L]
            first[w] = min(first.get(w, S.LAST), key(d))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - L + 1):
            if first[b[i : i + L]] < key(d):
                gone[i : i + L] = [True] * L
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df, dedup=S.dedup):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in dedup(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([8, 12, 15, 40]))) for _ in range(12)]
    texts = []
    for _ in range(120):
        if texts and rng.random() < 0.25:
            t = rng.choice(texts)
            if rng.random() < 0.6 and t:
                i = rng.randrange(len(t))
                t = t[:i] + rng.choice(["x", "", "yy "]) + t[i + 1 :]
        else:
            t = " ".join(rng.choice(passages) if rng.random() < 0.2 else word() for _ in range(rng.choice([0, 3, 30, 120])))
        texts.append(t)
    texts += ["a" * 300, "a" * 120, "ab" * 90, "For " * 60, "For " * 40, "b" + "a" * 49, "a" * 50]
    return texts


def test_against_brute_force(spark):
    for seed in range(3):
        texts = corpus(seed)
        ids = list(range(len(texts)))
        random.Random(seed).shuffle(ids)
        rows = list(zip(ids, texts, strict=True)) + [(None, texts[5]), (900, None), (3, texts[9]), (3, texts[9]), (901, ""), (None, "q" * 200)]
        df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, open boolean")
        assert result(df) == brute(rows), seed


def test_corpus_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([(1, "xyz " * 200_000), (2, "xyz " * 100)], "doc_id long, text string")
    assert [r[2] for r in result(df)] == [0, 400]
    assert result(df.limit(0)) == []


def test_small_groups_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 2)
    monkeypatch.setattr(S, "PASSES", 5)
    rows = list(enumerate(corpus(11)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_text_beyond_the_packed_size():
    """The order of a document too long for packed places is the same."""
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 1 << 12).astype(np.uint8)
    at = np.array([0, len(raw)])
    _, rank = S.ranks(raw)
    packed = S.elected(rank, at)
    long = np.concatenate([raw, np.zeros((1 << 24) + 1 - len(rank), np.uint8) + 100])
    _, rank = S.ranks(long)
    unpacked = S.elected(rank, np.array([0, len(long)]))
    n = len(packed[1]) - 2
    assert all(np.array_equal(a[:n], b[:n]) for a, b in zip(packed, unpacked, strict=True))


def test_every_position_against_brute_force(spark):
    texts = corpus(5)[40:]
    rows = list(enumerate(texts)) + [(None, texts[5]), (900, None), (3, texts[9]), (3, texts[9]), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, S.dedup_by_sorting) == brute(rows)
    assert result(df.limit(0), S.dedup_by_sorting) == []


def recorded(monkeypatch):
    """The names and rows of the tables that dedup stores from now on."""
    tables, real = [], S.stored

    def stored(df, name):
        out = real(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(S, "stored", stored)
    return tables


def test_shared_ranks_do_not_store_their_windows(spark, monkeypatch):
    """Passages shorter than LENGTH in ever new surroundings: all their windows are compared, none gets a row on disk."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passages = [word(40) for _ in range(5)]
    rows = [(i, " ".join(w for p in passages for w in (word(60), p))) for i in range(150)]
    tables = recorded(monkeypatch)
    found = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == brute(rows) and sum(r[2] for r in found) == 0
    # before, a row of suffix-pairs for each window of a part
    assert [n for name, n in tables if name not in ("suffix-ids", "suffix-settled")] == [0, 0, 0]


def test_parts_of_large_groups_are_compared_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 5)
    monkeypatch.setattr(S, "STEP", 3)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line = word(70)
    rows = list(enumerate(corpus(12) + [word(20) + line + rng.choice("xyz") * rng.randint(0, 3) + word(20) for _ in range(80)]))
    rows += [(None, rows[-1][1] + "q"), (3, rows[-2][1] + "r"), (3, rows[-3][1] + "s")]
    tables = recorded(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert result(df) == brute(rows)
    assert any(name == "suffix-pairs" and n for name, n in tables)


def test_parts_within_steps(spark, monkeypatch):
    """Keys go on from one step to the next, none is large."""
    monkeypatch.setattr(S, "STEP", 3)
    rows = list(enumerate(corpus(13)))
    tables = recorded(monkeypatch)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert not any(name == "suffix-pairs" for name, _ in tables)
