import random
import re

import numpy as np

from tessera.llm import jaccard


def brute(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                    root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    ids = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(sets[i]), ids[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            texts.append(" ".join(w) or "a")
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 9, 12, 20, 40, 90, 200]))))
    return texts


def test_components_match_brute_force(spark):
    for seed, (width, num, den) in enumerate([(3, 90, 100), (5, 80, 100), (1, 70, 100)]):
        texts = corpus(seed)
        rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " \n"), (902, "A b"), (903, "a B"), (7, texts[7]), (None, texts[3]), (None, "alone here now"), (3, "quite another text than before")]
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
        got = sorted((tuple(r) for r in jaccard.join(df, width, num, den).select("doc_id", "n_shingles", "component_id").collect()), key=str)
        want = brute(rows, width, num, den)
        # texts with no words stay by themselves
        assert got == want


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "x y " * 200_000), (2, "z" * 500_000)], "doc_id long, text string")
    assert sorted(tuple(r)[0] for r in jaccard.join(df).collect()) == [1, 2]
    assert jaccard.join(df.limit(0)).count() == 0


def test_small_tiles_and_no_rounds(spark, monkeypatch):
    """Everything that stars leave open goes through tiles, in many slices of the keys."""
    monkeypatch.setattr(jaccard, "TILE", 2)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "KEYS", 0.1)
    texts = corpus(7, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(df, 5, 80, 100).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(list(enumerate(texts)), 5, 80, 100)


def test_similar_sets_always_meet():
    """The D + 1 first blocks of any two sets within the threshold have one in common, whatever the order."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(5, 400))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        out = int(rng.integers(0, n // 5 + 1))
        y = np.concatenate([x[out:], rng.integers(0, 2**63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        bands = jaccard.Bands(80, 100)
        g = bands.of(len(x))
        assert bands.of(len(y)) in (g, g + 1)
        if bands.differ(g) == 0:
            assert len(np.setxor1d(x, y)) == 0
            continue
        given = [jaccard.keys(u, np.zeros(len(u), np.int64), np.array([g]), bands) for u in (x, y)]
        order = {int(k): rng.random() for k in np.concatenate([given[0][0], given[1][0]])}
        first = [set(sorted((int(k) for k in key), key=order.get)[: len(key) - int(spare[0])]) for key, _, spare in given]
        # a class that gives fewer blocks than K has left out empty ones, which come last
        assert all(len(f) == bands.differ(g) + 1 for f in first)
        assert first[0] & first[1]


def test_forgetting_classes_costs_rows_only():
    seen = set()
    cls, n = np.array([5, 5, 6, 0]), np.array([1, 1, 1, 0])
    assert list(jaccard._unseen(cls, n, seen)) == [0, 2] and not len(jaccard._unseen(cls, n, seen))
    seen.update(range(jaccard.SEEN + 1))
    assert list(jaccard._unseen(cls, n, seen)) == [0, 2] and len(seen) == 2


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITMAP", 64)
    texts = corpus(9, 100)
    rows = list(enumerate(texts)) + [(None, texts[3]), (2, texts[8])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, 3, 90, 100)
