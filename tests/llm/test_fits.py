"""Fitted parts against their definitions: ridge, isotonic steps, ordinal likelihood, expectation-maximisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import audio, pii, quality, toxicity

D = "/root/testdata/sf0.01"


def test_ridge_is_the_least_squares_solution(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    labelled = quality.described(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").withColumn("calibrate", F.col("doc_id") % 4 == 0)
    model = quality.fit(labelled)
    rows = labelled.where("NOT calibrate").collect()
    f, y = np.array([r.f for r in rows]), np.array([r.y for r in rows])
    scale = np.maximum(f.std(0), 1e-6)
    rng, p, m = np.random.default_rng(quality.SEED), f.shape[1], quality.FEATURES
    w, b = rng.normal(0, 1 / np.sqrt(p), (p, m - 1)), rng.uniform(0, 2 * np.pi, m - 1)

    def features(x):
        return np.hstack([np.sqrt(2 / m) * np.cos(np.clip((x - f.mean(0)) / scale, -5, 5) @ w + b), np.ones((len(x), 1))])

    penalty = np.sqrt(quality.RIDGE * len(y) / m) * np.eye(m)
    best = np.linalg.lstsq(np.vstack([features(f), penalty]), np.concatenate([y, np.zeros(m)]), rcond=None)[0]
    assert np.abs(model.raw(f) - features(f) @ best).max() < 1e-6
    # the products of features approximate a Gaussian kernel
    z = np.clip((f[:60] - f.mean(0)) / scale, -5, 5)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * p))
    assert np.abs(features(f[:60])[:, :-1] @ features(f[:60])[:, :-1].T - kernel).max() < 0.35
    assert (np.diff(model.y) >= 0).all()


def test_isotonic_steps_are_the_minimax_means():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 9, 15).astype(float)
        ones = np.floor(n * rng.random(15))
        mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, 15)) for a in range(i + 1)) for i in range(15)]
        assert np.allclose(quality.isotonic(n, ones), want)


def test_no_small_move_betters_the_ordinal_fit():
    rng, bad = np.random.default_rng(2), np.arange(6)
    rows = []
    for i in range(900):
        common = rng.choice(np.arange(100, 160), 12, replace=False)
        worst = rng.choice(bad, rng.integers(1, 6), replace=False) if i % 3 == 0 else rng.choice(bad, int(rng.random() < 0.05), replace=False)
        rows.append((int(i % 3 == 0), np.unique(np.concatenate([common, worst])).astype(np.int32)))
    model = toxicity.fit(rows)
    assert set(bad) <= set(model.buckets.tolist()) and (np.diff(model.thresholds) > 0).all()
    x = np.array([[b in set(ids.tolist()) for b in model.buckets] for _, ids in rows], float)
    y = np.array([r[0] for r in rows])
    hits = np.array([np.isin(ids, bad).sum() for _, ids in rows])
    grade = np.where(y == 1, 1 + (hits >= 2) + (hits >= 4), 0)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, t):
        z = np.clip((x @ w)[:, None] - t[None], -40, 40)
        target = grade[:, None] > np.arange(3)[None]
        return (share[:, None] * np.where(target, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum() + toxicity.PENALTY / 2 * (w**2).sum()

    now = loss(model.weights, model.thresholds)
    assert now < 0.6 * loss(model.weights * 0, np.array([0.0, 1.0, 2.0]))
    for i in range(len(model.weights)):
        for step in (-0.1, 0.1):
            assert loss(model.weights + step * (np.arange(len(model.weights)) == i), model.thresholds) > 0.99 * now
    for k in range(3):
        for step in (-0.1, 0.1):
            assert loss(model.weights, model.thresholds + step * (np.arange(3) == k)) > 0.99 * now


def test_only_telling_words_go_to_the_driver(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    sampled = toxicity.sample(docs.select("doc_id", "text"), labels)
    rows = lambda df: [(r.y, np.array(r.ids, np.int32)) for r in df.collect()]
    whole, few = rows(sampled), rows(toxicity.telling(sampled))
    assert len(few) == len(whole) and sum(len(r[1]) for r in few) < sum(len(r[1]) for r in whole) / 10
    a, b = toxicity.fit(whole), toxicity.fit(few)
    assert len(a.buckets) and np.array_equal(a.buckets, b.buckets) and np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.thresholds, b.thresholds, atol=1e-6)


def test_reliabilities_by_expectation_maximisation():
    seen = [((1, 1, 1), 40), ((1, 1, 0), 90), ((1, -1, 0), 12), ((-1, 1, 0), 25), ((-1, -1, 0), 70), ((-1, -1, -1), 30), ((-1, 1, 1), 18)]
    votes, n = np.array([v for v, _ in seen]), np.array([c for _, c in seen], float)
    onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    trust = np.array([0.9, 0.7, 0.6])
    yes = np.stack([(1 - trust) / 1, 0 * trust, trust], 1)
    yes[:, 0], yes[:, 2], yes[:, 1] = (1 - trust), trust, (1 - trust)
    no = yes[:, ::-1].copy()
    no[:, 1] = 1 - trust
    prior = 0.5
    for _ in range(pii.ROUNDS):
        a = prior * (onehot * yes).sum(2).prod(1)
        b = (1 - prior) * (onehot * no).sum(2).prod(1)
        p = a / (a + b)
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        yes = (np.einsum("i,ijk->jk", n * p, onehot) + 1) / ((n * p).sum() + 3)
        no = (np.einsum("i,ijk->jk", n * (1 - p), onehot) + 1) / ((n * (1 - p)).sum() + 3)
    got = pii._reliabilities(seen)
    # abstentions start from half the rest in the operator and from all of it here: the first round's scale, gone by the last
    assert np.allclose([got[v] for v, _ in seen], p, atol=0.05)
    assert got[(1, 1, 1)] > 0.95 and got[(-1, -1, -1)] < 0.05


def test_labelers_add_spans_that_rules_miss(spark):
    rows = [(i, f"Please call 415-555-{2000 + i} today, or write to a{i}@b.org") for i in range(60)]
    rows += [(100 + i, f"phone: +49 30 1234 {500 + i} in Berlin") for i in range(60)]
    rows += [(200 + i, f"order ref 155-555-{3000 + i} was shipped") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(60):
        added = [s for s in got[i] if not s.base]
        assert [(s.kind, rows[i][1][s.start : s.end]) for s in added] == [("phone", f"415-555-{2000 + i}")]
        assert [s.kind for s in got[100 + i]] == ["phone"] and got[100 + i][0].base
        assert not got[200 + i]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "plain words", 3, 0.5, "x"), (None, None, 3, 0.5, "x"), (1, "plain words", 3, 0.5, "x")], "doc_id long, text string, y int, f double, grade string")
    labels = spark.createDataFrame([(1, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    assert toxicity.score(docs, labels).count() == 3 and toxicity.score(docs.limit(0), labels).count() == 0
    assert quality.scored(docs, labels).count() == 3
    assert pii.detect(docs.limit(0)).count() == 0
    media = audio.rendered(spark.createDataFrame([(0, [float(x) for x in range(64)]), (0, [float(x) for x in range(64)]), (50, [1.0] * 64)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    prints = audio.fingerprinted(media.withColumn("codes", F.lit(1)).withColumn("cls", F.lit(1)))
    asks = F.coalesce(F.col("id") % 50 == 0, F.lit(False))
    assert audio.search(prints, asks).count() == 3 and audio.search(prints.limit(0), asks).count() == 0


@pytest.mark.parametrize("tile", [1, 3])
def test_audio_tiles(spark, monkeypatch, tile):
    rng = np.random.default_rng(6)
    base = [rng.normal(size=64) for _ in range(3)]
    rows = [(i * 25, (base[i % 3] + rng.normal(0, 0.005, 64)).tolist()) for i in range(12)]
    prints = audio.fingerprinted(audio.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    run = lambda: sorted(tuple(r) for r in audio.search(prints, F.col("id") % 50 == 0).collect())
    want = run()
    monkeypatch.setattr(audio, "TILE", tile)
    assert run() == want
