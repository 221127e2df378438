import numpy as np
from pyspark.sql import functions as F

from tessera.llm import audio


def tune(seed, n=40):
    return np.frombuffer(audio.melody(np.random.default_rng(seed).normal(size=n)), np.int16).astype(float)


def test_excerpt_and_noise_align():
    whole = tune(1)
    part = whole[audio.HOP * 20 : audio.HOP * 20 + 9000] + np.random.default_rng(2).normal(0, 300, 9000)
    offset, error = audio.align(audio.fingerprint(whole), audio.fingerprint(part))
    assert offset == 20 and error < 0.1
    assert audio.align(audio.fingerprint(whole), audio.fingerprint(tune(3)))[1] > 0.25


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=64) for _ in range(12)]
    rows = [(i, (base[i % 12] + rng.normal(0, 0.01 * (i % 5), 64)).tolist()) for i in range(150)] + [(500, base[0].tolist()), (501, None), (502, [1.0]), (None, base[1].tolist())]
    prints = audio.fingerprinted(audio.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    got = {r.id: r for r in audio.search(prints, F.coalesce(F.col("id") % 50 == 0, F.lit(False))).collect()}
    codes = {r.id: np.array(r.codes, np.int64) for r in prints.collect()}
    queries = {i: c for i, c in codes.items() if i is not None and i % 50 == 0 and len(c)}
    found = wanted = 0
    for i, c in codes.items():
        # equal fingerprints are one query
        near = {q.tobytes() for q in queries.values() if len(c) and not np.array_equal(q, c) and audio.align(q, c)[1] <= audio.ERROR}
        wanted += len(near)
        found += min(len(near), got[i].n_queries)
    assert len(got) == len(rows) and wanted and found / wanted >= 0.9
    assert got[501].n_queries == 0 and got[502].cls == 502
