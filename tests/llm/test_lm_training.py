import numpy as np

from tessera.llm import lm


def test_all_counts_are_learned():
    # 2000 of 10^9 counts: a sample of 2 million would hold four of them, and leave them at their share of 2e-6
    follows = np.zeros((lm.SYMBOLS, lm.SYMBOLS))
    follows[:4, :4] = 10**9 / 16
    follows[10, 20] = follows[11, 21] = 2000
    p = 10 ** lm.train(follows).astype(float)
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    assert p[10, 20] > 0.05 and p[11, 21] > 0.05


def test_held_out_texts(spark):
    """Every token's probability is normalised, and held-out tokens are the likelier for their context."""
    d = "/root/testdata/sf0.01"
    held = lm.query(spark, d).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS model", "sum(base_score) / sum(n_tokens) AS base").first()
    # 0.283 above the base with 255 own words
    assert held.model - held.base > 0.31
