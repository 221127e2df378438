import math

from pyspark.sql import functions as F

from tessera.operators import codebleu as C
from tessera.operators import scores

REFERENCE = "def total(xs):\n    out = 0\n    for x in xs:\n        out = out + x\n    return out\n"


def test_parts():
    # precisions 3/4, 2/3, 1/2 and none of one, no penalty
    assert math.isclose(C.bleu(list("abcx"), list("abcd")), (3 / 4 * 2 / 3 * 1 / 2 * 0.1) ** 0.25)
    assert math.isclose(C.bleu(list("ab"), list("abcd")), math.exp(1 - 2))
    assert math.isclose(C.bleu(["for", "x"], ["for", "y"], lambda g: 5.0 if g == ("for",) else 1.0), (5 / 6 * 0.1) ** 0.5)
    renamed = REFERENCE.replace("out", "acc").replace("xs", "items")
    assert C.subtrees(renamed) == C.subtrees(REFERENCE) and C.data_flow(renamed) == C.data_flow(REFERENCE)
    assert C.data_flow("a = b\nc = a") == {(1, 0): 1, (2, 1): 1}


def test_scores():
    assert C.score(REFERENCE, REFERENCE) == 1
    renamed = C.score(REFERENCE.replace("out", "acc"), REFERENCE)
    broken = C.score(REFERENCE.replace("def", "de f"), REFERENCE)
    assert 0.5 < renamed < 1 and broken < renamed and C.score("import os", REFERENCE) < 0.2
    assert C.score(None, None) == 0 and C.score("", REFERENCE) == 0 and 0 < C.score("x", "x") <= 1


def test_best_of_the_first_candidates(spark):
    rows = [(1, 0, "import os"), (1, 1, REFERENCE), (2, 0, REFERENCE), (2, 1, "x")]
    given = spark.createDataFrame(rows, "task int, place int, code string").withColumn("score", C.codebleu(F.col("code"), F.lit(REFERENCE)))
    best = {r.k: r.best_at_k for r in scores.best_at_k(given, [1, 2], "task", "place", "score").collect()}
    assert best[2] == 1 and math.isclose(best[1], (1 + C.score("import os", REFERENCE)) / 2)
