import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail bo.x+1@a-b.example.com, a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 é\U0001f600 x@y.zz",
    "4111 1111 1111 1111 then 4111-1111-1111-1112 and 12--34 +1 (017) 555-7713. call 415-555-2671",
    None,
    "",
    "a@b..c@d.e 300.1.1.1 001.02.3.255 +49 30 123 +123456789012345678",
    "1 " * 30_000,
    "9" * 50_000 + " a" * 10 + "x@" + "y." * 20_000 + "z",
    "A" * 60_000,
    "4111 1111 1111 1111 then 4111-1111-1111-1112 and 12--34 +1 (017) 555-7713. call 415-555-2671",
]


def test_base_spans_match_the_contract(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    rows = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        got = [(s.kind, s.start, s.end) for s in rows[i].spans if s.base]
        assert got == base(t), t and t[:60]
        assert set(got) <= {(s.kind, s.start, s.end) for s in rows[i].spans}


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "ask é@x a@b.com or 1.2.3.4 now")], "doc_id long, text string")
    got = docs.select(pii.redacted(F.col("text"), pii.decided(pii.candidates(F.col("text")), {})).alias("t")).first().t
    assert got == "ask é@x <EMAIL> or <IP> now"
    assert pii.detect(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.query(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
