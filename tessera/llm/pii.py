"""Personal data by weak supervision, in SQL functions only.

Candidate spans come from one pattern per kind (email, ip, card, phone) and a looser one for what the strict rules
drop (bad Luhn sums, octets above 255, local phone numbers). Three labelers vote on each candidate (1 personal, -1 not,
0 abstains): the *regex* labeler by the strict rule, the *gazetteer* labeler by known domain ends, routable first octets,
card issuers and calling codes, the *context* labeler by cue words shortly before the span. Votes of the whole corpus are
counted by pattern (at most ``4 * 3 ** 3`` rows, whatever the corpus), expectation-maximisation estimates each labeler's
reliability per kind without labels, and its posteriors train the final span classifier, a logistic model over the
votes. Base spans always stay; the classifier can only add candidates that do not overlap one.

Defined results: a null text is an empty one and has no spans; a text of blanks likewise; rows that share a doc_id are
scored separately; an empty table gives no rows; other columns are ignored. Offsets count code points, ends exclusive.
The patterns use possessive repeats throughout, so that neither long runs nor long chains backtrack or recurse.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored

NAME = "op2_pii"
KINDS = ("email", "ip", "card", "phone")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.)-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

CONTEXT = 24  # code points before a span in which cue words count
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|t[ée]l|m[óo]vil)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|serial|part|ref|id)\b"
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
ROUNDS, STEPS, RATE, THRESHOLD = 25, 400, 0.5, 0.5


def _found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, value>>; offsets from the lengths of the gaps."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _strict(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    n = F.char_length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    return value.startswith("+") & n.between(9, 15)


def _candidates(kind: str, text: Column) -> Column:
    """Candidates of one kind with their votes: array<struct<kind, start, end, regex, gazetteer, context>>."""
    if kind == "email":
        found = F.when(text.contains("@"), _found(text, EMAIL)).otherwise(_none())
    elif kind == "ip":
        found = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _found(text, IP)).otherwise(_none())
    elif kind == "card":
        found = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(_found(text, CARD), lambda s: F.char_length(_digits(s["value"])).between(13, 19))).otherwise(_none())
    else:
        plus = F.when(text.contains("+"), _found(text, PHONE)).otherwise(_none())
        local = F.when(text.rlike(LOCAL_PHONE), _found(text, LOCAL_PHONE)).otherwise(_none())
        found = F.concat(plus, local)

    def votes(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - CONTEXT + 1), F.least(F.lit(CONTEXT), s["start"]))
        # a card's issuer is read off its digits, not off separators
        shown = _digits(s["value"]) if kind == "card" else s["value"]
        context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.when(_strict(kind, s["value"]), 1).otherwise(-1).alias("regex"),
            F.when(shown.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
            context.alias("context"),
        )

    return F.transform(found, votes)


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind as listed and then by start."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_candidates(k, text) for k in KINDS])


LABELERS = ("regex", "gazetteer", "context")


def fit(spans: DataFrame) -> dict[tuple[str, int, int, int], float]:
    """From a frame with the column ``c`` (candidates): probability of every vote pattern seen in the corpus.

    The corpus is reduced to one count per pattern; what follows is arithmetic on those few rows.
    """
    rows = spans.select(F.explode("c").alias("c")).groupBy("c.kind", *[f"c.{x}" for x in LABELERS]).count().collect()
    out: dict[tuple[str, int, int, int], float] = {}
    for kind in KINDS:
        seen = sorted(((r["regex"], r["gazetteer"], r["context"]), r["count"]) for r in rows if r["kind"] == kind)
        if not seen:
            continue
        posterior = _reliabilities(seen)
        weights = _classifier([(v, n, posterior[v]) for v, n in seen])
        for v, _ in seen:
            out[(kind, *v)] = _sigmoid(weights[0] + sum(w * x for w, x in zip(weights[1:], v, strict=True)))
    return out


def _reliabilities(seen: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern: two classes, per labeler P(vote | class), abstentions included."""
    total = sum(n for _, n in seen)
    # starts from what the labelers are for: strict rules are mostly right, the others are right more often than not
    table = [{c: {v: (trust if v == c else 1 - trust) / (1 if v else 2) for v in (-1, 0, 1)} for c in (-1, 1)} for trust in (0.9, 0.7, 0.6)]
    prior, posterior = 0.5, {}
    for _ in range(ROUNDS):
        for v, _n in seen:
            a = prior * math.prod(table[i][1][x] for i, x in enumerate(v))
            b = (1 - prior) * math.prod(table[i][-1][x] for i, x in enumerate(v))
            posterior[v] = a / (a + b)
        mass = {1: sum(n * posterior[v] for v, n in seen), -1: sum(n * (1 - posterior[v]) for v, n in seen)}
        prior = (mass[1] + 1) / (total + 2)
        for i in range(len(LABELERS)):
            for c in (-1, 1):
                for x in (-1, 0, 1):
                    n = sum(n * (posterior[v] if c == 1 else 1 - posterior[v]) for v, n in seen if v[i] == x)
                    table[i][c][x] = (n + 1) / (mass[c] + 3)
    return posterior


def _classifier(rows: list[tuple[tuple[int, ...], int, float]]) -> list[float]:
    """Logistic regression on the votes, fitted to posteriors by gradient descent over the pattern counts."""
    total = sum(n for _, n, _ in rows)
    w = [0.0] * (len(LABELERS) + 1)
    for _ in range(STEPS):
        g = [0.001 * x for x in w]
        for v, n, p in rows:
            x = (1, *v)
            e = n / total * (_sigmoid(sum(a * b for a, b in zip(w, x, strict=True))) - p)
            g = [a + e * b for a, b in zip(g, x, strict=True)]
        w = [a - RATE * b for a, b in zip(w, g, strict=True)]
    return w


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def decided(c: Column, model: dict) -> Column:
    """The spans that stay, array<struct<kind, start, end, base>>, by kind as listed and then by start."""
    accepted = [f"{k}:{a}:{b}:{x}" for (k, a, b, x), p in sorted(model.items()) if p >= THRESHOLD]
    base = F.filter(c, lambda s: s["regex"] == 1)

    def extra(s: Column) -> Column:
        pattern = F.concat_ws(":", s["kind"], s["regex"].cast("string"), s["gazetteer"].cast("string"), s["context"].cast("string"))
        return (s["regex"] != 1) & pattern.isin(accepted or [""]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    kept = F.filter(c, lambda s: (s["regex"] == 1) | extra(s))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(rank(s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (s["regex"] == 1).alias("base"))))
    return F.when(F.size(c) == 0, F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")).otherwise(
        F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array<struct<kind, start, end, base>>) of every document."""
    spans = stored(docs.select("doc_id", candidates(F.col("text")).alias("c")), "pii-candidates")
    model = fit(spans)
    return spans.select("doc_id", decided(F.col("c"), model).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by <KIND>; what overlaps an earlier span goes with it."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[_count(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


ORACLE_SQL = None
