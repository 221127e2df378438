"""Near-duplicate removal: n-gram MinHash, banded LSH, star edges, connected components, keep the first."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.components import connected_components
from tessera.sources.tables import stored

# the hash family: v = (h * a + b) mod P with h the first 32 bits of the gram's md5
PRIME, SPACE, EMPTY = 2147483647, 1073741789, 4294967295
SPLIT = re.compile(T.NON_WORD)
AT_ONCE = 4096  # grams hashed at once


def family(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(num_perm, dtype=np.int64)
    return (i * 1103515245 + 12345) % SPACE + 1, (i * 69069 + 1) % SPACE


# a second family: v = ((h * a + b) mod 2^61 - 1) cut to 32 bits in wrapping 64-bit arithmetic, h the first 32 bits of the gram's
# SHA-1 (little-endian); a and b come from the first one's rule, spread over 61 bits
MERSENNE = (1 << 61) - 1


def wide_family(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(num_perm, dtype=np.uint64)
    a, b = i * np.uint64(6364136223846793005) + np.uint64(1442695040888963407), i * np.uint64(2862933555777941757) + np.uint64(3037000493)
    return a % np.uint64(MERSENNE - 1) + np.uint64(1), b % np.uint64(MERSENNE)


def wide_signatures(code: Column, num_perm: int, n: int = 5, minimum: int = 5) -> Column:
    """As signatures, by the second family."""
    a, b = wide_family(num_perm)

    @F.pandas_udf("array<long>")
    def minima(texts: pd.Series) -> pd.Series:
        def one(text):
            best, words = np.full(num_perm, EMPTY, np.uint64), SPLIT.split(text)
            grams = len(words) - n + 1 if len(words) >= max(n, minimum) else 0
            for i in range(0, grams, AT_ONCE):
                digests = b"".join(hashlib.sha1(" ".join(words[j : j + n]).encode()).digest()[:4] for j in range(i, min(grams, i + AT_ONCE)))
                h = np.unique(np.frombuffer(digests, "<u4")).astype(np.uint64)
                best = np.minimum(best, ((h[:, None] * a + b) % np.uint64(MERSENNE) & np.uint64(EMPTY)).min(0))
            return best.astype(np.int64)

        return texts.map(one)

    return minima(code)


def banding(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positive and false negative area; rows = num_perm // bands."""
    below, above = np.linspace(0, threshold, 4001), np.linspace(threshold, 1, 4001)
    costs = []
    for b in range(1, num_perm + 1):
        r = num_perm // b
        costs.append((np.trapezoid(1 - (1 - below**r) ** b, below) + np.trapezoid((1 - above**r) ** b, above), b, r))
    cost, b, r = min(costs, key=lambda c: c[0])
    return b, r


def signatures(code: Column, num_perm: int, n: int = 5, minimum: int = 5) -> Column:
    """array<long> of num_perm minima over the n-grams of text.tokens; all EMPTY for a text without any.

    Only the text goes to Python; grams are made and hashed there, a bounded number at a time.
    """
    a, b = family(num_perm)

    @F.pandas_udf("array<long>")
    def minima(texts: pd.Series) -> pd.Series:
        def one(text):
            best = np.full(num_perm, EMPTY, np.int64)
            words = SPLIT.split(text)
            grams = len(words) - n + 1 if len(words) >= max(n, minimum) else 0
            for i in range(0, grams, AT_ONCE):
                count = min(AT_ONCE, grams - i)
                digests = b"".join(hashlib.md5(" ".join(words[j : j + n]).encode()).digest()[:4] for j in range(i, i + count))
                h = np.unique(np.frombuffer(digests, ">u4")).astype(np.int64)
                best = np.minimum(best, ((h[:, None] * a[None, :] + b[None, :]) % PRIME).min(0))
            return best

        return texts.map(one)

    return minima(code)


def bands(df: DataFrame, key: str, column: str, num_perm: int, n_bands: int, rows: int, n: int = 5, minimum: int = 5) -> DataFrame:
    """(key, band, bucket): the md5 of each band's rows of the signature."""
    signed = df.select(key, signatures(F.coalesce(F.col(column), F.lit("")), num_perm, n, minimum).alias("sig"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.md5(F.array_join(F.transform(F.slice("sig", i * rows + 1, rows), lambda v: v.cast("string")), ",").cast("binary")))
    return signed.select(key, F.posexplode(cut).alias("band", "bucket"))


def star_edges(banded: DataFrame, key: str) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's least; no pairs within a bucket are made."""
    least = banded.groupBy("band", "bucket").agg(F.min(key).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return banded.join(least, ["band", "bucket"]).where(F.col(key) != F.col("b")).select(F.col(key).alias("a"), "b").distinct()


def clusters(df: DataFrame, key: str = "doc_id", column: str = "text", num_perm: int = 256, threshold: float = 0.7, n: int = 5, minimum: int = 5, keep_short: bool = False) -> DataFrame:
    """(key, cluster): the least key of each row's component. keep_short: texts without n-grams stay by themselves."""
    b, r = banding(threshold, num_perm)
    source = df.where(F.size(T.tokens(F.col(column))) >= max(n, minimum)) if keep_short else df
    banded = stored(bands(source, key, column, num_perm, b, r, n, minimum), "bands")
    roots = connected_components(star_edges(banded, key), stored)
    return df.select(key).join(roots.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("root", key).alias("cluster"))


def near_dedup(df: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
    """The rows of df that are the first of their cluster."""
    drop = clusters(df, key, column, **options).where(F.col("cluster") != F.col(key)).select(key)
    return df.join(drop, key, "left_anti")


def exact_jaccard(df: DataFrame, pairs: DataFrame, key: str = "doc_id", column: str = "text", n: int = 5) -> DataFrame:
    """(a, b, jaccard) of the given pairs over their distinct n-grams, told apart by 64-bit hashes. Grams are made for rows of
    a pair only."""
    ids = pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct()
    hashes = F.array_distinct(F.transform(T.ngrams(T.tokens(F.col(column)), n, n), lambda g: F.xxhash64(g)))
    grams = df.join(ids, key, "left_semi").select(F.col(key), hashes.alias("g"))
    both = pairs.join(grams.select(F.col(key).alias("a"), F.col("g").alias("x")), "a").join(grams.select(F.col(key).alias("b"), F.col("g").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", F.coalesce(F.try_divide(common.cast("double"), F.size("x") + F.size("y") - common), F.lit(0.0)).alias("jaccard"))
