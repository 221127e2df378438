"""CodeBLEU of Python candidates, after Ren et al. 2020 (arXiv:2009.10297): the weighted sum of BLEU, BLEU with heavier
keywords, the share of the reference's syntax subtrees and the share of its data-flow edges that the candidate has too.

Defined results: a candidate that doesn't parse has no subtrees and no edges; a reference without any subtree or edge
leaves that part to the others, in proportion to their weights; null is the empty text; two empty texts score 0.
"""

from __future__ import annotations

import ast
import keyword
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
KEYWORD_WEIGHT = 5.0  # against 1 for other tokens
SMOOTH = 0.1  # stands for no match of an order


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu(candidate: list[str], reference: list[str], weight=lambda gram: 1.0, orders: int = 4) -> float:
    """Geometric mean of clipped n-gram precisions times the brevity penalty; orders longer than the candidate are left out."""
    logs = []
    for n in range(1, min(orders, len(candidate)) + 1):
        own, theirs = _grams(candidate, n), _grams(reference, n)
        hit = sum(min(c, theirs[g]) * weight(g) for g, c in own.items())
        logs.append(math.log((hit or SMOOTH) / sum(c * weight(g) for g, c in own.items())))
    if not logs or not reference:
        return 0.0
    return math.exp(sum(logs) / len(logs) + min(0.0, 1 - len(reference) / len(candidate)))


def _parsed(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def subtrees(code: str) -> Counter:
    """Shapes of all syntax subtrees with children, names and constants left out."""
    out: Counter = Counter()

    def shape(node: ast.AST) -> str:
        inner = [shape(c) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]
        text = f"{type(node).__name__}({','.join(inner)})"
        if inner:
            out[text] += 1
        return text

    tree = _parsed(code)
    if tree is not None:
        shape(tree)
    return out


def data_flow(code: str) -> Counter:
    """Edges (target, source) of all assignments, loops and arguments, variables numbered in order of first use."""
    tree, numbers, out = _parsed(code), {}, Counter()
    if tree is None:
        return out

    def names(node) -> list[int]:
        found = sorted((n for n in ast.walk(node) if isinstance(n, ast.Name)), key=lambda n: (n.lineno, n.col_offset))
        return [numbers.setdefault(n.id, len(numbers)) for n in found]

    def edges(targets, *sources) -> None:
        read = [i for s in sources if s is not None for i in names(s)]
        for t in targets:
            out.update((i, j) for i in names(t) for j in read)

    for node in sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Assign):
            edges(node.targets, node.value)
        elif isinstance(node, ast.AugAssign):
            edges([node.target], node.target, node.value)
        elif isinstance(node, ast.AnnAssign | ast.NamedExpr):
            edges([node.target], node.value)
        elif isinstance(node, ast.For | ast.AsyncFor):
            edges([node.target], node.iter)
    return out


def _share(candidate: Counter, reference: Counter) -> float | None:
    total = reference.total()
    return (candidate & reference).total() / total if total else None


def score(candidate: str | None, reference: str | None, weights=(0.25, 0.25, 0.25, 0.25)) -> float:
    candidate, reference = candidate or "", reference or ""
    own, theirs = TOKEN.findall(candidate), TOKEN.findall(reference)
    heavy = lambda gram: KEYWORD_WEIGHT if len(gram) == 1 and keyword.iskeyword(gram[0]) else 1.0
    parts = [bleu(own, theirs), bleu(own, theirs, heavy), _share(subtrees(candidate), subtrees(reference)), _share(data_flow(candidate), data_flow(reference))]
    there = [(w, p) for w, p in zip(weights, parts, strict=True) if p is not None]
    return sum(w * p for w, p in there) / sum(w for w, _ in there)


def codebleu(candidate: Column, reference: Column) -> Column:
    return F.pandas_udf(lambda c, r: pd.Series([score(x, y) for x, y in zip(c, r, strict=True)], dtype=float), "double")(candidate, reference)
