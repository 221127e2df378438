"""Symbol tables, scopes, masking and code metrics on Python's ast."""

from __future__ import annotations

import ast
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: complexity added by each kind of statement
COMPOUND = {ast.ClassDef: 4, ast.For: 3, ast.AsyncFor: 3, ast.FunctionDef: 4, ast.AsyncFunctionDef: 4, ast.If: 2, ast.Match: 4, ast.Try: 5, ast.While: 3, ast.With: 3, ast.AsyncWith: 3}
SIMPLE = {ast.Assert: 2, ast.Break: 1, ast.Continue: 1, ast.Delete: 2, ast.Expr: 2, ast.Assign: 2, ast.AugAssign: 2, ast.AnnAssign: 2, ast.Global: 2, ast.ImportFrom: 2, ast.Import: 1, ast.Nonlocal: 2, ast.Pass: 1, ast.Raise: 2, ast.Return: 1, ast.TypeAlias: 3}
DECORATED = 3


def _elifs(tree: ast.AST) -> set[int]:
    return {id(n.orelse[0]) for n in ast.walk(tree) if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset}


def cyclomatic(code: str) -> int:
    """1 plus the weights of all statements; an elif is part of its if, a decorator list counts once."""
    tree = ast.parse(code)
    skip, total = _elifs(tree), 1
    for n in ast.walk(tree):
        if id(n) not in skip:
            total += COMPOUND.get(type(n), SIMPLE.get(type(n), 0))
        if getattr(n, "decorator_list", None):
            total += DECORATED
    return total


def halstead(code: str) -> dict[str, float]:
    """Counts over kinds of operators (binary, boolean, comparison, not, unary, assignment) and identifiers."""
    operators, operands = [], []
    for n in ast.walk(ast.parse(code)):
        if isinstance(n, ast.BinOp):
            operators.append("binary_operator")
        elif isinstance(n, ast.BoolOp):
            operators += ["boolean_operator"] * (len(n.values) - 1)
        elif isinstance(n, ast.Compare):
            operators.append("comparison_operator")
        elif isinstance(n, ast.UnaryOp):
            operators.append("not_operator" if isinstance(n.op, ast.Not) else "unary_operator")
        elif isinstance(n, ast.Assign):
            operators += ["assignment"] * len(n.targets)
        elif isinstance(n, ast.AnnAssign):
            operators.append("assignment")
        elif isinstance(n, ast.Name):
            operands.append(n.id)
        elif isinstance(n, ast.arg):
            operands.append(n.arg)
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            operands.append(n.name)
        elif isinstance(n, ast.Attribute):
            operands.append(n.attr)
        elif isinstance(n, ast.keyword) and n.arg:
            operands.append(n.arg)
        elif isinstance(n, ast.alias):
            operands += n.name.split(".") + ([n.asname] if n.asname else [])
    n1, n2 = len(set(operators)), len(set(operands))
    length = len(operators) + len(operands)
    return {
        "operators": n1,
        "operands": n2,
        "length": length,
        "vocabulary": n1 + n2,
        "difficulty": n1 / 2 * len(operands) / n2 if n2 else 0.0,
        "volume": length * math.log2(n1 + n2) if n1 + n2 else 0.0,
    }


METRICS = "cc int, halstead struct<operators:int,operands:int,length:int,vocabulary:int,difficulty:double,volume:double>, error string"


def code_metrics(code: Column) -> Column:
    """struct<cc, halstead, error>; a source that doesn't parse has cc 0 and no halstead."""

    @F.pandas_udf(METRICS)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                rows.append((cyclomatic(t or ""), halstead(t or ""), None))
            except (SyntaxError, ValueError, RecursionError) as e:
                rows.append((0, None, type(e).__name__))
        return pd.DataFrame(rows, columns=["cc", "halstead", "error"])

    return run(code)


# --- symbols -------------------------------------------------------------------------------------------------------
class _Places:
    """Character offsets of ast nodes."""

    def __init__(self, code: str):
        self.lines = code.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def at(self, line: int, col: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:col].decode())

    def of(self, node) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


def symbols(code: str) -> list[tuple[str, str, int | None, int | None, str | None, int | None, int | None]]:
    """(symbol, kind, definition start, end, module, usage start, usage end), one row a usage, or one without usage."""
    tree, places, table = ast.parse(code), _Places(code), {}

    def define(name, kind, place=None, module=None):
        table.setdefault(name, {"kind": kind, "place": place, "module": module, "usages": []})
        return table[name]

    def name_place(node, keyword):
        start, _ = places.of(node)
        start = code.index(node.name, code.index(keyword, start) + len(keyword))
        return start, start + len(node.name)

    def targets(node):
        if isinstance(node, ast.Name):
            return [node]
        return [x for e in getattr(node, "elts", []) for x in targets(e)]

    def walk(node, scope):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            define(node.name, "function", places.of(node))
            scope = dict(scope)
        elif isinstance(node, ast.ClassDef):
            define(node.name, "class", name_place(node, "class"))
            scope = dict(scope)
        elif isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign | ast.For | ast.AsyncFor):
            for t in [x for y in (node.targets if isinstance(node, ast.Assign) else [node.target]) for x in targets(y)]:
                scope[t.id] = define(t.id, "variable", places.of(t))
        elif isinstance(node, ast.With | ast.AsyncWith):
            for t in [x for i in node.items if i.optional_vars for x in targets(i.optional_vars)]:
                scope[t.id] = define(t.id, "variable", places.of(t))
        elif isinstance(node, ast.Import):
            for a in node.names:
                define(a.name, "import", module="*")
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                define(a.name, "import", module=node.module or ".")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            define(node.func.id, "function")["usages"].append(places.of(node))
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load) and node.id in scope:
            scope[node.id]["usages"].append(places.of(node))
        for child in ast.iter_child_nodes(node):
            walk(child, scope)

    walk(tree, {})
    rows = []
    for name, s in table.items():
        start, end = s["place"] or (None, None)
        for a, b in sorted(set(s["usages"])) or [(None, None)]:
            rows.append((name, s["kind"], start, end, s["module"], a, b))
    return rows


SYMBOLS = "array<struct<symbol:string,kind:string,start:int,end:int,module:string,usage_start:int,usage_end:int>>"


def symbol_table(code: Column) -> Column:
    @F.pandas_udf(SYMBOLS)
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [dict(zip(("symbol", "kind", "start", "end", "module", "usage_start", "usage_end"), r, strict=True)) for r in symbols(t or "")]
            except (SyntaxError, ValueError, RecursionError):
                return []

        return s.map(one)

    return run(code)


def scope_nodes(code: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all statements and identifiers, in order of place."""
    places = _Places(code)
    kinds = tuple({**COMPOUND, **SIMPLE}) + (ast.Name,)
    found = [(type(n).__name__, *places.of(n)) for n in ast.walk(ast.parse(code)) if isinstance(n, kinds)]
    return sorted(found, key=lambda x: (x[1], -x[2]))


def mask(code: str, symbol: str, replacement: str = "<MASK>", mode: str = "compat") -> str:
    """Replaces a symbol from the end backwards. compat: a function's definition and calls go as a whole; strict: names
    only. An unknown symbol changes nothing."""
    try:
        if mode == "compat":
            spans = {(a, b) for n, _, s, e, _, u, v in symbols(code) if n == symbol for a, b in ((s, e), (u, v)) if a is not None}
        else:
            places = _Places(code)
            spans = {places.of(n) for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Name) and n.id == symbol}
            for n in ast.walk(ast.parse(code)):
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and n.name == symbol:
                    start = code.index(symbol, places.of(n)[0] + 3)
                    spans.add((start, start + len(symbol)))
                elif isinstance(n, ast.arg) and n.arg == symbol:
                    start = places.of(n)[0]
                    spans.add((start, start + len(symbol)))
    except (SyntaxError, ValueError, RecursionError):
        return code
    # a span inside one that goes as a whole goes with it
    outer = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
    for start, end in sorted(outer, reverse=True):
        code = code[:start] + replacement + code[end:]
    return code


def masked(code: Column, symbol: Column, replacement: str = "<MASK>", mode: str = "compat") -> Column:
    @F.pandas_udf("string")
    def run(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, n, replacement, mode) for t, n in zip(c, s, strict=True)])

    return run(code, symbol)


def rename_in_repo(df: DataFrame, symbol: str, replacement: str, mode: str = "strict") -> DataFrame:
    """(repo, path, code) with the symbol replaced in every file: files are independent, so no grouping is needed."""
    return df.withColumn("code", masked(F.col("code"), F.lit(symbol), replacement, mode))
