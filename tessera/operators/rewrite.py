"""Source rewrites on Python's ast: unrolling, loop conversion, renaming; chains of them over Arrow batches.

Every rewrite takes the first fenced block of a text (or the text), and gives the text back unchanged where it doesn't
parse. ``mode="compat"`` keeps the observable quirks of the established behaviour; ``mode="strict"`` gives programs that
mean the same.
"""

from __future__ import annotations

import ast
import random
import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:\w+)?\n(.*?)```", re.S)
_ANY_FENCE = re.compile(r"```(.*?)```", re.S)


def first_block(text: str) -> str:
    found = _FENCE.search(text) or _ANY_FENCE.search(text)
    return found[1] if found else text


class _Fresh:
    """Names not used in a tree: _base, then _base_1, _base_2, ..."""

    def __init__(self, tree: ast.AST):
        self.used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)} | {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}

    def __call__(self, base: str) -> str:
        name, k = f"_{base}", 0
        while name in self.used:
            k += 1
            name = f"_{base}_{k}"
        self.used.add(name)
        return name


def _load(name):
    return ast.Name(name, ast.Load())


def _put(name, value):
    return ast.Assign([ast.Name(name, ast.Store())], value)


class _Assignments(ast.NodeTransformer):
    def __init__(self, fresh, mode):
        self.fresh, self.mode = fresh, mode

    def visit_Assign(self, node):
        if len(node.targets) < 2:
            return node
        name = self.fresh("assign_tmp")
        # established order is right to left; Python itself binds from the left
        targets = node.targets if self.mode == "strict" else node.targets[::-1]
        return [_put(name, node.value), *(ast.Assign([t], _load(name)) for t in targets)]


class _Conditions(ast.NodeTransformer):
    def __init__(self, fresh, mode):
        self.fresh, self.mode = fresh, mode

    def _chain(self, node, kind):
        self.generic_visit(node)
        test = node.test
        if not (isinstance(test, ast.Compare) and len(test.ops) > 1):
            return node
        if self.mode == "strict":
            if not all(isinstance(c, ast.Name | ast.Constant) for c in test.comparators[:-1]):
                return node  # evaluating an operand twice could be seen
            sides = [test.left, *test.comparators]
            node.test = ast.BoolOp(ast.And(), [ast.Compare(a, [op], [b]) for a, op, b in zip(sides, test.ops, sides[1:], strict=False)])
            return node
        first, second = self.fresh("cmp"), self.fresh("cmp")
        out = [_put(first, test.left), _put(second, test.comparators[0])]
        top = kind(ast.Compare(_load(first), [test.ops[0]], [_load(second)]), [], node.orelse)
        inner, last = top, second
        for op, side in zip(test.ops[1:], test.comparators[1:], strict=True):
            name = self.fresh("cmp")
            nested = kind(ast.Compare(_load(last), [op], [_load(name)]), [], [])
            inner.body = [_put(name, side), nested]
            inner, last = nested, name
        inner.body = node.body
        return [*out, top]

    def visit_If(self, node):
        return self._chain(node, ast.If)

    def visit_While(self, node):
        return self._chain(node, ast.While)


class _Loops(ast.NodeTransformer):
    def __init__(self, fresh, mode):
        self.fresh, self.mode = fresh, mode

    def visit_For(self, node):
        self.generic_visit(node)
        simple = isinstance(node.target, ast.Name)
        if not simple and self.mode == "compat":
            return None
        base = node.target.id if simple else "loop"
        it, at = self.fresh(f"{base}_iter"), self.fresh(f"{base}_idx")
        step = lambda: [ast.AugAssign(ast.Name(at, ast.Store()), ast.Add(), ast.Constant(1))]
        fetch = ast.Assign([node.target], ast.Subscript(_load(it), _load(at), ast.Load()))
        if self.mode == "strict":
            # the index moves on as soon as the element is fetched, so that continue can't skip it
            body = [fetch, *step(), *node.body]
        else:
            body = [fetch, *node.body, *step()]
        test = ast.Compare(_load(at), [ast.Lt()], [ast.Call(_load("len"), [_load(it)], [])])
        drop = ast.Delete([ast.Name(it, ast.Del()), ast.Name(at, ast.Del())])
        return [_put(it, ast.Call(_load("list"), [node.iter], [])), _put(at, ast.Constant(0)), ast.While(test, body, node.orelse), drop]


def _apply(visitor) -> Callable[[str, str], str]:
    def run(text: str, mode: str = "compat") -> str:
        try:
            tree = ast.parse(first_block(text))
            return ast.unparse(ast.fix_missing_locations(visitor(_Fresh(tree), mode).visit(tree)))
        except Exception:  # any failure gives the text back
            return text

    return run


def name_map(names, seed: int = 42) -> dict[str, str]:
    """Sorted names to random identifiers of six characters, the same for the same names."""
    rng, out = random.Random(seed), {}
    for name in sorted(names):
        while True:
            new = rng.choice(string.ascii_letters + "_") + "".join(rng.choice(string.ascii_letters + string.digits + "_") for _ in range(5))
            if new not in out.values():
                break
        out[name] = new
    return out


def _renameable(tree: ast.AST) -> set[str]:
    stored = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    return stored | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}


class _Rename(ast.NodeTransformer):
    def __init__(self, names):
        self.names = names

    def visit_Name(self, node):
        node.id = self.names.get(node.id, node.id)
        return node

    def visit_arg(self, node):
        self.generic_visit(node)
        node.arg = self.names.get(node.arg, node.arg)
        return node

    def _listed(self, node):
        node.names = [self.names.get(n, n) for n in node.names]
        return node

    visit_Global = visit_Nonlocal = _listed

    def visit_ExceptHandler(self, node):
        self.generic_visit(node)
        node.name = self.names.get(node.name, node.name)
        return node

    def visit_Call(self, node):
        self.generic_visit(node)
        # keywords follow the parameters of functions defined in the same source
        if isinstance(node.func, ast.Name) and node.func.id in self.own:
            for k in node.keywords:
                k.arg = self.names.get(k.arg, k.arg)
        return node


def rename_variables(text: str, mode: str = "compat") -> str:
    try:
        tree = ast.parse(first_block(text))
        names = _renameable(tree)
        if mode == "compat":
            # a parameter that is never read has no place to rename from
            names &= {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        if not names:
            return text
        in_class = {t.id for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for s in c.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)}
        mapping = {k: v for k, v in name_map(names).items() if k not in in_class}
        visitor = _Rename(mapping)
        visitor.own = {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)}
        return ast.unparse(ast.fix_missing_locations(visitor.visit(tree)))
    except Exception:
        return text


REWRITES: dict[str, Callable[[str, str], str]] = {
    "assignment_unroll": _apply(_Assignments),
    "condition_unroll": _apply(_Conditions),
    "for_to_while": _apply(_Loops),
    "randomize_var_names": rename_variables,
}


def register(name: str, rewrite: Callable[[str, str], str]) -> None:
    REWRITES[name] = rewrite


def with_ir(code: str, compiler: str = "codon", imports: str = "") -> tuple[str | None, str]:
    """(code followed by its compiled form, status); status names the failure, as where no compiler is installed."""
    import shutil
    import subprocess
    import tempfile

    if not shutil.which(compiler):
        return None, f"COMPILER_NOT_FOUND: {compiler}"
    with tempfile.TemporaryDirectory() as d:
        with open(f"{d}/m.py", "w") as f:
            f.write(imports + "\n" + code)
        done = subprocess.run([compiler, "build", "-llvm", "-o", f"{d}/m.ll", f"{d}/m.py"], capture_output=True, text=True, timeout=60)
        if done.returncode:
            return None, f"COMPILATION_ERROR: {done.stderr[:500]}"
        with open(f"{d}/m.ll") as f:
            return code + "\n" + f.read(), "OK"


def chained(text: str | None, names: tuple[str, ...], mode: str) -> str | None:
    for name in names:
        text = None if text is None else REWRITES[name](text, mode)
    return text


def rewritten(code: Column, *names: str, mode: str = "compat") -> Column:
    """The named rewrites in order; an unknown name is refused."""
    unknown = [n for n in names if n not in REWRITES]
    if unknown:
        raise ValueError(f"unknown rewrites: {', '.join(unknown)}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chained(t, names, mode))

    return run(code)


def augment(df: DataFrame, transforms: list[str], mode: str = "compat") -> DataFrame:
    """Rewrites every element of reward_model.ground_truth; the rest of the record stays."""
    unknown = [n for n in transforms if n not in REWRITES]
    if unknown:
        raise ValueError(f"unknown rewrites: {', '.join(unknown)}")
    names = tuple(transforms)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [chained(t, names, mode) for t in a])

    return df.withColumn("reward_model", F.col("reward_model").withField("ground_truth", run(F.col("reward_model.ground_truth"))))
