"""Formatting, linting, transpiling and translating behind tool registries, with diffs and a status for every row."""

from __future__ import annotations

import ast
import difflib
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import split_repo

Tool = Callable[[str], tuple[str, str]]  # code -> (code, status)


def diff(before: str, after: str) -> list[str]:
    return list(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), lineterm=""))


_PLACEHOLDER = re.compile(r"<[A-Za-z_]\w*>")


def protect(code: str) -> tuple[str, list[str]]:
    """<name> placeholders as plain identifiers, and what they stood for."""
    names = _PLACEHOLDER.findall(code)
    last = {n: i for i, n in enumerate(names)}
    return _PLACEHOLDER.sub(lambda m: f"DUMMY_{last[m[0]]}", code), names


def restore(code: str, names: list[str]) -> str:
    return re.sub(r"DUMMY_(\d+)", lambda m: names[int(m[1])] if int(m[1]) < len(names) else m[0], code)


def _ruff(arguments: list[str], failure: str) -> Tool:
    def run(code: str) -> tuple[str, str]:
        if not shutil.which("ruff"):
            return code, "TOOL_NOT_FOUND: ruff"
        with tempfile.TemporaryDirectory() as d:
            with open(f"{d}/m.py", "w") as f:
                f.write(code)
            done = subprocess.run(["ruff", *arguments, f"{d}/m.py"], capture_output=True, text=True, timeout=60)
            with open(f"{d}/m.py") as f:
                return (f.read(), "OK") if done.returncode == 0 else (code, f"{failure}: {done.stderr[:300]}")

    return run


def normalised(code: str) -> tuple[str, str]:
    """The source as ast prints it: what can be done without a formatter."""
    try:
        return ast.unparse(ast.parse(code)) + "\n", "NORMALISED"
    except (SyntaxError, ValueError, RecursionError) as e:
        return code, f"FORMATTING_ERROR: {type(e).__name__}"


SYNTAXERS: dict[str, Tool] = {"python": _ruff(["format"], "FORMATTING_ERROR")}
LINTERS: dict[str, Tool] = {"python": _ruff(["check", "--fix"], "LINTING_ERROR")}
TRANSPILERS: dict[tuple[str, str], Tool] = {}
TRANSLATORS: dict[str, Tool] = {}

FORMATTED = "struct<code:string,diff:array<string>,abs_diff:int,rel_diff:double,status:string>"


def format_one(code: str, language: str = "python", placeholders: bool = False) -> tuple[str, list[str], int, float | None, str]:
    given, names = protect(code) if placeholders else (code, [])
    out, status = SYNTAXERS[language](given)
    if status.startswith("TOOL_NOT_FOUND"):
        out, status = normalised(given)
    elif status == "OK":
        out, status = LINTERS[language](out)
    lines = diff(given, out)
    return restore(out, names) if placeholders else out, lines, len(lines), len(lines) / len(given) if given else None, status


def formatted(code: Column, language: str = "python", placeholders: bool = False) -> Column:
    @F.pandas_udf("code string, diff array<string>, abs_diff int, rel_diff double, status string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([format_one(t or "", language, placeholders) for t in s], columns=["code", "diff", "abs_diff", "rel_diff", "status"])

    return run(code)


def format_corpus(df: DataFrame, column: str = "code", language: str = "python", placeholders: bool = False) -> DataFrame:
    """First line off as repo, the rest formatted: code, repo, diff, abs_diff, rel_diff, status."""
    repo, code = split_repo(F.col(column))
    return df.select(repo.alias("repo"), formatted(code, language, placeholders).alias("f")).select("f.code", "repo", "f.diff", "f.abs_diff", "f.rel_diff", "f.status")


def _with_tool(df: DataFrame, column: str, tool: Tool | None, missing: str, name: str, failure: str) -> DataFrame:
    @F.pandas_udf("out string, diff array<string>, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            t = t or ""
            try:
                out, status = tool(t) if tool else (t, missing)
            except Exception as e:  # one bad row doesn't stop the batch
                out, status = t, f"{failure}: {e}"
            rows.append((out, diff(t, out), status))
        return pd.DataFrame(rows, columns=["out", "diff", "error"])

    return df.withColumn("_r", run(F.col(column))).withColumns({name: F.col("_r.out"), "diff": F.col("_r.diff"), "error": F.col("_r.error")}).drop("_r")


def transpile(df: DataFrame, source: str, target: str, column: str = "content") -> DataFrame:
    return _with_tool(df, column, TRANSPILERS.get((source, target)), f"TRANSPILER_NOT_FOUND: {source} -> {target}", "transpiled", "TRANSPILATION_ERROR")


def translate(df: DataFrame, language: str, column: str = "content") -> DataFrame:
    return _with_tool(df, column, TRANSLATORS.get(language), f"TRANSLATION_ERROR: no translator for {language}", "translated", "TRANSLATION_ERROR")


def diff_sizes(lines: Column, code: Column) -> tuple[Column, Column]:
    """(abs_diff, rel_diff); no rel_diff for an empty source."""
    return F.size(lines), F.try_divide(F.size(lines).cast("double"), F.char_length(code).cast("double"))


def unified_diff(before: Column, after: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run(before, after)
