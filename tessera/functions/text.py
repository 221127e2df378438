"""Text functions as Column builders: tokens, n-grams, fences, lines, truncation, comparison, templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- tokens and n-grams -------------------------------------------------------------------------------------------
NON_WORD = "[^A-Za-z_0-9]"


def tokens(text: Column) -> Column:
    """Split at every character that is no ASCII letter, digit or underscore; empty strings stay."""
    return F.split(text, NON_WORD, -1)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression inside a lambda is otherwise computed anew at each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int = 5, minimum: int = 5) -> Column:
    """Space-joined n-grams in order; none when there are fewer than max(n, minimum) words."""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= max(n, minimum), F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(words, grams)


def sha1_u32(text: Column) -> Column:
    """The first four bytes of SHA-1 as a little-endian unsigned integer."""
    h = F.sha1(text.cast("binary"))
    pairs = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    return F.conv(pairs, 16, 10).cast("long")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


# --- fenced code ----------------------------------------------------------------------------------------------------
FENCE_LANG = r"(?s)```(?:\w+)?\n(.*?)```"
FENCE_ANY = r"(?s)```(.*?)```"
FENCE_LAST = r"(?s)```(?:\w+\n)?(.*?)```"
FENCE_BLOCK = r"(?s)```([^\n]*)\n(.*?)\n\s*```"
FENCE_OPEN = r"(?s)```([^\n]*)\n(.*)"


def first_block(text: Column, include_fence: bool = False) -> Column:
    """Body (or the whole fence) of the first block with a line end after its mark, else of the first block, else the text."""
    group = 0 if include_fence else 1
    return F.when(text.rlike(FENCE_LANG), F.regexp_extract(text, FENCE_LANG, group)).when(text.rlike(FENCE_ANY), F.regexp_extract(text, FENCE_ANY, group)).otherwise(text)


def last_block(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(FENCE_LAST), F.lit(1)), F.lit(-1)), text)


# fixed values: names of languages as they stand after a fence, with their canonical name
ALIASES = {
    "python": ["python", "Python", "py", "Python3", "python3", "PY"],
    "cpp": ["cpp", "c++", "C++", "Cpp", "CPP"],
    "nodejs": ["javascript", "Javascript", "JavaScript", "JS", "js"],
    "go": ["go", "Go"],
    "java": ["java", "Java"],
    "php": ["php", "PHP"],
    "csharp": ["csharp", "c#", "C#"],
    "bash": ["bash", "Bash", "BASH", "sh", "shell"],
    "typescript": ["typescript"],
    "rust": ["rust", "Rust", "rs"],
    "sql": ["sql", "SQL", "Sql"],
    "D": ["D", "d"],
    "julia": ["julia", "Julia", "jl"],
    "lua": ["lua", "Lua"],
    "perl": ["perl", "Perl", "PERL"],
    "R": ["R", "r"],
    "ruby": ["ruby", "Ruby"],
    "scala": ["scala", "Scala"],
    "kotlin": ["kotlin", "Kotlin"],
    "c": ["c", "C"],
    "html": ["html", "Html", "HTML"],
    "javascript": ["javascript", "Javascript", "JavaScript"],
    "verilog": ["verilog", "Verilog", "VERILOG"],
    "racket": ["racket"],
    "swift": ["swift"],
}


# a name that two languages have stands for the later one
CANONICAL = {name: language for language, names in ALIASES.items() for name in names}

# fixed values: code that stands without fences, blank lines taken out; None: all of it
HEURISTICS = {"python": r"(?m)(?:^(?:import|from|#)[^\n]+\n)*^(?:def|class) [^\n]+\n(?:\s+[^\n]+\n)+", "sql": r"(?im)^\s*(?:select|with\s[^\n]+as)[^;]*", "bash": None}


def canonical_language(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.lit(""))


def _blocks(text: Column, pattern: str, priority: int) -> Column:
    names, bodies = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    zipped = F.arrays_zip(names.alias("name"), bodies.alias("code"))
    return F.transform(zipped, lambda b: F.struct(F.lit(priority).alias("priority"), canonical_language(stripped(b["name"])).alias("language"), b["code"].alias("code")))


def fenced_blocks(text: Column) -> Column:
    """Complete fences: array<struct<priority, language, code>>, priority 30."""
    return _blocks(text, FENCE_BLOCK, 30)


def open_blocks(text: Column) -> Column:
    """From the first fence to the end of the text, complete or not; priority 20."""
    return _blocks(text, FENCE_OPEN, 20)


def heuristic_blocks(text: Column, language: Column) -> Column:
    """Code without fences, in the wanted language; priority 10."""
    dense = F.concat(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: stripped(x) != ""), "\n"), F.lit("\n"))
    codes = F.array().cast("array<string>")
    for name, pattern in HEURISTICS.items():
        own = F.array(dense) if pattern is None else F.regexp_extract_all(dense, F.lit(pattern), F.lit(0))
        codes = F.when(language == name, own).otherwise(codes)
    return F.transform(codes, lambda c: F.struct(F.lit(10).alias("priority"), language.alias("language"), c.alias("code")))


def best_block(text: Column, language: Column) -> Column:
    """Of the blocks with the highest priority the first in the language, else the first; '' if there is none."""

    def chosen(blocks: Column) -> Column:
        top = F.filter(blocks, lambda b: b["priority"] == F.array_max(F.transform(blocks, lambda x: x["priority"])))
        same = F.filter(top, lambda b: b["language"] == language)
        return F.coalesce(F.try_element_at(same, F.lit(1))["code"], F.try_element_at(top, F.lit(1))["code"], F.lit(""))

    return bound(F.concat(fenced_blocks(text), open_blocks(text), heuristic_blocks(text, language)), chosen)


# fixed values: a fence that holds the function solution()
FENCE_SOLUTION = r"(?s)```python\n(.*?)def solution\(\):\n(.*?)```"


def solution_block(text: Column) -> Column:
    """From the first Python fence to the end of the fence in which solution() is defined; '' without one."""
    head, body = (F.regexp_extract(text, FENCE_SOLUTION, g) for g in (1, 2))
    return F.when(text.rlike(FENCE_SOLUTION), F.concat(head, F.lit("def solution():\n"), body)).otherwise(F.lit(""))


# --- cutting, assembling ----------------------------------------------------------------------------------------------
def cut_at(text: Column, *marks: str) -> Column:
    """What stands before the first of each mark in turn."""
    return reduce(lambda t, m: F.substring_index(t, m, 1), marks, text)


# fixed values: what ends the useful part of a completion
ENTRY_POINTS = {"python": 'if __name__ == "__main__":', "cpp": "int main()", "go": "package main"}


def before_mark(text: Column, mark: str) -> Column:
    """What stands before the first mark, blanks at either end stripped; the text as it is without one."""
    return F.when(text.contains(mark), stripped(F.substring_index(text, mark, 1))).otherwise(text)


def without_entry_point(code: Column, language: str) -> Column:
    if language == "go":
        code = F.replace(code, F.lit(ENTRY_POINTS["go"]), F.lit(""))
    elif language in ENTRY_POINTS:
        code = before_mark(code, ENTRY_POINTS[language])
    return before_mark(code, "# Example usage")


def append_test(code: Column, test: Column, mark: str = "#<INSERT>") -> Column:
    """Puts code where the test has its mark; without one, the test follows the code up to its main guard."""
    return F.when(test.contains(mark), F.replace(test, F.lit(mark), code)).otherwise(F.concat(F.substring_index(code, "if __name__ ==", 1), F.lit("\n"), test))


def check_program(test: Column, entry_point: Column) -> Column:
    return F.concat(test, F.lit("\ncheck("), entry_point, F.lit(")"))


def commented(code: Column, mark: str = "# ") -> Column:
    return F.array_join(F.transform(F.split(code, "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n")


# fixed values: the import that a proof must not have
WHOLE_LIBRARY = r"\bimport\s+Mathlib([^\w.]|$)"


def lean_hoisted(code: Column) -> Column:
    """Imports first, but for one of the whole library, then opens, an empty line, and the other lines."""

    def sorted_lines(lines: Column) -> Column:
        is_import, is_open = (lambda x: stripped(x).startswith("import ")), (lambda x: stripped(x).startswith("open "))
        imports = F.filter(lines, lambda x: is_import(x) & ~stripped(x).rlike(WHOLE_LIBRARY))
        rest = F.filter(lines, lambda x: ~is_import(x) & ~is_open(x))
        return stripped(F.array_join(F.concat(imports, F.filter(lines, is_open), F.array(F.lit("")), rest), "\n"))

    return bound(F.split(code, "\n", -1), sorted_lines)


def lean_without_imports(code: Column) -> Column:
    return stripped(F.array_join(F.filter(F.split(code, "\n", -1), lambda x: ~stripped(x).startswith("import ")), "\n"))


def middle_ellipsis(text: Column, limit: int = 1000) -> Column:
    half = (limit - 3) // 2
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, half), F.lit("..."), F.expr("''"), F.right(text, F.lit(half)))).otherwise(text)


def tail_lines(text: Column, n: int = 60) -> Column:
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), n), "\n")


def tail_words(text: Column, n: int = 1600) -> Column:
    """The last n words, space-joined."""
    return bound(whitespace_words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n), " "))


def php_tagged(code: Column) -> Column:
    return F.when(F.ltrim(code).startswith("<?php"), code).otherwise(F.concat(F.lit("<?php\n"), code))


def template(text: Column, fields: dict[str, Column]) -> Column:
    """{name} replaced by each field."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), fields.items(), text)


def dollar_template(text: Column, fields: dict[str, Column]) -> Column:
    """$name and ${name} replaced by each field, $$ by one dollar; names without a field stay. No field's own dollars are
    looked at again: the text is cut at its dollars first."""
    hold = "\x00"
    names = "|".join(sorted(fields, key=len, reverse=True))
    marked = F.regexp_replace(text, rf"\$(?:(\$)|\{{({names})\}}|({names})(?![A-Za-z0-9_]))", f"{hold}$1$2$3{hold}")
    known = F.create_map(F.lit("$"), F.lit("$"), *[x for k, v in fields.items() for x in (F.lit(k), v)])
    parts = F.split(marked, hold, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.try_element_at(known, x)).otherwise(x)), "")


# --- comparing ----------------------------------------------------------------------------------------------------
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The value of plain decimal notation, else null."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, r"\s", "").try_cast("double"))


def close(a: Column, b: Column) -> Column:
    """|a - b| / max(|b|, 1e-10) < 1e-5 on numbers; false if either is none."""
    x, y = number(a), number(b)
    return F.coalesce(F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-10)) < 1e-5, F.lit(False))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def same_output(actual: Column, expected: Column) -> Column:
    """Line by line, blanks at either end and case ignored, numbers within tolerance, as many lines on both sides."""

    def lines(x: Column) -> Column:
        return F.split(F.lower(stripped(x)), "\n", -1)

    a, b = lines(actual), lines(expected)
    both = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.struct(stripped(p["a"]).alias("a"), stripped(p["b"]).alias("b")))
    return (F.size(a) == F.size(b)) & F.forall(both, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)) | close(p["a"], p["b"]))


def same_tokens(a: Column, b: Column) -> Column:
    return whitespace_words(a) == whitespace_words(b)


def allowed(code: Column) -> Column:
    """False for programs that leave early with success."""
    return ~code.rlike(r"exit\(\s*0\s*\)")


# --- line and word counts ------------------------------------------------------------------------------------------
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def code_lines(code: Column) -> Column:
    """Lines as splitlines() has them: no empty piece after the last line end."""
    parts = F.split(code, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_metrics(code: Column) -> Column:
    """struct<loc, cloc, bloc>: lines, lines that start with #, blank lines."""
    rows = code_lines(code)
    return F.struct(
        F.size(rows).cast("long").alias("loc"),
        F.size(F.filter(rows, lambda x: stripped(x).startswith("#"))).cast("long").alias("cloc"),
        F.size(F.filter(rows, lambda x: stripped(x) == "")).cast("long").alias("bloc"),
    )


def maintainability(volume: Column, cc: Column, loc: Column) -> Column:
    raw = (171 - 5.2 * F.ln(volume + 1) - 0.23 * cc - 16.2 * F.ln(loc + 1)) * 100 / 171
    return F.when(loc == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), raw))
