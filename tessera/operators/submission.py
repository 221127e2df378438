"""Problem tables, prompts and submissions: what a problem class asks, and what it accepts.

A problem class is an entry of ``CLASSES``: columns that make the prompt, columns that make the code and the whole program
of a submission, the language it runs in, and what has the last word on a run. ``prompts`` and ``submit`` apply a class to
a problem table; programs are put together as columns and only their runs leave the JVM. All tables go by the column
``id``. Config is a mapping of the class's options.

Defined results: a submission whose problem isn't in the table is not accepted and has the error ``unknown problem``; null
completions are empty; submissions that share an id are judged separately.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, judge, scores

Config = Mapping[str, Any]


def _completion() -> Column:
    return F.coalesce(F.col("completion"), F.lit(""))


@dataclass(frozen=True)
class ProblemClass:
    prompt: Callable[[Config], Column]
    code: Callable[[Config], Column]
    program: Callable[[Column, Config], Column]  # of the code
    language: Callable[[Config], Column] = lambda config: F.lit("python")
    verdict: Callable[[Column, Config], Column] = lambda ran, config: ran  # of whether the run ended well
    run_timeout: float = 20
    # judges by itself what isn't one program a submission
    judge: Callable[[DataFrame, Config], DataFrame] | None = None


def _default(language: str) -> Callable[[Config], Column]:
    return lambda config: T.best_block(_completion(), F.lit(language))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


# --- function completion -------------------------------------------------------------------------------------------------
# fixed values: what a Python program may use without importing it; where a completion of a function ends
PYTHON_IMPORTS = "\n".join(
    [
        *(f"import {m}" for m in ("math", "re", "sys", "copy", "datetime", "itertools", "collections", "heapq", "statistics", "functools", "hashlib", "numpy")),
        "import numpy as np",
        "import string",
        "from typing import *",
        "from collections import *",
    ]
)
FUNCTION_END = r"re:\n(?!\s|\n)(?=.|\n)"


def _function_prompt(config: Config) -> Column:
    """The prompt as it stands; freeform: fenced, with the instruction."""
    if not config.get("is_freeform"):
        return F.col("prompt")
    ask = "Please complete the above code according to the requirements in the docstring. Write the complete code and wrap it in markdown syntax. The code should not contain `Main` function."
    return F.concat(F.lit("```python\n"), F.col("prompt"), F.lit("\n```\n\n" + ask))


def _function_code(config: Config) -> Column:
    if config.get("is_freeform"):
        return _default("python")(config)
    stops = list(config.get("stop_tokens", [FUNCTION_END]))
    return F.pandas_udf(lambda s: s.map(lambda t: extraction.trim_at_stops(t, stops)), "string")(_completion())


def _function_program(code: Column, config: Config) -> Column:
    body = code if config.get("is_freeform") else _lines(F.col("prompt"), code)
    return F.concat(_lines(F.lit(PYTHON_IMPORTS), body, F.col("test")), F.lit("\ncheck("), F.col("entry_point"), F.lit(")"))


# --- predicted inputs and outputs ----------------------------------------------------------------------------------------
def _prediction(config: Config) -> Column:
    """What is claimed: the answer between its marks, or the text of an assertion about f, or one side of an equation."""
    answer = judge.answer_part(_completion())
    answer = F.when(answer.contains("assert f"), F.concat(F.lit("f"), T.stripped(F.split_part(answer, F.lit("assert f"), F.lit(2))))).otherwise(answer)
    side = 1 if config["mode"] == "input" else 2
    return F.when(answer.contains("=="), T.stripped(F.split_part(answer, F.lit("=="), F.lit(side)))).otherwise(answer)


def _prediction_program(answer: Column, config: Config) -> Column:
    return judge.prediction_program(F.col("code"), F.col("input"), F.col("output"), answer, config["mode"])


def _prediction_prompt(config: Config) -> Column:
    given = F.concat(F.lit("Find an input such that f gives "), F.col("output")) if config["mode"] == "input" else F.concat(F.lit("Find what f gives for "), F.col("input"))
    return F.concat(F.col("code"), F.lit("\n\n"), given, F.lit(". Put the answer between [ANSWER] and [/ANSWER]."))


# --- assertions ----------------------------------------------------------------------------------------------------------
def _assert_prompt(config: Config) -> Column:
    tests = F.slice("test_list", 1, 2) if config.get("is_fewshot") else F.col("test_list")
    asked = F.concat(F.lit("You are an expert Python programmer, and here is your task: "), F.col("content"), F.lit(" Your code should pass these tests:\n\n"), F.array_join(tests, "\n"))
    return F.concat(*[F.concat(F.lit(x), F.lit("\n")) for x in config.get("examples", ())], asked, F.lit("\n[BEGIN]\n")) if config.get("is_fewshot") else asked


def _assert_code(config: Config) -> Column:
    code = T.cut_at(T.last_block(T.cut_at(_completion(), "[DONE]")), *config.get("stop_words", ()))
    return T.cut_at(_lines(F.coalesce(F.col("test_setup_code"), F.lit("")), code), "if __name__ ==")


def _assert_program(code: Column, config: Config) -> Column:
    tests = F.slice("test_list", -1, 1) if config.get("is_fewshot") else F.col("test_list")
    return F.concat(code, F.array_join(F.transform(tests, lambda t: F.concat(F.lit("\n"), t, F.lit("\n"))), ""))


# --- docstring problems, translations, tests of several languages ---------------------------------------------------------
def _docstring_prompt(config: Config) -> Column:
    """The content up to its last docstring mark, with the first test as an example."""
    marks = F.split("content", '"""', -1)
    head = F.array_join(F.slice(marks, 1, F.size(marks) - 1), '"""')
    return F.concat(head, F.lit("\n    e.g. "), F.substring_index("test", "\n", 1), F.lit(' """'))


def _docstring_code(config: Config) -> Column:
    own = _default("python")(config)
    return F.when(F.trim(own) != "", own).otherwise(T.best_block(_lines(F.col("content"), _completion()), F.lit("python")))


def _translated_code(config: Config) -> Column:
    language = config.get("language", "python")
    first = config.get("first_block_only", True)
    options = {"first_only": first, "exactly_match": first, "no_removal": True, "inner_function_only": language == "csharp"}
    return extraction.freeform(_completion(), language, 2, **options)["code"]


def _translated_verdict(ran: Column, config: Config) -> Column:
    """No early exit; some test programs end well although they say that they failed."""
    fair = T.allowed(F.col("extracted_code")) if config.get("language", "python") in judge.ANTIHACK else F.lit(True)
    return ran & fair & ~(F.coalesce(F.col("stderr"), F.lit("")).contains("FAILURE") & F.lit(config.get("language") == "racket"))


def _tested_code(config: Config) -> Column:
    language = config.get("language", "python")
    return T.without_entry_point(T.best_block(_completion(), F.lit(language)), language)


def _tested_program(code: Column, config: Config) -> Column:
    program = T.append_test(code, F.col("test"))
    # what was asked to be printed proves that the program ran to its end
    return F.concat(program, F.lit('\n\nprint("'), _flag(), F.lit('")')) if config.get("append_flag") else program


def _flag() -> Column:
    return F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), _completion()).cast("binary")), 1, 20)


def _tested_verdict(ran: Column, config: Config) -> Column:
    return ran & F.coalesce(F.col("stdout"), F.lit("")).contains(_flag()) if config.get("append_flag") else ran


def _tagged_code(config: Config) -> Column:
    language = config.get("language", "python")
    return F.pandas_udf(lambda s: s.map(lambda t: extraction.tagged_code(t, language)), "string")(_completion())


def _proof_code(config: Config) -> Column:
    return T.lean_hoisted(T.last_block(_completion()))


# --- judges of their own ---------------------------------------------------------------------------------------------------
def _stdio(df: DataFrame, config: Config) -> DataFrame:
    out = judge.judge_stdio(df, config["language"], "completion", "test", run_all=bool(config.get("run_all_cases")))
    return out.withColumn("extracted_code", F.col("code")).withColumn("full_code", F.col("code"))


def _contest(df: DataFrame, config: Config) -> DataFrame:
    out = judge.judge_contest(df, "completion", "test", config.get("fn_name"))
    return out.withColumn("extracted_code", _default("python")(config)).withColumn("full_code", F.col("extracted_code"))


def _next_line(df: DataFrame, config: Config) -> DataFrame:
    out = df.withColumn("extracted_code", _completion()).withColumn("full_code", F.col("extracted_code"))
    return out.withColumn("accepted", judge.next_line_verdict(F.col("extracted_code"), F.col("next_line"), config.get("language", "python")))


def _content(config: Config) -> Column:
    return F.col("content")


def _no_program(code: Column, config: Config) -> Column:
    return code


CLASSES: dict[str, ProblemClass] = {
    "CommonOJDataset": ProblemClass(_content, _default("python"), _no_program, judge=_stdio),
    "AutoEvalDataset": ProblemClass(_content, _tested_code, _tested_program, lambda c: F.lit(c.get("execution_language", c.get("language", "python"))), _tested_verdict),
    "CruxEvalDataset": ProblemClass(_prediction_prompt, _prediction, _prediction_program, run_timeout=30),
    "HumanEvalDataset": ProblemClass(_function_prompt, _function_code, _function_program),
    "MultiPLEDataset": ProblemClass(_function_prompt, _function_code, lambda code, c: _lines(F.col("prompt"), code, F.col("test")), lambda c: F.lit(c.get("language", "python"))),
    "EvoEvalDataset": ProblemClass(_function_prompt, _function_code, _function_program),
    "LiveCodeBenchDataset": ProblemClass(_content, _default("python"), _no_program, judge=_contest),
    "MBPPDataset": ProblemClass(_assert_prompt, _assert_code, _assert_program),
    "MBXPDataset": ProblemClass(_content, _translated_code, lambda code, c: T.append_test(code, F.col("test")), lambda c: F.lit(c.get("execution_language", c.get("language", "python"))), _translated_verdict, 30),
    "MHPPDataset": ProblemClass(_docstring_prompt, _docstring_code, lambda code, c: _lines(code, F.col("test"))),
    "MiniF2FLean4Dataset": ProblemClass(
        _content, _proof_code, _no_program, lambda c: F.lit("lean"), lambda ran, c: judge.proof_verdict(ran, F.col("full_code"), F.col("id").cast("string"), F.col("stdout")), 60
    ),
    "NaturalCodeBenchDataset": ProblemClass(_content, _tagged_code, lambda code, c: _lines(code, F.col("test")), lambda c: F.lit("pytest"), run_timeout=40),
    "PalMathDataset": ProblemClass(_content, lambda c: T.solution_block(_completion()), lambda code, c: judge.math_program(code, F.col("answer"))),
    "RepobenchCDataset": ProblemClass(_content, _default("python"), _no_program, judge=_next_line),
    "RepobenchPDataset": ProblemClass(_content, _default("python"), _no_program, judge=_next_line),
    "VerilogDataset": ProblemClass(_content, lambda c: extraction.freeform(_completion(), "verilog", 2)["code"], lambda code, c: _lines(F.col("prompt"), code, F.col("test")), lambda c: F.lit("verilog")),
    "AiderBenchmarkDataset": ProblemClass(_content, _default("python"), lambda code, c: judge.inserted_program(F.col("test"), code)),
}


def problem_class(name: str) -> ProblemClass:
    if name not in CLASSES:
        raise ValueError(f"no problem class {name!r}; there are {', '.join(sorted(CLASSES))}")
    return CLASSES[name]


def prompts(problems: DataFrame, name: str, config: Config | None = None, offset: int = 0, limit: int = 1_000_000) -> DataFrame:
    """(id, prompt, labels): a page of the problems by id; labels are the problem's other columns."""
    page = problems.orderBy("id").offset(offset).limit(limit)
    rest = [c for c in problems.columns if c not in ("id", "prompt", "content")]
    return page.select("id", problem_class(name).prompt(config or {}).alias("prompt"), F.struct(*rest).alias("labels"))


def prompt_by_id(problems: DataFrame, name: str, key, config: Config | None = None) -> DataFrame:
    return prompts(problems.where(F.col("id") == F.lit(key)), name, config)


def submit(submissions: DataFrame, problems: DataFrame, name: str, config: Config | None = None) -> DataFrame:
    """submissions (id, completion) -> id, completion, extracted_code, full_code, accepted, error."""
    config, kind = config or {}, problem_class(name)
    joined = judge.attach(submissions.select("id", "completion"), problems)
    known, unknown = joined.where("error IS NULL"), joined.where("error IS NOT NULL")
    if kind.judge is not None:
        judged = kind.judge(known, config)
    else:
        coded = known.withColumn("extracted_code", kind.code(config))
        coded = coded.withColumn("full_code", kind.program(F.col("extracted_code"), config))
        request = coded.select(F.struct("*").alias("given"), F.col("full_code").alias("code"), kind.language(config).alias("language"), F.lit(float(config.get("run_timeout", kind.run_timeout))).alias("run_timeout"))
        ran = judge.run_code(request).select("given.*", (F.col("status") == "Success").alias("ran"), F.col("run_result.stdout").alias("stdout"), F.col("run_result.stderr").alias("stderr"))
        judged = ran.withColumn("accepted", kind.verdict(F.col("ran"), config))
    out = ["id", "completion", "extracted_code", "full_code", "accepted", "error"]
    nothing = unknown.select("id", "completion", F.lit("").alias("extracted_code"), F.lit("").alias("full_code"), F.lit(False).alias("accepted"), "error")
    return judged.select(*out).unionByName(nothing)


def metrics(results: DataFrame, name: str, repeats: int, ks: list[int], category: str | None = None) -> DataFrame:
    """pass@k of a class's results (id, accepted), overall or by a category; k beyond repeats are left out."""
    problem_class(name)
    return scores.pass_at_k(results, [k for k in ks if k <= repeats], "id", "accepted", repeats, category)
