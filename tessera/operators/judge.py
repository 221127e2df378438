"""Running programs and judging submissions: runners, notebooks, problem classes, contest harness.

Programs run in child processes with a time limit, an address-space limit and their own process group. That bounds
accidents; it is not a security boundary, which the executors' containers have to be. Tasks retry as Spark tasks do, so
programs should have no side effects outside their folder.
"""

from __future__ import annotations

import base64
import json
import os
import resource
import shutil
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, scores

OUTPUT_LIMIT = 1 << 20
COMMAND = "struct<status:string,execution_time:double,return_code:int,stdout:string,stderr:string>"
RESULT = f"status string, message string, compile_result {COMMAND}, run_result {COMMAND}, files map<string,string>"

# fixed values: file, compile command (or none) and run command of each language; {d} is the program's folder
RUNNERS: dict[str, tuple[str, str | None, str]] = {
    "python": ("main.py", None, sys.executable + " main.py"),
    "pytest": ("test_main.py", None, sys.executable + " -m pytest -q -p no:cacheprovider test_main.py"),
    "bash": ("main.sh", None, "bash main.sh"),
    "cpp": ("main.cpp", "g++ -std=c++17 main.cpp -o main", "./main"),
    "c": ("main.c", "gcc main.c -o main -lm", "./main"),
    "java": ("Main.java", "javac Main.java", "java -ea Main"),
    "nodejs": ("main.js", None, "node main.js"),
    "javascript": ("main.js", None, "node main.js"),
    "typescript": ("main.ts", None, "tsx main.ts"),
    "go": ("main.go", "go build -o main main.go", "./main"),
    "go_test": ("main_test.go", None, "go test main_test.go"),
    "csharp": ("Program.cs", None, "dotnet run"),
    "php": ("main.php", None, "php -f main.php"),
    "rust": ("main.rs", "rustc main.rs -o main", "./main"),
    "jest": ("main.test.ts", None, "npx jest --json"),
    "junit": ("MainTest.java", None, "java -jar junit.jar --scan-classpath"),
    "lua": ("main.lua", None, "lua main.lua"),
    "R": ("main.R", None, "Rscript main.R"),
    "perl": ("main.pl", None, "perl main.pl"),
    "D_ut": ("main.d", None, "dmd -unittest -run main.d"),
    "ruby": ("main.rb", None, "ruby main.rb"),
    "scala": ("Main.scala", "scalac Main.scala", "scala Main"),
    "julia": ("main.jl", None, "julia main.jl"),
    "kotlin_script": ("main.kts", None, "kotlin main.kts"),
    "verilog": ("main.v", "iverilog -g2012 main.v -o main", "vvp -n main"),
    "lean": ("main.lean", None, "lean main.lean"),
    "swift": ("main.swift", "swiftc main.swift -o main", "./main"),
    "racket": ("main.rkt", None, "racket main.rkt"),
    "cuda": ("main.cu", "nvcc main.cu -o main", "./main"),
    "python_gpu": ("main.py", None, sys.executable + " main.py"),
}
LANGUAGES = (*RUNNERS, "sql")


def command(line: str, folder: str, timeout: float, stdin: str | None = None, memory_mb: int = -1) -> dict:
    """One command in a process group of its own, killed as a whole at the time limit."""

    def limits():
        os.setsid()
        if memory_mb > 0:
            resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20,) * 2)

    began = time.time()
    try:
        p = subprocess.Popen(line, shell=True, cwd=folder, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, preexec_fn=limits)
    except OSError as e:
        return {"status": "Error", "execution_time": 0.0, "return_code": None, "stdout": "", "stderr": str(e)}
    status = "Finished"
    try:
        out, err = p.communicate((stdin or "").encode(), timeout=timeout)
    except subprocess.TimeoutExpired:
        status = "TimeLimitExceeded"
        os.killpg(p.pid, signal.SIGKILL)
        out, err = p.communicate()
    return {
        "status": status,
        "execution_time": time.time() - began,
        "return_code": p.returncode if status == "Finished" else None,
        "stdout": out[:OUTPUT_LIMIT].decode(errors="replace"),
        "stderr": err[:OUTPUT_LIMIT].decode(errors="replace"),
    }


def run_program(code: str, language: str, stdin: str | None = None, compile_timeout: float = 10, run_timeout: float = 10, memory_mb: int = -1, files: dict | None = None, fetch: list | None = None) -> dict:
    """Compile where there is something to compile, run if that went well, bring back the files asked for."""
    none = {"status": "SandboxError", "message": f"no runner for {language}", "compile_result": None, "run_result": None, "files": {}}
    if language not in RUNNERS:
        return none
    name, build, run = RUNNERS[language]
    tool = (build or run).split()[0]
    if not shutil.which(tool):
        return none | {"message": f"{tool} is not installed"}
    with tempfile.TemporaryDirectory() as d:
        for path, content in (files or {}).items():
            if isinstance(content, str) and "IGNORE_THIS_FILE" not in path:
                full = os.path.normpath(os.path.join(d, path))
                if full.startswith(d + os.sep):
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    with open(full, "wb") as f:
                        f.write(base64.b64decode(content))
        with open(os.path.join(d, name), "w") as f:
            f.write(code)
        built = command(build, d, compile_timeout, memory_mb=memory_mb) if build else None
        ran = None
        if built is None or (built["status"] == "Finished" and built["return_code"] == 0):
            ran = command(run, d, run_timeout, stdin, memory_mb)
        got = {}
        for path in fetch or []:
            full = os.path.normpath(os.path.join(d, path))
            if full.startswith(d + os.sep) and os.path.isfile(full):
                with open(full, "rb") as f:
                    got[path] = base64.b64encode(f.read()).decode()
    return {"compile_result": built, "run_result": ran, "files": got, **_status(built, ran)}


def _status(*results: dict | None) -> dict:
    done = [r for r in results if r]
    error = next((r for r in done if r["status"] == "Error"), None)
    if error:
        return {"status": "SandboxError", "message": error["stderr"]}
    bad = any(r["status"] == "TimeLimitExceeded" or r["return_code"] for r in done)
    return {"status": "Failed" if bad else "Success", "message": ""}


def with_retry(run: Callable[[], dict], attempts: int = 1, pause: float = 0.5) -> dict:
    """Again, at growing pauses, while the sandbox itself fails."""
    for i in range(attempts):
        result = run()
        if result["status"] != "SandboxError" or i == attempts - 1:
            return result
        time.sleep(pause * 2**i * (0.5 + np.random.random()))
    return result


def run_code(requests: DataFrame, attempts: int = 1) -> DataFrame:
    """requests (code, language, and optionally stdin, compile_timeout, run_timeout, memory_limit_MB, files,
    fetch_files) with the columns of a response. One program at a time a task; rows are spread by Spark."""
    has = set(requests.columns)

    def get(row, name, default):
        v = row.get(name) if name in has else None
        return default if v is None or (isinstance(v, float) and v != v) else v

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                files = get(row, "files", {})
                fetch = get(row, "fetch_files", None)
                one = lambda row=row, files=files, fetch=fetch: run_program(
                    get(row, "code", ""), get(row, "language", ""), get(row, "stdin", None), float(get(row, "compile_timeout", 10)), float(get(row, "run_timeout", 10)), int(get(row, "memory_limit_MB", -1)), dict(files), None if fetch is None else list(fetch)
                )
                out.append(with_retry(one, attempts))
            yield pdf.assign(**{k: [r[k] for r in out] for k in ("status", "message", "compile_result", "run_result")}, result_files=[r["files"] for r in out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields]
    return requests.mapInPandas(run, ", ".join([*fields, RESULT.replace("files map", "result_files map")]))


_CELLS = """
import contextlib, io, json, sys, traceback
out, scope = [], {"__name__": "__main__"}
for cell in json.load(open("cells.json")):
    o, e, error = io.StringIO(), io.StringIO(), None
    with contextlib.redirect_stdout(o), contextlib.redirect_stderr(e):
        try:
            import ast
            tree = ast.parse(cell)
            last = ast.Expression(tree.body.pop().value) if tree.body and isinstance(tree.body[-1], ast.Expr) else None
            exec(compile(tree, "cell", "exec"), scope)
            shown = repr(v) if last is not None and (v := eval(compile(last, "cell", "eval"), scope)) is not None else None
        except BaseException:
            shown, error = None, traceback.format_exc(limit=0)
    out.append({"stdout": o.getvalue(), "stderr": e.getvalue(), "display": shown, "error": error})
json.dump(out, open("out.json", "w"))
"""
CELLS = "array<struct<stdout:string,stderr:string,display:string,error:string>>"


def run_cells(requests: DataFrame, cells: str = "cells", timeout: float = 45) -> DataFrame:
    """The cells of a notebook, all from scratch in one fresh process: a column ``results`` and a status."""

    @F.pandas_udf(f"status string, results {CELLS}")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            given = base64.b64encode(json.dumps(list(x if x is not None else [])).encode()).decode()
            r = run_program(_CELLS, "python", run_timeout=timeout, files={"cells.json": given}, fetch=["out.json"])
            got = json.loads(base64.b64decode(r["files"]["out.json"])) if "out.json" in r["files"] else []
            rows.append((r["status"], got))
        return pd.DataFrame(rows, columns=["status", "results"])

    return requests.withColumn("_r", run(F.col(cells))).withColumns({"status": F.col("_r.status"), "results": F.col("_r.results")}).drop("_r")


# --- comparing outputs -----------------------------------------------------------------------------------------------
def _float(x: str) -> float | None:
    try:
        return float(x)
    except ValueError:
        return None


def same_stdout(actual: str, expected: str) -> bool:
    """Line by line without blanks at the ends or case; numbers within a relative 1e-5."""
    a, b = actual.strip().lower().split("\n"), expected.strip().lower().split("\n")
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        x, y = x.strip(), y.strip()
        if x != y:
            u, v = _float(x), _float(y)
            if u is None or v is None or not abs(u - v) / max(abs(v), 1e-10) < 1e-5:
                return False
    return True


def contest_stdout(actual: str, expected: str) -> bool:
    """A contest's cascade: whole text, lines, lines without empties, lists of numbers."""
    if actual.strip() == expected.strip():
        return True
    a = [x.strip() for x in actual.strip().split("\n")]
    b = [x.strip() for x in expected.strip().split("\n")]
    if a == b:
        return True
    a, b = [x for x in a if x], [x for x in b if x]
    if a == b:
        return True
    u, v = [_float(t) for x in a for t in x.split()], [_float(t) for x in b for t in x.split()]
    if None in u or None in v or len(u) != len(v):
        return False
    if all(x.is_integer() and y.is_integer() for x, y in zip(u, v, strict=True)):
        return u == v
    return bool(np.allclose(u, v))


def contest_value(actual, expected) -> bool:
    """A call's result against the expected value, tuples as lists, or against the only element of an expected list."""
    plain = lambda x: [plain(y) for y in x] if isinstance(x, list | tuple) else x
    a = plain(actual)
    return a == expected or (isinstance(expected, list) and bool(expected) and a == expected[0])


_CALL = """
import json, sys
from typing import *
import collections, heapq, itertools, math, bisect, functools, re, string, random
from collections import *
from functools import *
from itertools import *
{code}
_args = [json.loads(x) for x in json.load(open("input.json")).split("\\n") if x.strip()]
_f = getattr(Solution(), {name!r}) if {is_class} else {name}
print("\\x00" + json.dumps(_f(*_args)))
"""


def contest(code: str, cases: list[dict], fn_name: str | None = None, timeout: float = 6) -> list:
    """Results in order up to the first that isn't True: False wrong, -1 an exception or the time limit, -2 no code."""
    try:
        compile(code, "solution", "exec")
    except (SyntaxError, ValueError):
        return [-2]
    out, until = [], time.time() + min((timeout + 1) * len(cases) + 5, 160)
    for case in cases:
        left = min(timeout, max(0.1, until - time.time()))
        if fn_name:
            program = _CALL.format(code=code, name=fn_name, is_class="class Solution" in code)
            r = run_program(program, "python", run_timeout=left, files={"input.json": base64.b64encode(json.dumps(case["input"]).encode()).decode()})
            ok = r["status"] == "Success" and "\x00" in r["run_result"]["stdout"]
            verdict = contest_value(json.loads(r["run_result"]["stdout"].rpartition("\x00")[2]), json.loads(case["output"])) if ok else -1
        else:
            r = run_program(code, "python", stdin=case["input"], run_timeout=left)
            verdict = contest_stdout(r["run_result"]["stdout"], case["output"]) if r["status"] == "Success" else -1
        out.append(verdict)
        if verdict is not True:
            break
    return out


# --- judging -----------------------------------------------------------------------------------------------------------
ANTIHACK = {
    "python": "import os\nimport sys\nexit = None\nos._exit = None\nsys.exit = None\n",
    "cpp": "#include <cstdlib>\nvoid exit(int) { std::abort(); }\n",
}


def guarded(code: Column, language: str) -> Column:
    return F.concat(F.lit(ANTIHACK[language] + "\n\n"), code) if language in ANTIHACK else code


def attach(submissions: DataFrame, problems: DataFrame) -> DataFrame:
    """Submissions with their problem; one without gets the error ``unknown problem``."""
    p = problems.withColumn("_known", F.lit(True))
    return submissions.join(p, "id", "left").withColumn("error", F.when(F.col("_known").isNull(), F.lit("unknown problem"))).drop("_known")


def judge_programs(df: DataFrame, full_code: Column, language: str, run_timeout: float = 10) -> DataFrame:
    """Runs assembled programs; accepted where they end well."""
    ran = run_code(df.withColumn("_given", F.struct(*df.columns)).select("_given", full_code.alias("code"), F.lit(language).alias("language"), F.lit(run_timeout).alias("run_timeout")))
    return ran.select("_given.*", F.col("code").alias("full_code"), "status", (F.col("status") == "Success").alias("accepted"))


def judge_stdio(df: DataFrame, language: str, completion: str = "completion", tests: str = "test", run_all: bool = False, run_timeout: float = 20) -> DataFrame:
    """tests: array<struct<input:string,output:string>>. Adds code, passed (one a case, up to the first failure unless
    run_all) and accepted."""
    if language not in RUNNERS:
        raise ValueError(f"a language with a runner is required, not {language!r}")

    @F.pandas_udf("code string, passed array<boolean>")
    def run(answers: pd.Series, cases: pd.Series) -> pd.DataFrame:
        rows = []
        for answer, case_list in zip(answers, cases, strict=True):
            code, passed = extraction.default_code(answer or "", language), []
            for case in case_list if case_list is not None else []:
                r = run_program(code, language, stdin=case["input"], run_timeout=run_timeout)
                passed.append(r["status"] == "Success" and same_stdout(r["run_result"]["stdout"], case["output"]))
                if not passed[-1] and not run_all:
                    break
            rows.append((code, passed))
        return pd.DataFrame(rows, columns=["code", "passed"])

    out = df.withColumn("_r", run(F.col(completion), F.col(tests)))
    return out.withColumns({"code": F.col("_r.code"), "passed": F.col("_r.passed"), "accepted": F.forall("_r.passed", lambda p: p)}).drop("_r")


def judge_contest(df: DataFrame, completion: str = "completion", tests: str = "test", fn_name: str | None = None, timeout: float = 6) -> DataFrame:
    """accepted where every case gives True; no case accepts."""

    @F.pandas_udf("boolean")
    def run(answers: pd.Series, cases: pd.Series) -> pd.Series:
        return pd.Series([all(r is True for r in contest(extraction.default_code(a or "", "python"), list(c) if c is not None else [], fn_name, timeout)) for a, c in zip(answers, cases, strict=True)])

    return df.withColumn("accepted", run(F.col(completion), F.col(tests)))


def answer_part(completion: Column) -> Column:
    """What an answer holds after its first opening mark, up to its closing mark; without one, all of it."""
    cut = T.cut_at(completion, "# done", "[/ANSWER]")
    return F.when(cut.contains("[ANSWER]"), T.stripped(F.split_part(cut, F.lit("[ANSWER]"), F.lit(2)))).otherwise(cut)


def prediction_program(code: Column, given: Column, expected: Column, answer: Column, mode: str) -> Column:
    """A program that asserts a predicted input (a call of f) or output."""
    fact = expected if mode == "input" else F.concat(F.lit("f("), given, F.lit(")"))
    return F.concat(code, F.lit("\nassert "), answer, F.lit(" == "), fact)


def assert_program(setup: Column, code: Column, tests: Column) -> Column:
    return F.concat_ws("\n", setup, code, F.array_join(tests, "\n"))


def math_program(code: Column, answer: Column) -> Column:
    """Asserts that solution() gives the answer, numbers within tolerance."""
    check = "\n_r = solution()\n_e = {}\ntry:\n    _ok = abs(float(_r) - float(_e)) < 1e-6 * max(1, abs(float(_e)))\nexcept (TypeError, ValueError):\n    _ok = str(_r).strip() == str(_e).strip()\nassert _ok\n"
    head, tail = check.split("{}")
    return F.concat(code, F.lit(head), answer, F.lit(tail))


def inserted_program(template: Column, code: Column) -> Column:
    return F.replace(template, F.lit("#<INSERT>"), code)


def next_line_verdict(completion: Column, expected: Column, language: str = "python") -> Column:
    """Whether the first line that is no comment has the expected line's tokens."""
    first = F.pandas_udf(lambda s: s.map(lambda t: extraction.first_code_line(t or "", language)), "string")
    return T.same_tokens(first(completion), expected)


def proof_verdict(accepted: Column, full_code: Column, theorem: Column, stdout: Column) -> Column:
    """A proof counts if it builds, still states its theorem and admits nothing."""
    return accepted & full_code.contains(F.concat(F.lit("theorem "), theorem)) & ~F.coalesce(stdout, F.lit("")).contains("declaration uses 'sorry'")


def retrieval_prompt(df: DataFrame, group: str, order: str, snippet: str, budget: int) -> DataFrame:
    """(group, prompt): commented snippets by the md5 order of their text while their words fit the budget."""
    words = df.withColumn("_w", F.size(T.whitespace_words(F.col(snippet)))).withColumn("_o", F.struct(F.md5(F.col(snippet).cast("binary")), F.col(order)))
    kept = scores.within_budget(words, group, "_o", "_w", budget)
    return kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", T.commented(F.col(snippet)).alias("t")))), lambda x: x["t"]), "\n").alias("prompt"))


def run_tests(df: DataFrame, code: str = "code", tests: str = "tests", timeout: float = 30) -> DataFrame:
    """pytest of each row's tests against its code (module ``file``): exit_code, feedback, coverage of the code's lines."""
    names = {0: "OK", 1: "TESTS_FAILED", 2: "INTERRUPTED", 3: "INTERNAL_ERROR", 4: "USAGE_ERROR", 5: "NO_TESTS"}
    trace = """
import json, sys
hit = set()
def local(frame, event, arg):
    if event == "line":
        hit.add(frame.f_lineno)
    return local
def watch(frame, event, arg):
    return local if frame.f_code.co_filename.endswith("file.py") else None
import pytest
sys.settrace(watch)
rc = int(pytest.main(["-q", "--tb=short", "-p", "no:cacheprovider", "tests.py"]))
sys.settrace(None)
def lines(code):
    out = {n for _, _, n in code.co_lines() if n}
    for c in code.co_consts:
        if hasattr(c, "co_lines"):
            out |= lines(c)
    return out
all_lines = lines(compile(open("file.py").read(), "file.py", "exec"))
json.dump({"rc": rc, "coverage": 100.0 * len(hit & all_lines) / max(1, len(all_lines))}, open("out.json", "w"))
"""

    @F.pandas_udf("coverage double, exit_code string, feedback string")
    def run(codes: pd.Series, test_codes: pd.Series) -> pd.DataFrame:
        rows = []
        for c, t in zip(codes, test_codes, strict=True):
            files = {k: base64.b64encode((v or "").encode()).decode() for k, v in (("file.py", c), ("tests.py", t))}
            r = run_program(trace, "python", run_timeout=timeout, files=files, fetch=["out.json"])
            out = r["run_result"]["stdout"] if r["run_result"] else ""
            got = json.loads(base64.b64decode(r["files"]["out.json"])) if "out.json" in r["files"] else {"rc": 3, "coverage": 0.0}
            at = min((i for i in (out.find("= FAILURES ="), out.find("= ERRORS =")) if i >= 0), default=-1)
            rows.append((got["coverage"], names.get(got["rc"], "INTERNAL_ERROR"), out[at:] if at >= 0 else ""))
        return pd.DataFrame(rows, columns=["coverage", "exit_code", "feedback"])

    return df.withColumn("_r", run(F.col(code), F.col(tests))).withColumns({k: F.col(f"_r.{k}") for k in ("coverage", "exit_code", "feedback")}).drop("_r")
