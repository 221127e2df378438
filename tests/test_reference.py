"""Goldens of operators that SQL cannot express."""

import pytest

from tessera.operators import dedup, extraction, formatting, judge, rewrite, symbols


def test_rewrites():
    code = "a = b = c = 5\nfor i in range(a): print(i)"
    out = rewrite.chained(code, ("assignment_unroll", "for_to_while"), "compat")
    assert out.split("\n") == ["_assign_tmp = 5", "c = _assign_tmp", "b = _assign_tmp", "a = _assign_tmp", "_i_iter = list(range(a))", "_i_idx = 0", "while _i_idx < len(_i_iter):", "    i = _i_iter[_i_idx]", "    print(i)", "    _i_idx += 1", "del _i_iter, _i_idx"]
    out = rewrite.REWRITES["condition_unroll"]("if a < b < c:\n    x = 1\nelse:\n    x = 2", "compat")
    assert out.split("\n") == ["_cmp = a", "_cmp_1 = b", "if _cmp < _cmp_1:", "    _cmp_2 = c", "    if _cmp_1 < _cmp_2:", "        x = 1", "else:", "    x = 2"]
    assert rewrite.REWRITES["for_to_while"]("for a, b in xs: print(a)", "compat") == ""
    assert rewrite.name_map({"i", "n", "total"}) == {"i": "OhbVrp", "n": "oiVgRV", "total": "IfLBcb"}
    assert all(f("not python (", "compat") == "not python (" for f in rewrite.REWRITES.values())


@pytest.mark.parametrize("name", list(rewrite.REWRITES))
def test_strict_rewrites_mean_the_same(name):
    code = "out = []\nx = y = 2\nfor k in range(6):\n    if k % 2:\n        continue\n    if 0 < k < 5:\n        out.append(k + x + y)\n"
    before, after = {}, {}
    exec(code, before)
    exec(rewrite.REWRITES[name](code, "strict"), after)
    assert [v for v in after.values() if v == before["out"]]


def test_metrics_and_symbols():
    code = "def add(a, b):\n    return a + b\n"
    assert symbols.cyclomatic(code) == 6
    h = symbols.halstead(code)
    assert (h["operators"], h["operands"], h["length"], h["vocabulary"], round(h["difficulty"], 4), h["volume"]) == (1, 3, 6, 4, 0.8333, 12.0)
    assert symbols.mask("x = 1\nprint(x)\n", "x", "Z", "strict") == "Z = 1\nprint(Z)\n"
    assert symbols.mask("x = (", "x") == "x = ("


def test_parameters_and_comparators():
    assert dedup.banding(0.7, 256) == (25, 10)
    assert judge.same_stdout("1.0000001\nYES", "1\nyes") and not judge.same_stdout("a\nb", "a\nb\nc")
    assert extraction.default_code("```bash\nls\n```\n```python\nx\n```", "python") == "x"
    assert extraction.default_code("nothing", "python") == ""
    assert formatting.format_one("")[3] is None
    assert judge.run_program("x", "sql")["status"] == "SandboxError"
    assert judge.run_program("while True: pass", "python", run_timeout=0.5)["status"] == "Failed"
