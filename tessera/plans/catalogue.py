"""Registered queries over the engine's operators and their SQL twins.

A query reads whole tables, or an inline fixture (the same VALUES text in both engines) where the corpus holds no code.
In fixtures ``~`` stands for a line end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import annotate as A
from tessera.operators import dedup, extraction, formatting, judge, rewrite, scores, submission, symbols
from tessera.operators.components import connected_components
from tessera.sources import tables as S
from tessera.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(values: str, *columns: str) -> str:
    """A subquery over VALUES; string columns named t or t_* have ~ for line ends."""
    shown = ", ".join(f"replace({c}, '~', chr(10)) AS {c}" if c == "t" or c.startswith("t_") else c for c in columns)
    return f"(SELECT {shown} FROM (VALUES {values}) AS v({', '.join(columns)}))"


# --- sources, projection, sets ---------------------------------------------------------------------------------------
@query("scan_rename", "SELECT doc_id, text AS code, lang AS language, source, n_chars FROM documents")
def _(spark, sf):
    return S.renamed(table(spark, sf, "documents"))


@query("lang_remap", "SELECT DISTINCT CASE lang WHEN 'C++' THEN 'cpp' WHEN 'C#' THEN 'c-sharp' ELSE lower(lang) END AS folder FROM (SELECT lang FROM documents UNION ALL SELECT * FROM (VALUES ('C++'), ('C#'), ('Go')) AS v(lang))")
def _(spark, sf):
    extra = spark.createDataFrame([("C++",), ("C#",), ("Go",)], "lang string")
    return table(spark, sf, "documents").select("lang").union(extra).select(S.language_folder(F.col("lang")).alias("folder")).distinct()


@query("language_counts", "SELECT lang AS language, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def _(spark, sf):
    return S.renamed(table(spark, sf, "documents")).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("repo_split", "SELECT doc_id, split_part(text, chr(10), 1) AS repo, CASE WHEN strpos(text, chr(10)) = 0 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1) END AS code FROM documents")
def _(spark, sf):
    repo, code = S.split_repo(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", repo.alias("repo"), code.alias("code"))


@query("page_slice", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def _(spark, sf):
    return S.page(table(spark, sf, "benchmark"), "item_id", 5, 10)


@query("point_lookup", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id = 7")
def _(spark, sf):
    return S.point_lookup(table(spark, sf, "documents"), "doc_id", 7).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("list_ids", "SELECT item_id AS id, 'input' AS mode FROM benchmark UNION ALL SELECT item_id, 'output' FROM benchmark")
def _(spark, sf):
    ids = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return ids.withColumn("mode", F.lit("input")).unionByName(ids.withColumn("mode", F.lit("output")))


@query("head_range", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row_index FROM documents")
def _(spark, sf):
    return S.with_row_index(table(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "row_index")


@query("contiguous_shard", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 8 // count(*) OVER ())::BIGINT AS shard FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.count()
    return S.with_row_index(docs, ["doc_id"]).select("doc_id", F.floor(F.col("row_index") * 8 / F.lit(n)).cast("long").alias("shard"))


@query("hash_split", "SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 8))::BIGINT < 3435973836 AS train FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.hash_split(F.col("doc_id"), 0.8).alias("train"))


@query("exact_split", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 AS place, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 < floor(count(*) OVER () * 0.8) AS train FROM documents")
def _(spark, sf):
    return S.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8)


@query(
    "seed_multisets",
    "SELECT [a, b] AS members FROM (SELECT a.s AS a, b.s AS b FROM (VALUES ('x'), ('y'), ('z'), ('w')) AS a(s) JOIN (VALUES ('x'), ('y'), ('z'), ('w')) AS b(s) ON a.s <= b.s) ORDER BY md5(a || ',' || b || ':42'), a || ',' || b LIMIT 5",
)
def _(spark, sf):
    return scores.seed_multisets(spark.createDataFrame([(x,) for x in "xyzw"], "s string"), "s", 2, 5)


@query("union_two_modes", "SELECT item_id, 'input' AS mode, 'Predict the input: ' || text AS prompt FROM benchmark UNION ALL SELECT item_id, 'output', 'Predict the output: ' || text FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    parts = [b.select("item_id", F.lit(m).alias("mode"), T.template(F.lit(f"Predict the {m}: {{text}}"), {"text": F.col("text")}).alias("prompt")) for m in ("input", "output")]
    return parts[0].unionByName(parts[1])


@query("shard_union", "SELECT text AS code FROM documents WHERE lang IS NOT NULL")
def _(spark, sf):
    """One shard a language, put together again."""
    d = S.renamed(table(spark, sf, "documents"))
    return reduce(DataFrame.unionByName, [d.where(F.col("language") == x).select("code") for x in ("de", "en", "es", "fr")])


@query("set_operations", "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'documents' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def _(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").distinct().withColumn("side", F.lit("both")).union(d.join(l, "doc_id", "left_anti").distinct().withColumn("side", F.lit("documents")))


# --- text ----------------------------------------------------------------------------------------------------------
@query("tail_lines", "SELECT doc_id, array_to_string(l[greatest(1, len(l) - 59):], chr(10)) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tail_lines(F.col("text")).alias("tail"))


@query("truncate_32k", "SELECT doc_id, substr(text, 1, 32000) AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, A.LIMIT).alias("text"))


@query("middle_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 498) || '...' || right(text, 498) ELSE text END AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.middle_ellipsis(F.col("text")).alias("text"))


@query("token_counts", "SELECT doc_id, len(regexp_split_to_array(text, '[^A-Za-z_0-9]'))::BIGINT AS tokens, len(list_distinct(regexp_split_to_array(text, '[^A-Za-z_0-9]')))::BIGINT AS distinct_tokens FROM documents")
def _(spark, sf):
    w = T.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("distinct_tokens"))


_GRAMS = "CASE WHEN len(w) < 5 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END"


@query("ngram_counts", f"SELECT doc_id, len({_GRAMS})::BIGINT AS grams FROM (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z_0-9]') AS w FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(T.ngrams(T.tokens(F.col("text"))))).cast("long").alias("grams"))


@query("md5_order", "SELECT item_id, md5(text) AS digest, row_number() OVER (ORDER BY md5(text), item_id) AS place FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return S.with_row_index(b, ["digest", "item_id"]).select("item_id", "digest", (F.col("row_index") + 1).alias("place"))


@query("sha1_u32", "SELECT doc_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS h FROM (SELECT doc_id, sha1(text) AS h FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sha1_u32(F.col("text")).alias("h"))


@query("b64_roundtrip", "SELECT doc_id, to_base64(encode(text)) AS b64, text AS back FROM documents")
def _(spark, sf):
    b = F.translate(F.base64(F.encode("text", "utf-8")), "\r\n", "")
    return table(spark, sf, "documents").select("doc_id", b.alias("b64"), F.decode(F.unbase64(b), "utf-8").alias("back"))


@query("json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("line_metrics", "SELECT doc_id, len(l)::BIGINT AS loc, len(list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13)) LIKE '#%'))::BIGINT AS cloc, len(list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13)) = ''))::BIGINT AS bloc FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:len(s) - 1] ELSE s END AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.line_metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


_ENDS = "(SELECT * FROM (VALUES (1, 'a' || chr(13) || chr(10) || '# b' || chr(12) || chr(13) || 'c'), (2, chr(10)), (3, ''), (4, 'x' || chr(8232) || ' #y' || chr(133) || chr(28) || 'z' || chr(10))) AS v(id, code))"


@query("line_ends", rf"""SELECT id, len(l)::BIGINT AS loc, len(list_filter(l, lambda x: starts_with(ltrim(x), '#')))::BIGINT AS cloc, len(list_filter(l, lambda x: trim(x) = ''))::BIGINT AS bloc
FROM (SELECT id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM (SELECT id, regexp_split_to_array(code, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM {_ENDS}))""")
def _(spark, sf):
    """All line ends that count as such."""
    rows = [(1, "a\r\n# b\x0c\rc"), (2, "\n"), (3, ""), (4, "x  #y\x85\x1cz\n")]
    return spark.createDataFrame(rows, "id int, code string").select("id", T.line_metrics(F.col("code")).alias("m")).select("id", "m.*")


@query("word_count", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS woc FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.whitespace_words(F.col("text"))).cast("long").alias("woc"))


_MI = "(SELECT * FROM (VALUES (12.0, 6, 2), (0.0, 1, 1), (5.0, 3, 0), (100000.0, 400, 9000)) AS v(vol, cc, loc))"


@query("maintainability", f"SELECT cc, loc, CASE WHEN loc = 0 THEN 100.0::DOUBLE ELSE round(greatest(0, (171 - 5.2 * ln(vol::DOUBLE + 1) - 0.23 * cc::DOUBLE - 16.2 * ln(loc::DOUBLE + 1)) * 100 / 171), 6)::DOUBLE END AS mi FROM {_MI}")
def _(spark, sf):
    v = spark.sql(f"SELECT * FROM {_MI}")
    return v.select("cc", "loc", F.round(T.maintainability(F.col("vol").cast("double"), F.col("cc").cast("double"), F.col("loc").cast("double")), 6).alias("mi"))


_ANSWERS = fixture(
    """(9, 'import os~def f(x):~    return x~~~done'), (10, 'so:~~def g():~~    y = 1~    return y~class A:~    pass~'), (11, '```nodejs~a~```~```C#~b~```~```zig~c~```~```rs~d~```~```PHP~e~```'),
(12, 'SELECT a~from t; with x as (~select 1)~from x; end'), (1, 'say ```python~x = 1~``` and ```~y = 2~```'), (2, 'none here'), (3, 'open ```sql~select 1'), (4, '```bash~ls~```~then~```python~print(2)~```'),
(5, 'a ```inline``` b'), (6, '```js~f()~```~```JavaScript~g()~```'), (7, '```python~def solution():~    return 3~```'), (8, '```python~import os~```~```python~def solution():~    return 4~```')""",
    "id",
    "t",
)
_FENCED = r"'(?s)```(?:\w+)?\n(.*?)```'"


@query("extract_block", rf"SELECT id, CASE WHEN regexp_matches(t, {_FENCED}) THEN regexp_extract(t, {_FENCED}, 1) WHEN regexp_matches(t, '(?s)```(.*?)```') THEN regexp_extract(t, '(?s)```(.*?)```', 1) ELSE t END AS body, CASE WHEN regexp_matches(t, {_FENCED}) THEN regexp_extract(t, {_FENCED}, 0) WHEN regexp_matches(t, '(?s)```(.*?)```') THEN regexp_extract(t, '(?s)```(.*?)```', 0) ELSE t END AS fence FROM {_ANSWERS}")
def _(spark, sf):
    t = F.col("t")
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", T.first_block(t).alias("body"), T.first_block(t, True).alias("fence"))


@query("last_block", rf"SELECT id, coalesce(regexp_extract_all(t, '(?s)```(?:\w+\n)?(.*?)```', 1)[-1], t) AS body FROM {_ANSWERS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", T.last_block(F.col("t")).alias("body"))


# written out by hand: the library's own table is not asked
_ALIAS_SQL = """CASE WHEN n IN ('python', 'Python', 'py', 'Python3', 'python3', 'PY') THEN 'python' WHEN n IN ('JS', 'js') THEN 'nodejs'
WHEN n IN ('javascript', 'Javascript', 'JavaScript') THEN 'javascript' WHEN n IN ('bash', 'Bash', 'BASH', 'sh', 'shell') THEN 'bash' WHEN n IN ('sql', 'SQL', 'Sql') THEN 'sql'
WHEN n IN ('cpp', 'c++', 'C++', 'Cpp', 'CPP') THEN 'cpp' WHEN n IN ('c', 'C') THEN 'c' WHEN n IN ('csharp', 'c#', 'C#') THEN 'csharp' WHEN n IN ('rust', 'Rust', 'rs') THEN 'rust'
WHEN n IN ('php', 'PHP') THEN 'php' WHEN n IN ('D', 'd') THEN 'D' WHEN n IN ('R', 'r') THEN 'R' ELSE '' END"""


@query("fenced_blocks", rf"SELECT id, {_ALIAS_SQL} AS language, code FROM (SELECT id, trim(unnest(regexp_extract_all(t, '(?s)```([^\n]*)\n(.*?)\n\s*```', 1))) AS n, unnest(regexp_extract_all(t, '(?s)```([^\n]*)\n(.*?)\n\s*```', 2)) AS code FROM {_ANSWERS})")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", F.explode(T.fenced_blocks(F.col("t"))).alias("b")).select("id", "b.language", "b.code")


def _default(language: str, heuristic: str) -> str:
    """SQL: complete fences, then open ones, then the pattern over the text without blank lines."""
    names = lambda p: f"list_transform(regexp_extract_all(t, '{p}', 1), lambda n: {_ALIAS_SQL.replace(chr(10), ' ').replace('WHEN n IN', 'WHEN trim(n) IN')})"
    codes = lambda p: f"regexp_extract_all(t, '{p}', 2)"
    whole, rest = r"(?s)```([^\n]*)\n(.*?)\n\s*```", r"(?s)```([^\n]*)\n(.*)"
    pick = lambda p: f"coalesce({codes(p)}[list_position({names(p)}, '{language}')], {codes(p)}[1])"
    return f"coalesce({pick(whole)}, {pick(rest)}, regexp_extract_all(array_to_string(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''), chr(10)) || chr(10), '{heuristic}')[1], '')"


_PY_CODE, _SQL_CODE = r"(?m)(?:^(?:import|from|#)[^\n]+\n)*^(?:def|class) [^\n]+\n(?:\s+[^\n]+\n)+", r"(?im)^\s*(?:select|with\s[^\n]+as)[^;]*"


@query("default_extract", f"SELECT id, {_default('python', _PY_CODE)} AS code, {_default('sql', _SQL_CODE)} AS statement FROM {_ANSWERS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", T.best_block(F.col("t"), F.lit("python")).alias("code"), T.best_block(F.col("t"), F.lit("sql")).alias("statement"))


_SOLUTION = r"'(?s)```python\n(.*?)def solution\(\):\n(.*?)```'"


@query("solution_block", f"SELECT id, CASE WHEN regexp_matches(t, {_SOLUTION}) THEN regexp_extract(t, {_SOLUTION}, 1) || 'def solution():' || chr(10) || regexp_extract(t, {_SOLUTION}, 2) ELSE '' END AS code FROM {_ANSWERS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", T.solution_block(F.col("t")).alias("code"))


_CODES = fixture("""(1, 'x = 1~if __name__ == "__main__":~    main()'), (2, 'y = 2~# Example usage~print(y)'), (3, 'z = 3'), (4, 'import A~open B~theorem c~ import D'), (5, 'exit( 0 )'), (6, 'f()~[DONE]~g()~')""", "id", "t")


_MAINS = fixture("""(1, 'x = 1~if __name__ == "__main__":~    main()'), (2, 'y = 2~# Example usage~print(y)'), (3, 'int f();~int main() { }'), (4, 'package main~func f() { }~// package main'), (5, ' z '), (6, '')""", "id", "t")


def _before(text: str, mark: str) -> str:
    return f"CASE WHEN contains({text}, '{mark}') THEN regexp_replace(split_part({text}, '{mark}', 1), '^\\s+|\\s+$', '', 'g') ELSE {text} END"


def _no_entry(text: str) -> str:
    return _before("c", "# Example usage").join(["(SELECT ", f" FROM (SELECT {text} AS c))"])


@query("strip_entrypoint", f"SELECT id, {_no_entry(_before('t', 'if __name__ == \"__main__\":'))} AS python, {_no_entry(_before('t', 'int main()'))} AS cpp, {_no_entry(chr(39).join(['replace(t, ', 'package main', ', ', '', ')']))} AS go FROM {_MAINS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_MAINS}").select("id", *[T.without_entry_point(F.col("t"), x).alias(x) for x in ("python", "cpp", "go")])


_TESTS = fixture("(1, 'f = 1', 'a~#<INSERT>~b'), (2, 'g = 2~if __name__ == 1: g()', 'assert g'), (3, 'h', '#<INSERT>')", "id", "t_code", "t_test")


@query("append_test", f"SELECT id, CASE WHEN contains(t_test, '#<INSERT>') THEN replace(t_test, '#<INSERT>', t_code) ELSE split_part(t_code, 'if __name__ ==', 1) || chr(10) || t_test END AS program FROM {_TESTS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_TESTS}").select("id", T.append_test(F.col("t_code"), F.col("t_test")).alias("program"))


@query("mbpp_cut", f"SELECT id, split_part(t, '[DONE]', 1) AS code FROM {_CODES}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_CODES}").select("id", T.cut_at(F.col("t"), "[DONE]").alias("code"))


@query("comment_lines", f"SELECT id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: '# ' || x), chr(10)) AS code FROM {_CODES}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_CODES}").select("id", T.commented(F.col("t")).alias("code"))


_LEAN = fixture("(1, 'import A~open B~theorem c~ import D'), (2, 'import Mathlib~import Mathlib.Data~  open Nat ~theorem x'), (3, 'theorem y~~import Mathlib '), (4, '')", "id", "t")
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_IMPORT, _OPEN = (f"starts_with({_STRIP.format('x')}, '{m} ')" for m in ("import", "open"))


@query("lean_hoist", f"SELECT id, {_STRIP.format(f'array_to_string(list_concat(list_concat(list_concat(list_filter(l, lambda x: {_IMPORT} AND NOT regexp_matches({_STRIP.format(chr(120))}, {chr(39)}\\bimport\\s+Mathlib([^\\w.]|$){chr(39)})), list_filter(l, lambda x: {_OPEN})), [{chr(39) * 2}]), list_filter(l, lambda x: NOT {_IMPORT} AND NOT {_OPEN})), chr(10))')} AS code FROM (SELECT id, string_split(t, chr(10)) AS l FROM {_LEAN})")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_LEAN}").select("id", T.lean_hoisted(F.col("t")).alias("code"))


@query("lean_without_imports", f"SELECT id, {_STRIP.format(f'array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT {_IMPORT}), chr(10))')} AS code FROM {_LEAN}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_LEAN}").select("id", T.lean_without_imports(F.col("t")).alias("code"))


@query("dollar_template", "SELECT item_id, 'Item ' || item_id || ' costs $5: ' || text || ' $unknown ' || text || 's' AS prompt FROM benchmark")
def _(spark, sf):
    fields = {"id": F.col("item_id").cast("string"), "text": F.col("text")}
    return table(spark, sf, "benchmark").select("item_id", T.dollar_template(F.lit("Item $id costs $$5: $text $unknown ${text}s"), fields).alias("prompt"))


@query("tail_words", r"SELECT doc_id, array_to_string(list_slice(w, greatest(1, len(w) - 1599), len(w)), ' ') AS tail FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tail_words(F.col("text")).alias("tail"))


@query("label_keys", "SELECT doc_id, CASE WHEN quality = 1 THEN 'quality' END AS quality, NULL::VARCHAR AS prompt, CASE WHEN toxic = 1 THEN 'toxic' END AS toxic FROM labels")
def _(spark, sf):
    """Labels without the key 'prompt' and without null values."""
    named = F.create_map(F.lit("prompt"), F.lit("x"), F.lit("quality"), F.when(F.col("quality") == 1, "quality"), F.lit("toxic"), F.when(F.col("toxic") == 1, "toxic"))
    kept = table(spark, sf, "labels").select("doc_id", F.map_filter(named, lambda k, v: (k != "prompt") & v.isNotNull()).alias("m"))
    return kept.select("doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("quality", "prompt", "toxic")])


@query("result_category", "SELECT * FROM (VALUES (1, 'hard', 'creative'), (2, NULL, NULL)) AS v(id, difficulty, category)")
def _(spark, sf):
    rows = [(1, '[{"passed": true, "test_info": {"difficulty_type": "hard"}}]', "EvoEval_creative_EvoEval_7"), (2, "[]", "HumanEval/3")]
    return spark.createDataFrame(rows, "id int, tests string, key string").select("id", scores.difficulty(F.col("tests")).alias("difficulty"), scores.category_of_id(F.col("key")).alias("category"))


@query("check_program", f"SELECT id, t || chr(10) || 'check(' || 'f' || ')' AS program FROM {_CODES}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_CODES}").select("id", T.check_program(F.col("t"), F.lit("f")).alias("program"))


@query("php_tag", f"SELECT id, CASE WHEN starts_with(ltrim(t), '<?php') THEN t ELSE '<?php' || chr(10) || t END AS code FROM {_CODES}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_CODES}").select("id", T.php_tagged(F.col("t")).alias("code"))


@query("antihack", rf"SELECT id, NOT regexp_matches(t, 'exit\(\s*0\s*\)') AS allowed FROM {_CODES}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_CODES}").select("id", T.allowed(F.col("t")).alias("allowed"))


_OUTPUTS = fixture("(1, '1.0000001~YES', '1~yes'), (2, 'a~b', 'a~b~c'), (3, ' x ~', 'X'), (4, '1e3', '1000'), (5, '2', '3'), (6, '', ''), (7, '1_0', '10')", "id", "t_a", "t_b")
_NUM = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN trim({0})::DOUBLE END"


@query("stdout_compare", rf"""SELECT id, len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (trim(a[i]) = trim(b[i]) OR coalesce(abs({_NUM.format('a[i]')} - {_NUM.format('b[i]')}) / greatest(abs({_NUM.format('b[i]')}), 1e-10) < 1e-5, false)))) = 0 AS same
FROM (SELECT id, string_split(lower(regexp_replace(t_a, '^\s+|\s+$', '', 'g')), chr(10)) AS a, string_split(lower(regexp_replace(t_b, '^\s+|\s+$', '', 'g')), chr(10)) AS b FROM {_OUTPUTS})""")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_OUTPUTS}").select("id", T.same_output(F.col("t_a"), F.col("t_b")).alias("same"))


@query("float_close", f"SELECT id, coalesce(abs({_NUM.format('t_a')} - {_NUM.format('t_b')}) / greatest(abs({_NUM.format('t_b')}), 1e-10) < 1e-5, false) AS close FROM {_OUTPUTS}")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_OUTPUTS}").select("id", T.close(F.col("t_a"), F.col("t_b")).alias("close"))


@query("token_equal", r"SELECT a.item_id AS a, list_filter(regexp_split_to_array(a.text, '\s+'), lambda x: x <> '') = list_filter(regexp_split_to_array(replace(b.text, ' ', '  '), '\s+'), lambda x: x <> '') AS same FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    wide = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    return b.select(F.col("item_id").alias("a"), T.same_tokens(F.col("text"), wide).alias("same"))


_SHOWN = fixture("(1, 'think [ANSWER] f(3) [/ANSWER] x'), (2, '7 # done'), (3, '8'), (4, '[ANSWER]~a [ANSWER] b')", "id", "t")


@query("answer_part", f"SELECT id, CASE WHEN contains(c, '[ANSWER]') THEN regexp_replace(string_split(c, '[ANSWER]')[2], '^\\s+|\\s+$', '', 'g') ELSE c END AS answer FROM (SELECT id, split_part(split_part(t, '# done', 1), '[/ANSWER]', 1) AS c FROM {_SHOWN})")
def _(spark, sf):
    return spark.sql(f"SELECT * FROM {_SHOWN}").select("id", judge.answer_part(F.col("t")).alias("answer"))


# --- the same over whole documents --------------------------------------------------------------------------------------
_DOCUMENTS = "(SELECT doc_id AS id, text AS t FROM documents)"
_ON_DOCUMENTS: dict[str, tuple[str, Callable[[Column], list[Column]]]] = {
    "extract_block": (_ANSWERS, lambda t: [T.first_block(t).alias("body"), T.first_block(t, True).alias("fence")]),
    "last_block": (_ANSWERS, lambda t: [T.last_block(t).alias("body")]),
    "default_extract": (_ANSWERS, lambda t: [T.best_block(t, F.lit(x)).alias(n) for n, x in (("code", "python"), ("statement", "sql"))]),
    "solution_block": (_ANSWERS, lambda t: [T.solution_block(t).alias("code")]),
    "strip_entrypoint": (_MAINS, lambda t: [T.without_entry_point(t, x).alias(x) for x in ("python", "cpp", "go")]),
    "mbpp_cut": (_CODES, lambda t: [T.cut_at(t, "[DONE]").alias("code")]),
    "comment_lines": (_CODES, lambda t: [T.commented(t).alias("code")]),
    "lean_hoist": (_LEAN, lambda t: [T.lean_hoisted(t).alias("code")]),
    "check_program": (_CODES, lambda t: [T.check_program(t, F.lit("f")).alias("program")]),
    "php_tag": (_CODES, lambda t: [T.php_tagged(t).alias("code")]),
    "antihack": (_CODES, lambda t: [T.allowed(t).alias("allowed")]),
}
for _name, (_inline, _columns) in _ON_DOCUMENTS.items():

    @query(f"{_name}_docs", _ORACLES[_name].replace(_inline, _DOCUMENTS))
    def _(spark, sf, columns=_columns):
        return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), *columns(F.col("text")))


_PAIRS = "(SELECT doc_id AS id, text AS t_a, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'ABCDEFGHIJKLM', 'abcdefghijklm') || ' ' ELSE text || ' x' END AS t_b FROM documents)"


def _pairs(spark, sf):
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.translate("text", "ABCDEFGHIJKLM", "abcdefghijklm"), F.lit(" "))).otherwise(F.concat("text", F.lit(" x")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t_a"), other.alias("t_b"))


@query("stdout_compare_docs", _ORACLES["stdout_compare"].replace(_OUTPUTS, _PAIRS))
def _(spark, sf):
    return _pairs(spark, sf).select("id", T.same_output(F.col("t_a"), F.col("t_b")).alias("same"))


@query("float_close_docs", _ORACLES["float_close"].replace(_OUTPUTS, _PAIRS))
def _(spark, sf):
    return _pairs(spark, sf).select("id", T.close(F.col("t_a"), F.col("t_b")).alias("close"))


# --- aggregates, prefixes, status -------------------------------------------------------------------------------------
_TASKS = "(SELECT d.source AS task, d.lang AS cat, l.quality = 1 AS passed FROM documents d JOIN labels l USING (doc_id))"
_PASS = "CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k::DOUBLE / i), lambda a, b: a * b) END"


def _tasks(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("task"), F.col("lang").alias("cat"), (F.col("quality") == 1).alias("passed"))


@query("pass_at_k", f"SELECT k, round(avg({_PASS}), 6) AS pass_at_k FROM (SELECT task, count(*) AS n, count(*) FILTER (passed) AS c FROM {_TASKS} GROUP BY task), (VALUES (1), (2), (5)) AS ks(k) WHERE n >= k GROUP BY k")
def _(spark, sf):
    return scores.pass_at_k(_tasks(spark, sf), [1, 2, 5]).withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("pass_at_k_by_category", f"SELECT cat, k, round(avg({_PASS}), 6) AS pass_at_k FROM (SELECT cat, task, count(*) AS n, count(*) FILTER (passed) AS c FROM {_TASKS} GROUP BY cat, task), (VALUES (1), (3)) AS ks(k) WHERE n >= k GROUP BY cat, k")
def _(spark, sf):
    return scores.pass_at_k(_tasks(spark, sf), [1, 3], by="cat").withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("best_at_k", "SELECT k, round(avg(best), 6) AS best_at_k FROM (SELECT k, conv_id, max(score) AS best FROM (SELECT conv_id, length(text)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), (VALUES (1), (2), (4)) AS ks(k) WHERE r <= k GROUP BY k, conv_id) GROUP BY k")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("score", F.char_length("text").cast("double"))
    return scores.best_at_k(c, [1, 2, 4], "conv_id", "turn", "score").withColumn("best_at_k", F.round("best_at_k", 6))


_PRED = "(SELECT quality AS y, (doc_id % 7) * 0.25 AS p FROM labels)"


def _predicted(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 7) * 0.25).cast("double").alias("p"))


@query("regression_metrics", f"SELECT count(*)::BIGINT AS n, round(avg((p::DOUBLE - y) * (p::DOUBLE - y)), 6) AS mse, round(avg(CASE WHEN greatest(0, least(1, round_even(p::DOUBLE, 0))) = y THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM {_PRED}")
def _(spark, sf):
    m = scores.regression_metrics(_predicted(spark, sf), "p", "y", 2)
    return m.select("n", F.round("mse", 6).alias("mse"), F.round("accuracy", 6).alias("accuracy"))


@query("confusion", "WITH c AS (SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2), s AS (SELECT label AS x FROM c UNION SELECT predicted FROM c), e AS (SELECT a.x AS label, b.x AS predicted FROM s a, s b) SELECT e.label, e.predicted, coalesce(n, 0)::BIGINT AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY e.label), 0), 0), 6)::DOUBLE AS share FROM e LEFT JOIN c ON e.label = c.label AND e.predicted = c.predicted")
def _(spark, sf):
    return scores.confusion(table(spark, sf, "labels"), "quality", "toxic").withColumn("share", F.round("share", 6))


@query("precision_recall", "WITH l AS (SELECT quality AS y, toxic AS p FROM labels) SELECT c.x AS class, round((count(*) FILTER (y = x AND p = x))::DOUBLE / nullif(count(*) FILTER (p = x), 0), 6) AS precision, round((count(*) FILTER (y = x AND p = x))::DOUBLE / nullif(count(*) FILTER (y = x), 0), 6) AS recall FROM l, (SELECT DISTINCT y AS x FROM l UNION SELECT DISTINCT p FROM l) c GROUP BY c.x")
def _(spark, sf):
    out = scores.precision_recall(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("first_fail_prefix", "SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM conversations) WHERE f = 0")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ok", F.char_length("text") % 3 != 0)
    return scores.until_first_failure(c, "conv_id", "turn", "ok").select("conv_id", "turn")


@query("token_budget", "SELECT conv_id, turn, running::BIGINT AS running FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM conversations) WHERE running <= 400")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("cost", F.char_length("text"))
    return scores.within_budget(c, "conv_id", "turn", "cost", 400).select("conv_id", "turn", "running")


@query("keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("every_passed", "SELECT conv_id AS id, bool_and(length(text) > 20) AS accepted FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), (F.char_length("text") > 20).alias("passed"))
    return scores.accepted(c)


@query("diff_ratio", "SELECT id, n AS abs_diff, CASE WHEN length(t) = 0 THEN NULL ELSE n::DOUBLE / length(t) END AS rel_diff FROM (VALUES (1, 4, 'abcdefgh'), (2, 2, ''), (3, 0, 'x')) AS v(id, n, t)")
def _(spark, sf):
    v = spark.sql("SELECT id, array_repeat('l', n) AS d, t FROM (VALUES (1, 4, 'abcdefgh'), (2, 2, ''), (3, 0, 'x')) AS v(id, n, t)")
    a, r = formatting.diff_sizes(F.col("d"), F.col("t"))
    return v.select("id", a.alias("abs_diff"), r.alias("rel_diff"))


_RUNS = "(VALUES (1, 'Finished', 0, 'TimeLimitExceeded', NULL), (2, NULL, NULL, 'Error', NULL), (3, NULL, NULL, NULL, NULL), (4, 'Finished', 1, NULL, NULL), (5, 'Finished', 0, 'Finished', 0), (6, NULL, NULL, 'Finished', 3), (7, 'TimeLimitExceeded', NULL, NULL, NULL)) AS v(id, cs, cr, rs, rr)"
_STATUS = "CASE WHEN cs = 'Error' OR rs = 'Error' THEN 'SandboxError' WHEN cs = 'TimeLimitExceeded' OR rs = 'TimeLimitExceeded' THEN 'Failed' WHEN cr <> 0 OR rr <> 0 THEN 'Failed' ELSE 'Success' END"


def _runs(spark):
    v = spark.sql(f"SELECT * FROM {_RUNS}")
    side = lambda s, r: F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("status"), F.col(r).alias("return_code"), F.lit("").alias("stderr")))
    return v.withColumn("c", side("cs", "cr")).withColumn("r", side("rs", "rr")).withColumn("status", scores.run_status(F.col("c"), F.col("r")))


@query("run_status", f"SELECT id, {_STATUS} AS status FROM {_RUNS}")
def _(spark, sf):
    return _runs(spark).select("id", "status")


@query("summary_status", f"SELECT id, CASE WHEN s <> 'Failed' THEN s WHEN cs = 'TimeLimitExceeded' THEN 'CompileTimeout' WHEN cs = 'Finished' AND cr <> 0 THEN 'CompileFailed' WHEN rs = 'TimeLimitExceeded' THEN 'RunTimeout' WHEN rs = 'Finished' AND rr <> 0 THEN 'RunFailed' ELSE 'Failed' END AS summary FROM (SELECT *, {_STATUS} AS s FROM {_RUNS})")
def _(spark, sf):
    return _runs(spark).select("id", scores.summary_status(F.col("status"), F.col("c"), F.col("r")).alias("summary"))


_JEST = '{"testResults":[{"name":"s1","assertionResults":[{"ancestorTitles":["a","b"],"title":"t1","status":"passed","failureMessages":[]},{"ancestorTitles":[],"title":"t2","status":"failed","failureMessages":["x","y"]}]}]}'


@query("jest_cases", f"SELECT c->>'title' AS title, array_to_string((c->'ancestorTitles')::VARCHAR[], ' > ') AS describe, c->>'status' = 'passed' AS passed, array_to_string((c->'failureMessages')::VARCHAR[], chr(10)) AS message FROM (SELECT unnest((x->'assertionResults')::JSON[]) AS c FROM (SELECT unnest(('{_JEST}'::JSON->'testResults')::JSON[]) AS x))")
def _(spark, sf):
    return scores.jest_cases(spark.createDataFrame([(_JEST,)], "report string"), "report").select("title", "describe", "passed", "message")


@query("submission_lookup", "SELECT l.doc_id AS id, coalesce(b.text, '') AS problem, CASE WHEN b.item_id IS NULL THEN 'unknown problem' END AS error FROM labels l LEFT JOIN benchmark b ON l.doc_id = b.item_id")
def _(spark, sf):
    s = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("problem"))
    return judge.attach(s, p).select("id", F.coalesce("problem", F.lit("")).alias("problem"), "error")


@query("grouping_sets", "SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def _(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("rank_window", "SELECT doc_id, rank() OVER (PARTITION BY lang, source ORDER BY n_chars DESC)::INTEGER AS place, lag(doc_id) OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS before FROM documents")
def _(spark, sf):
    by = Window.partitionBy("lang", "source")
    return table(spark, sf, "documents").select("doc_id", F.rank().over(by.orderBy(F.desc("n_chars"))).alias("place"), F.lag("doc_id").over(by.orderBy(F.desc("n_chars"), "doc_id")).alias("before"))


# --- readers and writers, through the shared folder ---------------------------------------------------------------------
def _folder(spark, name: str) -> str:
    return f"{S.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@query("json_lines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = _folder(spark, "json")
    S.write_json(table(spark, sf, "documents"), path)
    return S.read_json(spark, path, _DOCS)


@query("json_gzip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = _folder(spark, "gzip")
    table(spark, sf, "documents").write.option("compression", "gzip").json(path)
    return S.read_json(spark, path, _DOCS)


@query("json_array", "SELECT item_id, text FROM benchmark")
def _(spark, sf):
    path = _folder(spark, "array")
    S.write_json(table(spark, sf, "benchmark"), path, pretty_limit=100_000)
    return S.read_json(spark, path, "item_id long, text string", whole_file=True)


@query("seed_list", "SELECT (row_number() OVER (ORDER BY item_id) - 1)::INTEGER AS position, text AS seed FROM benchmark")
def _(spark, sf):
    path = _folder(spark, "seeds")
    seeds = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"])
    table(spark, sf, "benchmark").agg(F.to_json(seeds).alias("value")).coalesce(1).write.text(path)
    return S.read_seed_list(spark, path)


@query("language_folders", "SELECT lower(lang) AS folder, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def _(spark, sf):
    path = _folder(spark, "languages")
    S.write_by_language(S.renamed(table(spark, sf, "documents").where("lang IS NOT NULL")), path)
    return spark.read.parquet(path).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("unify", "SELECT text AS code, 0::BIGINT AS errors FROM documents UNION ALL SELECT text, 0 FROM benchmark")
def _(spark, sf):
    path = _folder(spark, "shards")
    for name in ("documents", "benchmark"):
        S.renamed(table(spark, sf, name)).write.parquet(f"{path}/{name}")
    found, errors = S.unify(spark, [f"{path}/documents", f"{path}/benchmark", f"{path}/missing"])
    return found.withColumn("errors", F.lit(len(errors) - 1).cast("long"))


@query("source_files", "SELECT split_part(f, '/', 1) AS file, n FROM (SELECT 'part' AS f, count(*)::BIGINT AS n FROM documents)")
def _(spark, sf):
    """A sorted glob with provenance."""
    path = _folder(spark, "glob")
    table(spark, sf, "documents").repartition(3, "doc_id").write.parquet(path)
    read = S.read_parquet(spark, f"{path}/*.parquet", provenance=True)
    return read.select(F.substring_index(F.substring_index("source_file", "/", -1), "-", 1).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


# --- streams ----------------------------------------------------------------------------------------------------------------
@query("event_sessions", """SELECT user_id, s AS started, count(*)::BIGINT AS n FROM (
  SELECT user_id, ts, max(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s""")
def _(spark, sf):
    return jobs.sessions(table(spark, sf, "events")).select("user_id", F.col("session_window.start").alias("started"), "n")


@query("event_stream_distinct", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    """Every event sent twice, as a stream that ends."""
    source, out = _folder(spark, "events"), _folder(spark, "distinct")
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.unionAll(events).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    jobs.distinct_events(stream, "400 days").writeStream.option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("event_id", "event_type")


@query("job_stream", "SELECT * FROM (VALUES ('a', 'Success', '7'), ('b', 'Success', '5'), ('c', 'Failed', '')) AS v(id, status, stdout)")
def _(spark, sf):
    source, out = _folder(spark, "jobs"), _folder(spark, "results")
    rows = [("a", "print(input())", "python", "7"), ("b", "echo $((2+3))", "bash", None), ("c", "raise SystemExit(3)", "python", None)]
    spark.createDataFrame(rows, "id string, code string, language string, stdin string").write.json(source)
    jobs.job_queue(spark, source, out, _folder(spark, "state"), workers=2).awaitTermination()
    return spark.read.parquet(out).select("id", "status", F.trim(F.regexp_replace("run_result.stdout", r"\s+$", "")).alias("stdout"))


# --- near duplicates -----------------------------------------------------------------------------------------------
P, B, R = 64, 8, 8
_SIGS = f"""g AS (SELECT doc_id, {_GRAMS} AS grams FROM (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z_0-9]') AS w FROM documents)),
h AS (SELECT doc_id, list_transform(grams, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM g),
s AS (SELECT doc_id, list_transform(range(0, {P}), lambda i: coalesce(list_min(list_transform(h, lambda v: (v * ((i * 1103515245 + 12345) % 1073741789 + 1) + (i * 69069 + 1) % 1073741789) % 2147483647)), 4294967295)) AS sig FROM h),
k AS (SELECT doc_id, b::INTEGER AS band, md5(array_to_string(sig[b * {R} + 1:b * {R} + {R}], ',')) AS bucket FROM s, unnest(range(0, {B})) AS t(b))"""
_EDGES = "e AS (SELECT DISTINCT doc_id AS a, m AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, bucket) AS m FROM k) WHERE doc_id <> m)"
_ROOTS = "u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, u.b FROM r JOIN u ON r.x = u.a), c AS (SELECT n AS doc_id, min(x) AS cluster FROM r GROUP BY n)"


def _banded(spark, sf):
    return dedup.bands(table(spark, sf, "documents"), "doc_id", "text", P, B, R)


@query("minhash_bands", f"WITH {_SIGS} SELECT * FROM k")
def _(spark, sf):
    return _banded(spark, sf)


@query("lsh_buckets", f"WITH {_SIGS} SELECT band, bucket, count(*)::BIGINT AS n, min(doc_id) AS root FROM k GROUP BY band, bucket HAVING count(*) > 1")
def _(spark, sf):
    return _banded(spark, sf).groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("root")).where("n > 1")


@query("lsh_edges", f"WITH {_SIGS}, {_EDGES} SELECT * FROM e")
def _(spark, sf):
    return dedup.star_edges(S.stored(_banded(spark, sf), "bands"), "doc_id")


@query("dup_components", f"WITH RECURSIVE {_SIGS}, {_EDGES}, {_ROOTS} SELECT * FROM c")
def _(spark, sf):
    edges = dedup.star_edges(S.stored(_banded(spark, sf), "bands"), "doc_id")
    roots = connected_components(edges, S.stored).withColumnRenamed("node", "doc_id")
    return table(spark, sf, "documents").select("doc_id").join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster"))


@query("near_dedup", f"WITH RECURSIVE {_SIGS}, {_EDGES}, {_ROOTS} SELECT doc_id, text, lang, source, n_chars FROM documents JOIN c USING (doc_id) WHERE cluster = doc_id")
def _(spark, sf):
    return dedup.near_dedup(table(spark, sf, "documents"), num_perm=P, threshold=0.7)


@query("exact_jaccard", f"WITH {_SIGS}, {_EDGES} SELECT e.a, e.b, round(coalesce(len(list_intersect(x.grams, y.grams))::DOUBLE / nullif(len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams)), 0), 0), 6) AS jaccard FROM e JOIN g x ON x.doc_id = e.a JOIN g y ON y.doc_id = e.b")
def _(spark, sf):
    edges = dedup.star_edges(S.stored(_banded(spark, sf), "bands"), "doc_id")
    return dedup.exact_jaccard(table(spark, sf, "documents"), edges).withColumn("jaccard", F.round("jaccard", 6))


_WIDE = 16


@query("minhash_wide", f"""WITH g AS (SELECT doc_id, {_GRAMS} AS grams FROM (SELECT doc_id, regexp_split_to_array(text, '[^A-Za-z_0-9]') AS w FROM documents)),
h AS (SELECT doc_id, list_transform(grams, lambda x: ('0x' || substr(sha1(x), 7, 2) || substr(sha1(x), 5, 2) || substr(sha1(x), 3, 2) || substr(sha1(x), 1, 2))::BIGINT) AS h FROM g),
p AS (SELECT list(((i::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616) % 2305843009213693950 + 1 ORDER BY i) AS a, list(((i::HUGEINT * 2862933555777941757 + 3037000493) % 18446744073709551616) % 2305843009213693951 ORDER BY i) AS b FROM range(0, {_WIDE}) AS t(i))
SELECT doc_id, list_transform(range(1, {_WIDE + 1}), lambda i: coalesce(list_min(list_transform(h, lambda v: ((((v::HUGEINT * a[i] + b[i]) % 18446744073709551616) % 2305843009213693951) % 4294967296)::BIGINT)), 4294967295)) AS signature FROM h, p""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dedup.wide_signatures(F.coalesce("text", F.lit("")), _WIDE).alias("signature"))


# The same at the production parameters, banding(0.7, 256). The twins above stay at 64, which SQL can follow on whole
# tables; these have none, a brute force tests them.
FULL_P, FULL_B, FULL_R = 256, 25, 10


def _full_banded(spark, sf):
    return dedup.bands(table(spark, sf, "documents"), "doc_id", "text", FULL_P, FULL_B, FULL_R)


@query("minhash_bands_256")
def _(spark, sf):
    return _full_banded(spark, sf)


@query("lsh_buckets_256")
def _(spark, sf):
    return _full_banded(spark, sf).groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("root")).where("n > 1")


@query("lsh_edges_256")
def _(spark, sf):
    return dedup.star_edges(S.stored(_full_banded(spark, sf), "bands"), "doc_id")


@query("dup_components_256")
def _(spark, sf):
    return dedup.clusters(table(spark, sf, "documents"), num_perm=FULL_P, threshold=0.7)


@query("near_dedup_256")
def _(spark, sf):
    return dedup.near_dedup(table(spark, sf, "documents"), num_perm=FULL_P, threshold=0.7)


@query("exact_jaccard_256")
def _(spark, sf):
    edges = dedup.star_edges(S.stored(_full_banded(spark, sf), "bands"), "doc_id")
    return dedup.exact_jaccard(table(spark, sf, "documents"), edges).withColumn("jaccard", F.round("jaccard", 6))


# --- operators that SQL cannot express: golden and property tests are their real check ----------------------------------
_SOURCES = fixture(
    """(1, 'a = b = c = 5~for i in range(a):~    print(i)'), (2, 'if a < b < c:~    x = 1~else:~    x = 2'), (3, 'def add(a, b):~    return a + b~'),
(4, 'for a, b in xs: print(a)'), (5, 'not python ('), (6, 'total = 0~for i in range(9):~    if i % 2:~        continue~    total += i~print(total)')""",
    "id",
    "t",
)


def _sources(spark):
    return spark.sql(f"SELECT * FROM {_SOURCES}")


def _rewrite(*names):
    return lambda spark, sf: _sources(spark).select("id", rewrite.rewritten(F.col("t"), *names).alias("code"))


for _name, _rewrites in {"rewrite_assign": ["assignment_unroll"], "rewrite_cond": ["condition_unroll"], "rewrite_for": ["for_to_while"], "rename_vars": ["randomize_var_names"], "rewrite_chain": ["assignment_unroll", "for_to_while"]}.items():
    query(_name)(_rewrite(*_rewrites))


@query("augment_records")
def _(spark, sf):
    rows = _sources(spark).select("id", F.struct(F.lit("rule").alias("style"), F.array("t").alias("ground_truth")).alias("reward_model"))
    return rewrite.augment(rows, ["assignment_unroll", "for_to_while"])


@query("code_metrics")
def _(spark, sf):
    m = _sources(spark).select("id", symbols.code_metrics(F.col("t")).alias("m"), T.line_metrics(F.col("t")).alias("l"))
    mi = T.maintainability(F.col("m.halstead.volume"), F.col("m.cc").cast("double"), F.col("l.loc").cast("double"))
    return m.select("id", "l.*", "m.*", mi.alias("mi"))


@query("symbol_table")
def _(spark, sf):
    return _sources(spark).select("id", F.explode(symbols.symbol_table(F.col("t"))).alias("s")).select("id", "s.*")


@query("rename_in_repo", "SELECT * FROM (VALUES ('r', 'a.py', 'total = 1' || chr(10) || 'print(total)'), ('r', 'b.py', 'x = (')) AS v(repo, path, code)")
def _(spark, sf):
    rows = [("r", "a.py", "count = 1\nprint(count)"), ("r", "b.py", "x = (")]
    return symbols.rename_in_repo(spark.createDataFrame(rows, "repo string, path string, code string"), "count", "total")


@query("mask_symbols")
def _(spark, sf):
    return _sources(spark).select("id", symbols.masked(F.col("t"), F.lit("a")).alias("code"))


@query("format_corpus")
def _(spark, sf):
    return formatting.format_corpus(_sources(spark).select(F.concat(F.lit("repo\n"), F.col("t")).alias("code")))


@query("transpile_status")
def _(spark, sf):
    return formatting.transpile(_sources(spark), "python", "go", "t")


@query("translate_status")
def _(spark, sf):
    return formatting.translate(_sources(spark), "python", "t")


@query("unified_diff")
def _(spark, sf):
    return _sources(spark).select("id", formatting.unified_diff(F.col("t"), rewrite.rewritten(F.col("t"), "assignment_unroll")).alias("diff"))


@query("freeform_extract")
def _(spark, sf):
    v1, v2 = (extraction.freeform(F.col("t"), "python", v).alias(f"v{v}") for v in (1, 2))
    return spark.sql(f"SELECT * FROM {_ANSWERS}").select("id", v1, v2)


@query("run_programs")
def _(spark, sf):
    jobs_ = spark.createDataFrame([("a", "print(input())", "python", "7"), ("b", "echo $((2+3))", "bash", None), ("c", "select 1", "sql", None), ("d", "raise SystemExit(3)", "python", None)], "id string, code string, language string, stdin string")
    return judge.run_code(jobs_).select("id", "status", "message", F.trim("run_result.stdout").alias("stdout"), "run_result.return_code")


@query("run_notebook")
def _(spark, sf):
    return judge.run_cells(spark.createDataFrame([("n", ["x = 2", "x * 21", "1 / 0"])], "id string, cells array<string>")).select("id", "status", F.expr("transform(results, r -> r.display)").alias("shown"), F.expr("transform(results, r -> r.error is not null)").alias("failed"))


@query("judge_stdio")
def _(spark, sf):
    cases = "array<struct<input:string,output:string>>"
    rows = [(1, "```python\nprint(int(input()) * 2)\n```", [("2", "4"), ("5", "10")]), (2, "```python\nprint(input())\n```", [("2", "4"), ("5", "5")])]
    return judge.judge_stdio(spark.createDataFrame(rows, f"id int, completion string, test {cases}"), "python")


@query("judge_contest")
def _(spark, sf):
    cases = "array<struct<input:string,output:string>>"
    rows = [(1, "```python\nclass Solution:\n    def twice(self, x):\n        return 2 * x\n```", [("2", "4")]), (2, "```python\ndef twice(x):\n    return x\n```", [("2", "4")])]
    return judge.judge_contest(spark.createDataFrame(rows, f"id int, completion string, test {cases}"), fn_name="twice")


@query("judge_asserts")
def _(spark, sf):
    rows = [(1, "def f(x):\n    return x + 1", ["assert f(1) == 2"]), (2, "def f(x):\n    return x", ["assert f(1) == 2"])]
    df = spark.createDataFrame(rows, "id int, code string, tests array<string>")
    return judge.judge_programs(df, judge.assert_program(F.lit(""), F.col("code"), F.col("tests")), "python").select("id", "accepted")


@query("judge_predictions")
def _(spark, sf):
    rows = [(1, "def f(x):\n    return x * 2", "3", "6", "[ANSWER]6[/ANSWER]"), (2, "def f(x):\n    return x * 2", "3", "6", "7")]
    df = spark.createDataFrame(rows, "id int, code string, given string, expected string, completion string")
    program = judge.prediction_program(F.col("code"), F.col("given"), F.col("expected"), judge.answer_part(F.col("completion")), "output")
    return judge.judge_programs(df, program, "python").select("id", "accepted")


# --- submissions: inline problems, the verdicts written out ----------------------------------------------------------------
def _verdicts(*rows: tuple) -> str:
    shown = ", ".join(f"({i}, {str(ok).lower()}, {'NULL' if error is None else repr(error)})" for i, ok, error in rows)
    return f"SELECT id::INTEGER AS id, accepted::BOOLEAN AS accepted, error::VARCHAR AS error FROM (VALUES {shown}) AS v(id, accepted, error)"


def _submit(spark, name: str, problems: list, schema: str, completions: list, config: dict | None = None) -> DataFrame:
    given = spark.createDataFrame(completions, "id int, completion string")
    return submission.submit(given, spark.createDataFrame(problems, schema), name, config).select("id", "accepted", "error")


_NONE = "unknown problem"
_FUNCTION = [(1, "def add(a, b):\n", "def check(f):\n    assert f(1, 2) == 3\n", "add"), (2, "def half(x):\n    \"\"\"Half of x.\"\"\"\n", "def check(f):\n    assert f(4) == math.floor(2.5)\n", "half")]


@query("submit_functions", _verdicts((1, True, None), (1, False, None), (2, True, None), (7, False, _NONE)))
def _(spark, sf):
    done = [(1, "    return a + b\nprint(add)\n"), (1, "    return a - b\n"), (2, "    return x // 2\n\ndef other():\n    pass\n"), (7, "    pass")]
    return _submit(spark, "HumanEvalDataset", _FUNCTION, "id int, prompt string, test string, entry_point string", done)


@query("submit_functions_freeform", _verdicts((1, True, None), (1, False, None), (2, False, None)))
def _(spark, sf):
    done = [(1, "Sure:\n```python\ndef add(a, b):\n    return a + b\n```"), (1, "I can't."), (2, None)]
    return _submit(spark, "HumanEvalDataset", _FUNCTION, "id int, prompt string, test string, entry_point string", done, {"is_freeform": True})


_CRUX = [(1, "def f(x):\n    return x + x", "'ab'", "'abab'"), (2, "def f(n):\n    return n * n", "3", "9")]


@query("submit_inputs", _verdicts((1, True, None), (1, False, None), (2, True, None), (2, False, None)))
def _(spark, sf):
    done = [(1, "thinking [ANSWER] f('ab') [/ANSWER] f('c')"), (1, "f('b')"), (2, "assert f(-3) == 9"), (2, None)]
    return _submit(spark, "CruxEvalDataset", _CRUX, "id int, code string, input string, output string", done, {"mode": "input"})


@query("submit_outputs", _verdicts((1, True, None), (1, True, None), (2, False, None), (9, False, _NONE)))
def _(spark, sf):
    done = [(1, "[ANSWER]'abab'[/ANSWER]"), (1, "assert f('ab') == 'abab'"), (2, "6"), (9, "9")]
    return _submit(spark, "CruxEvalDataset", _CRUX, "id int, code string, input string, output string", done, {"mode": "output"})


@query("submit_asserts", _verdicts((1, True, None), (1, False, None), (1, True, None)))
def _(spark, sf):
    problems = [(1, "Double x.", "import math", ["assert twice(2) == 4", "assert twice(math.floor(1.5)) == 2"])]
    done = [(1, "def twice(x):\n    return 2 * x\n[DONE]\nnothing"), (1, "def twice(x):\n    return 4\n"), (1, "```python\ndef twice(x):\n    return x + x\n```\nif __name__ == 1: raise")]
    return _submit(spark, "MBPPDataset", problems, "id int, content string, test_setup_code string, test_list array<string>", done)


@query("submit_asserts_fewshot", _verdicts((1, True, None)))
def _(spark, sf):
    problems = [(1, "Double x.", None, ["assert twice(2) == 5", "assert twice(1) == 2"])]
    return _submit(spark, "MBPPDataset", problems, "id int, content string, test_setup_code string, test_list array<string>", [(1, "def twice(x):\n    return 2 * x")], {"is_fewshot": True})


@query("submit_translations", _verdicts((1, True, None), (1, False, None), (1, False, None), (1, False, None)))
def _(spark, sf):
    problems = [(1, "Double x.", "#<INSERT>\nassert twice(2) == 4")]
    done = [(1, "```python\ndef twice(x):\n    return 2 * x\n\nif __name__ == '__main__':\n    raise ValueError\n```"), (1, "```python\ndef twice(x):\n    return 4\n\nexit(0)\n```"), (1, "```java\nint x;\n```"), (1, "```python\ndef twice(x):\n    return x\n```")]
    return _submit(spark, "MBXPDataset", problems, "id int, content string, test string", done, {"language": "python"})


_DOCSTRINGS = [(1, 'def one():\n    """Gives 1. """', "assert one() == 1\nassert one() != 2", "easy"), (2, 'def two():\n    """Gives 2. """', "assert two() == 2", "hard")]


@query("submit_docstrings", _verdicts((1, True, None), (1, False, None), (2, True, None)))
def _(spark, sf):
    done = [(1, "```python\ndef one():\n    return 1\n```"), (1, "```python\ndef one():\n    return 2\n```"), (2, "    return 2\n")]
    return _submit(spark, "MHPPDataset", _DOCSTRINGS, "id int, content string, test string, level string", done)


@query("submission_metrics", "SELECT * FROM (VALUES ('easy', 1::INTEGER, 0.5::DOUBLE), ('easy', 2, 1.0), ('hard', 1, 1.0), ('hard', 2, 1.0)) AS v(level, k, pass_at_k)")
def _(spark, sf):
    results = spark.createDataFrame([(1, "easy", True), (1, "easy", False), (2, "hard", True), (2, "hard", True)], "id int, level string, accepted boolean")
    return submission.metrics(results, "MHPPDataset", 2, [1, 2, 5], "level")


@query("submit_tests", _verdicts((1, True, None), (1, False, None), (1, False, None)))
def _(spark, sf):
    problems = [(1, "One.", "assert one() == 1")]
    done = [(1, "```python\ndef one():\n    return 1\nif __name__ == \"__main__\":\n    raise ValueError\n```"), (1, "```python\ndef one():\n    return 1\n\nraise SystemExit(0)\n```"), (1, "```python\ndef one():\n    return 2\n```")]
    return _submit(spark, "AutoEvalDataset", problems, "id int, content string, test string", done, {"append_flag": True})


@query("submit_pytest", _verdicts((1, True, None), (1, False, None)))
def _(spark, sf):
    problems = [(1, "One.", "def test_one():\n    assert one() == 1\n")]
    done = [(1, "<code>\ndef one():\n    return 1\n</code>"), (1, "```python\ndef one():\n    return 2\n```")]
    return _submit(spark, "NaturalCodeBenchDataset", problems, "id int, content string, test string", done)


@query("submit_math", _verdicts((1, True, None), (1, False, None), (1, False, None)))
def _(spark, sf):
    done = [(1, "```python\ndef solution():\n    return 1 / 3 * 3\n```"), (1, "```python\ndef solution():\n    return 2\n```"), (1, "It is 1.")]
    return _submit(spark, "PalMathDataset", [(1, "What is 3 thirds?", "1")], "id int, content string, answer string", done)


@query("submit_next_lines", _verdicts((1, True, None), (1, False, None)))
def _(spark, sf):
    return _submit(spark, "RepobenchCDataset", [(1, "x = 1", "y  =  x + 1")], "id int, content string, next_line string", [(1, "# next\ny = x + 1\nz = 3"), (1, "z = 3")])


@query("submit_stdio", _verdicts((1, True, None), (1, False, None), (3, False, _NONE)))
def _(spark, sf):
    done = [(1, "```python\nprint(int(input()) * 2)\n```"), (1, "```python\nprint(input())\n```"), (3, "")]
    return _submit(spark, "CommonOJDataset", [(1, "Double it.", [("2", "4"), ("5", "10")])], "id int, content string, test array<struct<input:string,output:string>>", done, {"language": "python"})


@query("prompts_functions", "SELECT item_id AS id, '```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Please complete the above code according to the requirements in the docstring. Write the complete code and wrap it in markdown syntax. The code should not contain `Main` function.' AS prompt FROM benchmark")
def _(spark, sf):
    problems = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"), F.lit("").alias("test"))
    return submission.prompts(problems, "HumanEvalDataset", {"is_freeform": True}).select("id", "prompt")


@query("prompts_asserts", "SELECT item_id AS id, 'You are an expert Python programmer, and here is your task: ' || text || ' Your code should pass these tests:' || chr(10) || chr(10) || 'assert f()' || chr(10) || 'assert g()' AS prompt FROM benchmark")
def _(spark, sf):
    problems = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"), F.array(F.lit("assert f()"), F.lit("assert g()")).alias("test_list"))
    return submission.prompts(problems, "MBPPDataset").select("id", "prompt")


_Q = '"' * 3


@query("prompt_docstring", f"SELECT id, array_to_string(list_slice(string_split(content, '{_Q}'), 1, -2), '{_Q}') || chr(10) || '    e.g. ' || split_part(test, chr(10), 1) || ' {_Q}' AS prompt FROM (SELECT 1::INTEGER AS id, 'def one():' || chr(10) || '    {_Q}Gives 1. {_Q}' AS content, 'assert one() == 1' || chr(10) || 'assert one() != 2' AS test)")
def _(spark, sf):
    return submission.prompt_by_id(spark.createDataFrame(_DOCSTRINGS, "id int, content string, test string, level string"), "MHPPDataset", 1).select("id", "prompt")


@query("next_line")
def _(spark, sf):
    df = spark.createDataFrame([(1, "# c\n\nx  =  1\ny", "x = 1"), (2, '"""doc"""\nz', "z"), (3, "a = 2", "a = 3")], "id int, completion string, expected string")
    return df.select("id", judge.next_line_verdict(F.col("completion"), F.col("expected")).alias("accepted"))


@query("retrieval_prompt")
def _(spark, sf):
    return judge.retrieval_prompt(table(spark, sf, "conversations"), "conv_id", "turn", "text", 200)


@query("run_tests")
def _(spark, sf):
    rows = [(1, "def f(x):\n    return x + 1\n", "from file import f\ndef test_f():\n    assert f(1) == 2\n"), (2, "def f(x):\n    return x\n", "from file import f\ndef test_f():\n    assert f(1) == 2\n")]
    return judge.run_tests(spark.createDataFrame(rows, "id int, code string, tests string")).select("id", "coverage", "exit_code")


@query("annotate_stub", "SELECT doc_id, (('0x' || substr(md5('Rate the quality of this code from 0 to 9. Answer with one digit.' || chr(10) || substr(text, 1, 32000)), 1, 8))::BIGINT % 10)::VARCHAR AS score FROM documents")
def _(spark, sf):
    return A.annotate(table(spark, sf, "documents"), "quality", "text").select("doc_id", "score")


@query("synthesize")
def _(spark, sf):
    return A.synthesize(table(spark, sf, "benchmark").select(F.col("text").alias("seed")), "similar", n=2)


@query("embedding_regressor")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    _, predict = A.fit_regressor(e, "embedding", "label")
    return predict(e).select("vec_id", F.round("predicted", 4).alias("predicted"))


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    w = jobs.event_windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
