"""Aggregates: pass@k, best@k, error and accuracy, confusion, prefix rules, status algebra, test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k_value(n: Column, c: Column, k: Column) -> Column:
    """1 where n - c < k, else 1 minus the product of 1 - k / i for i from n - c + 1 to n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - k / i))
    # sequence() counts down where its end is below its start: no success, no factor
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1 - product)


def pass_at_k(results: DataFrame, ks: list[int], task: str = "task", passed: str = "passed", n: int | None = None, by: str | None = None) -> DataFrame:
    """([by,] k, pass_at_k): mean over tasks. n is what the caller says each task was tried, or else counted;
    tasks tried fewer than k times are left out."""
    keys = [by] if by else []
    per = results.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col(passed)).alias("c"))
    per = per.withColumn("n", F.lit(n).cast("long") if n else F.col("tries"))
    each = per.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n >= k")
    return each.groupBy(*keys, "k").agg(F.avg(pass_at_k_value(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"))


def best_at_k(scores: DataFrame, ks: list[int], example: str, order: str, score: str) -> DataFrame:
    """(k, best_at_k): mean over examples of the best score among the first k candidates."""
    rank = Window.partitionBy(example).orderBy(order)
    ranked = scores.withColumn("_r", F.row_number().over(rank))
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("_r <= k")
    return each.groupBy("k", example).agg(F.max(score).alias("best")).groupBy("k").agg(F.avg("best").alias("best_at_k"))


def regression_metrics(df: DataFrame, predicted: str, label: str, classes: int) -> DataFrame:
    """(n, mse, accuracy); predictions are rounded half to even and clipped for accuracy."""
    p, y = F.col(predicted), F.col(label)
    hit = (F.greatest(F.lit(0.0), F.least(F.lit(classes - 1.0), F.rint(p))) == y).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("mse"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n, share) over all classes seen in either column; share is of the label's rows."""
    pairs = df.select(F.col(label).alias("label"), F.col(predicted).alias("predicted"))
    counts = pairs.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(F.explode(F.array("label", "predicted")).alias("c")).distinct()
    # classes squared, a handful; made by an explode of the collected set, not by a join without keys
    every = seen.agg(F.sort_array(F.collect_set("c")).alias("cs")).select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("predicted"))
    dense = every.join(counts, ["label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("label"))
    return dense.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), total.cast("double")), F.lit(0.0)))


def precision_recall(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall)."""
    c = confusion(df, label, predicted)
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    p = c.groupBy(F.col("predicted").alias("class")).agg(F.try_divide(right.cast("double"), F.sum("n").cast("double")).alias("precision"))
    r = c.groupBy(F.col("label").alias("class")).agg(F.try_divide(right.cast("double"), F.sum("n").cast("double")).alias("recall"))
    return p.join(r, "class")


def until_first_failure(df: DataFrame, group: str, order: str, passed: str) -> DataFrame:
    """Rows up to and with each group's first failure."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_f", F.coalesce(F.sum(F.when(F.col(passed), 0).otherwise(1)).over(before), F.lit(0))).where("_f = 0").drop("_f")


def within_budget(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows in order while their running cost stays within the budget; the first that doesn't fit ends it."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(cost).over(upto)).where(F.col("running") <= budget)


def keep_first(df: DataFrame, group: list[str], order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where("_r = 1").drop("_r")


def accepted(tests: DataFrame, submission: str = "id", passed: str = "passed") -> DataFrame:
    return tests.groupBy(submission).agg(F.every(F.col(passed)).alias("accepted"))


# --- status algebra ------------------------------------------------------------------------------------------------
def run_status(compile_result: Column, run_result: Column) -> Column:
    """SandboxError if a command failed to run, Failed on a time limit or a return code, else Success."""
    both = (compile_result, run_result)
    is_ = lambda s: sum((F.coalesce((r["status"] == s).cast("int"), F.lit(0)) for r in both), F.lit(0)) > 0
    bad = sum((F.coalesce((r["return_code"] != 0).cast("int"), F.lit(0)) for r in both), F.lit(0)) > 0
    return F.when(is_("Error"), "SandboxError").when(is_("TimeLimitExceeded"), "Failed").when(bad, "Failed").otherwise("Success")


def run_message(compile_result: Column, run_result: Column) -> Column:
    return F.coalesce(F.when(compile_result["status"] == "Error", compile_result["stderr"]), F.when(run_result["status"] == "Error", run_result["stderr"]), F.lit(""))


def summary_status(status: Column, compile_result: Column, run_result: Column) -> Column:
    """Where a Failed run failed: compiling or running, by time or by return code."""
    done = lambda r, s: F.coalesce(r["status"] == s, F.lit(False))
    bad = lambda r: F.coalesce((r["status"] == "Finished") & (r["return_code"] != 0), F.lit(False))
    return (
        F.when(status != "Failed", status)
        .when(done(compile_result, "TimeLimitExceeded"), "CompileTimeout")
        .when(bad(compile_result), "CompileFailed")
        .when(done(run_result, "TimeLimitExceeded"), "RunTimeout")
        .when(bad(run_result), "RunFailed")
        .otherwise("Failed")
    )


JEST = "testResults array<struct<name:string,assertionResults:array<struct<ancestorTitles:array<string>,title:string,fullName:string,status:string,duration:double,failureMessages:array<string>>>>>"


def jest_cases(df: DataFrame, report: str) -> DataFrame:
    """One row a test case of a jest JSON report."""
    suites = df.withColumn("_j", F.from_json(report, JEST)).select("*", F.explode("_j.testResults").alias("_s"))
    cases = suites.select("*", F.explode("_s.assertionResults").alias("_c"))
    return cases.select(
        *[c for c in df.columns if c != report],
        F.col("_s.name").alias("suite"),
        F.array_join("_c.ancestorTitles", " > ").alias("describe"),
        F.col("_c.title").alias("title"),
        (F.col("_c.status") == "passed").alias("passed"),
        F.col("_c.duration").alias("duration"),
        F.array_join("_c.failureMessages", "\n").alias("message"),
    )


def seed_multisets(df: DataFrame, key: str, size: int, limit: int, seed: int = 42) -> DataFrame:
    """``limit`` distinct sorted multisets of ``size`` keys, by hash order; fewer where there are no more. Sets grow by a
    join on keys no smaller than their last one."""
    keys = df.select(F.col(key).alias("k")).distinct()
    sets = keys.select(F.array("k").alias("members"), F.col("k").alias("last"))
    for _ in range(size - 1):
        sets = sets.join(keys, F.col("k") >= F.col("last")).select(F.concat("members", F.array("k")).alias("members"), F.col("k").alias("last"))
    text = F.array_join(F.transform("members", lambda x: x.cast("string")), ",")
    return sets.select("members").orderBy(F.md5(F.concat(text, F.lit(f":{seed}")).cast("binary")), text).limit(limit)


def difficulty(results: Column) -> Column:
    """The category of a problem's results: the first one's difficulty."""
    return F.get_json_object(results, "$[0].test_info.difficulty_type")


def category_of_id(key: Column) -> Column:
    """The category that an id names between its marks; null without them."""
    found = F.regexp_extract(key, "EvoEval_(.*)_EvoEval", 1)
    return F.when(found != "", found)
