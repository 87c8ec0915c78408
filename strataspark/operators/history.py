"""Change logs, runs and comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_days


def churn(log: DataFrame, as_of: Column) -> DataFrame:
    """path, churn, authors, author_list, last_modified, age_days from rows (path, commit, author, ts)."""
    return log.groupBy("path").agg(
        F.countDistinct("commit").alias("churn"), F.countDistinct("author").alias("authors"),
        F.array_join(F.sort_array(F.collect_set("author")).cast("array<string>"), ",").alias("author_list"), F.max("ts").alias("last_modified"),
    ).withColumn("age_days", age_days(F.col("last_modified"), as_of))


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("active_authors"), F.min("ts").alias("since"), F.max("ts").alias("until"))


def weekly(log: DataFrame) -> DataFrame:
    """Commits by week, Mondays first."""
    return log.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.countDistinct("commit").alias("commits"))


def authors(churned: DataFrame, log: DataFrame) -> DataFrame:
    """author, files changed and the churn of the files touched."""
    touched = log.select("author", "path").distinct().join(churned.select("path", "churn"), "path")
    return touched.groupBy("author").agg(F.count("*").alias("files"), F.sum("churn").alias("churn"))


def hotspots(churned: DataFrame, cc: DataFrame, n: int) -> DataFrame:
    """The files of highest churn times complexity; files with neither are left out."""
    from .rollup import frequency

    both = churned.select("path", "churn").join(cc.select("path", "cc"), "path", "full").na.fill(0, ["churn", "cc"])
    scored = frequency(both, "churn").where("churn > 0 or cc > 0").withColumn("score", F.col("churn") * F.col("cc"))
    return scored.orderBy(F.desc("score"), F.desc("churn"), "path").limit(n)


def direction(delta: Column, better: Column) -> tuple[Column, Column]:
    """(up, down or sideways; whether that is better, null where neither is)"""
    way = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("sideways")
    good = F.when((delta == 0) | ~better.isin("high", "low"), F.lit(None).cast("boolean")).otherwise(F.when(better == "high", delta > 0).otherwise(delta < 0))
    return way, good


def run_deltas(series: DataFrame) -> DataFrame:
    """metric, run, value, delta to the run before, direction, is_better; from (metric, run, value, better)."""
    w = Window.partitionBy("metric").orderBy("run")
    d = F.round(F.col("value") - F.lag("value").over(w), 2)
    out = series.withColumn("delta", d)
    way, good = direction(F.col("delta"), F.col("better"))
    return out.withColumns({"direction": F.when(F.col("delta").isNotNull(), way), "is_better": good})


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, improvement (delta with the sign of what is better, 0 where neither is)."""
    a = before.select("metric", F.col("value").alias("before"), F.col("better").alias("_a"))
    b = after.select("metric", F.col("value").alias("after"), F.col("better").alias("_b"))
    out = a.join(b, "metric", "full").withColumn("delta", F.round(F.col("after") - F.col("before"), 2))
    better = F.coalesce("_a", "_b")
    return out.withColumn("improvement", F.when(better == "low", -F.col("delta")).when(better == "high", F.col("delta")).otherwise(F.lit(0.0))).drop("_a", "_b")


SIGNATURE = ["entity", "message", "level"]


def new_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """Problems of ``after`` whose signature ``before`` lacks; duplicates stay."""
    return after.join(before.select(*SIGNATURE).distinct(), SIGNATURE, "left_anti")


def problem_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """New and resolved problems, with a column change."""
    return new_problems(before, after).withColumn("change", F.lit("new")).unionByName(new_problems(after, before).withColumn("change", F.lit("resolved")))


def check_baseline(baseline: DataFrame, now: DataFrame) -> tuple[int, int, bool]:
    """(new, resolved, failed): failed if any new problem is an error."""
    r = problem_changes(baseline, now).agg(F.count_if(F.col("change") == "new"), F.count_if(F.col("change") == "resolved"), F.count_if((F.col("change") == "new") & (F.col("level") == "ERROR"))).first()
    return r[0], r[1], r[2] > 0


def compare_levels(before: DataFrame, after: DataFrame) -> DataFrame:
    from .rules import by_level

    a, b = by_level(before).withColumnRenamed("n", "before"), by_level(after).withColumnRenamed("n", "after")
    return a.join(b, "level", "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))
