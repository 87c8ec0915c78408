"""Project roll-ups: totals, averages, extremes, and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limits(df: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """entity, metric, min, max, avg of each key; what is missing counts as 0, and no maximum is below 0."""
    aggs = []
    for k in keys:
        v = F.coalesce(F.col(k).cast("double"), F.lit(0.0))
        aggs.append(F.struct(F.lit(k).alias("metric"), F.min(v).alias("lo"), F.greatest(F.max(v), F.lit(0.0)).alias("hi"), F.avg(v).alias("mean")).alias(f"_{k}"))
    one = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{k}") for k in keys])).alias("m"))
    return one.select(F.lit(entity).alias("entity"), "m.metric", "m.lo", "m.hi", "m.mean")


def most(df: DataFrame, entity: str, name: str, value: str) -> DataFrame:
    """entity, the names with the highest value (joined, in order) and the value; '-' for an empty table.

    Two aggregates instead of a ranking: nothing is sorted and no window holds the table.
    """
    top = df.agg(F.max(value).alias("_top"))
    named = df.join(F.broadcast(top), F.col(value) == F.col("_top"))
    return named.agg(F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list(F.col(name))).cast("array<string>"), ", "), F.lit("")), F.lit("-")).alias("names"), F.max(value).alias("top")).select(F.lit(entity).alias("entity"), "names", "top")


def above_average(df: DataFrame, group: str, value: str, factor: float) -> DataFrame:
    """Rows whose value is over ``factor`` times their group's average; averages are joined, not windowed."""
    mean = df.groupBy(group).agg(F.avg(F.coalesce(value, F.lit(0))).alias("_mean"))
    return df.join(mean, group).where(F.col(value) > F.col("_mean") * factor)


def top(df: DataFrame, by: str, name: str, n: int, descending: bool = True) -> DataFrame:
    return df.orderBy(F.desc(by) if descending else F.asc(by), F.asc(name)).limit(n)


def frequency(df: DataFrame, value: str) -> DataFrame:
    """frequency: the value relative to the largest (at least 1), three decimals."""
    m = df.agg(F.greatest(F.max(value), F.lit(1)).alias("_m"))
    return df.join(F.broadcast(m)).withColumn("frequency", F.round(F.col(value) / F.col("_m"), 3)).drop("_m")


def first_by_priority(candidates: DataFrame, key: str, priority: str = "prio") -> DataFrame:
    """All candidates of each key's best priority."""
    w = Window.partitionBy(key).orderBy(priority)
    return candidates.withColumn("_r", F.dense_rank().over(w)).where("_r = 1").drop("_r")


def common_prefix(paths: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """One row: the longest run of leading segments that all paths share.

    One aggregate over segments: at most as many groups as the deepest path has
    segments reach the last step.
    """
    parts = paths.select(F.posexplode(F.split(path, separator)).alias("i", "s"))
    level = parts.groupBy("i").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    total = paths.where(F.col(path).isNotNull()).agg(F.count("*").alias("total"))
    same = level.join(F.broadcast(total)).select("i", "lo", ((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("total"))).alias("same"))
    cut = same.agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("i"))), F.max("i") + 1).alias("cut"))
    shared = same.join(F.broadcast(cut)).where("i < cut")
    return shared.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "lo"))), lambda x: x.lo), separator).alias("common_path"))
