"""Run history and baselines: append-only JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "date string, digest string, data map<string,double>"
BASELINE = "entity string, message string, level string"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def last_run(history: DataFrame) -> DataFrame:
    """The latest run, without a sort of all runs."""
    return history.agg(F.max_by(F.struct("date", "digest", "data"), "date").alias("r")).where("r is not null").select("r.*")


def append_run(project: DataFrame, path: str, *, date: str) -> bool:
    """Append a project row as a run unless its data equals that of the last run; whether it was appended."""
    spark = project.sparkSession
    data = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("double")) for c in sorted(project.columns)]))
    run = project.select(F.lit(date).alias("date"), F.md5(F.to_json(data)).alias("digest"), data.alias("data"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        last = last_run(read_history(spark, path)).first()
        if last and last.digest == run.first().digest:
            return False
    run.write.mode("append").json(path)
    return True


def trend(history: DataFrame, keys: list[str]) -> DataFrame:
    return history.select("date", *[F.element_at("data", F.lit(k)).alias(k) for k in keys]).orderBy("date")


def history_series(history: DataFrame, better: dict[str, str]) -> DataFrame:
    """metric, run, value, better: the input of run-to-run deltas."""
    e = history.select(F.col("date").alias("run"), F.explode("data").alias("metric", "value"))
    known = F.create_map(*[F.lit(x) for p in better.items() for x in p]) if better else F.create_map().cast("map<string,string>")
    return e.withColumn("better", F.coalesce(F.element_at(known, F.col("metric")), F.lit("none")))


def write_baseline(problems: DataFrame, path: str) -> None:
    problems.select(F.col("entity").cast("string").alias("entity"), "message", "level").write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE).json(path)
