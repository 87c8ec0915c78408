"""Report documents as DataFrames: SARIF results, JSON reports and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rule_slug


def sarif(problems: DataFrame) -> DataFrame:
    """rule_id, n_results, results (JSON): SARIF results from (rule, level, path, line, message), one row a rule."""
    level = F.when(F.col("level") == "ERROR", "error").when(F.col("level") == "WARNING", "warning").otherwise("note")
    result = F.struct(
        F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    named = problems.withColumn("rule_id", rule_slug(F.col("rule"), F.lower("level")))
    rows = named.select("rule_id", F.struct("path", "line", "message", result.alias("r")).alias("k"))
    return rows.groupBy("rule_id").agg(F.count("*").alias("n_results"), F.to_json(F.transform(F.sort_array(F.collect_list("k")), lambda x: x.r)).alias("results"))


def write_sarif(problems: DataFrame, path: str, *, tool: str = "strataspark", version: str = "1.0") -> None:
    """A SARIF 2.1.0 log, one line of JSON, from the rows of ``sarif``."""
    s = sarif(problems)
    rules = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("rule_id").alias("id")))))
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","version":"' + version + '","rules":'), rules, F.lit('}},"results":['), F.array_join(F.sort_array(F.collect_list(F.expr("substring(results, 2, length(results) - 2)"))), ","), F.lit("]}]}"))
    s.agg(body.alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """project (map of metrics) and problems (array) of a JSON report."""
    return spark.read.schema("project struct<metrics:map<string,struct<value:string,name:string>>>, problems array<struct<entityId:string,message:string,level:string>>").json(path, multiLine=True)


def report_metrics(report: DataFrame) -> DataFrame:
    return report.select(F.explode("project.metrics").alias("metric", "m")).select("metric", F.expr("try_cast(m.value AS double)").alias("value"), "m.name")


def report_problems(report: DataFrame) -> DataFrame:
    return report.select(F.explode("problems").alias("p")).select(F.col("p.entityId").alias("entity"), "p.message", "p.level")


def write_report(path: str, *, project: DataFrame, problems: DataFrame) -> None:
    """A JSON report: the project's row as a map of metrics, and the problem rows."""
    metrics = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.struct(F.col(c).cast("string").alias("value"), F.lit(c).alias("name"))) for c in project.columns]))
    rows = problems.agg(F.sort_array(F.collect_list(F.struct(F.col("entity").cast("string").alias("entityId"), "message", "level"))).alias("problems"))
    project.select(F.struct(metrics.alias("metrics")).alias("project")).join(F.broadcast(rows)).coalesce(1).write.mode("overwrite").json(path)


def write_graph(path: str, *, nodes: DataFrame, edges: DataFrame) -> None:
    """A property graph as two JSON tables beside each other."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
