"""The interactive surface: parameterised queries over analysed tables, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import urgency
from .operators import graph

SORT_KEYS = ("name", "cc", "lcom", "lloc", "mi", "refactoring_priority")


@dataclass
class Analysis:
    """The tables that the tools read; columns as the operators make them."""

    project: DataFrame
    classes: DataFrame
    functions: DataFrame
    files: DataFrame
    problems: DataFrame
    edges: DataFrame
    calls: DataFrame
    nodes: DataFrame | None = None
    links: DataFrame | None = None

    def health_score(self) -> DataFrame:
        return self.project

    def problem_list(self, *, severity: str | None = None, contains: str | None = None, limit: int = 50) -> DataFrame:
        p = self.problems
        if severity:
            p = p.where(F.col("level") == severity.upper())
        if contains:
            p = p.where(F.contains(F.lower("message"), F.lit(contains.lower())))
        rank = F.when(F.col("level") == "ERROR", 0).when(F.col("level") == "WARNING", 1).otherwise(2)
        return p.orderBy(rank, "entity", "message").limit(limit)

    def hotspots(self, *, limit: int = 10) -> DataFrame:
        f = self.files.where("churn > 0 or cc > 0").withColumn("score", F.col("churn") * F.col("cc"))
        return f.orderBy(F.desc("score"), "path").limit(limit)

    def refactoring_priorities(self, *, limit: int = 15, min_score: float = 0.0) -> DataFrame:
        c = self.classes.where((F.col("refactoring_priority") > 0) & (F.col("refactoring_priority") >= min_score))
        return c.withColumn("urgency", urgency(F.col("refactoring_priority"))).orderBy(F.desc("refactoring_priority"), "name").limit(limit)

    def class_list(self, *, sort_by: str = "cc", limit: int = 50, contains: str = "") -> DataFrame:
        """All keys sort descending, names too."""
        if sort_by not in SORT_KEYS:
            raise ValueError(f"sort_by is one of {', '.join(SORT_KEYS)}")
        c = self.classes.where(F.contains(F.lower("name"), F.lit(contains.lower())))
        return c.orderBy(F.desc(sort_by), "name").limit(limit)

    def metrics(self, *, entity: str, kind: str = "class") -> DataFrame:
        """name, metric, value of the matching entities."""
        t = {"class": self.classes, "function": self.functions, "file": self.files}[kind]
        key = "path" if kind == "file" else "name"
        numbers = [c for c, d in t.dtypes if c != key and d in ("int", "bigint", "double", "float")]
        hit = t.where(F.contains(F.lower(key), F.lit(entity.lower()))).select(key, *[F.col(c).cast("double") for c in numbers])
        return hit.unpivot(key, numbers, "metric", "value")

    def dependencies(self, *, name: str, direction: str = "both") -> DataFrame:
        """The edges of the first class that is, or contains, the name."""
        first = self.classes.where((F.col("name") == name) | F.contains(F.lower("name"), F.lit(name.lower()))).orderBy(F.col("name") != name, "name").limit(1).select(F.col("name").alias("_n"))
        out = self.edges.join(F.broadcast(first), F.col("src") == F.col("_n")).select(F.lit("out").alias("direction"), F.col("dst").alias("other"))
        back = self.edges.join(F.broadcast(first), F.col("dst") == F.col("_n")).select(F.lit("in").alias("direction"), F.col("src").alias("other"))
        return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()

    def graph(self, *, summary_only: bool = True) -> DataFrame:
        """The property graph's edges, or with ``summary_only`` its nodes and edges by kind."""
        if self.nodes is None or self.links is None:
            return self.edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind") if summary_only else self.edges
        if not summary_only:
            return self.links
        each = [t.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n") for part, t in (("node", self.nodes), ("edge", self.links))]
        return each[0].unionByName(each[1]).orderBy("part", F.desc("n"), "kind")

    def search(self, *, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        every = self.classes.select("name", F.lit("class").alias("kind")).union(self.functions.select("name", F.lit("function").alias("kind"))).union(self.files.select(F.col("path").alias("name"), F.lit("file").alias("kind")))
        hit = every.where(F.contains(F.lower("name"), F.lit(query.lower())))
        return (hit.where(F.col("kind") == kind) if kind else hit).orderBy("name").limit(limit)

    def impact(self, *, target: str, depth: int = 2) -> DataFrame:
        """Callers of ``Class::method``, or of any method of ``Class``, up to a depth."""
        ends = self.calls.select(F.col("src").alias("node")).union(self.calls.select("dst")).distinct()
        start = ends.where((F.col("node") == target) | F.col("node").startswith(target + "::"))
        return graph.callers(self.calls, start, depth=depth)

    def impact_summary(self, *, target: str, depth: int = 2) -> DataFrame:
        """One row: callers at the first step, further ones, all, and the classes that they are in."""
        hit = self.impact(target=target, depth=depth)
        return hit.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count("*").alias("affected"), F.countDistinct(F.substring_index("node", "::", 1)).alias("classes"))

    def test_coverage(self, *, limit: int = 10, cc: int = 8) -> DataFrame:
        return self.classes.where(~F.col("has_test") & (F.col("cc") >= cc)).orderBy(F.desc("cc"), "name").select("name", "cc").limit(limit)
