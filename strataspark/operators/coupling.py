"""Coupling, cohesion, layers and design checks over edges between named classes.

Class tables have columns name, package, is_abstract (abstract classes and
interfaces) and is_trait; edges have src and dst names.  Joins carry names only;
whether a side is broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import distance, instability, ratio


def resolve(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct edges between different known classes; what does not resolve is dropped."""
    known = classes.select(F.col("name").alias("dst"))
    return edges.where("src <> dst").select("src", "dst").distinct().join(known, "dst", "left_semi").select("src", "dst")


def coupling(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, uses, uses_in_project, used_by, instability of every class; traits do not count as efferent."""
    own = edges.where("src <> dst").select("src", "dst").distinct()
    kinds = classes.select(F.col("name").alias("dst"), F.coalesce("is_trait", F.lit(False)).alias("_trait"))
    known = own.join(kinds, "dst", "left")
    out = known.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("uses"), F.count_if(~F.col("_trait")).alias("uses_in_project"))
    back = known.where("_trait is not null").groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("used_by"))
    joined = classes.join(out, "name", "left").join(back, "name", "left").na.fill(0, ["uses", "uses_in_project", "used_by"])
    return joined.withColumn("instability", instability(F.col("uses_in_project"), F.col("used_by")))


def coupling_totals(coupled: DataFrame) -> DataFrame:
    """One row of averages, overall abstractness and distance from the main sequence."""
    a = coupled.agg(
        F.count("*").alias("classes"), F.avg("uses").alias("avg_uses"), F.avg("used_by").alias("avg_used_by"),
        F.avg("instability").alias("avg_instability"), ratio(F.count_if("is_abstract"), F.count("*")).alias("abstractness"),
    )
    return a.withColumn("distance", distance(F.col("abstractness"), F.col("avg_instability")))


def packages(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """package, classes, abstractness, uses, used_by, instability, distance; dependencies cross packages and count once per class."""
    where = classes.select("name", "package", F.coalesce("is_trait", F.lit(False)).alias("_trait"))
    e = edges.select("src", "dst").distinct().join(where.select(F.col("name").alias("src"), F.col("package").alias("p")), "src")
    e = e.join(where.select(F.col("name").alias("dst"), F.col("package").alias("q"), "_trait"), "dst").where("p <> q and not _trait")
    out = e.groupBy(F.col("p").alias("package")).agg(F.countDistinct("dst").alias("uses"))
    back = e.groupBy(F.col("q").alias("package")).agg(F.countDistinct("src").alias("used_by"))
    base = classes.groupBy("package").agg(F.countDistinct("name").alias("classes"), ratio(F.countDistinct(F.when(F.col("is_abstract"), F.col("name"))), F.countDistinct("name")).alias("abstractness"))
    joined = base.join(out, "package", "left").join(back, "package", "left").na.fill(0, ["uses", "used_by"])
    joined = joined.withColumn("instability", instability(F.col("uses"), F.col("used_by")))
    return joined.withColumn("distance", distance(F.col("abstractness"), F.col("instability")))


def cohesion(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """package, members, relations inside it and H = min(1, (R + 1) / N), 1 for a single class."""
    where = classes.select("name", "package")
    inside = edges.select("src", "dst").distinct().join(where.select(F.col("name").alias("src"), "package"), "src").join(where.select(F.col("name").alias("dst"), "package"), ["dst", "package"])
    r = inside.where("src <> dst").groupBy("package").agg(F.count("*").alias("relations"))
    n = classes.groupBy("package").agg(F.countDistinct("name").alias("members"))
    h = F.when(F.col("members") == 1, 1.0).otherwise(F.least(F.lit(1.0), F.round((F.col("relations") + 1) / F.col("members"), 2)))
    return n.join(r, "package", "left").na.fill(0, ["relations"]).withColumn("cohesion", h)


def layer_violations(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """name, violations and their list, of classes that use one of a higher rank; classes without a rank are left out."""
    a = ranked.where("rank is not null").select(F.col("name").alias("src"), F.col("layer").alias("a"), F.col("rank").alias("ra"))
    b = ranked.where("rank is not null").select(F.col("name").alias("dst"), F.col("layer").alias("b"), F.col("rank").alias("rb"))
    hit = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("rb > ra")
    said = F.format_string("%s → %s (%s)", F.col("a"), F.col("b"), F.col("dst"))
    return hit.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("violations"), F.array_join(F.sort_array(F.collect_list(said)), "; ").alias("list"))


def solid(coupled: DataFrame, edges: DataFrame) -> DataFrame:
    """Single-responsibility and interface-segregation flags, and the share of dependencies on abstractions.

    ``coupled``: coupling() with method_count, lcom and is_interface.
    """
    kinds = coupled.select(F.col("name").alias("dst"), "is_abstract")
    dip = edges.select("src", "dst").distinct().join(kinds, "dst", "left").groupBy(F.col("src").alias("name")).agg(F.round(100.0 * F.count_if("is_abstract") / F.count("*"), 2).alias("dip_score"))
    srp = (F.col("method_count") > 15) & (F.col("lcom") > 2) & (F.col("uses") > 8)
    isp = F.col("is_interface") & (F.col("method_count") > 10)
    out = coupled.join(dip, "name", "left").withColumns({"dip_score": F.coalesce("dip_score", F.lit(100.0)), "srp": srp, "isp": isp})
    return out.withColumn("violations", F.array_join(F.array_compact(F.array(F.when(srp, "SRP"), F.when(isp, "ISP"))), ","))


def same_position(packages_: DataFrame) -> DataFrame:
    """Packages grouped by equal abstractness and instability, names joined."""
    return packages_.groupBy("abstractness", "instability").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("package")), ", ").alias("packages"))


def called_by(calls: DataFrame) -> DataFrame:
    """target, callers and weight from call edges (src, dst), one row per call site."""
    return calls.groupBy("dst").agg(F.countDistinct("src").alias("callers"), F.count("*").alias("weight"))
