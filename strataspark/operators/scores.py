"""Technical debt, health score and refactoring priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import grade, ratio, rounded

POINTS = {"ERROR": 3.0, "WARNING": 1.0, "INFO": 0.5}


def debt(entities: DataFrame, found: DataFrame, *, entity: str = "entity", lloc: str = "lloc") -> DataFrame:
    """points and debt (points per 100 logical lines, two decimals) of every entity."""
    point = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in POINTS.items()], F.lit(0.0))
    p = found.groupBy(F.col("entity").alias(entity)).agg(F.sum(point).alias("points"))
    out = entities.join(p, entity, "left").na.fill(0.0, ["points"])
    return out.withColumn("debt", F.when(F.col(lloc) > 0, F.round(F.col("points") / F.col(lloc) * 100, 2)).otherwise(0.0))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def health(project: DataFrame) -> DataFrame:
    """health_score and health_grade of a project row.

    Columns: avg_mi, errors, warnings, classes, files, avg_cc, distance, lloc,
    lloc_outside, loc, html_loc, methods, public_methods, static_methods,
    classes_in_cycles, cycles, abstractness, and test_score, which drops out with its
    weight where it is null.
    """
    c = F.col
    private = ratio(c("methods") - c("public_methods"), c("methods"))
    static = ratio(c("static_methods"), c("methods"))
    encapsulation = F.when(c("methods") > 0, 0.6 * F.least(F.lit(100.0), private * 333) + 0.4 * _clip(100 - F.greatest(F.lit(0.0), static - 0.10) * 200)).otherwise(100.0)
    cycle = F.when(c("classes") > 0, _clip(100 * F.pow(1 - ratio(c("classes_in_cycles"), c("classes")), 2) - 5 * c("cycles"))).otherwise(100.0)
    parts = {
        "maintainability": (0.13, _clip((c("avg_mi") - 40) * 1.25)),
        "problems": (0.09, F.greatest(F.lit(0.0), 100 - 30 * F.log1p((c("errors") + c("warnings")) / F.greatest(c("classes") + c("files"), F.lit(1))))),
        "complexity": (0.09, _clip(100 - (c("avg_cc") - 1) * 5)),
        "coupling": (0.09, _clip((1 - F.abs("distance")) * 100)),
        "structure": (0.05, F.greatest(F.lit(0.0), (1 - c("lloc_outside") / F.greatest("lloc", F.lit(1))) * 100)),
        "html": (0.13, 100 * F.pow(1 - c("html_loc") / F.greatest("loc", F.lit(1)), 3)),
        "encapsulation": (0.13, encapsulation),
        "cycles": (0.09, cycle),
        "abstractness": (0.10, F.least(F.lit(100.0), F.abs("abstractness") * 1000)),
    }
    tested = c("test_score").isNotNull()
    total = sum((w * s for w, s in parts.values()), F.lit(0.0)) + F.when(tested, 0.10 * F.least(F.lit(100.0), c("test_score"))).otherwise(0.0)
    weight = sum(w for w, _ in parts.values()) + F.when(tested, 0.10).otherwise(0.0)
    out = project.withColumn("health_score", total / weight)
    return out.withColumn("health_grade", grade(c("health_score")))


def priority(df: DataFrame) -> DataFrame:
    """priority, drivers (joined) and recommendation of classes.

    Columns: cc, lcom, lloc, errors, warnings, infos, in_cycle, cycle_length,
    layer_violations, solid_violations, used_by, churn, authors, age_days, has_test.
    Classes without problems and structural issues score 0.
    """
    c = F.col
    low = lambda x, most: F.least(F.lit(float(most)), x.cast("double"))
    sub = {
        "problems": low(c("errors") * 12 + c("warnings") * 4 + c("infos"), 100),
        "complexity": _clip((c("cc") - 5) * 4),
        "cohesion": _clip((c("lcom") - 1) * 20),
        "size": _clip((c("lloc") - 100) * 0.25),
        "structural": low(F.when(c("in_cycle"), 30).otherwise(0) + low(c("cycle_length") * 5, 30) + low(c("layer_violations") * 10, 20) + low(c("solid_violations") * 5, 20), 100),
    }
    a = df.withColumns({f"_{k}": v for k, v in sub.items()})
    severity = c("_problems") * 0.30 + c("_complexity") * 0.25 + c("_cohesion") * 0.15 + c("_size") * 0.10 + c("_structural") * 0.20
    fresh = F.when((c("age_days") > 0) & (c("age_days") < 90), 0.15).when((c("age_days") > 0) & (c("age_days") < 365), 0.08).otherwise(0.0)
    impact = 1.0 + low(c("used_by") * 0.04, 0.4) + low(c("churn") * 0.015, 0.3) + low(c("authors") * 0.05, 0.15) + fresh
    open_ = (c("errors") + c("warnings") + c("infos") > 0) | c("in_cycle") | (c("layer_violations") > 0) | (c("solid_violations") > 0) | (c("lcom") > 1)
    a = a.withColumn("priority", F.when(open_, F.least(F.lit(100.0), rounded(severity * impact / 2.0, 1))).otherwise(0.0))
    tangled = c("_structural") >= 40
    notes = [
        ("high complexity", c("_complexity") >= 60, F.format_string("CC=%d: extract methods, or split into strategies.", "cc")),
        ("untested", ~c("has_test") & (c("cc") > 5), F.lit("No tests found: add them before changing this class.")),
        ("low cohesion", c("_cohesion") >= 40, F.format_string("LCOM=%d: split into focused classes.", "lcom")),
        ("dependency cycle", tangled & c("in_cycle"), F.format_string("In a cycle of %d classes: break it with interfaces.", "cycle_length")),
        ("layer violations", tangled & (c("layer_violations") > 0), F.format_string("%d layer violation(s): depend on interfaces.", "layer_violations")),
        ("SOLID violations", tangled & (c("solid_violations") > 0), F.lit(None).cast("string")),
        ("many issues", c("_problems") >= 50, F.format_string("%d errors and %d warnings: errors first.", "errors", "warnings")),
        ("excessive size", c("_size") >= 50, F.format_string("%d logical lines: extract helpers.", "lloc")),
    ]
    drivers = F.array_compact(F.array(*[F.when(open_ & when, name) for name, when, _ in notes]))
    texts = F.array_compact(F.array(*[F.when(open_ & when, text) for _, when, text in notes]))
    mild = open_ & (F.size(drivers) == 0) & (c("_complexity") > 0)
    a = a.withColumn("drivers", F.when(mild, "moderate complexity").otherwise(F.array_join(drivers, ",")))
    a = a.withColumn("recommendation", F.when(mild, "Minor issues: simplify when next changing this class.").otherwise(F.array_join(F.slice(texts, 1, 3), " ")))
    return a.drop(*[f"_{k}" for k in sub])


def priority_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(rounded(F.coalesce(F.avg("priority"), F.lit(0.0)), 1).alias("avg_priority"), F.coalesce(F.max("priority"), F.lit(0.0)).alias("max_priority"), F.count_if(F.col("priority") > 0).alias("needing"))
