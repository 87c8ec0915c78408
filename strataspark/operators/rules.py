"""Rules that turn metrics into problems, and the counts of problems.

A rule is a filter that emits (rule, entity, level, message); thresholds are
parameters.  All rules of one table are evaluated in a single pass over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob

INFO, WARNING, ERROR = "INFO", "WARNING", "ERROR"
#: The level under which a rule's hits are counted, which may differ from its rows' levels.
COUNT_LEVEL = {
    "too_long": WARNING, "god_class": ERROR, "too_complex": ERROR, "too_dependent": INFO, "too_much_html": WARNING, "low_type_coverage": WARNING,
    "deep_inheritance": WARNING, "dependency_cycle": ERROR, "too_many_parameters": WARNING, "dead_code": INFO, "security_smell": ERROR,
    "solid_violation": WARNING, "untested_complex": WARNING, "hotspot": WARNING,
}


#: Interfaces of classes whose methods need not share fields.
LISTENERS = ("EventSubscriberInterface", "EventListenerInterface", "ListenerInterface")


@dataclass(frozen=True)
class Thresholds:
    long_file: int = 400
    long_class: int = 300
    long_function: int = 40
    long_method: int = 30
    public_methods: int = 10
    god_uses: int = 10
    god_signs: int = 3
    cc: int = 10
    cc_long: int = 20
    cc_long_from: int = 20
    difficulty: float = 30.0
    effort_factor: float = 1.30
    mi_tolerance: float = 0.20
    lcom_factor: float = 1.30
    cognitive: int = 15
    method_cc: float = 10.0
    class_uses: int = 20
    function_uses: int = 10
    html_file: float = 25.0
    html_class: float = 10.0
    output_file: int = 10
    output_class: int = 4
    type_warning: float = 60.0
    type_error: float = 40.0
    dit_warning: int = 4
    dit_error: int = 6
    params_warning: int = 4
    params_error: int = 7
    untested_cc: int = 8
    hot_churn: int = 10
    hot_cc: int = 15


def of_framework(t: Thresholds) -> Thresholds:
    """The thresholds for classes of a detected framework."""
    from dataclasses import replace

    return replace(t, god_uses=25, difficulty=45.0, effort_factor=1.50, mi_tolerance=0.35, class_uses=35)


def problems(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
    """entity, rule, level for every rule whose column gives a level; one pass, however many rules."""
    made = F.array(*[F.struct(F.lit(name).alias("rule"), level.alias("level")) for name, level in rules.items()])
    return df.select(F.col(entity).alias("entity"), F.explode(F.filter(made, lambda r: r.level.isNotNull())).alias("p")).select("entity", "p.rule", "p.level")


def too_long(lloc: Column, limit: int) -> Column:
    return F.when(lloc > limit, WARNING)


def god_class(public: Column, coupled: Column, lcom: Column, long_method: Column, t: Thresholds = Thresholds()) -> tuple[Column, Column]:
    """(number of signs, level)"""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    signs = one(public > t.public_methods) + one(coupled > t.god_uses) + one(lcom > 1) + one(long_method)
    return signs, F.when(signs >= t.god_signs, ERROR)


def complex_cc(cc: Column, lloc: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(cc > F.when(lloc > t.cc_long_from, t.cc_long).otherwise(t.cc), ERROR)


def complex_difficulty(difficulty: Column, lloc: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when((lloc > 5) & (difficulty > t.difficulty), ERROR)


def complex_effort(effort: Column, mean: Column, lloc: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when((lloc > 5) & (effort > mean * t.effort_factor), WARNING)


def complex_mi(mi: Column, mean: Column, lloc: Column, type_coverage: Column | None = None, t: Thresholds = Thresholds()) -> Column:
    tolerance = F.lit(t.mi_tolerance)
    if type_coverage is not None:
        tolerance = F.when(type_coverage > 80, F.greatest(tolerance, F.lit(0.30))).otherwise(tolerance)
    return F.when((lloc > 5) & (mi < mean * (1 - tolerance)), WARNING)


def complex_lcom(lcom: Column, mean: Column, skip: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(~skip & (lcom > F.greatest(F.lit(1.0), mean) * t.lcom_factor), WARNING)


def too_dependent(uses: Column, limit: int) -> Column:
    return F.when(uses > limit, INFO)


def too_much_html(share: Column, outputs: Column, html: float, output: int) -> Column:
    return F.when((share > html) | (outputs > output), WARNING)


def low_type_coverage(coverage: Column, t: Thresholds = Thresholds()) -> Column:
    c = F.coalesce(coverage, F.lit(100.0))
    return F.when(c < t.type_error, ERROR).when(c < t.type_warning, WARNING)


def deep_inheritance(dit: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(dit >= t.dit_error, ERROR).when(dit >= t.dit_warning, WARNING)


def dependency_cycle(length: Column, entities_only: Column | None = None) -> Column:
    mild = F.lit(False) if entities_only is None else entities_only
    return F.when(length > 1, F.when(mild, INFO).otherwise(ERROR))


def too_many_parameters(n: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(n > t.params_error, ERROR).when(n > t.params_warning, WARNING)


def dead_code(unused: Column) -> Column:
    return F.when(unused > 0, INFO)


def solid_violation(violations: Column) -> Column:
    return F.when(violations != "", WARNING)


def untested_complex(cc: Column, has_test: Column, exempt: Column, t: Thresholds = Thresholds(), infrastructure: bool | Column = True) -> Column:
    """Holds only in projects that test at all (``infrastructure``)."""
    there = F.lit(infrastructure) if isinstance(infrastructure, bool) else infrastructure
    return F.when(there & ~exempt & ~F.coalesce(has_test, F.lit(False)) & (cc >= t.untested_cc), WARNING)


def hotspot(churn: Column, cc: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when((churn >= t.hot_churn) & (cc >= t.hot_cc), WARNING)


def skips_lcom(name: Column, kind: Column, methods: Column, implements: Column | None = None, framework: bool = False) -> Column:
    """Classes whose cohesion says nothing: no real class, at most one method, errors, listeners, and a framework's handlers.

    ``implements``: names of the interfaces, with or without namespace.
    """
    out = kind.isin("enum", "interface", "trait") | (methods <= 1) | glob(name, "*Exception") | glob(name, "*Error")
    if framework:
        for p in ("*Subscriber", "*Listener", "*Command", "*Handler"):
            out = out | glob(F.substring_index(name, "\\", -1), p)
    return out if implements is None else out | F.exists(F.coalesce(implements, F.array().cast("array<string>")), lambda i: F.substring_index(i, "\\", -1).isin(*LISTENERS))


def counts(found: DataFrame) -> DataFrame:
    """rule, rows, and the level it is counted under."""
    levels = F.create_map(*[F.lit(x) for pair in COUNT_LEVEL.items() for x in pair])
    return found.groupBy("rule").agg(F.count("*").alias("n")).withColumn("count_level", F.coalesce(F.element_at(levels, F.col("rule")), F.lit(WARNING)))


def by_level(found: DataFrame) -> DataFrame:
    """Rows by level, and a total."""
    return found.rollup("level").agg(F.count("*").alias("n")).withColumn("level", F.coalesce("level", F.lit("Total")))


def fails_gate(levels: DataFrame, *, fail_on: str | None = None, max_errors: int | None = None, max_warnings: int | None = None) -> bool:
    """Whether counts by level (level, n) fail the quality gate."""
    n = {r.level: r.n for r in levels.collect()}
    errors, warnings = n.get(ERROR, 0), n.get(WARNING, 0)
    if fail_on:
        return errors > 0 or (fail_on == "warning" and warnings > 0)
    return (max_errors is not None and errors > max_errors) or (max_warnings is not None and warnings > max_warnings)
