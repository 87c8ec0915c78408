"""A whole source tree, from files to scores: the tables that reports and tools read."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.stage import cut
from ..operators import coupling, duplication, graph, history, nodes, propertygraph, rules, scores, testmap, text
from ..operators.rules import Thresholds
from ..sources import files as source_files
from ..sources import php
from ..tools import Analysis


def analyse(spark: SparkSession, root: str, *, log: DataFrame | None = None, as_of: str = "2024-01-01 00:00:00", thresholds: Thresholds = Thresholds(), package_depth: int = 2, excludes: tuple[str, ...] = (), framework: bool = False) -> Analysis:
    """Scan, parse and measure the PHP files below ``root``.

    ``log``: commits as (path, commit, author, ts) with the files' paths.
    ``framework``: the project uses one whose handlers need no cohesion.  The
    parsed records and the class table are cut, since every measure reads them.
    """
    found = source_files.scan_files(spark, root, excludes=excludes)
    texts = source_files.source_texts(found)
    tests = source_files.test_files(texts)
    texts = texts.join(tests.select(F.col("test").alias("path")), "path", "left_anti")
    recs = cut(php.records(texts))
    n = php.nodes(recs)
    classes, edges = php.classes(recs, package_depth), php.edges(recs)
    wide, narrow = edges.select("src", "dst").distinct(), edges.where("kind = 'used'").select("src", "dst").distinct()

    by_file = text.lines(texts.select("path", F.col("content").alias("text"))).select("path", "loc", "cloc", "lloc")
    by_file = _measured(by_file, n, "path")
    dup = duplication.duplication(text.tokens(texts.select("path", F.col("content").alias("text"))).join(by_file.select("path", "loc"), "path"), key="path").select("path", "duplicated_lines", "duplication_rate")
    churned = history.churn(log, F.to_timestamp(F.lit(as_of))).select("path", "churn", "authors", "age_days") if log is not None else spark.createDataFrame([], "path string, churn long, authors long, age_days long")
    by_file = by_file.join(dup, "path", "left").join(churned, "path", "left").na.fill(0, ["churn", "authors", "age_days"])

    funcs = _measured(php.functions(recs).withColumns({"loc": F.col("end_line") - F.col("start_line") + 1, "cloc": F.lit(0)}), n, "func_id")
    methods = funcs.where("kind = 'method'").groupBy(F.col("class_name").alias("name")).agg(F.count("*").alias("method_count"), F.count_if("is_public").alias("public_count"), F.avg("cc").alias("avg_method_cc"), F.bool_or(F.col("lloc") > thresholds.long_method).alias("long_method"), F.max("cognitive_complexity").alias("max_cognitive"))
    c = _measured(classes.withColumn("cloc", F.lit(0)), n.withColumn("name", F.col("class_name")), "name")
    c = coupling.coupling(c, wide).join(methods, "name", "left").join(php.lcom(recs).withColumnRenamed("class_name", "name"), "name", "left")
    scc = graph.strongly_connected(coupling.resolve(narrow, classes))
    size = scc.groupBy("scc").agg(F.count("*").alias("cycle_length")).where("cycle_length > 1")
    c = c.join(scc.join(size, "scc").select(F.col("node").alias("name"), "cycle_length"), "name", "left")
    parent = edges.where("kind = 'extends'").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"))
    tree = classes.select(F.col("name").alias("node")).join(parent, "node", "left")
    c = c.join(graph.tree_depth(tree).withColumnRenamed("node", "name").withColumnRenamed("depth", "dit"), "name", "left")
    ranked = classes.select("name", scalars.layer_name(scalars.namespace_of(F.col("name"))).alias("layer")).withColumn("rank", scalars.layer_rank(scalars.namespace_of(F.col("name"))))
    c = c.join(coupling.layer_violations(ranked, narrow).select("name", F.col("violations").alias("layer_violations")), "name", "left")
    c = c.join(nodes.type_coverage(php.type_slots(recs), "class_name").withColumnRenamed("class_name", "name"), "name", "left")
    c = c.join(php.dead_private(recs).groupBy(F.col("class_id").alias("name")).agg(F.count("*").alias("dead")), "name", "left")
    def smells(by):
        return nodes.security_smells(n.where(F.col(by).isNotNull()), by).select(by, F.col("level").alias("smell_level"))

    by_file = by_file.join(smells("path"), "path", "left").join(nodes.output_count(n, "path"), "path", "left").join(php.view(recs, "file").select("path", F.col("params").alias("html_loc")), "path", "left").na.fill(0, ["output_count", "html_loc"])
    funcs = funcs.join(smells("func_id"), "func_id", "left").join(nodes.output_count(n.where("func_id is not null"), "func_id"), "func_id", "left").na.fill(0, ["output_count"])
    interfaces = edges.where("kind = 'implements'").groupBy(F.col("src").alias("name")).agg(F.collect_set("dst").alias("interfaces"))
    c = c.join(smells("class_id").withColumnRenamed("class_id", "name"), "name", "left").join(interfaces, "name", "left")
    c = c.join(nodes.output_count(n.where("class_id is not null"), "class_id").withColumnRenamed("class_id", "name"), "name", "left").na.fill(0, ["output_count"])
    c = c.join(by_file.select("path", "churn", "authors", "age_days"), "path", "left")
    named = classes.select("name", scalars.short_name(F.col("name")).alias("short"))
    c = testmap.coverage(testmap.mapping(tests, named), tests, c)
    c = c.na.fill(0, ["method_count", "public_count", "avg_method_cc", "lcom", "cycle_length", "layer_violations", "dead", "churn", "authors", "age_days"]).na.fill(100.0, ["type_coverage"])
    c = coupling.solid(c.withColumn("is_interface", F.col("kind") == "interface"), wide).withColumn("in_cycle", F.col("cycle_length") > 1)
    c = cut(c)

    def means_of(df):
        return df.agg(*[F.coalesce(F.avg(k), F.lit(0.0)).alias(k) for k in ("effort", "mi")]).first().asDict()

    by_file, funcs = cut(by_file), cut(funcs)
    file_means, func_means = means_of(by_file), means_of(funcs)
    tested_at_all = tests.limit(1).count() > 0
    means = {r: c.agg(*[F.avg(F.coalesce(F.col(k).cast("double"), F.lit(0.0))).alias(k) for k in ("effort", "mi", "lcom")]).first()[r] or 0.0 for r in ("effort", "mi", "lcom")}
    x = F.col
    _, god = rules.god_class(x("public_count"), x("uses") + x("used_by"), x("lcom"), x("long_method"), thresholds)
    exempt = x("kind").isin("interface", "trait", "enum") | x("is_abstract")
    checks = {
        "too_long": rules.too_long(x("lloc"), thresholds.long_class), "god_class": god, "too_complex_cc": rules.complex_cc(x("cc"), x("lloc"), thresholds),
        "too_complex_difficulty": rules.complex_difficulty(x("difficulty"), x("lloc"), thresholds), "too_complex_effort": rules.complex_effort(x("effort"), F.lit(means["effort"]), x("lloc"), thresholds),
        "too_complex_mi": rules.complex_mi(x("mi"), F.lit(means["mi"]), x("lloc"), x("type_coverage"), thresholds), "too_complex_lcom": rules.complex_lcom(x("lcom"), F.lit(means["lcom"]), rules.skips_lcom(x("name"), x("kind"), x("method_count"), x("interfaces"), framework), thresholds),
        "too_complex_methods": F.when(x("avg_method_cc") > thresholds.method_cc, "ERROR"), "too_much_html": rules.too_much_html(F.lit(0.0), x("output_count"), thresholds.html_class, thresholds.output_class),
        "too_dependent": rules.too_dependent(x("uses"), thresholds.class_uses), "low_type_coverage": rules.low_type_coverage(x("type_coverage"), thresholds), "deep_inheritance": rules.deep_inheritance(x("dit"), thresholds),
        "dependency_cycle": rules.dependency_cycle(x("cycle_length")), "dead_code": rules.dead_code(x("dead")), "security_smell": x("smell_level"), "solid_violation": rules.solid_violation(x("violations")),
        "untested_complex": rules.untested_complex(x("cc"), x("has_test"), exempt, thresholds, tested_at_all),
    }
    problems = rules.problems(c, "name", checks)
    def standard(mean):
        return {
            "too_complex_cc": rules.complex_cc(x("cc"), x("lloc"), thresholds), "too_complex_difficulty": rules.complex_difficulty(x("difficulty"), x("lloc"), thresholds),
            "too_complex_effort": rules.complex_effort(x("effort"), F.lit(mean["effort"]), x("lloc"), thresholds), "too_complex_mi": rules.complex_mi(x("mi"), F.lit(mean["mi"]), x("lloc"), t=thresholds), "security_smell": x("smell_level"),
        }

    html = scalars.html_share(x("lloc"), x("html_loc"))
    more = rules.problems(by_file, "path", {
        "too_long": rules.too_long(x("lloc"), thresholds.long_file), "hotspot": rules.hotspot(x("churn"), x("cc"), thresholds),
        "too_much_html": rules.too_much_html(html, x("output_count"), thresholds.html_file, thresholds.output_file), **standard(file_means),
    })
    less = rules.problems(funcs, "func_id", {
        "too_long": rules.too_long(x("lloc"), F.when(x("kind") == "method", thresholds.long_method).otherwise(thresholds.long_function)), "too_many_parameters": rules.too_many_parameters(x("params"), thresholds),
        "too_complex_cognitive": F.when((x("kind") == "method") & (x("cognitive_complexity") > thresholds.cognitive), "ERROR"),
        "too_much_html": rules.too_much_html(F.lit(0.0), x("output_count"), thresholds.html_class, thresholds.output_class), **standard(func_means),
    })
    problems = cut(problems.unionByName(more).unionByName(less).withColumn("message", F.concat_ws(" ", F.translate("rule", "_", " "), F.lit("in"), "entity")))

    counts = problems.groupBy(F.col("entity").alias("name")).agg(*[F.count_if(x("level") == level).alias(name) for level, name in (("ERROR", "errors"), ("WARNING", "warnings"), ("INFO", "infos"))])
    scored = c.join(counts, "name", "left").na.fill(0, ["errors", "warnings", "infos"]).withColumn("solid_violations", F.size(F.filter(F.split("violations", ","), lambda v: v != "")).cast("long"))
    skipped = x("kind").isin("interface", "trait", "enum") | scalars.short_name(x("name")).rlike("(Test|Spec|Cest)$")
    scored = scores.priority(scored).withColumn("refactoring_priority", F.when(~skipped, x("priority"))).drop("priority")
    scored = scores.debt(scored, problems.select(F.col("entity"), "level"), entity="name")

    totals = coupling.coupling_totals(c).select("classes", "distance", "abstractness")
    one = by_file.agg(F.count("*").alias("files"), F.avg("mi").alias("avg_mi"), F.avg("cc").alias("avg_cc"), F.sum("loc").alias("loc"), F.sum("lloc").alias("lloc"))
    rest = [
        totals, c.agg(F.greatest(F.lit(0), F.coalesce(F.sum("lloc"), F.lit(0))).alias("lloc_inside"), F.count_if("in_cycle").alias("classes_in_cycles")), size.agg(F.count("*").alias("cycles")),
        rules.counts(problems.withColumn("rule", F.regexp_replace("rule", "^too_complex_.*", "too_complex"))).agg(F.coalesce(F.sum(F.when(x("count_level") == "ERROR", x("n"))), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.when(x("count_level") == "WARNING", x("n"))), F.lit(0)).alias("warnings")),
        funcs.where("kind = 'method'").agg(F.count("*").alias("methods"), F.count_if("is_public").alias("public_methods"), F.count_if("is_static").alias("static_methods")),
        php.view(recs, "file").agg(F.coalesce(F.sum("params"), F.lit(0)).alias("html_loc")), php.view(recs, "error").agg(F.count("*").alias("file_errors")),
        testmap.totals(c.withColumns({"line_rate": F.lit(None).cast("double"), "statements": F.lit(0)})).select("tested", "untested", "ratio"), tests.agg(F.count("*").alias("test_files")),
    ]
    for part in rest:  # one row each
        one = one.join(F.broadcast(part))
    one = one.withColumns({"lloc_outside": F.greatest(F.lit(0), x("lloc") - x("lloc_inside")), "test_score": F.when(x("test_files") > 0, x("ratio"))})
    calls = php.view(recs, "method_call").select(F.col("name").alias("src"), "dst")
    changes = log.select("path", "author") if log is not None else None
    vertices = propertygraph.graph_nodes(scored, funcs, changes)
    links = propertygraph.graph_edges(scored, funcs, edges, calls, scc, changes)
    return Analysis(project=scores.health(one), classes=scored, functions=funcs, files=by_file, problems=problems, edges=edges, calls=calls, nodes=vertices, links=links)


def _measured(base: DataFrame, n: DataFrame, key: str) -> DataFrame:
    """``base`` with complexity, Halstead measures and maintainability of its nodes; entities without nodes count as empty."""
    out = base.join(nodes.cyclomatic(n, key), key, "left").join(nodes.cognitive(n, key), key, "left")
    out = out.join(nodes.halstead(n, key), key, "left").na.fill(1, ["cc"]).na.fill(0, ["cognitive_complexity", "volume", "difficulty", "effort"])
    m = scalars.maintainability(F.col("volume"), F.col("cc"), F.col("lloc"), F.col("loc"), F.col("cloc"))
    return out.withColumn("mi", m.mi)


def framework_thresholds(composer: str, thresholds: Thresholds = Thresholds()) -> Thresholds:
    """The thresholds for a project whose composer.json names a framework."""
    return rules.of_framework(replace(thresholds)) if source_files.parse_composer(composer).frameworks else thresholds
