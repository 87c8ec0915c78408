"""The operators bound to the driver's tables: one function of (spark, sf_dir) for each query.

file = document, class = nation, package = region, commit = event (author = user,
file = props.k), dependency = customer nation to supplier nation in the orders,
method call = part to supplier, member = part, test = benchmark item, run = day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.stage import cut
from ..operators import coupling, duplication, graph, history, nodes, rollup, rules, scores, testmap, text

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


def _documents(spark, sf_dir, *more: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    return text.documents(docs)


# ---- texts -------------------------------------------------------------------


def loc_by_document(spark, sf_dir):
    return text.lines(table(spark, sf_dir, "documents")).select("doc_id", "loc", "cloc", "lloc")


def cc_by_document(spark, sf_dir):
    return text.cyclomatic(text.tokens(table(spark, sf_dir, "documents"))).select("doc_id", "cc")


HALSTEAD = ("vocabulary", "length", "calc_length", "volume", "difficulty", "effort", "complexity_density")


def halstead_by_document(spark, sf_dir):
    h = text.halstead(text.tokens(table(spark, sf_dir, "documents")))
    return h.select("doc_id", "operators", "operands", "unique_operators", "unique_operands", *[_r(F.col(c)).alias(c) if c not in HALSTEAD[:2] else F.col(c) for c in HALSTEAD])


def maintainability_index(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("doc_id", _r(F.col("mi")).alias("mi"), _r(F.col("mi_without_comments")).alias("mi_without_comments"), _r(F.col("comment_weight")).alias("comment_weight"))


def variables_summary(spark, sf_dir):
    v = text.variables(text.tokens(table(spark, sf_dir, "documents")))
    return v.select("doc_id", "superglobals_used", "distinct_superglobals_used", "constants_used", "distinct_constants_used", "variables_used", "distinct_variables_used", "superglobal_metric")


def cognitive_by_conversation(spark, sf_dir):
    turns = text.cyclomatic(text.tokens(table(spark, sf_dir, "conversations")))
    return text.cognitive(turns, "conv_id", F.col("turn"), F.col("cc") - 1)


def runtime_complexity_bucket(spark, sf_dir):
    deepest = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("depth"))
    return deepest.groupBy(scalars.runtime_bucket(F.col("depth")).alias("runtime")).agg(F.count("*").alias("n"))


def duplication_rate(spark, sf_dir):
    docs = text.tokens(text.lines(table(spark, sf_dir, "documents"))).select("doc_id", "loc", "tokens")
    return duplication.duplication(docs, key="doc_id").select("doc_id", "duplicated_lines", "duplication_rate")


def duplication_project(spark, sf_dir):
    docs = text.tokens(text.lines(table(spark, sf_dir, "documents"))).select("doc_id", "loc", "tokens")
    return duplication.project_rate(duplication.duplication(docs, key="doc_id"))


def limits_averages(spark, sf_dir):
    d = rollup.limits(_documents(spark, sf_dir), "document", ["cc", "mi", "difficulty", "effort"])
    p = rollup.limits(table(spark, sf_dir, "part"), "part", ["p_size", "p_retailprice"])
    e = rollup.limits(table(spark, sf_dir, "events"), "event", ["value"])
    return d.unionByName(p).unionByName(e).select("entity", "metric", *[_r(F.col(c)).alias(c) for c in ("lo", "hi", "mean")])


def most_complex_with_ties(spark, sf_dir):
    d = text.cyclomatic(text.tokens(table(spark, sf_dir, "documents"))).select("doc_id", "lang", "cc")
    return rollup.most(d, "document", "doc_id", "cc").unionByName(rollup.most(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s")), "part", "p_partkey", "s"))


def project_rollup(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.agg(
        F.count("*").alias("files"), F.countDistinct("source").alias("sources"), F.sum("loc").alias("loc"), F.sum("lloc").alias("lloc"), F.sum("cloc").alias("cloc"),
        F.sum("cc").alias("cc"), F.max("cc").alias("max_cc"), _r(F.avg("cc"), 4).alias("avg_cc"), _r(F.avg("mi"), 4).alias("avg_mi"),
    )


def above_average_effort(spark, sf_dir):
    d = _documents(spark, sf_dir).select("doc_id", "lang", "lloc", "effort")
    return rollup.above_average(d, "lang", "effort", rules.Thresholds().effort_factor).where("lloc > 5").select("doc_id", "lang")


# ---- pages and paths -----------------------------------------------------------


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))


def package_assignment(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("package", scalars.package_of(F.col("path"), 2, "/"))
    return p.groupBy("package").agg(F.count("*").alias("pages"), F.countDistinct("path").alias("paths"))


def common_path(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("corpus"), F.lit("texts"), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return rollup.common_prefix(d, "path")


def relative_paths(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("page_id", F.regexp_extract("path", "([^/]*)$", 1).alias("base_name"), F.regexp_replace("path", "/?[^/]*$", "").alias("dir_name"))


def security_smells(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    smells = F.regexp_count("html", F.lit("<script")) + F.regexp_count("html", F.lit("track\\("))
    return p.select("page_id", smells.cast("long").alias("smells"), F.when(F.col("url").contains("utm_"), "ERROR").when(smells > 0, "WARNING").alias("level"))


def too_much_html(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("all"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("outputs"))
    p = p.withColumn("share", scalars.html_share(F.col("all"), F.col("all") - F.col("text")))
    return p.select("page_id", _r(F.col("share")).alias("share"), "outputs", rules.too_much_html(F.col("share"), F.col("outputs"), 25.0, 10).alias("level"))


def rule_slug(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", scalars.rule_slug(F.concat_ws(" / ", F.initcap("p_name"), "p_type"), F.lit("size")).alias("slug"))


# ---- events as a change log ----------------------------------------------------


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.get_json_object("props", "$.k").cast("long").alias("path"), F.col("event_id").alias("commit"), F.col("user_id").alias("author"), "ts", "event_type", "value")


def output_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def git_churn(spark, sf_dir):
    c = history.churn(_log(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))
    return c.select("path", "churn", "authors", F.md5("author_list").alias("author_list_md5"), "age_days")


def git_totals(spark, sf_dir):
    return history.log_totals(_log(spark, sf_dir)).select("commits", "active_authors", F.to_date("since").cast("string").alias("since"), F.to_date("until").cast("string").alias("until"))


def weekly_commits(spark, sf_dir):
    return history.weekly(_log(spark, sf_dir)).select(F.col("week").cast("string").alias("week"), "commits")


def author_rollup(spark, sf_dir):
    log = _log(spark, sf_dir)
    return history.authors(history.churn(log, F.to_timestamp(F.lit(AS_OF))), log)


def _file_cc(spark, sf_dir):
    d = text.cyclomatic(text.tokens(table(spark, sf_dir, "documents"))).select((F.col("doc_id") % 100).alias("path"), "cc")
    return d.groupBy("path").agg(F.max("cc").alias("cc"))


def hotspots_topk(spark, sf_dir):
    log = _log(spark, sf_dir)
    churned = log.groupBy("path").agg(F.countDistinct("commit").alias("churn"))
    return history.hotspots(churned, _file_cc(spark, sf_dir), 50)


def hotspot_rule(spark, sf_dir):
    churned = _log(spark, sf_dir).groupBy("path").agg(F.countDistinct("commit").alias("churn"))
    both = churned.join(_file_cc(spark, sf_dir), "path").withColumn("level", rules.hotspot(F.col("churn"), F.col("cc")))
    return both.where("level is not null").select("path", "churn", "cc", "level")


BETTER = {"click": "high", "view": "high", "purchase": "high", "error": "low"}


def _daily(spark, sf_dir):
    better = F.create_map(*[F.lit(x) for p in BETTER.items() for x in p])
    d = _log(spark, sf_dir).groupBy(F.col("event_type").alias("metric"), F.to_date("ts").alias("run")).agg(F.count("*").cast("double").alias("value"))
    return d.withColumn("better", F.coalesce(F.element_at(better, F.col("metric")), F.lit("none")))


def history_delta(spark, sf_dir):
    d = history.run_deltas(_daily(spark, sf_dir))
    return d.select("metric", F.col("run").cast("string").alias("run"), "value", "delta", "direction", "is_better")


def trend_series(spark, sf_dir):
    d = _daily(spark, sf_dir).groupBy("run").pivot("metric", ["click", "error", "purchase", "view"]).agg(F.first("value"))
    return d.select(F.col("run").cast("string").alias("run"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("click", "error", "purchase", "view")])


def _halves(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.where("ts < timestamp'2024-01-16'"), log.where("ts >= timestamp'2024-01-16'")


def report_compare(spark, sf_dir):
    better = F.create_map(*[F.lit(x) for p in BETTER.items() for x in p])

    def report(half):
        r = half.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
        return r.withColumn("better", F.coalesce(F.element_at(better, F.col("metric")), F.lit("none")))

    before, after = _halves(spark, sf_dir)
    return history.compare_metrics(report(before), report(after))


def _problem_rows(half):
    r = half.groupBy("path", "event_type").agg(F.count("*").alias("n")).where("n >= 2")
    return r.select(F.col("path").alias("entity"), F.col("event_type").alias("message"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("n") > 3, "WARNING").otherwise("INFO").alias("level"))


def new_resolved_problems(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    return history.problem_changes(_problem_rows(before), _problem_rows(after))


def level_compare(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    return history.compare_levels(_problem_rows(before), _problem_rows(after))


# ---- nations as classes --------------------------------------------------------


def _edges(spark, sf_dir, n: int = 3):
    """The three nations that each nation buys most from."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    r = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    r = r.where("src <> dst").groupBy("src", "dst").agg(F.sum("p").alias("revenue"))
    w = Window.partitionBy("src").orderBy(F.desc("revenue"), "dst")
    return r.withColumn("k", F.row_number().over(w)).where(f"k <= {n}").select("src", "dst")


def _classes(spark, sf_dir):
    """Nations; abstract ones have suppliers that are poorer than all suppliers on average."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("name"), F.col("n_regionkey").cast("long").alias("package"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").alias("b"))
    own = s.groupBy("name").agg(F.sum("b").cast("double").alias("t"), F.count("*").alias("k"))
    total = s.agg(F.sum("b").cast("double").alias("tt"), F.count("*").alias("kk"))
    return n.join(own, "name", "left").join(F.broadcast(total)).select("name", "package", F.coalesce(F.col("t") * F.col("kk") < F.col("tt") * F.col("k"), F.lit(False)).alias("is_abstract"), F.lit(False).alias("is_trait"))


def coupling_instability(spark, sf_dir):
    c = coupling.coupling(_classes(spark, sf_dir), _edges(spark, sf_dir))
    return c.select("name", "uses", "uses_in_project", "used_by", _r(F.col("instability")).alias("instability"))


def coupling_totals(spark, sf_dir):
    c = coupling.coupling_totals(coupling.coupling(_classes(spark, sf_dir), _edges(spark, sf_dir)))
    return c.select("classes", *[_r(F.col(x)).alias(x) for x in ("avg_uses", "avg_used_by", "avg_instability", "abstractness", "distance")])


def _packages(spark, sf_dir):
    return coupling.packages(_classes(spark, sf_dir), _edges(spark, sf_dir))


def package_abstractness(spark, sf_dir):
    p = _packages(spark, sf_dir)
    return p.select("package", "classes", "uses", "used_by", *[_r(F.col(x)).alias(x) for x in ("abstractness", "instability", "distance")])


def package_cohesion(spark, sf_dir):
    return coupling.cohesion(_classes(spark, sf_dir), _edges(spark, sf_dir))


def ai_scatter(spark, sf_dir):
    p = _packages(spark, sf_dir).select(F.col("package").cast("string").alias("package"), _r(F.col("abstractness"), 2).alias("abstractness"), _r(F.col("instability"), 2).alias("instability"))
    return coupling.same_position(p)


def layer_violations(spark, sf_dir):
    n = _classes(spark, sf_dir).select("name", F.col("package").alias("rank"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("rank"), F.col("r_name").alias("layer"))
    return coupling.layer_violations(n.join(r, "rank"), _edges(spark, sf_dir))


def _nation_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("name")).agg(F.count("*").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("name")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "name", "full").na.fill(0, ["customers", "segments", "suppliers"])


def solid_checks(spark, sf_dir):
    e = _edges(spark, sf_dir)
    c = coupling.coupling(_classes(spark, sf_dir), e).join(_nation_sizes(spark, sf_dir), "name", "left")
    c = c.withColumns({"method_count": F.col("customers") % 40, "lcom": F.col("segments"), "uses": F.col("uses") + F.col("used_by") * 3, "is_interface": F.col("is_abstract")})
    return coupling.solid(c, e).select("name", "srp", "isp", "dip_score", "violations")


def dependency_cycles(spark, sf_dir):
    return graph.cycles(graph.strongly_connected(_edges(spark, sf_dir)))


def dependency_cycle_members(spark, sf_dir):
    scc = graph.strongly_connected(_edges(spark, sf_dir))
    size = scc.groupBy("scc").agg(F.count("*").alias("cycle_length"))
    return scc.join(size, "scc").select("node", "scc", "cycle_length", rules.dependency_cycle(F.col("cycle_length")).alias("level"))


def impact_bfs(spark, sf_dir):
    start = spark.range(1).select(F.lit(7).cast("long").alias("node"))
    return graph.callers(_edges(spark, sf_dir), start, depth=2).select("node", "depth", "path")


def forward_calls(spark, sf_dir):
    return _edges(spark, sf_dir).where("src = 7").select("src", "dst")


def degree_ranking(spark, sf_dir):
    return graph.top_degrees(_edges(spark, sf_dir), 5)


# ---- parts as members and as a tree ----------------------------------------------


def _tree(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return p.select("node", F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / 2).cast("long")).alias("parent"))


def inheritance_depth(spark, sf_dir):
    t = _tree(spark, sf_dir)
    noc = t.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    d = graph.tree_depth(t).join(noc, "node", "left").na.fill(0, ["children"])
    return d.select("node", "depth", "children", rules.deep_inheritance(F.col("depth")).alias("level"))


def dead_members(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_id"), F.col("p_partkey").alias("name"), F.lit(False).alias("is_magic"))
    li = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp'1995-04-01'").select(F.col("l_partkey").alias("name"))
    calls = li.distinct().join(p.select("class_id", "name"), "name")
    dead = nodes.dead_members(p, calls)
    return dead.groupBy("class_id").agg(F.count("*").alias("unused"), F.array_join(F.slice(F.sort_array(F.collect_list("name")).cast("array<string>"), 1, 5), ",").alias("first_five")).withColumn("level", rules.dead_code(F.col("unused")))


def method_calls_weighted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return coupling.called_by(li)


def lcom_components(spark, sf_dir):
    # orders are even nodes and parts odd ones
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "month").alias("month"), (F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return graph.group_components(li, ["l_suppkey", "month"]).withColumn("month", F.date_format("month", "yyyy-MM"))


def type_coverage_weighted(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    slots = F.explode(F.array(
        F.struct(F.lit("param").alias("slot"), (F.col("p_size") > 10).alias("typed")),
        F.struct(F.lit("return").alias("slot"), F.col("p_type").isin("ECONOMY", "SMALL", "PROMO").alias("typed")),
        F.struct(F.lit("property").alias("slot"), (F.col("p_retailprice") > 950).alias("typed")),
    ))
    c = nodes.type_coverage(p.select("p_brand", slots.alias("m")).select("p_brand", "m.slot", "m.typed"), "p_brand")
    return c.withColumn("level", rules.low_type_coverage(F.col("type_coverage")))


def doc_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has"))
    m = d.join(lab, "doc_id", "left").select("lang", F.lit(True).alias("is_public"), F.lit(False).alias("is_magic"), F.coalesce("has", F.lit(False)).alias("has_doc"))
    return nodes.doc_coverage(m, "lang")


def class_members(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_id"), (F.col("p_size") % 3 != 0).alias("is_public"), (F.col("p_size") % 5 == 0).alias("is_static"))
    return nodes.class_members(p)


def too_many_parameters(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parameters"))
    n = n.withColumn("level", rules.too_many_parameters(F.col("parameters")))
    return n.where("level is not null").groupBy("level").agg(F.count("*").alias("orders"), F.max("parameters").alias("most"))


# ---- rules and scores on documents ------------------------------------------------


def _measured(spark, sf_dir):
    """Documents with their measures, the means of their language, churn, tests and class-like counts."""
    # measured once: texts and tokens are gone before anything is joined
    d = cut(_documents(spark, sf_dir).drop("text", "tokens").withColumn("path", F.col("doc_id") % 100))
    mean = d.groupBy("lang").agg(F.avg("effort").alias("mean_effort"), F.avg("mi").alias("mean_mi"))
    churned = _log(spark, sf_dir).groupBy("path").agg(F.countDistinct("commit").alias("churn"), F.countDistinct("author").alias("authors"))
    tested = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("has_test"))
    out = d.join(mean, "lang").join(churned, "path", "left").join(tested, "doc_id", "left").na.fill(0, ["churn", "authors"])
    return cut(out.withColumns({"has_test": F.coalesce("has_test", F.lit(False)), "uses": F.col("unique_operands") % 40, "lcom": F.col("operators") % 4}))


def _rules(d: DataFrame) -> dict:
    c = F.col
    signs, god = rules.god_class(c("cc"), c("uses"), c("lcom"), c("lloc") > 20)
    return {
        "too_long": rules.too_long(c("lloc"), 20),
        "god_class": god,
        "too_complex_cc": rules.complex_cc(c("cc"), c("lloc")),
        "too_complex_difficulty": rules.complex_difficulty(c("difficulty"), c("lloc")),
        "too_complex_effort": rules.complex_effort(c("effort"), c("mean_effort"), c("lloc")),
        "too_complex_mi": rules.complex_mi(c("mi"), c("mean_mi"), c("lloc")),
        "too_dependent": rules.too_dependent(c("uses"), rules.Thresholds().class_uses),
        "untested_complex": rules.untested_complex(c("cc"), c("has_test"), c("lang") == "es"),
        "hotspot": rules.hotspot(c("churn"), c("cc")),
    }


def _problems(spark, sf_dir):
    d = _measured(spark, sf_dir)
    return rules.problems(d, "doc_id", _rules(d))


def problem_rows(spark, sf_dir):
    return _problems(spark, sf_dir).select(F.col("entity").alias("doc_id"), "rule", "level")


def _one_rule(name):
    def query(spark, sf_dir):
        d = _measured(spark, sf_dir)
        return rules.problems(d, "doc_id", {k: v for k, v in _rules(d).items() if k == name or k.startswith(name + "_")}).select(F.col("entity").alias("doc_id"), "rule", "level")

    return query


too_long, too_complex, too_dependent, god_class, untested_complex = (_one_rule(n) for n in ("too_long", "too_complex", "too_dependent", "god_class", "untested_complex"))


def problem_union_counts(spark, sf_dir):
    return rules.by_level(_problems(spark, sf_dir))


def rule_counts(spark, sf_dir):
    return rules.counts(_problems(spark, sf_dir).withColumn("rule", F.regexp_replace("rule", "^too_complex_.*", "too_complex")))


def technical_debt(spark, sf_dir):
    d = _measured(spark, sf_dir)
    found = rules.problems(d, "doc_id", _rules(d))
    return scores.debt(d.select("doc_id", "lloc"), found, entity="doc_id").select("doc_id", "points", "debt")


def _project(spark, sf_dir):
    d = _measured(spark, sf_dir)
    one = d.agg(F.count("*").alias("files"), F.avg("mi").alias("avg_mi"), F.avg("cc").alias("avg_cc"), F.sum("lloc").alias("lloc"), F.sum("loc").alias("loc"), F.sum(F.when(F.col("lang") == "es", F.col("lloc")).otherwise(0)).alias("lloc_outside"), F.sum("cloc").alias("html_loc"), F.count_if("has_test").alias("tested"))
    p = rules.by_level(rules.problems(d, "doc_id", _rules(d))).agg(F.coalesce(F.max(F.when(F.col("level") == "ERROR", F.col("n"))), F.lit(0)).alias("errors"), F.coalesce(F.max(F.when(F.col("level") == "WARNING", F.col("n"))), F.lit(0)).alias("warnings"))
    totals = coupling.coupling_totals(coupling.coupling(_classes(spark, sf_dir), _edges(spark, sf_dir))).select("classes", "distance", "abstractness")
    found = graph.cycles(graph.strongly_connected(_edges(spark, sf_dir))).agg(F.count("*").alias("cycles"), F.coalesce(F.sum("cycle_length"), F.lit(0)).alias("classes_in_cycles"))
    members = nodes.class_members(table(spark, sf_dir, "part").select(F.lit(1).alias("class_id"), (F.col("p_size") % 3 != 0).alias("is_public"), (F.col("p_size") % 5 == 0).alias("is_static")))
    members = members.select(F.col("method_count").alias("methods"), F.col("public_count").alias("public_methods"), F.col("static_count").alias("static_methods"))
    for part in (p, totals, found, members):  # one row each
        one = one.join(F.broadcast(part))
    return one.withColumn("test_score", 100.0 * F.col("tested") / F.col("files"))


def health_score(spark, sf_dir):
    return scores.health(_project(spark, sf_dir)).select(_r(F.col("health_score"), 4).alias("health_score"), "health_grade", "errors", "warnings", "cycles", "classes_in_cycles")


def _prioritised(spark, sf_dir):
    d = _measured(spark, sf_dir)
    c = rules.problems(d, "doc_id", _rules(d)).groupBy(F.col("entity").alias("doc_id")).agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARNING").alias("warnings"), F.count_if(F.col("level") == "INFO").alias("infos"))
    d = d.join(c, "doc_id", "left").na.fill(0, ["errors", "warnings", "infos"])
    d = d.withColumns({
        "in_cycle": F.col("doc_id") % 7 == 0, "cycle_length": F.when(F.col("doc_id") % 7 == 0, 3).otherwise(0).cast("long"), "layer_violations": F.col("doc_id") % 3,
        "solid_violations": F.col("doc_id") % 2, "used_by": F.col("unique_operators"), "age_days": F.col("doc_id") % 400,
    })
    return scores.priority(d)


def refactoring_priority(spark, sf_dir):
    return _prioritised(spark, sf_dir).select("doc_id", "priority", scalars.urgency(F.col("priority")).alias("urgency"), "drivers", F.md5("recommendation").alias("recommendation_md5"))


def score_distribution(spark, sf_dir):
    return _prioritised(spark, sf_dir).groupBy(scalars.score_band(F.col("priority")).alias("band")).agg(F.count("*").alias("n"))


def priority_totals(spark, sf_dir):
    return scores.priority_totals(_prioritised(spark, sf_dir))


def refactoring_ranking(spark, sf_dir):
    p = _prioritised(spark, sf_dir).where("priority > 0").select("doc_id", "priority", "cc")
    return p.orderBy(F.desc("priority"), "doc_id").limit(15)


# ---- tests and coverage --------------------------------------------------------


def test_mapping(spark, sf_dir):
    classes = table(spark, sf_dir, "documents").select(F.concat(F.lit("Corpus\\"), "lang", F.lit("\\D"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("short"))
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    tests = b.select(
        i.alias("test"),
        F.when(i % 4 == 0, F.array(F.concat(F.lit("D"), (i * 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("covers"),
        F.array(F.concat(F.lit("Corpus\\en\\D"), (i + 1).cast("string"))).alias("uses"),
        F.when(i % 3 == 0, "unit").when(i % 3 == 1, "integration").otherwise("unknown").alias("test_type"),
        F.concat(F.lit("Corpus\\en\\Tests\\D"), i.cast("string"), F.lit("Test")).alias("fqcn"),
    )
    m = testmap.mapping(tests, classes)
    cov = testmap.coverage(m, tests, classes.withColumn("is_abstract", F.lit(False)))
    return cov.where("has_test").select("name", "tests", "test_type")


def coverage_totals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("statements"), (F.col("lang") == "es").alias("is_abstract"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("line_rate"))
    c = d.join(lab, "doc_id", "left").withColumn("has_test", F.coalesce(F.col("line_rate") == 1, F.lit(False)))
    return testmap.totals(c)


def coverage_suffix_join(spark, sf_dir):
    pages = _paths(spark, sf_dir).select("page_id", "path")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("doc_path"))
    return testmap.suffix_join(pages, docs, left_path="path", right_path="doc_path").select("page_id", "doc_id")


def coverage_gaps(spark, sf_dir):
    d = text.cyclomatic(text.tokens(table(spark, sf_dir, "documents"))).select(F.col("doc_id").alias("name"), "cc")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.lit(True).alias("has_test"))
    return testmap.gaps(d.join(lab, "name", "left").withColumn("has_test", F.coalesce("has_test", F.lit(False)))).select("name", "cc")


# ---- the property graph and the query surface ------------------------------------


def _graph_nodes(spark, sf_dir):
    def of(name, kind, key, label):
        return table(spark, sf_dir, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"))

    return of("region", "package", "r_regionkey", "r_name").union(of("nation", "class", "n_nationkey", "n_name")).union(of("supplier", "function", "s_suppkey", "s_name")).union(of("part", "method", "p_partkey", "p_name")).union(of("customer", "author", "c_custkey", "c_name"))


def _graph_edges(spark, sf_dir):
    def node(kind, c):
        return F.concat(F.lit(kind + ":"), F.col(c).cast("string"))

    n, s, c, li = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "lineitem"))
    belongs = n.select(node("class", "n_nationkey").alias("source"), node("package", "n_regionkey").alias("target"), F.lit("belongs_to").alias("type"), F.lit(1).cast("long").alias("weight"))
    declares = s.select(node("class", "s_nationkey").alias("source"), node("function", "s_suppkey").alias("target"), F.lit("declares").alias("type"), F.lit(1).cast("long").alias("weight"))
    authored = c.select(node("class", "c_nationkey").alias("source"), node("author", "c_custkey").alias("target"), F.lit("authored_by").alias("type"), F.lit(1).cast("long").alias("weight"))
    depends = _edges(spark, sf_dir).select(node("class", "src").alias("source"), node("class", "dst").alias("target"), F.lit("depends_on").alias("type"), F.lit(1).cast("long").alias("weight"))
    calls = li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight")).select(node("method", "l_partkey").alias("source"), node("function", "l_suppkey").alias("target"), F.lit("calls").alias("type"), "weight")
    return belongs.unionByName(declares).unionByName(authored).unionByName(depends).unionByName(calls)


def knowledge_graph_nodes(spark, sf_dir):
    return _graph_nodes(spark, sf_dir)


def knowledge_graph_edges(spark, sf_dir):
    return _graph_edges(spark, sf_dir)


def graph_histogram(spark, sf_dir):
    a = _graph_nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    return a.unionByName(_graph_edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).withColumn("part", F.lit("edge")))


def graph_clusters(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.groupBy(F.col("n_regionkey").cast("long").alias("package")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("members"))


def class_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%ring%")).select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"))
    return p.orderBy(F.desc("p_size"), "p_partkey").limit(50)


def search_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("customer#00000012"))).select("c_custkey", "c_name")
    return c.orderBy("c_name").limit(20)


def entity_metrics(spark, sf_dir):
    """Metrics of matching parts, one row for each metric."""
    p = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("widget"))).select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "metric", "value")


def class_dependencies(spark, sf_dir):
    e = _edges(spark, sf_dir)
    out = e.where("src = 3").select(F.lit("out").alias("direction"), F.col("dst").alias("other"))
    return out.union(e.where("dst = 3").select(F.lit("in").alias("direction"), F.col("src").alias("other")))


def sarif_results(spark, sf_dir):
    from ..sources.reports import sarif

    found = _problems(spark, sf_dir).select("rule", "level", F.col("entity").cast("string").alias("path"), F.lit(1).alias("line"), F.concat_ws(" ", "rule", F.col("entity").cast("string")).alias("message"))
    return sarif(found).select("rule_id", "n_results", F.md5("results").alias("results_md5"))
