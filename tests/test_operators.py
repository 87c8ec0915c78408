"""Metric operators against hand-calculated vectors and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataspark.functions import scalars
from strataspark.operators import coupling, duplication, graph, history, nodes, rollup, rules, scores, testmap, text


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("v,cc,lloc,loc,cloc,mi,weight", [(13.9316, 1, 1, 3, 0, 157.07238159728848, 0.0), (13.9316, 1, 4, 5, 1, 166.54990347999657, 31.935490532850302), (0.0, 1, 1, 3, 1, 171.0, 0.0), (5.0, 1, 0, 0, 0, 171.0, 0.0)])
def test_maintainability(spark, v, cc, lloc, loc, cloc, mi, weight):
    r = value(spark, scalars.maintainability(*map(F.lit, (v, cc, lloc, loc, cloc))))
    assert r.mi == pytest.approx(mi, abs=1e-4) and r.comment_weight == pytest.approx(weight)


def test_halstead_vector(spark):
    rows = [("operator", x) for x in ("assign", "plus", "return")] + [("operand", x) for x in ("a", "b", "param", "param", "sum", "a", "b", "sum")]
    df = spark.createDataFrame([(1, r, v) for r, v in rows], "func_id long, role string, value string")
    h = one(nodes.halstead(df, "func_id"))
    assert (h.vocabulary, h.length, h.difficulty) == (7, 11, 3.0)
    assert h.calc_length == pytest.approx(19.651484454403228) and h.volume == pytest.approx(30.880904142633646)
    assert h.effort == pytest.approx(92.64271242790093) and h.complexity_density == pytest.approx(1 / 6)


def test_text_measures(spark):
    df = spark.createDataFrame([(1, "# note\n\nWalk and talk. Or not!"), (2, ""), (3, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in text.documents(df).collect()}
    assert (r[1].loc, r[1].cloc, r[1].lloc, r[1].cc) == (3, 1, 1, 3)
    assert (r[2].loc, r[2].lloc, r[2].cc, r[2].mi, r[2].volume) == (1, 1, 1, 171.0, 0.0) and r[3].lloc == 1
    assert r[1].operators == 2 and r[1].unique_operands == r[1].operands == 7


def test_scalars(spark):
    assert value(spark, scalars.layer_rank(F.lit("App\\Service\\Domain\\User"))) == 0
    assert value(spark, scalars.layer_rank(F.lit("App\\Controller\\X"))) == 3 and value(spark, scalars.layer_rank(F.lit("A\\B"))) is None
    assert value(spark, scalars.package_of(F.lit("A\\B\\C"))) == "A\\B" and value(spark, scalars.package_of(F.lit(""))) == "_global"
    assert [value(spark, scalars.without_test_suffix(F.lit(x))) for x in ("UserTest", "UserTests", "UserSpec", "Tester")] == ["User", "User", "User", "Tester"]
    assert [value(spark, scalars.grade(F.lit(x))) for x in (90, 89.9, 65, 50, 49)] == ["A", "B", "C", "D", "F"]
    assert [value(spark, scalars.urgency(F.lit(x))) for x in (76, 75, 50, 25)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    for pattern, name, hit in (("*Controller", "UserController", True), ("*Controller", "ControllerX", False), ("a?c", "abc", True), ("[!x]*", "xa", False), ("a.b", "axb", False)):
        assert value(spark, scalars.glob(F.lit(name), pattern)) is hit
    assert value(spark, scalars.rule_slug(F.lit("Too long: 12/3!"), F.lit("size"))) == "STR/size/Too-long-12-3"
    assert value(spark, scalars.short_name(F.lit("A\\B\\C"))) == "C" and value(spark, scalars.show(F.lit(12.345), "percentage")) in ("12.35%", "12.34%")


def _classes(spark, names, package="p", traits=()):
    return spark.createDataFrame([(n, package, False, n in traits) for n in names], "name string, package string, is_abstract boolean, is_trait boolean")


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_coupling_vectors(spark):
    edges = _edges(spark, [("A", "B"), ("A", "C"), ("C", "B"), ("D", "T"), ("A", "A"), ("A", "B")])
    got = {r.name: (r.instability, r.uses_in_project, r.used_by) for r in coupling.coupling(_classes(spark, "ABCDT"), edges).collect()}
    assert got == {"A": (1.0, 2, 0), "B": (0.0, 0, 2), "C": (0.5, 1, 1), "D": (1.0, 1, 0), "T": (0.0, 0, 1)}
    assert {r.name: r.uses_in_project for r in coupling.coupling(_classes(spark, "ABCDT", traits="T"), edges).collect()}["D"] == 0
    t = one(coupling.coupling_totals(coupling.coupling(_classes(spark, "AB"), _edges(spark, [("A", "B")]))))
    assert (t.avg_uses, t.avg_instability, t.abstractness, t.distance) == (0.5, 0.5, 0.0, 0.5)


def test_packages_and_cohesion(spark):
    c = spark.createDataFrame([("A", "p", True, False), ("B", "p", False, False), ("C", "q", False, False), ("S", "r", False, False)], "name string, package string, is_abstract boolean, is_trait boolean")
    e = _edges(spark, [("A", "C"), ("B", "C"), ("B", "A"), ("S", "A")])
    p = {r.package: r for r in coupling.packages(c, e).collect()}
    assert (p["p"].uses, p["p"].used_by, p["p"].abstractness, p["p"].instability) == (1, 1, 0.5, 0.5) and p["q"].used_by == 2
    h = {r.package: r.cohesion for r in coupling.cohesion(c, e).collect()}
    assert h == {"p": 1.0, "q": 1.0, "r": 1.0}


SCC_CASES = [
    ([("A", "B"), ("A", "C"), ("B", "C")], set()), ([("A", "B"), ("B", "A")], {"A,B"}), ([("A", "B"), ("B", "C"), ("C", "A")], {"A,B,C"}),
    ([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("E", "A")], {"A,B", "C,D"}),
]


@pytest.mark.parametrize("edges,want,small", [(*c, 1000) for c in SCC_CASES] + [(*SCC_CASES[3], 0)])
def test_strongly_connected(spark, edges, want, small):
    found = graph.cycles(graph.strongly_connected(_edges(spark, edges), small=small))
    assert {r.members for r in found.collect()} == want


def test_strongly_connected_against_reachability(spark):
    rng = random.Random(3)
    for n_nodes, n_edges, small in ((14, 22, 1000), (6, 8, 0)):
        e = list({(rng.randrange(n_nodes), rng.randrange(n_nodes)) for _ in range(n_edges)})
        reach = {(a, b) for a, b in e}
        for k in range(n_nodes):
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c == k}
        got = {r.node: r.scc for r in graph.strongly_connected(spark.createDataFrame([x for x in e if x[0] != x[1]], "src long, dst long"), small=small).collect()}
        for n in got:
            assert got[n] == min([n, *[m for m in got if (n, m) in reach and (m, n) in reach]])


def test_tree_depth_and_callers(spark):
    t = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("x", "outside"), ("y", "x"), ("m", "n"), ("n", "m")], "node string, parent string")
    assert {r.node: r.depth for r in graph.tree_depth(t).collect()} == {"r": 0, "a": 1, "b": 2, "c": 3, "x": 1, "y": 2, "m": 0, "n": 0}
    calls = _edges(spark, [("B::m2", "A::m1"), ("C::m3", "B::m2")])
    start = spark.createDataFrame([("A::m1",)], "node string")
    assert {r.node for r in graph.callers(calls, start, depth=1).collect()} == {"B::m2"}
    assert {(r.node, r.depth, r.path) for r in graph.callers(calls, start, depth=2).collect()} == {("B::m2", 1, "B::m2>A::m1"), ("C::m3", 2, "C::m3>B::m2>A::m1")}


def test_group_components(spark):
    e = spark.createDataFrame([(1, "f", "p"), (1, "g", "p"), (1, "h", "q"), (2, "f", "f")], "class_id long, a string, b string")
    assert {r.class_id: (r.components, r.nodes, r.largest) for r in graph.group_components(e, ["class_id"]).collect()} == {1: (2, 5, 3), 2: (1, 1, 1)}


def test_group_components_in_order(spark, monkeypatch):
    """Groups are solved in one exchange, without loops of joins; those with too many edges go through the joins, with equal results."""
    rng = random.Random(3)
    rows = [(g, None if g == 7 else f"m{g % 3}", rng.randrange(40), 100 + rng.randrange(40)) for g in range(30) for _ in range(rng.choice((1, 5, 30, 60)))]
    rows += [(None, "m", 1, 2), (None, "m", 2, 3), (99, "m", 5, 5)] + [(98, "m", i, i + 1) for i in range(200)]
    want = {}
    for key in {r[:2] for r in rows}:
        up = {}
        for _, _, a, b in (r for r in rows if r[:2] == key):
            ends = up.setdefault(a, {a}) | up.setdefault(b, {b})
            up |= dict.fromkeys(ends, ends)
        sets = {frozenset(x) for x in up.values()}
        want[key] = (len(sets), len(up), max(map(len, sets)))
    e = spark.createDataFrame(rows, "g long, h string, a long, b long").repartition(5)

    def got(**more):
        return {(r.g, r.h): (r.components, r.nodes, r.largest) for r in graph.group_components(e, ["g", "h"], **more).collect()}

    assert got(most=25) == want
    monkeypatch.setattr(graph, "components", None)
    assert got() == want


def test_duplication(spark):
    a = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, 4), (2, a, 100), (3, "short text", 2), (4, " ".join(f"v{i}" for i in range(60)), 3), (5, "z " * 120, 3)], "doc_id long, text string, loc long")
    got = {r.doc_id: (r.duplicated_lines, r.duplication_rate) for r in duplication.duplication(text.tokens(df), key="doc_id").collect()}
    assert got == {1: (4, 100.0), 2: (11, 11.0), 3: (0, 0.0), 4: (0, 0.0), 5: (0, 0.0)}


def test_rollups(spark):
    df = spark.createDataFrame([("a", 3), ("b", 7), ("c", 7), ("d", None)], "name string, v long")
    assert tuple(one(rollup.most(df, "x", "name", "v"))) == ("x", "b, c", 7)
    assert tuple(one(rollup.most(df.limit(0), "x", "name", "v")))[1] == "-"
    assert tuple(one(rollup.limits(df, "x", ["v"]))) == ("x", "v", 0.0, 7.0, 4.25)
    p = spark.createDataFrame([("src/a/x.php",), ("src/a/y.php",), ("src/b",)], "path string")
    assert one(rollup.common_prefix(p, "path")).common_path == "src"
    c = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 3), (2, "a", 4)], "test long, name string, prio int")
    assert {(r.test, r.name) for r in rollup.first_by_priority(c, "test").collect()} == {(1, "a"), (1, "b"), (2, "a")}


T = rules.Thresholds()
BOUNDARIES = [
    (lambda x: rules.too_long(x, T.long_class), 300, 301, "WARNING"), (lambda x: rules.complex_cc(x, F.lit(20)), 10, 11, "ERROR"), (lambda x: rules.complex_cc(x, F.lit(21)), 20, 21, "ERROR"),
    (lambda x: rules.complex_difficulty(x, F.lit(6)), 30, 31, "ERROR"), (lambda x: rules.complex_difficulty(F.lit(99), x), 5, 6, "ERROR"), (lambda x: rules.complex_effort(x, F.lit(100.0), F.lit(9)), 130, 131, "WARNING"),
    (lambda x: rules.complex_mi(100 - x, F.lit(100.0), F.lit(9)), 20, 21, "WARNING"), (lambda x: rules.complex_lcom(x, F.lit(2.0), F.lit(False)), 2, 3, "WARNING"), (lambda x: rules.too_dependent(x, T.class_uses), 20, 21, "INFO"),
    (lambda x: rules.too_much_html(x, F.lit(0), T.html_class, T.output_class), 10, 11, "WARNING"), (lambda x: rules.low_type_coverage(100 - x), 40, 41, "WARNING"), (lambda x: rules.low_type_coverage(100 - x), 60, 61, "ERROR"),
    (lambda x: rules.deep_inheritance(x), 3, 4, "WARNING"), (lambda x: rules.deep_inheritance(x), 5, 6, "ERROR"), (lambda x: rules.too_many_parameters(x), 4, 5, "WARNING"), (lambda x: rules.too_many_parameters(x), 7, 8, "ERROR"),
    (lambda x: rules.dependency_cycle(x), 1, 2, "ERROR"), (lambda x: rules.dead_code(x), 0, 1, "INFO"), (lambda x: rules.untested_complex(x, F.lit(False), F.lit(False)), 7, 8, "WARNING"),
    (lambda x: rules.hotspot(x, F.lit(15)), 9, 10, "WARNING"), (lambda x: rules.hotspot(F.lit(10), x), 14, 15, "WARNING"),
]


def test_rule_boundaries(spark):
    cols = [f(F.lit(v)).alias(f"c{i}_{k}") for i, (f, lo, hi, _) in enumerate(BOUNDARIES) for k, v in enumerate((lo, hi))]
    r = spark.range(1).select(*cols).first()
    for i, (_, lo, hi, level) in enumerate(BOUNDARIES):
        assert r[f"c{i}_0"] != level and r[f"c{i}_1"] == level, (i, lo, hi)


def test_god_class_counts_and_gate(spark):
    signs, level = rules.god_class(F.lit(11), F.lit(11), F.lit(1), F.lit(True))
    assert value(spark, signs) == 3 and value(spark, level) == "ERROR"
    assert value(spark, rules.god_class(F.lit(10), F.lit(11), F.lit(1), F.lit(True))[1]) is None
    found = spark.createDataFrame([("a", "god_class", "ERROR"), ("a", "too_long", "WARNING"), ("b", "deep_inheritance", "ERROR")], "entity string, rule string, level string")
    assert {r.rule: r.count_level for r in rules.counts(found).collect()} == {"god_class": "ERROR", "too_long": "WARNING", "deep_inheritance": "WARNING"}
    levels = rules.by_level(found)
    assert {r.level: r.n for r in levels.collect()} == {"ERROR": 2, "WARNING": 1, "Total": 3}
    assert rules.fails_gate(levels, fail_on="error") and not rules.fails_gate(levels, max_errors=2) and rules.fails_gate(levels, max_warnings=0)
    for name, kind, methods, skip in (("X", "class", 5, False), ("FooException", "class", 5, True), ("X", "trait", 5, True), ("X", "class", 1, True)):
        assert value(spark, rules.skips_lcom(F.lit(name), F.lit(kind), F.lit(methods))) is skip


HEALTH = ["avg_mi", "errors", "warnings", "classes", "files", "avg_cc", "distance", "lloc", "lloc_outside", "html_loc", "loc", "methods", "public_methods", "static_methods", "classes_in_cycles", "cycles", "abstractness"]


@pytest.mark.parametrize("row,score,grade", [
    ((95.0, 5, 10, 100, 50, 2.5, 0.1, 5000, 250, 0, 8000, 500, 325, 25, 0, 0, 0.12), 93.2, "A"),
    ((139.0, 7743, 2561, 673, 2214, 3.77, -0.26, 82569, 16000, 180080, 305381, 6593, 5487, 1926, 79, 5, 0.05), 60.6, "D"),
    ((85.0, 30, 50, 80, 40, 5.0, 0.2, 4000, 400, 500, 10000, 300, 240, 30, 0, 0, 0.05), 77.1, "C"),
])
def test_health(spark, row, score, grade):
    df = spark.createDataFrame([row], ", ".join(f"{c} {'double' if isinstance(v, float) else 'long'}" for c, v in zip(HEALTH, row))).withColumn("test_score", F.lit(None).cast("double"))
    r = one(scores.health(df))
    assert r.health_score == pytest.approx(score, abs=0.06) and r.health_grade == grade


PRIORITY = ["cc", "lcom", "lloc", "errors", "warnings", "infos", "cycle_length", "layer_violations", "solid_violations", "used_by", "churn", "authors", "age_days"]


@pytest.mark.parametrize("over,low,high", [
    ({"cc": 1, "lloc": 20}, 0, 0),
    ({"cc": 45, "lcom": 5, "lloc": 400, "used_by": 15, "cycle_length": 4, "layer_violations": 2, "solid_violations": 2, "errors": 4, "churn": 25, "authors": 5, "age_days": 30}, 60, 100),
    ({"cc": 12, "lcom": 2, "lloc": 80, "warnings": 1}, 0.1, 25), ({"cc": 30, "lcom": 3, "lloc": 200, "errors": 1}, 0.1, 50),
    ({k: 10_000 for k in PRIORITY}, 90, 100),
])
def test_priority(spark, over, low, high):
    row = {k: over.get(k, 0) for k in PRIORITY}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in PRIORITY)).withColumns({"in_cycle": F.col("cycle_length") > 0, "has_test": F.lit(False)})
    r = one(scores.priority(df))
    assert low <= r.priority <= high
    if high > 50:
        assert "untested" in r.drivers and "high complexity" in r.drivers


@pytest.mark.parametrize("cc,lcom,used_by,churn,score", [(0, 3, 0, 10, 3.5), (8, 3, 10, 20, 7.7), (11, 3, 1, 19, 8.0)])
def test_priority_is_rounded_by_its_product(spark, cc, lcom, used_by, churn, score):
    """3.4499999999999997 and the like: times ten they are 34.5."""
    row = {k: 0 for k in PRIORITY} | {"cc": cc, "lcom": lcom, "used_by": used_by, "churn": churn}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in PRIORITY)).withColumns({"in_cycle": F.lit(False), "has_test": F.lit(False)})
    assert one(scores.priority(df)).priority == score
    assert one(scores.priority_totals(spark.createDataFrame([(3.4499999999999997,)], "priority double"))).avg_priority == 3.5


def test_debt(spark):
    e = spark.createDataFrame([("a", 50), ("b", 0), ("c", 10)], "entity string, lloc long")
    p = spark.createDataFrame([("a", "ERROR"), ("a", "INFO"), ("b", "ERROR")], "entity string, level string")
    assert {r.entity: (r.points, r.debt) for r in scores.debt(e, p).collect()} == {"a": (3.5, 7.0), "b": (3.0, 0.0), "c": (0.0, 0.0)}


def test_comparisons(spark):
    before = spark.createDataFrame([("Foo", "existing", "error")], "entity string, message string, level string")
    after = before.union(spark.createDataFrame([("Bar", "new issue", "warning")], before.schema))
    assert [r.change for r in history.problem_changes(before, after).collect()] == ["new"]
    assert [r.change for r in history.problem_changes(after, before).collect()] == ["resolved"]
    assert history.check_baseline(before, after) == (1, 0, False)
    m = spark.createDataFrame([("cc", 5.0, "low"), ("mi", 80.0, "high"), ("loc", 10.0, "none")], "metric string, value double, better string")
    n = spark.createDataFrame([("cc", 4.0, "low"), ("mi", 81.5, "high"), ("loc", 12.0, "none")], "metric string, value double, better string")
    assert {r.metric: (r.delta, r.improvement) for r in history.compare_metrics(m, n).collect()} == {"cc": (-1.0, 1.0), "mi": (1.5, 1.5), "loc": (2.0, 0.0)}
    runs = spark.createDataFrame([("cc", "1", 5.0, "low"), ("cc", "2", 4.0, "low"), ("cc", "3", 4.0, "low")], "metric string, run string, value double, better string")
    assert [(r.delta, r.direction, r.is_better) for r in history.run_deltas(runs).orderBy("run").collect()] == [(None, None, None), (-1.0, "down", True), (0.0, "sideways", None)]


def test_test_mapping(spark):
    classes = spark.createDataFrame([("App\\User", "User"), ("App\\Order", "Order"), ("Lib\\User", "User")], "name string, short string")
    tests = spark.createDataFrame([
        ("t1", ["App\\Order"], [], "unit", "App\\Tests\\UserTest"), ("t2", ["User"], [], "unit", "X\\YTest"), ("t3", [], ["App\\Order"], "integration", "X\\ZTest"),
        ("t4", [], ["App\\Order"], "unit", "App\\Tests\\UserTest"), ("t5", [], [], "unknown", "Else\\OrderTest"),
    ], "test string, covers array<string>, uses array<string>, test_type string, fqcn string")
    m = testmap.mapping(tests, classes)
    assert {(r.test, r.name, r.prio) for r in m.collect()} == {("t1", "App\\Order", 1), ("t2", "App\\User", 1), ("t2", "Lib\\User", 1), ("t3", "App\\Order", 2), ("t4", "App\\User", 3), ("t5", "App\\Order", 4)}
    c = {r.name: (r.tests, r.test_type) for r in testmap.coverage(m, tests, classes).collect()}
    assert c["App\\Order"] == (3, "unit") and c["Lib\\User"] == (1, "unit")
    left = spark.createDataFrame([("src/a/b.php",), ("b.php",), ("zz.php",)], "path string")
    right = spark.createDataFrame([("/x/src/a/b.php", 1.0), ("a/b.php", 0.5)], "file string, rate double")
    assert {r.path: r.file for r in testmap.suffix_join(left, right, left_path="path", right_path="file").collect()} == {"src/a/b.php": "/x/src/a/b.php", "b.php": "a/b.php"}


def test_nodes(spark):
    rows = [(1, k, v, n, d) for k, v, n, d in [("if", None, 0, 0), ("for", None, 1, 1), ("boolean", None, 0, 0), ("call", "md5", 0, 1), ("call", "eval", 0, 2), ("echo", None, 0, 0), ("default", None, 0, 0)]]
    df = spark.createDataFrame(rows, "func_id long, kind string, value string, nest_depth int, loop_depth int").withColumns({"start_line": F.lit(3), "end_line": F.lit(4)})
    assert one(nodes.cyclomatic(df, "func_id")).cc == 3 and one(nodes.cognitive(df, "func_id")).cognitive_complexity == 4
    assert one(nodes.runtime_depth(df, "func_id")).runtime == "O(n²)" and one(nodes.output_count(df, "func_id")).output_count == 1
    s = one(nodes.security_smells(df, "func_id"))
    assert (s.smell_count, s.level, s.smells) == (2, "ERROR", ["eval:3", "md5:3"])
    t = spark.createDataFrame([(1, "param", True), (1, "param", False), (1, "return", True)], "c long, slot string, typed boolean")
    assert one(nodes.type_coverage(t, "c")).type_coverage == pytest.approx(round(100 * (0.4167 * 0.5 + 0.5833), 2))


def test_partitioning_changes_nothing(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice("and or if the cat dog".split()) for _ in range(rng.randint(0, 80)))) for i in range(60)], "doc_id long, text string")
    a = text.documents(df.repartition(1)).drop("tokens").collect()
    b = text.documents(df.repartition(7)).drop("tokens").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and not any(math.isnan(r.mi) for r in a)
