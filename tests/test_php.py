"""The PHP reader against counts made by hand on small programs."""

import pytest
from pyspark.sql import functions as F

from strataspark.operators import coupling, duplication, graph, nodes, text
from strataspark.sources import php

CODE = r'''<?php
namespace App\Service;

use App\Model\{User, Order as Sale};
use Lib\Base;

/** Adds.
 *
 * @param int $a first
 */
function add(int $a, $b = 1) { $sum = $a + $b; return $sum; }

function decide($x, $y) {
    if ($x && $y && $x > 2) {          // 1 + boolean sequence
        foreach ($y as $k) {           // nested once
            while ($k < 3) { $k++; }   // nested twice
        }
    } elseif ($x || $y) {
        return $x ? 1 : 2;
    } else {
        switch ($x) { case 1: break; case 2: break; default: break; }
    }
    try { eval('x'); } catch (\Exception $e) { echo md5($x ?? ''); }
    return match (true) { $x > 1 => 'a', default => fn($q) => $q <=> $y };
}

abstract class Runner extends Base implements \Countable {
    use Loud;
    const LIMIT = 3;
    private int $n = 0;
    protected $loose;
    public function __construct(private User $user, ?Sale $sale = null) { $this->n = 1; }
    /** Counts. */
    public function count(): int { return $this->n + $this->twice(); }
    private function twice(): int { return 2 * $this->n; }
    private function unused() { return Sale::LIMIT; }
    public function make() { $o = new Sale(1); Helper::go($o); return self::LIMIT; }
    abstract public function go(Missing|null $m): void;
}
interface Marker { const A = 1; public function mark(); }
enum Suit: string { case Hearts = 'H'; }
?>
<p>html</p>
<?= $done ?>
'''


@pytest.fixture(scope="module")
def recs(spark):
    rows = [(1, "a.php", CODE), (2, "bad.php", "<?php function f( {"), (3, "empty.php", ""), (4, "page.php", "<html>\n<b>x</b>\n</html>"), (5, "null.php", None)]
    return php.records(spark.createDataFrame(rows, "file_id long, path string, content string")).cache()


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_files_and_errors(recs):
    assert [r.path for r in php.view(recs, "error").collect()] == ["bad.php"]
    f = {r.path: (r.end_line, r.params) for r in php.view(recs, "file").collect()}
    assert f["page.php"] == (3, 3) and f["a.php"][1] == 1 and f["empty.php"] == (0, 0) and set(f) == {"a.php", "empty.php", "page.php", "null.php"}


def test_entities(recs):
    c = {r.name: r for r in php.classes(recs).collect()}
    assert set(c) == {"App\\Service\\Runner", "App\\Service\\Marker", "App\\Service\\Suit"}
    r = c["App\\Service\\Runner"]
    assert r.is_abstract and r.package == "App\\Service" and c["App\\Service\\Marker"].kind == "interface"
    f = {x.func_id: x for x in php.functions(recs).collect()}
    add = f["App\\Service\\add"]
    assert (add.params, add.optional, add.typed_params, add.described_params, add.has_doc) == (2, 1, 1, 1, True)
    ctor = f["App\\Service\\Runner::__construct"]
    assert (ctor.params, ctor.optional, ctor.nullable_params) == (1, 1, 1)
    assert not f["App\\Service\\Runner::twice"].is_public and f["App\\Service\\Runner::go"].is_abstract and f["App\\Service\\Runner::go"].lloc == 0
    m = {(r.kind, r.name): r.typed for r in php.view(recs, "member").collect()}
    assert m["property", "n"] and not m["property", "loose"] and m["property", "user"] and ("constant", "LIMIT") in m


def test_complexity(recs):
    n = php.nodes(recs)
    cc = by(nodes.cyclomatic(n, "func_id"), "func_id", "cc")
    # if, foreach, while, elseif, ternary, two cases, catch, coalesce, match, spaceship
    assert cc["App\\Service\\decide"] == 12 and cc["App\\Service\\add"] == 1
    cog = by(nodes.cognitive(n, "func_id"), "func_id", "cognitive_complexity")
    # if 1, && 1, foreach 2, while 3, elseif 1, || 1, ternary 2, else 1, switch 2, catch 1, ?? 1, match 1
    assert cog["App\\Service\\decide"] == 17 and cog["App\\Service\\add"] == 0
    run = by(nodes.runtime_depth(n, "func_id"), "func_id", "runtime")
    assert run["App\\Service\\decide"] == "O(n²)" and run["App\\Service\\add"] == "O(1)"
    s = {r.func_id: (r.smell_count, r.level) for r in nodes.security_smells(n, "func_id").collect()}
    assert s == {"App\\Service\\decide": (2, "ERROR")}


def test_halstead(recs):
    h = {r.func_id: r for r in nodes.halstead(php.nodes(recs).where("func_id is not null"), "func_id").collect()}["App\\Service\\add"]
    # operators assign, +, return; operands param twice, $a and $b with a default 1, and $sum, $a, $b, $sum
    assert (h.operators, h.unique_operators, h.operands, h.unique_operands) == (3, 3, 9, 5)


def test_dependencies(recs):
    e = {(r.dst, r.kind) for r in php.edges(recs).where(F.col("src") == "App\\Service\\Runner").collect()}
    assert e == {("Lib\\Base", "extends"), ("Countable", "implements"), ("App\\Service\\Loud", "trait"), ("App\\Model\\User", "type"), ("App\\Model\\Order", "type"), ("App\\Model\\Order", "used"), ("App\\Service\\Helper", "used"), ("App\\Service\\Missing", "type")}
    calls = {(r.name, r.dst) for r in php.view(recs, "method_call").collect()}
    assert calls == {("App\\Service\\Runner::make", "App\\Model\\Order::__construct"), ("App\\Service\\Runner::make", "App\\Service\\Helper::go")}
    assert by(php.lcom(recs), "class_name", "lcom")["App\\Service\\Runner"] == 4  # make, unused, go and the rest
    assert [r.name for r in php.dead_private(recs).collect()] == ["unused"]
    g = {(r.name, r.scope) for r in php.globals_used(recs).where("func_name = 'App\\\\Service\\\\add'").collect()}
    assert g == {("$a", "variable"), ("$b", "variable"), ("$sum", "variable")}


def test_coverage_of_types_and_docs(recs):
    t = by(nodes.type_coverage(php.type_slots(recs).where("class_name is not null"), "class_name"), "class_name", "type_coverage")
    # parameters 2 of 2, returns 3 of 5, properties 2 of 3
    assert t["App\\Service\\Runner"] == round(100 * (0.25 + 0.35 * 3 / 5 + 0.40 * 2 / 3), 2)
    d = by(nodes.doc_coverage(php.doc_slots(recs).where("class_name is not null"), "class_name"), "class_name", "doc_coverage")
    assert d["App\\Service\\Runner"] == round(100 / 3, 2)
    docs = php.view(recs, "function").where("has_doc").select("name", php.doc_summary(F.col("doc")).alias("s"))
    assert by(docs, "name", "s") == {"add": "Adds.", "count": "Counts."}


def test_alternative_syntax_and_nesting(spark):
    code = "<?php\nif ($a): while ($b): echo 1; endwhile; elseif ($c): echo 2; else: echo 3; endif;\nfor (;;) if ($x) break; else if ($y) do { $z = new class(1) extends B { function m() { if (1) {} } }; } while ($z);\n$f = function ($p) use ($q) { return $p ?: 'a'; };\n"
    r = php.records(spark.createDataFrame([(1, "x.php", code)], "file_id long, path string, content string"))
    assert r.where("rec = 'error'").count() == 0
    kinds = r.where("rec = 'node' and func_name is null").groupBy("kind").count()
    got = by(kinds, "kind", "count")
    assert (got["if"], got["while"], got["elseif"], got["else"], got["for"], got["do"], got["ternary"], got["echo"]) == (3, 1, 1, 2, 1, 1, 1, 3)


def test_project_from_source(spark, recs):
    """The records feed the table operators without change."""
    c, e = php.classes(recs), php.edges(recs).select("src", "dst")
    assert coupling.coupling(c, e).where("name like '%Runner'").first().uses == 7
    assert graph.strongly_connected(e).count() == 8
    one = " ".join(f"$v{i} = {i};" for i in range(60))
    df = spark.createDataFrame([(1, one, 9), (2, one, 9)], "doc_id long, text string, loc long")
    assert duplication.project_rate(duplication.duplication(text.tokens(df), key="doc_id")).first().duplication_rate == 100.0


def test_analysis_of_a_tree(spark, tmp_path):
    from strataspark.plans.project import analyse, framework_thresholds

    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "src" / "A.php").write_text(CODE)
    (tmp_path / "src" / "B.php").write_text("<?php\nnamespace App\\Model;\nclass User { public function pair() { return new Order(); } }\nclass Order { public function owner() { return new User(); } }\n")
    (tmp_path / "src" / "Bad.php").write_text("<?php class {")
    (tmp_path / "tests" / "UserTest.php").write_text("<?php\nnamespace App\\Model\\Tests;\n/** @covers \\App\\Model\\User */\nclass UserTest {}\n")
    log = spark.createDataFrame([(str(tmp_path / "src" / "B.php"), f"c{i}", "ann", "2023-12-01 00:00:00") for i in range(3)], "path string, commit string, author string, t string").withColumn("ts", F.to_timestamp("t"))
    a = analyse(spark, str(tmp_path), log=log)
    c = {r.name: r for r in a.class_list(limit=20).collect()}
    assert c["App\\Model\\User"].cycle_length == 2 and c["App\\Model\\User"].has_test and c["App\\Model\\User"].churn == 3 and not c["App\\Model\\Order"].has_test
    assert c["App\\Service\\Runner"].dead == 1 and c["App\\Service\\Runner"].dit == 1 and set(c) == {"App\\Model\\User", "App\\Model\\Order", "App\\Service\\Runner", "App\\Service\\Marker", "App\\Service\\Suit"}
    p = a.health_score().first()
    assert p.files == 3 and p.file_errors == 1 and p.cycles == 1 and 0 < p.health_score < 100 and p.test_files == 1
    found = {(r.entity, r.rule) for r in a.problem_list(limit=200).collect()}
    assert ("App\\Model\\User", "dependency_cycle") in found and ("App\\Service\\Runner", "dead_code") in found
    assert a.refactoring_priorities().count() >= 2 and a.impact(target="App\\Model\\User", depth=1).first().node == "App\\Model\\Order::owner"
    assert framework_thresholds('{"require": {"laravel/framework": "1"}}').god_uses == 25


def test_wanted_records(spark, recs):
    """Kinds and columns that are asked for are the same rows as in all records; files with errors stay."""
    rows = [(1, "a.php", CODE), (2, "bad.php", "<?php function f( {")]
    df = spark.createDataFrame(rows, "file_id long, path string, content string")
    for kinds in (("class",), ("function", "access"), ("node", "call"), ("edge", "member", "method_call")):
        columns = ("class_name", "kind", "name", "value", "nest_depth")
        some = php.records(df, *kinds, columns=columns)
        assert some.columns == ["rec", "kind", "value", "name", "class_name", "nest_depth"]
        every = recs.where(F.col("path").isin("a.php", "bad.php") & F.col("rec").isin(*kinds, "error")).select(*some.columns)
        assert sorted(map(str, some.collect())) == sorted(map(str, every.collect())) and some.where("rec = 'error'").count() == 1


def test_programs_are_dealt_out(spark, tmp_path):
    """A table of programs in one small file is parsed by all cores, in batches of records of many files."""
    from strataspark.plans import programs

    spark.range(1, 41).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    s = programs.sources(spark, str(tmp_path))
    assert s.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and s.count() == 40
    batches = php.records(s.coalesce(1), "class").mapInArrow(lambda it: (b.slice(0, 1) for b in it), php.SCHEMA)
    assert batches.count() == 1


def test_cohesion_parses_once(spark, tmp_path):
    """Methods and what they touch are read several times, files are parsed once."""
    log = str(tmp_path / "log")

    def noted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.writelines(f"{x}\n" for x in b.column("file_id").to_pylist())
            yield b

    df = spark.createDataFrame([(1, "a.php", CODE), (2, "b.php", "<?php class B { public $p; function f() { return $this->p; } function g() {} }")], "file_id long, path string, content string")
    got = by(php.lcom(php.records(df.mapInArrow(noted, "file_id long, path string, content string"))), "class_name", "lcom")
    assert got["B"] == 2 and got["App\\Service\\Runner"] == by(php.lcom(php.records(df)), "class_name", "lcom")["App\\Service\\Runner"]
    with open(log) as f:
        assert sorted(f.read().split()) == ["1", "2"]


@pytest.mark.parametrize("query", ["php_test_mapping", "php_layer_violations"])
def test_programs_are_parsed_once(spark, tmp_path, monkeypatch, query):
    from strataspark.plans import programs

    log, made = str(tmp_path / "log"), programs.sources

    def noted(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("".join(f"{x}\n" for x in b.column("file_id").to_pylist()))
            yield b

    monkeypatch.setattr(programs, "sources", lambda *a: made(*a).mapInArrow(noted, "file_id long, path string, content string"))
    spark.range(1, 31).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert programs.QUERIES[query](spark, str(tmp_path)).count() > 0
    with open(log) as f:
        assert sorted(map(int, f.read().split())) == list(range(1, 31))
