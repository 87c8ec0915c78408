"""Sources, sinks, the query surface and streaming."""

import json

from pyspark.sql import functions as F

from strataspark.operators import history
from strataspark.sources import files, reports, runs, summary
from strataspark.streaming import churn
from strataspark.tools import Analysis


def test_scan_and_decode(spark, tmp_path):
    for p, b in {"src/A.php": "<? echo 'é';".encode(), "src/B.php": "<?php // caf\xe9".encode("latin-1"), "vendor/C.php": b"<?php", "src/d.txt": b"x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b)
    t = {r.path.rsplit("/", 1)[1]: r.content for r in files.source_texts(files.scan_files(spark, str(tmp_path))).collect()}
    assert t == {"A.php": "<?php  echo 'é';", "B.php": "<?php // café"}
    kept = files.without_files(files.scan_files(spark, str(tmp_path)), spark.createDataFrame([(str(tmp_path / "src/A.php"),)], "path string"))
    assert [r.path.rsplit("/", 1)[1] for r in kept.collect()] == ["B.php"]


def test_git_log(spark, tmp_path):
    a, b = "a" * 40, "b" * 40
    (tmp_path / "log").write_text(f"{a}|Ann|1700000000\n\nx.php\ny.php\n{b}|Bob|1700100000\n\nx.php\n")
    log = files.read_git_log(spark, str(tmp_path / "log"))
    c = {r.path: (r.churn, r.authors, r.author_list, r.age_days) for r in history.churn(log, F.timestamp_seconds(F.lit(1700100000 + 86400 * 3))).collect()}
    assert c == {"x.php": (2, 2, "Ann,Bob", 3), "y.php": (1, 1, "Ann", 4)}
    assert history.log_totals(log).first().commits == 2


def test_clover(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<coverage><project><file name="/project/src/Foo.php"><metrics statements="10" coveredstatements="8"/></file><file name="/project/src/Bar.php"><metrics statements="5" coveredstatements="5"/></file></project></coverage>')
    got = {r.path: r.line_rate for r in files.read_clover(spark, str(tmp_path / "c.xml"), "/project").collect()}
    assert got == {"src/Foo.php": 0.8, "src/Bar.php": 1.0}


def test_configurations(spark):
    t = files.parse_phpunit('<phpunit><testsuites><testsuite name="u"><directory suffix="Spec.php">tests</directory><file>a.php</file><exclude>tests/x</exclude></testsuite></testsuites><source><include><directory>src</directory></include><exclude><directory>src/gen</directory></exclude></source></phpunit>')
    assert t.directories == (("tests", "", "Spec.php"),) and t.files == ("a.php",) and t.source_include == ("src",) and files.parse_phpunit("<bad") == files.TestConfig()
    df = spark.createDataFrame([("src/a.php",), ("src/gen/b.php",), ("lib/c.php",)], "path string")
    assert [r.path for r in df.where(files.in_scope(F.col("path"), t.source_include, t.source_exclude)).collect()] == ["src/a.php"]
    c = files.parse_composer(json.dumps({"require": {"doctrine/orm": "1"}, "require-dev": {"phpunit/phpunit": "9"}, "autoload": {"psr-4": {"App\\": ["src/", "lib/"]}}}))
    assert c.frameworks == ("doctrine",) and c.test_frameworks == ("phpunit",) and files.source_directories(c) == ["lib", "src"] and files.parse_composer("{") == files.Frameworks()
    assert files.parse_config("a: 1\nlist:\n  - x\n  - 'y'\nmap:\n  k: true\n  f: 1.5\n", yaml=True) == {"a": 1, "list": ["x", "y"], "map": {"k": True, "f": 1.5}}
    assert files.parse_arguments(["--quick", "--report", "json", "--n=3", "src"]) == {"files": [], "quick": True, "report": "json", "n": 3} | {"files": ["src"]}


def test_test_files(spark):
    df = spark.createDataFrame([("tests/Unit/UserTest.php", "<?php\nnamespace App\\Tests;\nuse App\\User;\nuse PHPUnit\\Framework\\TestCase;\n/** @covers \\App\\User */\n#[CoversClass(Order::class)]\nfinal class UserTest extends TestCase {}"), ("tests/integration/flow.php", "<?php it('works', fn() => 1);"), ("src/User.php", "<?php class User {}")], "path string, content string")
    got = {r.test: r for r in files.test_files(df).collect()}
    u = got["tests/Unit/UserTest.php"]
    assert (u.test_type, u.class_based, u.covers, u.uses, u.fqcn) == ("unit", True, ["App\\User", "Order"], ["App\\User"], "App\\Tests\\UserTest")
    assert set(got) == {"tests/Unit/UserTest.php", "tests/integration/flow.php"} and not got["tests/integration/flow.php"].class_based


def test_history_and_baseline(spark, tmp_path):
    p = str(tmp_path / "history")
    row = lambda x: spark.createDataFrame([(x, 2.0)], "cc double, mi double")
    assert runs.append_run(row(1.0), p, date="2024-01-01") and not runs.append_run(row(1.0), p, date="2024-01-02") and runs.append_run(row(3.0), p, date="2024-01-03")
    h = runs.read_history(spark, p)
    assert [(r.date, r.cc) for r in runs.trend(h, ["cc"]).collect()] == [("2024-01-01", 1.0), ("2024-01-03", 3.0)]
    assert {(r.metric, r.delta) for r in history.run_deltas(runs.history_series(h, {"cc": "low"})).where("delta is not null").collect()} == {("cc", 2.0), ("mi", 0.0)}
    b = spark.createDataFrame([("a", "m", "ERROR")], "entity string, message string, level string")
    runs.write_baseline(b, str(tmp_path / "b"))
    assert history.check_baseline(runs.read_baseline(spark, str(tmp_path / "b")), b) == (0, 0, False)


def test_reports(spark, tmp_path):
    p = spark.createDataFrame([("too_long", "WARNING", "a.php", 3, "m1"), ("too_long", "WARNING", "b.php", 1, "m2"), ("god", "ERROR", "a.php", 1, "m3")], "rule string, level string, path string, line int, message string")
    reports.write_sarif(p, str(tmp_path / "s"))
    doc = json.loads(spark.read.text(str(tmp_path / "s")).first().value)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 3 and {r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]} == {"STR/warning/too-long", "STR/error/god"}
    reports.write_report(str(tmp_path / "r"), project=spark.createDataFrame([(1.5, 2)], "mi double, files long"), problems=p.select(F.col("path").alias("entity"), "message", "level"))
    r = reports.read_report(spark, str(tmp_path / "r"))
    assert {x.metric: x.value for x in reports.report_metrics(r).collect()} == {"mi": 1.5, "files": 2.0} and reports.report_problems(r).count() == 3
    made = summary.write_reports(str(tmp_path / "out"), "Title", {"Problems": p.orderBy("message")}, "markdown,html,markdown")
    assert len(made) == 2 and "| m1 |" in open(made[0]).read() and "<td>m1</td>" in open(made[1]).read()


def test_tools(spark):
    classes = spark.createDataFrame([("App\\A", 9, 1, 10, 80.0, 60.0, False), ("App\\B", 12, 2, 30, 70.0, 0.0, True)], "name string, cc int, lcom int, lloc int, mi double, refactoring_priority double, has_test boolean")
    a = Analysis(
        project=spark.createDataFrame([(90.0, "A")], "health_score double, health_grade string"), classes=classes, functions=spark.createDataFrame([("run", 2)], "name string, cc int"),
        files=spark.createDataFrame([("a.php", 3, 4), ("b.php", 0, 0)], "path string, churn int, cc int"), problems=spark.createDataFrame([("App\\A", "too long", "WARNING"), ("App\\B", "god", "ERROR")], "entity string, message string, level string"),
        edges=spark.createDataFrame([("App\\A", "App\\B", "depends_on")], "src string, dst string, kind string"), calls=spark.createDataFrame([("B::m2", "A::m1"), ("C::m3", "B::m2")], "src string, dst string"),
    )
    assert a.health_score().first().health_grade == "A" and [r.level for r in a.problem_list().collect()] == ["ERROR", "WARNING"] and a.problem_list(contains="LONG").count() == 1
    assert [r.path for r in a.hotspots().collect()] == ["a.php"] and [r.urgency for r in a.refactoring_priorities().collect()] == ["HIGH"]
    assert [r.name for r in a.class_list(sort_by="name").collect()] == ["App\\B", "App\\A"] and a.metrics(entity="app\\a").count() == 5
    assert [tuple(r) for r in a.dependencies(name="App\\A").collect()] == [("out", "App\\B")] and a.graph().first().n == 1
    assert a.search(query="app").count() == 2 and a.search(query="a", kind="file").count() == 1
    assert {r.node for r in a.impact(target="A", depth=1).collect()} == {"B::m2"} and a.test_coverage().first().name == "App\\A"


def test_streaming_churn(spark, tmp_path):
    rows = [("a", i, i % 2, f"2024-01-{1 + i:02d} 10:00:00") for i in range(20)]
    spark.createDataFrame(rows, "path string, commit long, author long, t string").select("path", "commit", "author", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("path string, commit long, author long, ts timestamp").parquet(str(tmp_path / "in"))
    churn.run(churn.weekly_churn(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {str(r.week)[:10]: r.commits for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == 7 and got["2024-01-08"] == 7
