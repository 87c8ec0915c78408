"""Queries over syntax records of PHP programs, one program for each row of ``part``.

The programs are written from the row's size, so that SQL can say what the reader
and the node operators have to find in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.stage import cut, dealt
from ..operators import coupling, graph, nodes, propertygraph, testmap
from ..sources import php

#: Programs that a task parses: a few seconds of work.
PROGRAMS = 8_000
#: Segments of namespaces, by the row's number.
SEGMENTS = ("Model", "Entity", "Domain", "Repository", "Persistence", "Service", "Application", "Handler", "Controller", "Command", "Console", "Api", "Util", "Shared")


def _namespace(key):
    return F.concat(F.lit("App\\"), F.get(F.array(*[F.lit(s) for s in SEGMENTS]), F.pmod(key, F.lit(len(SEGMENTS))).cast("int")))


def sources(spark, sf_dir: str) -> DataFrame:
    """file_id, path, content; keys and sizes are dealt out, since texts are written and parsed in the same task."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    p = dealt(p, "k", PROGRAMS)

    def when(m, text):
        return F.when(F.expr(m), F.lit(text)).otherwise("")

    body = F.concat(
        F.lit("<?php\nnamespace "), _namespace(F.col("k")), F.lit(";\nuse Lib\\Base;\nclass C"), F.col("k").cast("string"), F.lit(" extends Base {\n  private $a = 1;\n  public int $b = 2;\n"),
        F.lit("  /** Runs. */\n  public function run($x, int $y): int {\n"),
        F.expr("repeat('    if ($x > $y) {\\n      echo $y;\\n    }\\n', int(s % 4))"),
        when("s % 3 = 0", "    foreach ($x as $z) {\n      while ($z) { $z--; }\n    }\n"),
        when("s % 5 = 0", "    exec($x);\n"), when("s % 7 = 0", "    $h = md5($x);\n"),
        when("s % 4 = 1", "    $q = 'SELECT * FROM t WHERE a = ' . $x;\n"), when("s % 4 = 2", "    $q = 'SELECT ' . self::LIMIT . ' FROM t';\n"),
        when("s % 6 = 1", "    $u = unserialize($x);\n"), when("s % 6 = 2", "    $u = unserialize($x, ['allowed_classes' => false]);\n"),
        when("s % 2 = 0", "    $this->idle();\n"), F.lit("    return $this->a;\n  }\n  private function idle() { return $this->b; }\n"),
        when("s % 8 = 0", "  public static function make() { return new Helper(); }\n"), F.lit("}\n"),
    )
    return p.select(F.col("k").alias("file_id"), F.concat(F.lit("src/C"), F.col("k").cast("string"), F.lit(".php")).alias("path"), body.alias("content"))


def _records(spark, sf_dir, *wanted, columns=()):
    return php.records(sources(spark, sf_dir), *wanted, columns=columns)


def _nodes(spark, sf_dir, *columns):
    return php.nodes(_records(spark, sf_dir, "node", "call", columns=("path", "class_name", "func_name", "kind", *columns)))


def _classes(spark, sf_dir):
    return php.classes(_records(spark, sf_dir, "class"))


def php_cyclomatic(spark, sf_dir):
    return nodes.cyclomatic(_nodes(spark, sf_dir), "path")


def php_cognitive(spark, sf_dir):
    return nodes.cognitive(_nodes(spark, sf_dir, "nest_depth"), "path")


def php_output(spark, sf_dir):
    return nodes.output_count(_nodes(spark, sf_dir, "value"), "path")


def php_runtime(spark, sf_dir):
    n = nodes.runtime_depth(_nodes(spark, sf_dir, "loop_depth").where("func_id is not null"), "func_id")
    return n.groupBy("runtime").agg(F.count("*").alias("functions"), F.max("loop_depth").alias("deepest"))


def php_smells(spark, sf_dir):
    return nodes.security_smells(_nodes(spark, sf_dir, "value", "start_line"), "path").select("path", "smell_count", "level")


def php_members(spark, sf_dir):
    f = php.functions(_records(spark, sf_dir, "function")).withColumn("class_id", F.col("class_name"))
    return nodes.class_members(f)


def php_dead(spark, sf_dir):
    return php.dead_private(_records(spark, sf_dir, "function", "access", columns=("class_name", "kind", "name", "is_public"))).select("class_id", "name")


def php_edges(spark, sf_dir):
    return php.edges(_records(spark, sf_dir, "edge", columns=("class_name", "dst", "kind"))).select("src", "dst", "kind")


def php_type_coverage(spark, sf_dir):
    return nodes.type_coverage(php.type_slots(_records(spark, sf_dir, "function", "member")), "class_name")


def php_cohesion(spark, sf_dir):
    return php.lcom(_records(spark, sf_dir, "function", "access", columns=("class_name", "func_name", "kind", "name"))).select("class_name", "lcom")


def php_layers(spark, sf_dir):
    c = _classes(spark, sf_dir)
    return c.select("name", scalars.layer_name(scalars.namespace_of(F.col("name"))).alias("layer"), scalars.layer_rank(scalars.namespace_of(F.col("name"))).cast("long").alias("rank"), scalars.short_name(F.col("name")).alias("short"))


def php_layer_violations(spark, sf_dir):
    """Classes that use the one whose number is 3 more, across layers."""
    c = cut(_classes(spark, sf_dir).select("name"))  # read four times below, parsed once
    c = c.select("name", scalars.layer_name(scalars.namespace_of(F.col("name"))).alias("layer"), scalars.layer_rank(scalars.namespace_of(F.col("name"))).cast("long").alias("rank"), F.regexp_extract("name", r"C(\d+)$", 1).cast("long").alias("k"))
    edges = c.select(F.col("name").alias("src"), (F.col("k") + 3).alias("k")).join(c.select(F.col("name").alias("dst"), "k"), "k").select("src", "dst")
    return coupling.layer_violations(c.select("name", "layer", "rank"), edges).select("name", "violations")


def php_test_mapping(spark, sf_dir):
    """Tests named after every other class, found by namespace or short name."""
    c = cut(_classes(spark, sf_dir).select("name", scalars.short_name(F.col("name")).alias("short")))  # every kind of match reads them
    half = c.where(F.regexp_extract("name", r"C(\d+)$", 1).cast("long") % 2 == 0)
    t = half.select(F.concat("short", F.lit("Test")).alias("test"), F.array().cast("array<string>").alias("covers"), F.array().cast("array<string>").alias("uses"), F.lit("unit").alias("test_type"), F.concat(F.lit("Tests\\"), "short", F.lit("Test")).alias("fqcn"))
    return testmap.coverage(testmap.mapping(t, c), t, c).select("name", "tests", "has_test", "test_type")


def _graph_tables(spark, sf_dir):
    recs = cut(_records(spark, sf_dir, "class", "function", "edge"))
    changes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("src/C"), (F.col("event_id") % 100).cast("string"), F.lit(".php")).alias("path"), F.col("user_id").cast("string").alias("author"))
    return recs, php.classes(recs), php.functions(recs), changes


def php_graph_nodes(spark, sf_dir):
    _, c, f, changes = _graph_tables(spark, sf_dir)
    return propertygraph.graph_nodes(c, f, changes)


def php_graph_edges(spark, sf_dir):
    """With calls from classes to those 3 further whose number leaves 0 or 2 by 5, and back where it leaves 0."""
    recs, c, f, changes = _graph_tables(spark, sf_dir)
    numbered = c.select("name", F.regexp_extract("name", r"C(\d+)$", 1).cast("long").alias("k"))
    on = numbered.select(F.col("name").alias("src"), (F.col("k") + 3).alias("k")).join(numbered.select(F.col("name").alias("dst"), "k"), "k").where("k % 5 in (0, 2)")
    used = on.select("src", "dst").unionByName(on.where("k % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    calls = used.select(F.concat("src", F.lit("::run")).alias("src"), F.concat("dst", F.lit("::run")).alias("dst"))
    edges = php.edges(recs).select("src", "dst", "kind").unionByName(used.withColumn("kind", F.lit("used")))
    return propertygraph.graph_edges(c, f, edges, calls, graph.strongly_connected(used, small=0), changes)


def php_clusters(spark, sf_dir):
    c = _classes(spark, sf_dir)
    return propertygraph.clusters(c).select("package", "n", F.md5(F.array_join("classes", ",")).alias("classes_md5"))


QUERIES = {f.__name__: f for f in (php_cyclomatic, php_cognitive, php_output, php_runtime, php_smells, php_members, php_dead, php_edges, php_type_coverage, php_cohesion, php_layers, php_layer_violations, php_test_mapping, php_graph_nodes, php_graph_edges, php_clusters)}

_P = """WITH p AS (SELECT p_partkey AS k, p_size::BIGINT AS s, 'src/C' || p_partkey || '.php' AS path,
  ['Model','Entity','Domain','Repository','Persistence','Service','Application','Handler','Controller','Command','Console','Api','Util','Shared'][1 + p_partkey % 14] AS seg,
  'App\\' || ['Model','Entity','Domain','Repository','Persistence','Service','Application','Handler','Controller','Command','Console','Api','Util','Shared'][1 + p_partkey % 14] || '\\C' || p_partkey AS name FROM part),
r AS (SELECT *, CASE WHEN seg IN ('Model','Entity','Domain') THEN 0 WHEN seg IN ('Repository','Persistence') THEN 1 WHEN seg IN ('Service','Application','Handler') THEN 2
  WHEN seg IN ('Controller','Command','Console','Api') THEN 3 END::BIGINT AS rank FROM p)
"""
_M = _P + """, m AS (SELECT name AS class_name, unnest(['run', 'idle'] || CASE WHEN s % 8 = 0 THEN ['make'] ELSE [] END) AS n FROM p),
u AS (SELECT a.name AS src, b.name AS dst, b.k FROM p a JOIN p b ON b.k = a.k + 3 WHERE b.k % 5 IN (0, 2)),
w AS (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u WHERE k % 5 = 0),
ch AS (SELECT DISTINCT 'src/C' || (event_id % 100) || '.php' AS path, user_id::VARCHAR AS author FROM events)
"""
ORACLE = {
    "php_graph_nodes": _M + """SELECT 'class:' || name AS id, 'class' AS type, name, path FROM p UNION ALL SELECT DISTINCT 'package:App\\' || seg, 'package', 'App\\' || seg, NULL FROM p
UNION ALL SELECT 'method:' || class_name || '::' || n, 'method', n, NULL FROM m UNION ALL SELECT DISTINCT 'author:' || author, 'author', author, NULL FROM ch WHERE author IS NOT NULL""",
    "php_graph_edges": _M + """SELECT 'class:' || src AS source, 'class:' || dst AS target, 'depends_on' AS type, 1::BIGINT AS weight FROM w
UNION ALL SELECT 'class:' || name, 'package:App\\' || seg, 'belongs_to', 1 FROM p UNION ALL SELECT 'class:' || class_name, 'method:' || class_name || '::' || n, 'declares', 1 FROM m
UNION ALL SELECT 'method:' || src || '::run', 'method:' || dst || '::run', 'calls', 1 FROM w
UNION ALL SELECT 'class:' || src, 'class:' || dst, 'cycle_member', 1 FROM w WHERE (src, dst) IN (SELECT (src, dst) FROM u WHERE k % 5 = 0) OR (dst, src) IN (SELECT (src, dst) FROM u WHERE k % 5 = 0)
UNION ALL SELECT DISTINCT 'class:' || name, 'author:' || author, 'authored_by', 1 FROM p JOIN ch USING (path) WHERE author IS NOT NULL""",
    "php_clusters": _P + "SELECT 'App\\' || seg AS package, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS classes_md5 FROM p GROUP BY seg",
    "php_cyclomatic": _P + "SELECT path, 1 + s % 4 + CASE WHEN s % 3 = 0 THEN 2 ELSE 0 END AS cc FROM p",
    "php_cognitive": _P + "SELECT path, s % 4 + CASE WHEN s % 3 = 0 THEN 3 ELSE 0 END AS cognitive_complexity FROM p",
    "php_output": _P + "SELECT path, s % 4 AS output_count FROM p",
    "php_runtime": _P + """SELECT runtime, sum(n)::BIGINT AS functions, max(d)::BIGINT AS deepest FROM (SELECT 'O(1)' AS runtime, 0 AS d, CASE WHEN s % 3 = 0 THEN 1 ELSE 2 END + CASE WHEN s % 8 = 0 THEN 1 ELSE 0 END AS n FROM p
  UNION ALL SELECT 'O(n²)', 2, 1 FROM p WHERE s % 3 = 0) GROUP BY runtime""",
    "php_smells": _P + """SELECT path, n AS smell_count, CASE WHEN s % 5 = 0 THEN 'ERROR' ELSE 'WARNING' END AS level FROM
  (SELECT path, s, (s % 5 = 0)::BIGINT + (s % 7 = 0)::BIGINT + (s % 4 = 1)::BIGINT + (s % 6 = 1)::BIGINT AS n FROM p) WHERE n > 0""",
    "php_members": _P + "SELECT name AS class_id, 2 + (s % 8 = 0)::BIGINT AS method_count, 1 + (s % 8 = 0)::BIGINT AS public_count, 1::BIGINT AS private_count, (s % 8 = 0)::BIGINT AS static_count FROM p",
    "php_dead": _P + "SELECT name AS class_id, 'idle' AS name FROM p WHERE s % 2 <> 0",
    "php_edges": _P + "SELECT name AS src, 'Lib\\Base' AS dst, 'extends' AS kind FROM p UNION ALL SELECT name, 'App\\' || seg || '\\Helper', 'used' FROM p WHERE s % 8 = 0",
    "php_type_coverage": _P + "SELECT name AS class_name, round(100 * (0.25 * 0.5 + 0.35 * (1.0 / (2 + (s % 8 = 0)::INT)) + 0.4 * 0.5), 2) AS type_coverage FROM p",
    "php_cohesion": _P + "SELECT name AS class_name, CASE WHEN s % 2 = 0 THEN 1 ELSE 2 END + (s % 8 = 0)::BIGINT AS lcom FROM p",
    "php_layers": _P + "SELECT name, CASE WHEN rank IS NOT NULL THEN lower(seg) END AS layer, rank, 'C' || k AS short FROM r",
    "php_layer_violations": _P + "SELECT a.name, count(*) AS violations FROM r a JOIN r b ON b.k = a.k + 3 WHERE a.rank < b.rank GROUP BY a.name",
    "php_test_mapping": _P + "SELECT name, (k % 2 = 0)::BIGINT AS tests, k % 2 = 0 AS has_test, CASE WHEN k % 2 = 0 THEN 'unit' END AS test_type FROM p",
}
