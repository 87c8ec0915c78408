"""Source trees, framework files, test files and coverage reports as DataFrames."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED = ("vendor", "node_modules", ".git")


def scan_files(spark: SparkSession, root: str, *, extensions: tuple[str, ...] = ("php",), excludes: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes of the files below ``root`` with one of the extensions, outside excluded directories (paths below the root)."""
    pattern = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").alias("bytes"))
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    below = F.when(F.col("path").startswith(base), F.substring(F.col("path"), F.lit(len(base) + 1), F.length("path"))).otherwise(F.col("path"))
    for e in (*EXCLUDED, *excludes):
        out = out.where(~below.startswith(e.strip("/") + "/"))
    return out


def without_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("path"), "path", "left_anti")


def decode_text(raw: Column) -> Column:
    """UTF-8 where the bytes are valid, else ISO-8859-1."""
    utf8 = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(utf8, F.decode(raw, "iso-8859-1"))


def with_full_tags(text: Column) -> Column:
    """Short open tags written out."""
    return F.regexp_replace(text, r"<\?(?!php|=|xml)", "<?php ")


def source_texts(files: DataFrame) -> DataFrame:
    """file_id, path, content; ids are hashes of the path."""
    return files.select(F.xxhash64("path").alias("file_id"), "path", with_full_tags(decode_text(F.col("bytes"))).alias("content"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, ts, path from the output of ``git log --name-only --format=%x1e%H|%an|%at``.

    The record separator (%x1e) makes every commit one row, so that a long log is
    read by many tasks.  A log without separators is read too, but in one task.
    """
    raw = spark.read.option("lineSep", "\x1e").text(path)
    head = r"(?m)^([0-9a-f]{40})\|([^|\n]*)\|(\d+)$"
    records = raw.select(F.explode(F.split("value", r"(?m)(?=^[0-9a-f]{40}\|[^|\n]*\|\d+$)")).alias("r")).where(F.col("r").rlike(head))
    own = records.select(F.regexp_extract("r", head, 1).alias("commit"), F.regexp_extract("r", head, 2).alias("author"), F.timestamp_seconds(F.regexp_extract("r", head, 3).cast("long")).alias("ts"), F.explode_outer(F.filter(F.slice(F.split("r", "\n"), 2, F.size(F.split("r", "\n"))), lambda x: F.trim(x) != "")).alias("path"))
    return own


def read_clover(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """path, statements, covered, line_rate of a Clover coverage report."""
    schema = "_name string, _path string, metrics struct<_statements:long,_coveredstatements:long>"
    rows = spark.read.format("xml").option("rowTag", "file").schema(schema).load(path)
    name = F.coalesce("_path", "_name")
    covered, statements = F.col("metrics._coveredstatements"), F.col("metrics._statements")
    rel = F.when(name.startswith(root.rstrip("/") + "/"), F.substring(name, F.lit(len(root.rstrip("/")) + 2), F.length(name))).otherwise(name) if root else name
    return rows.select(rel.alias("path"), statements.alias("statements"), covered.alias("covered"), F.coalesce(F.try_divide(covered.cast("double"), statements.cast("double")), F.lit(0.0)).alias("line_rate"))


@dataclass(frozen=True)
class TestConfig:
    """Where tests and sources are, as a test configuration says."""

    directories: tuple[tuple[str, str, str], ...] = ()  # directory, prefix, suffix
    files: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    source_include: tuple[str, ...] = ()
    source_exclude: tuple[str, ...] = ()
    __test__ = False


def parse_phpunit(xml: str) -> TestConfig:
    """The test suites and the source scope of a PHPUnit configuration; an unreadable one gives nothing."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return TestConfig()
    text = lambda e: (e.text or "").strip()
    suites = root.findall(".//testsuite")
    scope = lambda kind: tuple(text(e) for s in root.findall("source") for k in s.findall(kind) for e in k if text(e))
    return TestConfig(
        tuple((text(d), d.get("prefix", ""), d.get("suffix", "Test.php")) for s in suites for d in s.findall("directory")),
        tuple(text(f) for s in suites for f in s.findall("file")),
        tuple(text(e) for s in suites for e in s.findall("exclude")), scope("include"), scope("exclude"),
    )


PHPUNIT_FILES = ("phpunit.xml", "phpunit.xml.dist", "phpunit.dist.xml")


def in_scope(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether a path is inside the source scope; exclusion wins, no inclusion means everything."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    under = lambda d: (p == d.rstrip("/")) | p.startswith(d.rstrip("/") + "/")
    out, inn = F.lit(False), F.lit(not include)
    for d in exclude:
        out = out | under(d)
    for d in include:
        inn = inn | under(d)
    return inn & ~out


@dataclass(frozen=True)
class Frameworks:
    frameworks: tuple[str, ...] = ()
    test_frameworks: tuple[str, ...] = ()
    autoload: dict = field(default_factory=dict)
    autoload_dev: dict = field(default_factory=dict)


#: Package name beginnings that reveal a framework.
KNOWN = {"doctrine/orm": "doctrine", "symfony/framework-bundle": "symfony", "laravel/framework": "laravel"}
KNOWN_TESTS = {"phpunit/phpunit": "phpunit", "pestphp/pest": "pest", "codeception/codeception": "codeception"}


def parse_composer(text: str) -> Frameworks:
    """Frameworks and autoload maps of a composer.json; an unreadable one gives nothing."""
    try:
        d = json.loads(text)
    except ValueError:
        return Frameworks()
    need = {**d.get("require", {}), **d.get("require-dev", {})}
    maps = lambda k: {ns: [p] if isinstance(p, str) else list(p) for ns, p in d.get(k, {}).get("psr-4", {}).items()}
    return Frameworks(tuple(v for k, v in KNOWN.items() if k in need), tuple(v for k, v in KNOWN_TESTS.items() if k in need), maps("autoload"), maps("autoload-dev"))


def source_directories(found: Frameworks) -> list[str]:
    return sorted({p.rstrip("/") for paths in found.autoload.values() for p in paths})


def test_files(files: DataFrame, *, suffixes: tuple[str, ...] = ("Test.php", "Spec.php", "Cest.php")) -> DataFrame:
    """path, test_type, class_based, covers, uses, fqcn of the test files among (path, content)."""
    named = F.lit(False)
    for s in suffixes:
        named = named | F.col("path").endswith(s)
    inside = F.col("path").rlike(r"(^|/)(tests?|spec)/")
    t = files.where(named | (inside & F.col("path").rlike(r"\.php$") & F.col("content").rlike(r"\b(it|test)\s*\(")))
    ns = F.regexp_extract("content", r"(?m)^namespace\s+([^;{\s]+)", 1)
    cls = F.regexp_extract("content", r"(?m)^\s*(?:final\s+|abstract\s+|readonly\s+)*class\s+(\w+)", 1)
    covers = F.concat(F.regexp_extract_all("content", F.lit(r"@covers(?:Class)?\s+\\?([\w\\]+)"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"#\[CoversClass\(\s*\\?([\w\\]+)::class"), F.lit(1)))
    uses = F.regexp_extract_all("content", F.lit(r"(?m)^use\s+\\?([\w\\]+)\s*;"), F.lit(1))
    infra = lambda u: u.rlike(r"^(PHPUnit|Mockery|Prophecy|Pest|Illuminate\\Foundation\\Testing)\\|(TestCase|Trait)$")
    return t.select(
        F.col("path").alias("test"), F.when(F.col("path").rlike("(?i)/unit/"), "unit").when(F.col("path").rlike("(?i)/(integration|feature|functional)/"), "integration").otherwise("unknown").alias("test_type"),
        F.col("content").rlike(r"\bclass\s+\w+").alias("class_based"), F.array_distinct(covers).alias("covers"), F.filter(F.array_distinct(uses), lambda u: ~infra(u)).alias("uses"),
        F.when(cls != "", F.concat(F.when(ns != "", F.concat(ns, F.lit("\\"))).otherwise(""), cls)).otherwise(F.regexp_extract("path", r"([^/]+)\.php$", 1)).alias("fqcn"),
    )


def parse_config(text: str, *, yaml: bool = False) -> dict:
    """A configuration from JSON, or from the flat subset of YAML that configurations use (keys, lists, scalars, one level of maps)."""
    if not yaml:
        return json.loads(text)
    out: dict = {}
    here, key = out, None
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        depth = len(body) - len(body.lstrip())
        item = body.strip()
        if item.startswith("- "):
            if not isinstance(here.get(key), list):
                here[key] = []
            here[key].append(_scalar(item[2:]))
            continue
        name, _, value = item.partition(":")
        if depth == 0:
            here = out
        elif here is out and key is not None and not isinstance(out.get(key), list):
            out[key] = out[key] if isinstance(out.get(key), dict) else {}
            here = out[key]
        key = name.strip()
        here[key] = _scalar(value) if value.strip() else None
    return out


def _scalar(text: str):
    t = text.strip().strip("\"'")
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    return int(t) if re.fullmatch(r"-?\d+", t) else float(t) if re.fullmatch(r"-?\d+\.\d+", t) else t


def parse_arguments(argv: list[str]) -> dict:
    """Command-line options: --k=v, --k v, bare flags, and positional paths under ``files``."""
    out: dict = {"files": []}
    i = 0
    while i < len(argv):
        a = argv[i]
        if a.startswith("--"):
            name, eq, value = a[2:].partition("=")
            if not eq and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                value, eq, i = argv[i + 1], "=", i + 1
            out[name] = _scalar(value) if eq else True
        else:
            out["files"].append(a)
        i += 1
    return out
