"""Tests mapped to the classes that they cover, and coverage from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import without_test_suffix
from .rollup import first_by_priority

#: Best first.
TEST_TYPES = {"unit": 0, "integration": 1, "unknown": 2}


def candidates(tests: DataFrame, classes: DataFrame) -> DataFrame:
    """test, name, prio: 1 declared coverage, 2 imports of integration tests, 3 the same namespace, 4 the same short name.

    Tests: test, covers, uses (arrays), test_type, fqcn; classes: name, short.
    Each way is an equi-join on names; none compares all pairs.
    """
    c = classes.select("name", "short")
    named = tests.select("test", F.explode("covers").alias("k"))
    by_full = named.join(c, F.col("k") == F.col("name")).select("test", "name", F.lit(1).alias("prio"))
    by_short = named.join(c.select("name"), F.col("k") == F.col("name"), "left_anti").join(c, F.col("k") == F.col("short")).select("test", "name", F.lit(1).alias("prio"))
    used = tests.where("test_type = 'integration'").select("test", F.explode("uses").alias("k")).join(c, F.col("k") == F.col("name")).select("test", "name", F.lit(2).alias("prio"))
    bare = tests.select("test", without_test_suffix(F.col("fqcn")).alias("k"), without_test_suffix(F.substring_index("fqcn", "\\", -1)).alias("s"))
    mirrored = bare.join(c, F.regexp_replace("k", r"\\Tests?\\", r"\\") == F.col("name")).select("test", "name", F.lit(3).alias("prio"))
    alike = bare.join(c, F.col("s") == F.col("short")).select("test", "name", F.lit(4).alias("prio"))
    return by_full.union(by_short).union(used).union(mirrored).union(alike).distinct()


def mapping(tests: DataFrame, classes: DataFrame) -> DataFrame:
    """test, name, prio: all matches of each test's best way."""
    return first_by_priority(candidates(tests, classes), "test")


def coverage(mapped: DataFrame, tests: DataFrame, classes: DataFrame) -> DataFrame:
    """name, tests, has_test, test_type (the best one) of every class."""
    order = F.create_map(*[F.lit(x) for pair in TEST_TYPES.items() for x in pair])
    t = mapped.join(tests.select("test", "test_type"), "test").groupBy("name").agg(F.countDistinct("test").alias("tests"), F.min_by("test_type", F.element_at(order, F.col("test_type"))).alias("test_type"))
    return classes.join(t, "name", "left").na.fill(0, ["tests"]).withColumn("has_test", F.col("tests") > 0)


def totals(covered: DataFrame) -> DataFrame:
    """tested, untested (abstract classes are not), the ratio, and line coverage weighted by statements."""
    untested = ~F.col("has_test") & ~F.coalesce("is_abstract", F.lit(False))
    out = covered.agg(F.count_if("has_test").alias("tested"), F.count_if(untested).alias("untested"), F.round(F.coalesce(F.try_divide(F.sum(F.col("line_rate") * F.col("statements")), F.sum(F.when(F.col("line_rate").isNotNull(), F.col("statements")))) * 100, F.lit(0.0)), 2).alias("coverage"))
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("tested") * 100.0, F.col("tested") + F.col("untested")), F.lit(0.0)), 2))


def suffix_join(left: DataFrame, right: DataFrame, *, left_path: str, right_path: str, separator: str = "/") -> DataFrame:
    """Rows of ``left`` with the row of ``right`` whose path equals theirs, or of which one is a path suffix of the other.

    Every suffix that starts at a segment is a key.  Two equi-joins: whole left
    paths with suffixes of right ones, and whole right paths with suffixes of left
    ones, so that a frequent base name meets only paths that consist of it.  Right
    rows are one for each path, the greatest.  The longest shared suffix wins, then
    the greater path.  A row that is repeated on the left comes back as often.
    """
    def suffixes(path):
        parts = F.split(path, separator)
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))

    own = [c for c in right.columns if c not in left.columns]
    row = F.struct(*[F.col(c) for c in own]).alias("_b")
    b = right.select(F.col(right_path).alias("_rp"), row).groupBy("_rp").agg(F.max("_b").alias("_b"))
    paths = left.select(F.col(left_path).alias("_lp")).where("_lp is not null").distinct()
    # the best right path of each whole key, before it meets the left ones
    by_suffix = b.select(F.explode(suffixes("_rp")).alias("_lp"), F.struct(F.col("_rp"), F.col("_b")).alias("r")).groupBy("_lp").agg(F.max("r").alias("r"))
    up = paths.join(by_suffix, "_lp").select("_lp", F.struct(F.length("_lp").alias("n"), "r").alias("h"))
    down = paths.select("_lp", F.explode(suffixes("_lp")).alias("_rp")).join(b, "_rp").select("_lp", F.struct(F.length("_rp").alias("n"), F.struct("_rp", "_b").alias("r")).alias("h"))
    best = up.unionByName(down).groupBy("_lp").agg(F.max("h").alias("h")).select("_lp", F.col("h.r._b").alias("_b"))
    return left.join(best, F.col(left_path) == F.col("_lp")).select(*[left[c] for c in left.columns], "_b.*")


def gaps(covered: DataFrame, *, cc: int = 8, n: int = 20) -> DataFrame:
    """Untested classes of some complexity, the most complex first."""
    return covered.where(~F.col("has_test") & (F.col("cc") >= cc)).orderBy(F.desc("cc"), "name").limit(n)
