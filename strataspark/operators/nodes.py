"""Measures of syntax trees: aggregates over a table of nodes.

Nodes carry their innermost scope (file_id, class_id, func_id), so each measure
is one aggregate by the scope of interest, combined in the tasks first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import halstead_of

BRANCHES = ("if", "elseif", "for", "foreach", "while", "do", "catch", "ternary", "coalesce", "case", "match", "spaceship")
NESTED = ("if", "for", "foreach", "while", "do", "catch", "switch", "match", "ternary")
FLAT = ("elseif", "else", "coalesce", "boolean")


def cyclomatic(nodes: DataFrame, *by: str) -> DataFrame:
    """cc: 1 + branching nodes (a case without a condition is of kind default and does not count)."""
    return nodes.groupBy(*by).agg((1 + F.count_if(F.col("kind").isin(*BRANCHES))).cast("long").alias("cc"))


def cognitive(nodes: DataFrame, *by: str) -> DataFrame:
    """1 + nesting for structures that nest, 1 for branches and starts of boolean sequences."""
    step = F.when(F.col("kind").isin(*NESTED), 1 + F.col("nest_depth")).when(F.col("kind").isin(*FLAT), 1).otherwise(0)
    return nodes.groupBy(*by).agg(F.sum(step).cast("long").alias("cognitive_complexity"))


def halstead(nodes: DataFrame, *by: str) -> DataFrame:
    """Halstead measures from nodes with role operator or operand, named by ``value``."""
    def of(role):
        return F.when(F.col("role") == role, F.col("value"))

    counts = nodes.groupBy(*by).agg(
        F.count(of("operator")).alias("operators"), F.count(of("operand")).alias("operands"),
        F.countDistinct(of("operator")).alias("unique_operators"), F.countDistinct(of("operand")).alias("unique_operands"),
    )
    return halstead_of(counts)


def runtime_depth(nodes: DataFrame, *by: str) -> DataFrame:
    """The deepest loop nesting and the runtime class it suggests."""
    from ..functions.scalars import runtime_bucket

    return nodes.groupBy(*by).agg(F.coalesce(F.max("loop_depth"), F.lit(0)).cast("long").alias("loop_depth")).withColumn("runtime", runtime_bucket(F.col("loop_depth")))


def output_count(nodes: DataFrame, *by: str) -> DataFrame:
    return nodes.groupBy(*by).agg(F.count_if(F.col("kind").isin("echo", "print") | ((F.col("kind") == "call") & (F.col("value") == "printf"))).alias("output_count"))


def nesting_map(nodes: DataFrame) -> DataFrame:
    """func_id, line, depth: the deepest relative nesting of each line of a function."""
    each = nodes.where("func_id is not null and nest_depth is not null").select("func_id", F.explode(F.sequence("start_line", "end_line")).alias("line"), "nest_depth")
    return each.groupBy("func_id", "line").agg(F.max("nest_depth").alias("depth"))


def type_coverage(members: DataFrame, *by: str) -> DataFrame:
    """Weighted share of typed parameters (25), returns (35) and properties (40) of rows (slot, typed)."""
    def share(slot):
        of = F.col("slot") == slot
        return F.try_divide(F.count_if(of & F.col("typed")), F.count_if(of)), F.count_if(of)

    (p, np_), (r, nr), (q, nq) = share("param"), share("return"), share("property")
    full = lambda c: F.coalesce(c, F.lit(1.0))
    score = F.when(np_ + nr + nq == 0, 100.0).when(nq == 0, 100 * (0.4167 * full(p) + 0.5833 * full(r))).otherwise(100 * (0.25 * full(p) + 0.35 * full(r) + 0.40 * full(q)))
    return members.groupBy(*by).agg(F.round(score, 2).alias("type_coverage"))


def doc_coverage(members: DataFrame, *by: str) -> DataFrame:
    """Share of public members, magic ones aside, that carry documentation."""
    shown = members.where("is_public and not is_magic")
    return shown.groupBy(*by).agg(F.round(100.0 * F.count_if("has_doc") / F.count("*"), 2).alias("doc_coverage"))


def class_members(members: DataFrame) -> DataFrame:
    """Counts of methods by visibility; what is not public counts as private."""
    return members.groupBy("class_id").agg(
        F.count("*").alias("method_count"), F.count_if("is_public").alias("public_count"),
        F.count_if(~F.col("is_public")).alias("private_count"), F.count_if("is_static").alias("static_count"),
    )


def dead_members(private: DataFrame, calls: DataFrame) -> DataFrame:
    """Private, non-magic members (class_id, name) that no call within the class names."""
    return private.where("not is_magic").join(calls.select("class_id", "name").distinct(), ["class_id", "name"], "left_anti")


#: Functions that run code or commands, weak hashes, and the other smells that the parser records.
DANGEROUS = ("eval", "exec", "system", "shell_exec", "passthru", "proc_open", "popen", "pcntl_exec")
WEAK_HASHES = ("md5", "sha1")
OTHER_SMELLS = ("unserialize", "sql concat")


def security_smells(nodes: DataFrame, *by: str) -> DataFrame:
    """Calls of dangerous functions and weak hashes, SQL texts joined with values, unserialize without allowed classes.

    Their number, the first three (value:line) and the level: ERROR if any runs code or commands.
    """
    hits = nodes.where(F.col("kind").isin("call", "eval", "sql concat") & F.col("value").isin(*DANGEROUS, *WEAK_HASHES, *OTHER_SMELLS))
    said = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("start_line", "value"))), 1, 3), lambda s: F.concat_ws(":", s.value, s.start_line))
    return hits.groupBy(*by).agg(F.count("*").alias("smell_count"), said.alias("smells"), F.when(F.bool_or(F.col("value").isin(*DANGEROUS)), "ERROR").otherwise("WARNING").alias("level"))
