"""Size, complexity, Halstead and variable measures of texts, row by row.

A text's tokens are arrays inside its row, so none of these operators shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as branches, in the languages of the tables, and as globals.
BRANCHES = ("and", "or", "if", "und", "oder", "wenn", "et", "ou", "si", "y", "o")
GLOBALS = ("the", "der", "die", "das", "le", "la", "les", "el", "los")
PUNCTUATION = "[.,;:!?|]"


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """loc, cloc, lloc: all lines; lines that begin as comments; the others that are not blank, at least 1."""
    each = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    comment = r"^[ \t]*(#|//|--|/\*|\*)"
    return df.withColumns({
        "loc": F.size(each).cast("long"),
        "cloc": F.size(F.filter(each, lambda x: x.rlike(comment))).cast("long"),
        "lloc": F.greatest(F.size(F.filter(each, lambda x: x.rlike("[^ \\t]") & ~x.rlike(comment))), F.lit(1)).cast("long"),
    })


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """tokens: words and, each alone, punctuation marks."""
    spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"({PUNCTUATION})", " $1 ")
    return df.withColumn("tokens", F.filter(F.split(spaced, "[ \\n\\t]+"), lambda x: x != ""))


def cyclomatic(df: DataFrame, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """cc: 1 + the branch words among tokens."""
    return df.withColumn("cc", (1 + F.size(F.filter("tokens", lambda x: F.lower(x).isin(*branches)))).cast("long"))


def halstead(df: DataFrame) -> DataFrame:
    """The Halstead measures, with punctuation as operators and words as operands; all 0 without operands."""
    is_op = lambda x: x.rlike(f"^{PUNCTUATION}$")
    a = df.withColumns({"_o": F.filter("tokens", is_op), "_w": F.filter("tokens", lambda x: ~is_op(x))})
    a = a.withColumns({
        "operators": F.size("_o").cast("long"), "operands": F.size("_w").cast("long"),
        "unique_operators": F.size(F.array_distinct("_o")).cast("long"), "unique_operands": F.size(F.array_distinct("_w")).cast("long"),
    })
    return halstead_of(a.drop("_o", "_w"))


def halstead_of(df: DataFrame) -> DataFrame:
    """The derived measures from the four counts."""
    some = F.col("unique_operands") > 0
    n, size = F.col("unique_operators") + F.col("unique_operands"), F.col("operators") + F.col("operands")
    log = F.log2(F.when(n > 0, n).otherwise(1))
    zero = lambda c: F.when(some, c).otherwise(0.0)
    difficulty = F.col("unique_operators") / 2 * (F.col("operands") / F.when(some, F.col("unique_operands")).otherwise(1))
    return df.withColumns({
        "vocabulary": F.when(some, n).otherwise(0).cast("long"), "length": F.when(some, size).otherwise(0).cast("long"),
        "calc_length": zero(n * log), "volume": zero(size * log), "difficulty": zero(difficulty),
        "effort": zero(difficulty * size * log), "complexity_density": zero(difficulty / F.when(some, n + size).otherwise(1)),
    })


def variables(df: DataFrame, global_words: tuple[str, ...] = GLOBALS) -> DataFrame:
    """Uses and distinct uses of globals, constants (upper-case words) and other words, and their metric."""
    words = F.filter("tokens", lambda x: ~x.rlike(f"^{PUNCTUATION}$"))
    a = df.withColumn("_w", words)
    kinds = {
        "superglobals": lambda x: F.lower(x).isin(*global_words),
        "constants": lambda x: ~F.lower(x).isin(*global_words) & x.rlike("^[A-Z]{2,}$"),
        "variables": lambda x: ~F.lower(x).isin(*global_words) & ~x.rlike("^[A-Z]{2,}$"),
    }
    for name, test in kinds.items():
        a = a.withColumns({f"{name}_used": F.size(F.filter("_w", test)).cast("long"), f"distinct_{name}_used": F.size(F.array_distinct(F.filter("_w", test))).cast("long")})
    used = F.col("superglobals_used") + F.col("constants_used")
    metric = F.round(F.coalesce(F.try_divide(used * 100.0, used + F.col("variables_used")), F.lit(0.0)), 2)
    return a.withColumn("superglobal_metric", metric).drop("_w")


def documents(df: DataFrame, text: str = "text") -> DataFrame:
    """All row-wise measures of a text table."""
    from ..functions.scalars import maintainability

    out = halstead(cyclomatic(tokens(lines(df, text), text)))
    m = maintainability(*(F.col(c) for c in ("volume", "cc", "lloc", "loc", "cloc")))
    return out.withColumn("_m", m).withColumns({"mi": F.col("_m.mi"), "mi_without_comments": F.col("_m.without_comments"), "comment_weight": F.col("_m.comment_weight")}).drop("_m")


def cognitive(df: DataFrame, group: str, nesting: Column, branches: Column) -> DataFrame:
    """Cognitive complexity of groups: every branch counts 1 and its nesting."""
    return df.groupBy(group).agg(F.sum(branches * (1 + nesting)).cast("long").alias("cognitive"))
