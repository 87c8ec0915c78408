"""Duplicated passages between texts: hashes of all token windows that occur in more than one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import cut, in_bitmap, once


def _window_hashes(docs: DataFrame, tokens: str, window: int) -> DataFrame:
    """``docs`` with _w: two 64-bit hashes (a, b) of each window of tokens, by doubling: a window of 2 n is two of n.

    A step costs one hash for each token, whatever the window's length.
    """
    steps = [1 << k for k in range(window.bit_length())]
    out = once(docs, _a1=F.transform(tokens, lambda t: F.xxhash64(t)), _b1=F.transform(tokens, lambda t: F.xxhash64(t, F.lit(1))))

    def doubled(c: str, half: int):
        return F.transform(F.slice(c, 1, F.greatest(F.size(c) - half, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(c, i + half)))

    for n in steps[1:]:
        out = once(out, **{f"_{x}{n}": doubled(f"_{x}{n // 2}", n // 2) for x in "ab"})
    parts, at = [], 0
    for n in reversed(steps):
        if window & n:
            parts.append((n, at))
            at += n
    starts = F.greatest(F.size("_a1") - window + 1, F.lit(0))
    whole = F.transform(F.slice(f"_a{steps[-1]}", 1, starts), lambda h, i: F.struct(*[F.xxhash64(*[F.get(f"_{x}{n}", i + o) for n, o in parts]).alias(x) for x in "ab"]))
    return once(out, _w=whole)


def duplication(docs: DataFrame, *, key: str, tokens: str = "tokens", loc: str = "loc", window: int = 50) -> DataFrame:
    """key, duplicated_lines, duplication_rate: window starts also found in another text, at most the text's lines.

    Windows are hashed in the row; only 32 bytes each are shuffled, once, combined in
    the tasks before.  A bitmap of constant size of the shared windows' hashes then
    leaves few of the others to join.  A repeat inside one text counts only if
    another text has it too.  Texts of fewer tokens than a window have none.
    """
    each = _window_hashes(docs.select(key, tokens), tokens, window).select(key, F.explode("_w").alias("h")).select(F.col(key), "h.a", "h.b")
    text = F.xxhash64(key)
    shared = cut(each.groupBy("a", "b").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("a", "b"))
    hits = each.where(in_bitmap(shared, "a")).join(shared, ["a", "b"], "left_semi").groupBy(key).agg(F.count("*").alias("starts"))
    out = docs.select(key, loc).join(hits, key, "left")
    lines = F.least(F.coalesce("starts", F.lit(0)), F.col(loc)).cast("long")
    return out.withColumn("duplicated_lines", lines).withColumn("duplication_rate", F.when(F.col(loc) > 0, F.round(F.col("duplicated_lines") * 100 / F.col(loc), 2)).otherwise(0.0)).drop("starts")


def project_rate(duplicated: DataFrame, loc: str = "loc") -> DataFrame:
    return duplicated.agg(F.sum("duplicated_lines").alias("duplicated_lines"), F.round(F.coalesce(F.try_divide(F.sum("duplicated_lines") * 100.0, F.sum(loc)), F.lit(0.0)), 2).alias("duplication_rate"))
