"""Scalar column functions of the metric formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name segments (in lower case) that mark a layer, and the layers' ranks from the domain outwards.
LAYERS = {
    "model": 0, "entity": 0, "domain": 0,
    "repository": 1, "persistence": 1,
    "service": 2, "application": 2, "handler": 2,
    "controller": 3, "command": 3, "console": 3, "api": 3,
}


def maintainability(volume: Column, cc: Column, lloc: Column, loc: Column, cloc: Column) -> Column:
    """struct(mi, without_comments, comment_weight); texts without volume or logical lines score 171."""
    none = (volume <= 0) | (lloc <= 0)
    bare = F.greatest(F.lit(171.0) - 5.2 * F.log(F.when(none, 1.0).otherwise(volume)) - 0.23 * cc - 16.2 * F.log(F.when(none, 1).otherwise(lloc)), F.lit(0.0))
    weight = F.when(loc > 0, 50 * F.sin(F.sqrt(2.4 * cloc / F.when(loc > 0, loc).otherwise(1)))).otherwise(0.0)
    return F.struct(
        F.when(none, 171.0).otherwise(bare + weight).alias("mi"),
        F.when(none, 171.0).otherwise(bare).alias("without_comments"),
        F.when(none, 0.0).otherwise(weight).alias("comment_weight"),
    )


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole, or the default where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(default))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half up as ``round(value * 10^digits) / 10^digits``: by the product, not by the shortest decimal form of the value."""
    return F.round(value * 10.0**digits) / 10.0**digits


def instability(efferent: Column, afferent: Column) -> Column:
    return ratio(efferent, efferent + afferent)


def distance(abstractness: Column, instability_: Column) -> Column:
    return F.abs(abstractness + instability_ - 1)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def urgency(priority: Column) -> Column:
    return F.when(priority > 75, "CRITICAL").when(priority > 50, "HIGH").when(priority > 25, "MEDIUM").otherwise("LOW")


def score_band(priority: Column) -> Column:
    return F.when(priority <= 0, "clean").when(priority <= 25, "low").when(priority <= 50, "medium").when(priority <= 75, "high").otherwise("critical")


def runtime_bucket(depth: Column) -> Column:
    return F.when(depth <= 0, "O(1)").when(depth == 1, "O(n)").when(depth == 2, "O(n²)").otherwise("O(n³+)")


def layer_rank(name: Column) -> Column:
    """Rank of the right-most segment of a \\-separated name that names a layer in any letter case; null without one."""
    ranks = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    return F.element_at(ranks, layer_name(name))


def layer_name(name: Column) -> Column:
    """The right-most segment that names a layer, in lower case; null without one."""
    known = F.filter(F.split(F.lower(name), r"\\"), lambda s: s.isin(*LAYERS))
    return F.try_element_at(known, F.lit(-1))


def namespace_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\\?[^\\]*$", "")


def short_name(name: Column) -> Column:
    return F.substring_index(name, "\\", -1)


def package_of(namespace: Column, depth: int = 2, separator: str = r"\\") -> Column:
    """The first ``depth`` segments of a namespace; _global for none."""
    joined = F.array_join(F.slice(F.filter(F.split(namespace, separator), lambda s: s != ""), 1, depth), "\\")
    return F.when(F.coalesce(joined, F.lit("")) == "", "_global").otherwise(joined)


def without_test_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "(Tests|Test|Spec)$", "")


def html_share(lloc: Column, html: Column) -> Column:
    return F.when(lloc > 0, 100 / F.when(lloc > 0, lloc).otherwise(1) * html).otherwise(0.0)


def age_days(last: Column, as_of: Column) -> Column:
    return F.round((F.unix_timestamp(as_of) - F.unix_timestamp(last)) / 86400).cast("long")


def rule_slug(message: Column, category: Column) -> Column:
    """category/slug: other characters than letters and digits become one dash; letters keep their case; at most 60 characters."""
    slug = F.regexp_replace(F.regexp_replace(message, "[^a-zA-Z0-9]+", "-"), "^-|-$", "")
    return F.concat_ws("/", F.lit("STR"), category, F.substring(slug, 1, 60))


def glob_to_regex(pattern: str) -> str:
    """A file-name pattern (* ? and sets) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob(column: Column, pattern: str) -> Column:
    return column.rlike("(?s)" + glob_to_regex(pattern))


def show(value: Column, kind: str) -> Column:
    """A metric as reports print it: two decimals, a percent sign, joined lists."""
    if kind == "percentage":
        return F.concat(F.format_number(value, 2), F.lit("%"))
    if kind == "float":
        return F.format_number(value, 2)
    if kind == "array":
        return F.array_join(value, ", ")
    if kind == "count":
        return F.size(value).cast("string")
    return value.cast("string")
