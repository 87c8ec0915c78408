"""The property graph of a code base: nodes of five kinds and edges of nine, from the analysed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge kinds of the parser, by the kinds of the graph.
DEPENDS = {"extends": "extends", "implements": "implements", "trait": "uses_trait", "used": "depends_on"}


def _id(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c))


def _node(df: DataFrame, kind: str, key: str, name: str, path: str | None = None) -> DataFrame:
    return df.select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), (F.col(path) if path else F.lit(None).cast("string")).alias("path"))


def _edge(df: DataFrame, source: tuple[str, str], target: tuple[str, str], kind: str | Column, weight: Column | None = None) -> DataFrame:
    return df.select(_id(*source).alias("source"), _id(*target).alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.lit(1) if weight is None else weight).cast("long").alias("weight"))


def graph_nodes(classes: DataFrame, functions: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """id, type (class, method, function, package, author), name, path.

    classes: name, path, package; functions: func_id, name, kind; changes: path, author.
    """
    out = _node(classes, "class", "name", "name", "path").unionByName(_node(classes.select("package").where("package <> ''").distinct(), "package", "package", "package"))
    for kind in ("method", "function"):
        out = out.unionByName(_node(functions.where(F.col("kind") == kind), kind, "func_id", "name"))
    if changes is not None:
        out = out.unionByName(_node(changes.select("author").where("author is not null").distinct(), "author", "author", "author"))
    return out


def graph_edges(classes: DataFrame, functions: DataFrame, edges: DataFrame, calls: DataFrame, scc: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """source, target, type, weight; dependencies and calls on what the project does not hold are left out.

    edges: src, dst, kind; calls: src, dst (methods as Class::method), a row for
    each call; scc: node, scc; changes: path, author.  All are equi-joins on names.
    """
    known = classes.select(F.col("name").alias("dst"))
    kinds = F.create_map(*[F.lit(x) for pair in DEPENDS.items() for x in pair])
    own = edges.where(F.col("kind").isin(*DEPENDS)).join(known, "dst", "left_semi").join(classes.select(F.col("name").alias("src")), "src", "left_semi")
    out = _edge(own, ("class", "src"), ("class", "dst"), F.element_at(kinds, F.col("kind")))
    out = out.unionByName(_edge(classes.where("package <> ''"), ("class", "name"), ("package", "package"), "belongs_to"))
    methods = functions.where("kind = 'method'")
    out = out.unionByName(_edge(methods, ("class", "class_name"), ("method", "func_id"), "declares"))
    weighed = calls.groupBy("src", "dst").agg(F.count("*").alias("k")).join(methods.select(F.col("func_id").alias("dst")), "dst", "left_semi")
    out = out.unionByName(_edge(weighed, ("method", "src"), ("method", "dst"), "calls", F.col("k")))
    ring = scc.join(scc.groupBy("scc").agg(F.count("*").alias("m")).where("m > 1"), "scc").select("scc", "node")
    both = ring.join(ring.select("scc", F.col("node").alias("other")), "scc").where("node <> other")
    out = out.unionByName(_edge(both, ("class", "node"), ("class", "other"), "cycle_member"))
    if changes is not None:
        by = classes.join(changes.select("path", "author").distinct(), "path").select("name", "author").distinct()
        out = out.unionByName(_edge(by, ("class", "name"), ("author", "author"), "authored_by"))
    return out


def clusters(classes: DataFrame) -> DataFrame:
    """package, n and the sorted names of its classes."""
    return classes.where("package <> ''").groupBy("package").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("name")).alias("classes"))
