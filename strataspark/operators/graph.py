"""Graph operators over edge tables.

Graphs of classes are small; where the edges are counted and found to be at most
SMALL, the linear-time algorithm runs on the driver.  Larger ones go through loops
of joins, cut after every step in the shared checkpoint folder.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import cut

SMALL = 100_000


def _small(edges: DataFrame, bound: int) -> list | None:
    rows = edges.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def tarjan(edges: list[tuple]) -> dict:
    """node -> smallest node of its strongly connected component."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
        out[b]
    index, low, on, stack, found = {}, {}, set(), [], {}
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    found |= dict.fromkeys(members, min(members))
    return found


def strongly_connected(edges: DataFrame, *, small: int = SMALL) -> DataFrame:
    """node, scc (its component's smallest node), for every end of ``edges`` (src, dst)."""
    spark = edges.sparkSession
    edges = edges.select("src", "dst").distinct()
    kind = edges.schema["src"].dataType.simpleString()
    rows = _small(edges, small)
    if rows is not None:
        return spark.createDataFrame(list(tarjan([tuple(r) for r in rows]).items()), f"node {kind}, scc {kind}")
    return _colouring(edges)


def _colouring(edges: DataFrame) -> DataFrame:
    """Forward colours (largest node that reaches), then backward search inside a colour; each round settles a component of every colour."""
    left = cut(edges.where("src <> dst"))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    found = None
    while nodes.limit(1).count():
        colour = nodes.withColumn("colour", F.col("node"))
        while True:
            up = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("up"))
            after = cut(colour.join(up, "node", "left").select("node", F.greatest("colour", F.coalesce("up", "colour")).alias("colour"), (F.col("up") > F.col("colour")).alias("new")))
            colour = after.select("node", "colour")
            if not after.where("new").limit(1).count():
                break
        inside = cut(left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst"))
        got = cut(colour.where("node = colour").select("node"))
        fresh = got
        while fresh.limit(1).count():
            fresh = cut(inside.join(fresh.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(got, "node", "left_anti"))
            got = cut(got.union(fresh))
        done = colour.join(got, "node", "left_semi")
        found = done if found is None else found.union(done)
        nodes = cut(nodes.join(got, "node", "left_anti"))
        left = cut(left.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return found.join(found.groupBy("colour").agg(F.min("node").alias("scc")), "colour").select("node", "scc")


def cycles(scc: DataFrame) -> DataFrame:
    """scc, cycle_length, members (joined) of components of more than one node."""
    return scc.groupBy("scc").agg(F.count("*").alias("cycle_length"), F.array_join(F.sort_array(F.collect_list(F.col("node"))).cast("array<string>"), ",").alias("members")).where("cycle_length > 1")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for every end of the undirected ``edges`` (a, b).

    Large-star and small-star steps until nothing changes, each cut, so that a lost
    executor costs one step and no group has to fit in one task.
    """
    ends = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"))
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return ends.join(now.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


#: Edges of a group that one task joins in memory, some 50 MB; larger groups go through the joins of ``components``.
GROUP = 100_000


def group_components(edges: DataFrame, group: list[str], *, most: int = GROUP) -> DataFrame:
    """Connected components of the undirected graph (a, b) in each group: their number, nodes and largest size.

    Edges are counted by group first.  Groups of at most ``most`` edges are sorted
    by group and joined one after the other in a single exchange.  The nodes of all
    larger groups carry their group and are one graph, so a large group is no larger
    a task than many small ones.  ``edges`` are read twice.
    """
    edges = edges.select(*group, "a", "b")
    large = cut(edges.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*[F.col(c).alias(f"_{c}") for c in group]))
    if not large.limit(1).count():
        return _in_order(edges, group)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    own = edges.join(large, same, "left_semi").select(*[F.struct(*group, F.col(c).alias("n")).alias(c) for c in ("a", "b")])
    sizes = components(own).groupBy("comp").agg(F.count("*").alias("k")).select(*[F.col(f"comp.{c}") for c in group], "k")
    sizes = sizes.groupBy(*group).agg(F.count("*").alias("components"), F.sum("k").alias("nodes"), F.max("k").alias("largest"))
    return _in_order(edges.join(large, same, "left_anti"), group).unionByName(sizes)


def _in_order(edges: DataFrame, group: list[str]) -> DataFrame:
    """``group_components`` of groups that are sorted and joined one at a time; a task holds one group's nodes."""
    names = [*group, "components", "nodes", "largest"]
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types, found, up, size = None, [], [], {}, {}

        def out() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            found.clear()
            return batch

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            types = [batch.schema.field(c).type for c in group] + [pa.int64()] * 3
            keys = zip(*[batch.column(c).to_pylist() for c in group], strict=True)
            for g, a, b in zip(keys, batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if g != now:
                    if up:
                        found.append((*now, len(size), len(up), max(size.values())))
                        up, size = {}, {}
                    now = g
                if a not in up:
                    up[a], size[a] = a, 1
                if b not in up:
                    up[b], size[b] = b, 1
                x, y = root(a), root(b)
                if x != y:
                    if size[x] < size[y]:
                        x, y = y, x
                    up[y] = x
                    size[x] += size.pop(y)
            if len(found) >= 5_000:
                yield out()
        if up:
            found.append((*now, len(size), len(up), max(size.values())))
        if found:
            yield out()

    sorted_ = edges.repartition(*group).sortWithinPartitions(*group)
    return sorted_.mapInArrow(solve, ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", components long, nodes long, largest long")


def tree_depth(parents: DataFrame, *, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, depth: 0 for roots, 1 where the parent is not in the table, else one more than the parent's.

    By pointer doubling: a round doubles the distance seen, so a tree of depth d
    takes about log2(d) joins.  Nodes on a cycle, or below one, have depth 0.
    """
    base = parents.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = base.select(F.col("node").alias("p")).withColumn("_known", F.lit(True))
    now = base.join(known, base.parent == F.col("p"), "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now = cut(now)
    # no path is longer than there are nodes; what then still has a way up is on a cycle, or leads to one
    rounds, most = 0, now.count().bit_length() + 1
    while now.where("up is not null").limit(1).count() and rounds < most:
        far = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        now = cut(now.join(far, "up", "left").select("node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        rounds += 1
    return now.select("node", F.when(F.col("up").isNotNull(), 0).otherwise(F.col("depth")).cast("long").alias("depth"))


def callers(edges: DataFrame, start: DataFrame, *, depth: int = 2) -> DataFrame:
    """node, depth, path: nodes that reach ``start`` (node) over edges (src calls dst) in at most ``depth`` steps, first visit and smallest path."""
    seen = start.select("node", F.lit(0).cast("long").alias("depth"), F.col("node").cast("string").alias("path"))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("dst"), "path"), "dst").where("src <> dst")
        step = step.groupBy(F.col("src").alias("node")).agg(F.min(F.concat_ws(">", F.col("src").cast("string"), "path")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(d).cast("long").alias("depth"), "path"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def top_degrees(edges: DataFrame, n: int = 5) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def distinct_cycles(found: DataFrame, members: str = "members") -> DataFrame:
    """Cycles without those that have the same members."""
    return found.withColumn("_k", F.array_join(F.sort_array(members), ",")).dropDuplicates(["_k"]).drop("_k")
