"""MinHash near-duplicate detection with odd sketches.

1.  Each distinct set of word shingles becomes one node (a 128-bit digest of the
    set), so exact copies, however many, are one row after a partial aggregate.
2.  A node has ``bands`` of ``rows`` MinHash values, and an odd sketch: its
    MinHash samples folded into a parity bitmap.  The population count of the XOR
    of two bitmaps estimates how many samples differ, precisely when few do.
3.  Nodes that share a band are candidates.  A bucket of m nodes gives m - 1
    pairs with a pivot; after the components are known, buckets that still touch
    several components are taken up with another pivot, and what then is left is
    compared in blocks of bounded size, only across components.  A pair inside one
    component needs no link of its own, so no group is expanded into all pairs.
4.  The odd sketch rejects a pair whose estimate is more than SIGMAS deviations
    below the threshold.  A second parity bitmap, of the whole set, then bounds the
    difference from below (no more bits differ than members do), without loss.  All
    that remain are confirmed on the full shingle sets.
5.  Components are found by large-star and small-star steps on the links.

The bands are chosen so that a pair exactly at the threshold shares none with a
probability of at most MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import BY_SPACE, U, chunks, mix, shingles, words

MISS = 1e-6
ROWS = 5
SIGMAS = 6.0
SKETCH_BITS = 1024
BLOCK = 256
PIVOT_ROUNDS = 2
SKETCHES = "doc_id long, node binary, n_shingles long, bands array<long>, odd binary, parity binary, th long"


def bands_for(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _sets(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    s, edges = shingles(h, bounds, k)
    return [np.unique(s[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def _digest(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each set, from two sums over its mixed members; None for an empty set."""
    out = []
    for s in sets:
        if len(s):
            a, b = mix(s).sum(dtype=U), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
            out.append(np.array([a, b ^ U(len(s))], dtype=">u8").tobytes())
        else:
            out.append(None)
    return out


def _signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash values, one row per set; sets must not be empty."""
    flat = np.concatenate(sets)
    edges = np.cumsum([0] + [len(s) for s in sets])[:-1]
    out = np.empty((len(sets), k), U)
    for i, a in enumerate(_multipliers(k)):
        out[:, i] = np.minimum.reduceat(flat * a, edges)
    return mix(out + np.arange(k, dtype=U))


def _odd(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row's (sample number, value) pairs."""
    bits = np.zeros((len(sig), SKETCH_BITS), np.uint8)
    at = np.arange(len(sig))
    salts = _multipliers(sig.shape[1])
    for i in range(sig.shape[1]):
        bits[at, (mix(sig[:, i] + salts[i]) % U(SKETCH_BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1)


def _parity(members: np.ndarray) -> bytes:
    """Parity bitmap of a set, of a power of two of bits, two to four for each member or so."""
    size = 1 << max(9, math.ceil(math.log2(3 * len(members))))
    return np.packbits((np.bincount((members & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to a smaller width; parity bits fold by XOR.

    A bit's place is the low bits of a hash, so halves, quarters and so on line up.
    """
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, width), axis=1)


def differing(x: bytes, y: bytes) -> int:
    """A lower bound of the members in which two sets differ."""
    a, b = np.frombuffer(x, np.uint8)[None], np.frombuffer(y, np.uint8)[None]
    w = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(_folded(a, w) ^ _folded(b, w)).sum())


def _most_differing(n, need: int):
    """The members in which sets of together n members may differ and still be similar enough."""
    return (100 - need) * n // (100 + need)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n, k = sig.shape
    acc = np.broadcast_to(np.arange(k // rows, dtype=U), (n, k // rows)).copy()
    for r in range(rows):
        acc = mix(acc * U(0x9FB21C651E98DF25) + sig[:, r::rows][:, : k // rows])
    return acc.view(np.int64)


def similarity(popcount: np.ndarray, k: int) -> np.ndarray:
    """Estimated share of equal MinHash samples, from the population count of the XOR of two odd sketches."""
    z = np.minimum(popcount / SKETCH_BITS, 0.499)
    return 1 + SKETCH_BITS * np.log1p(-2 * z) / (4 * k)


def _floor(threshold: float, k: int) -> float:
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / k)


def sketches(docs: DataFrame, *, words_per: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SKETCHES for each row, th being the hash of its text; null node, bands and sketch where there are no words."""
    bands = bands_for(threshold)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, data, offsets in chunks(batch.column(1), 2_000_000):
                h, bounds = words(data, offsets, BY_SPACE)
                sets = _sets(h, bounds, words_per)
                full = [s for s in sets if len(s)]
                at = np.cumsum([0] + [len(s) > 0 for s in sets])
                if full:
                    sig = _signatures(full, bands * ROWS)
                    odd, band = _odd(sig), _bands(sig, ROWS)
                cut = pa.array((at * bands).astype(np.int32))
                values = pa.array(band.ravel() if full else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(_digest(sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(cut, values), pa.array([odd[i].tobytes() if len(s) else None for i, s in zip(at, sets)], pa.binary()), pa.array([_parity(s) if len(s) else None for s in sets], pa.binary()), batch.column(2).slice(a, b - a)],
                    names=["doc_id", "node", "n_shingles", "bands", "odd", "parity", "th"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col).alias("th")).mapInArrow(run, SKETCHES)


def _full_sets(docs: DataFrame, wanted: DataFrame, words_per: int, text_col: str, id_col: str) -> DataFrame:
    """(node, members) of the wanted nodes, read anew from the text of one document of each."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for _a, _b, data, offsets in chunks(batch.column(0), 2_000_000):
                h, bounds = words(data, offsets, BY_SPACE)
                sets = _sets(h, bounds, words_per)
                yield pa.RecordBatch.from_arrays([pa.array(_digest(sets), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "members"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # a null id is an id here: the hash of the text finds the rows of a node that has no other
    texts = own.join(wanted.select("doc", "th").distinct(), F.col("id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("th")), "left_semi").select("text")
    members = texts.mapInArrow(run, "node binary, members binary")
    return members.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: 100 * intersection >= 100 * threshold * union, in integers."""
    need = round(threshold * 100)

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= need * (len(p) + len(q) - both))
        return pd.Series(out)

    left = members.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = members.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(linked("x", "y")).select("a", "b")


def components(spark, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the component's smallest node.

    Large-star and small-star steps until nothing changes; each step is written,
    so that the plan stays short and a lost executor costs one step only.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = scratch.save(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges, large)
        edges = after
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def classes(docs: DataFrame, *, words_per: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is that id), one row per row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a
    document's set holds its distinct ``words_per``-word shingles, or its whole
    sequence where it has fewer words.  Texts without words (null, empty, blank)
    are linked with nothing.  Repeated rows come back as often as they came in.
    A null id is never the smallest: such a row is kept only if its class has no id.
    An empty table gives an empty result; other columns are not read.
    """
    return _classes(docs, Scratch(docs.sparkSession, "near_dup"), words_per, threshold, id_col, text_col).drop("th")


def _classes(docs: DataFrame, scratch: Scratch, words_per: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``classes`` with th, the hash of the row's text."""
    spark = docs.sparkSession
    k = bands_for(threshold) * ROWS
    s = scratch.save(sketches(docs, words_per=words_per, threshold=threshold, id_col=id_col, text_col=text_col))
    nodes = scratch.save(s.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("odd").alias("odd"), F.min("parity").alias("parity")).select("node", F.col("first.doc_id").alias("doc"), F.col("first.th").alias("th"), "n", "bands", "odd", "parity"))

    exploded = nodes.select("node", F.explode("bands").alias("band"))
    crowded = exploded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    buckets = scratch.save(exploded.join(crowded, "band"))

    links = None
    comp = None
    members = None
    tested = None
    for turn in range(PIVOT_ROUNDS + 1):
        at = buckets.withColumn("comp", F.col("node")) if comp is None else buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = at.groupBy("band", "comp").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node")).alias("p"))
        # the pivot stands in the bucket's largest component; buckets inside one component are done
        best = sizes.groupBy("band").agg(F.count("*").alias("comps"), F.sum("m").alias("size"), F.max(F.struct("m", "comp", "p")).alias("top")).where("comps > 1")
        best = best.select("band", "size", F.col("top.comp").alias("top"), F.col("top.p.node").alias("pivot"))
        if comp is not None:
            best = best.where("size > 2")
        best = scratch.save(best)
        if not best.limit(1).count():
            break
        if turn < PIVOT_ROUNDS:
            pairs = at.join(best, "band").where("comp <> top").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
            pairs = _sketched(pairs, nodes, threshold, k)
        else:
            pairs = _blocks(at.join(best.select("band", "size"), "band"), nodes, threshold, k)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if members is not None:
            ends = ends.join(members, "node", "left_anti")
        more = scratch.save(_full_sets(docs, nodes.join(ends, "node", "left_semi").select("node", "doc", "th"), words_per, text_col, id_col), "none")
        members = more if members is None else members.unionByName(more)
        found = scratch.save(_confirm(pairs, members, threshold))
        if not found.limit(1).count():
            continue
        links = found if links is None else links.unionByName(found)
        comp = scratch.save(components(spark, links, scratch))

    owner = nodes.select("node", "doc", F.col("node").alias("comp")) if comp is None else nodes.select("node", "doc").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = owner.groupBy("comp").agg(F.min("doc").alias("component_id"))
    reach = owner.join(first, "comp").select("node", F.col("component_id"))
    out = s.select("doc_id", "n_shingles", "node", "th").join(reach, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "th").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _sketched(pairs: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose odd sketches do not rule it out."""
    floor, need = _floor(threshold, k), round(threshold * 100)

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series, n: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        a = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        b = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        ok = similarity(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), k) >= floor
        for i in np.flatnonzero(ok):
            ok[i] = differing(p.iat[i], q.iat[i]) <= _most_differing(int(n.iat[i]), need)
        return pd.Series(ok)

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("x"), F.col("parity").alias("p"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("y"), F.col("parity").alias("q"))
    sized = pairs.join(left, "a").join(right, "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(need) * F.greatest("na", "nb"))
    return sized.where(near("x", "y", "p", "q", F.col("na") + F.col("nb"))).select("a", "b")


def _blocks(at: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs across components within a bucket, from groups of at most about two blocks of BLOCK nodes.

    A bucket of m nodes is cut into m / BLOCK blocks by hash, and every pair of
    blocks is a group of its own: no task holds a bucket, and only pairs that pass
    the sketches and stand in different components are emitted.
    """
    floor, need = _floor(threshold, k), round(threshold * 100)
    n = F.ceil(F.col("size") / BLOCK)
    own = at.join(nodes.select("node", "n", "odd", "parity"), "node").withColumn("parts", n).withColumn("part", F.pmod(F.xxhash64("node", "band"), n))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "comp", "n", "odd", "parity")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        x = pdf[pdf["part"] == i].reset_index(drop=True)
        y = x if i == j else pdf[pdf["part"] == j].reset_index(drop=True)
        out = []
        if len(x) and len(y):
            b = np.frombuffer(b"".join(y["odd"]), np.uint64).reshape(len(y), -1)
            yn, yk = y["n"].to_numpy(), y["node"].to_numpy()
            kinds, codes = {}, lambda s: np.fromiter((kinds.setdefault(c, len(kinds)) for c in s), np.int64, len(s))
            xc, yc = codes(x["comp"]), codes(y["comp"])
            width = np.fromiter(map(len, y["parity"]), np.int64, len(y))
            place = np.zeros(len(y), np.int64)
            stacks = {}
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                place[own] = np.arange(len(own))
                stacks[w] = np.frombuffer(b"".join(y["parity"].iloc[own]), np.uint8).reshape(len(own), w)
            for r in range(len(x)):
                pn = x["n"].iat[r]
                ok = (100 * np.minimum(yn, pn) >= need * np.maximum(yn, pn)) & (yc != xc[r])
                if i == j:
                    ok[: r + 1] = False
                ok = np.flatnonzero(ok)
                if len(ok):
                    a = np.frombuffer(x["odd"].iat[r], np.uint64)
                    ok = ok[similarity(np.bitwise_count(b[ok] ^ a).sum(axis=1, dtype=np.int64), k) >= floor]
                p, bits = x["node"].iat[r], np.frombuffer(x["parity"].iat[r], np.uint8)[None]
                for w in np.unique(width[ok]):
                    q = ok[width[ok] == w]
                    v = min(w, bits.shape[1])
                    apart = np.bitwise_count(_folded(stacks[w][place[q]], v) ^ _folded(bits, v)).sum(axis=1, dtype=np.int64)
                    out += [(min(p, yk[z]), max(p, yk[z])) for z in q[apart <= _most_differing(pn + yn[q], need)]]
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("band", "i", "j").applyInPandas(group, "a binary, b binary").distinct()


def deduplicate(docs: DataFrame, *, words_per: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, with all its columns.

    Texts without words are linked with nothing and stay, as do rows of a null id.
    Of rows that repeat an id and its text one stays; rows of one id with
    different texts that are the smallest of their groups all stay, and only
    those that are not go.
    """
    scratch = Scratch(docs.sparkSession, "near_dup")
    kept = scratch.save(_classes(docs, scratch, words_per, threshold, id_col, text_col))
    scratch.release()  # before the texts are shuffled
    gone = kept.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    own = F.col(id_col).cast("long")
    out = docs.join(gone, (own == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")
    twice = kept.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select(F.col("doc_id").alias("__twice"))
    if not twice.limit(1).count():
        return out
    again = out.join(twice, own == F.col("__twice"), "left_semi").dropDuplicates([id_col, text_col])
    return out.join(twice, own == F.col("__twice"), "left_anti").unionByName(again)
