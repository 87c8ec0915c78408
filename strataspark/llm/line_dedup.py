"""Near-duplicate lines by an exact set-similarity join.  DataFrame functions only.

A line is the set of its lower-cased words.  Two lines match if 100 *
intersection >= threshold * union.  A line goes if it matches a line at an
earlier position (document id, line number).  Every line with a word takes part;
blank lines stay.

1.  The text is split once.  Lines with equal word sets form a class, known by a
    128-bit hash, with its first position; all its later copies go.  From here on
    there is one row for each class.
2.  Words are ordered by rarity: by their count over all lines, kept in a table of
    COUNTERS counters that words share by hash (a total order is all that the
    filters need; sharing only makes it a little coarser), then by hash.
3.  Of each class only a prefix of its rarest words is written out, and a
    left-semi join on the word keeps the rows for which another class passes the
    length filter, the positional filter and a bound on the difference from parity
    signatures (64 bits, 256 for long lines); none loses a match.  The join stops at
    the first such class: its rows are never more than its input's, whatever the
    size of a group.  The shorter line of a pair is met by a shorter prefix, and
    frequent words only within a class of lengths.
4.  One earlier match decides a class, so the classes left over are first compared
    with the earliest class of their words' lists, and then with a few others
    (pivots: the first of each of some salts).  Classes that match one are done; the
    few that stay open meet all members of their lists.
5.  Every candidate is verified on the whole word sets (64-bit hashes of the words).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .settle import settle

COUNTERS = 1 << 17
BITMAP_WORDS = 1 << 16
#: Level of a counter that has seen one word, once.
ONCE = 4
#: Salts of each further round of pivots; one is made while open rows could meet more than OPEN times the rows of their lists.
ROUNDS = (4, 8, 16, 32)
OPEN = 16
#: Words of this level and above (their counter has seen 2,047 words) are keys together with a class of lengths, kept above BUCKET bits.
OFTEN = 44
BUCKET = 55
#: Shares of the words that are joined one after the other.
PASSES = 2
#: Lines of more words have the signature in parts, which do not saturate as early; the number of parts is a power of two.
LONG = 64
PARTS = 4
#: A class: its first position and half of its hash.
KEY = ("id", "ln", "k1")
#: What the rows of the join on words carry, beside the word and the place: half of the class's hash and its signatures.
SIGNATURE = ("k1", "bits", *[f"b{j}" for j in range(1, PARTS)])
LAST = 2**63 - 1


def _bit(x) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the whole text), ln, s (sorted hashes of the line's distinct words) and k1, k2 (128 bits of s), for each line with a word."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    plain, odd = F.lower("t"), F.lit(False)
    for x in "\t\x0b\x0c\r":  # splitting at one plain character needs no pattern
        plain, odd = F.replace(plain, F.lit(x), F.lit(" ")), odd | F.contains("t", F.lit(x))
    plain = F.when(odd, plain).otherwise(F.lower("t"))  # a search for one character costs a third of a replacement
    own = own.select("id", F.xxhash64("t").alias("th"), F.posexplode_outer(F.split(plain, "\n")).alias("ln", "line"))
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    own = settle(own.select("id", "th", "ln", "line"), s=F.sort_array(hashes)).where(F.size("s") > 0)
    return own.select("id", "th", "ln", "s", F.xxhash64("s").alias("k1"), F.xxhash64("s", F.lit(1)).alias("k2"))


def _dense(spark, counted: DataFrame, size: int, kind: str) -> Column:
    """A scalar: the array of ``size`` values of (i, v), 0 where there is none."""
    full = spark.range(size).join(counted, F.col("id") == F.col("i"), "left").select("id", F.coalesce("v", F.lit(0)).cast(kind).alias("v"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x.v).alias("a")).scalar()


def _in_bitmap(keys: DataFrame, key: str, scratch: Scratch) -> Column:
    """A test that holds for all values of ``keys``, and for few others: a bitmap of constant size, as a scalar."""
    place = F.pmod(F.shiftright(key, 6), F.lit(BITMAP_WORDS))
    bits = scratch.save(keys.groupBy(place.alias("i")).agg(F.bit_or(_bit(F.col(key))).alias("v")))
    return F.get(_dense(keys.sparkSession, bits, BITMAP_WORDS, "long"), place.cast("int")).bitwiseAND(_bit(F.col(key))) != 0


def rarity_table(lines: DataFrame, scratch: Scratch) -> str:
    """The COUNTERS levels, joined by commas: a logarithm, 0 to 127, of the count of a counter's words over all lines.

    The one value that comes to the driver has a constant size, whatever the corpus.
    """
    counted = lines.select(F.explode("s").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(COUNTERS - 1)).alias("i")).agg(F.count("*").alias("v"))
    level = F.least(F.floor(F.log2(F.col("v") + 1) * 4), F.lit(127))
    counted = scratch.save(counted.select("i", level.alias("v")))
    return lines.sparkSession.range(1).select(F.array_join(_dense(lines.sparkSession, counted, COUNTERS, "string"), ",")).first()[0]


def line_classes(lines: DataFrame, rarity: str, threshold: int) -> DataFrame:
    """k1, k2, id, ln (first position), copies, n (words), bits (their parity on 64 bits), b1 to b3 and pre (the probe prefix), a row for each class.

    b1 to b3 are the parities of a long line's words of one residue each; with the residue 0, which is left out, they add up to bits.
    A word of the prefix is a number: the rarity level of its counter above 48 bits of its hash.
    """
    levels = F.split(F.lit(rarity), ",").cast("array<tinyint>")

    def pack(x):
        level = F.coalesce(F.get(levels, x.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(level, 48).bitwiseOR(F.shiftrightunsigned(x, 16))

    def parity(s):
        return F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(_bit(x)))

    def part(j):
        own = F.filter("s", lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(PARTS - 1)) == j)
        return F.when(F.size("s") > LONG, parity(own)).otherwise(F.lit(0).cast("long"))

    parts = [part(j).alias(f"b{j}") for j in range(1, PARTS)]
    keep = F.size("s") + 1 - F.ceil(F.lit(threshold) * F.size("s") / F.lit(100.0) - 1e-9).cast("int")
    own = lines.select("k1", "k2", F.struct("id", "ln").alias("p"), F.struct(F.size("s").alias("n"), parity("s").alias("bits"), *parts, F.slice(F.sort_array(F.transform("s", pack)), F.lit(1), keep).alias("pre")).alias("v"))
    made = own.groupBy("k1", "k2").agg(F.min("p").alias("p"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return made.select("k1", "k2", "p.id", "p.ln", "copies", "v.*")


def _bucket(n, t: int) -> Column:
    """The class of a length; one that is allowed for a line is in its own class or the next."""
    return F.floor(F.ln(n) / F.lit(math.log(max(100 / t, 1.25)))).cast("long")


def prefixes(classes: DataFrame, t: int, share: int, index: bool) -> DataFrame:
    """w, ROW: a row for each prefix word of this share that another line may have.

    A shorter line of a pair meets the longer one already in the words that the filter needs for two lines of its own length
    (``index``).  A frequent word is a key together with a class of lengths of the longer line.
    """
    pre = F.slice("pre", F.lit(1), F.floor(F.col("n") * (100 - t) / (100 + t) + 1e-9).cast("int") + 1) if index else F.col("pre")
    rows = classes.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SIGNATURE], "n", F.posexplode(pre).alias("i", "w")).where((F.shiftright("w", 48) > ONCE) & (F.pmod("w", F.lit(PASSES)) == share))
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("place")
    often = F.shiftright("w", 48) >= OFTEN
    if not index:
        w = F.col("w").bitwiseOR(F.when(often, F.shiftleft(_bucket("n", t) + 1, BUCKET)).otherwise(F.lit(0).cast("long")))
        return rows.select(F.coalesce(w, F.lit(0).cast("long")).alias("w"), *SIGNATURE, place)
    classed = F.sequence(_bucket("n", t) + 1, _bucket(F.floor(100 * F.col("n") / t), t) + 1)
    rows = rows.select("w", *SIGNATURE, place, F.explode(F.when(often, classed).otherwise(F.array(F.lit(0).cast("long")))).alias("b"))
    return rows.select(F.coalesce(F.col("w").bitwiseOR(F.shiftleft("b", BUCKET)), F.lit(0).cast("long")).alias("w"), *SIGNATURE, "place")


def _may_match(t: int) -> Column:
    """For a row x and a row y of the same word: no filter rules the pair out."""
    nx, ny = F.shiftright("x.place", 32), F.shiftright("y.place", 32)
    ix, iy = F.col("x.place").bitwiseAND(F.lit(2**32 - 1)), F.col("y.place").bitwiseAND(F.lit(2**32 - 1))
    length = 100 * F.least(nx, ny) >= t * F.greatest(nx, ny)
    position = ((100 + t) * (nx - ix) >= t * (nx + ny)) & ((100 + t) * (ny - iy) >= t * (nx + ny))

    def differ(*names):
        """Every bit that differs is a word that differs."""
        x, y = (functools.reduce(Column.bitwiseXOR, [F.col(f"{side}.{n}") for n in names]) for side in "xy")
        return F.bit_count(x.bitwiseXOR(y))

    few = (100 + t) * differ("bits") <= (100 - t) * (nx + ny)
    parts = sum((differ(f"b{j}") for j in range(1, PARTS)), differ(*SIGNATURE[1:]))
    wide = (F.least(nx, ny) <= LONG) | ((100 + t) * parts <= (100 - t) * (nx + ny))
    return few & length & position & wide


def _longer(x: str, y: str) -> Column:
    """x is of another class than y, and not shorter.  Two classes of equal k1 and equal bits would be taken for one: 128 bits."""
    return (F.shiftright(f"{x}.place", 32) >= F.shiftright(f"{y}.place", 32)) & ((F.col(f"{x}.k1") != F.col(f"{y}.k1")) | (F.col(f"{x}.bits") != F.col(f"{y}.bits")))


def _candidates(classes: DataFrame, t: int, scratch: Scratch) -> DataFrame | None:
    """w, SIGNATURE, place, id, ln: the prefix rows for which another class passes all filters; None if there is none."""
    parts = []
    for share in range(PASSES):  # a share of the words at a time, so that less lies in shuffles at once
        index = prefixes(classes, t, share, True)
        longer = scratch.save(_on_word(prefixes(classes, t, share, False), index, _may_match(t) & _longer("x", "y"), "left_semi"))
        scratch.release()
        index = index.where(_in_bitmap(longer, "w", scratch))
        parts += [longer, scratch.save(_on_word(index, longer, _may_match(t) & _longer("y", "x"), "left_semi"))]
        scratch.release()
    rows = functools.reduce(DataFrame.unionByName, parts)
    if not rows.limit(1).count():
        return None
    places = classes.where(_in_bitmap(rows, "k1", scratch)).select(*KEY)
    # one exchange on k1 serves both steps
    found = rows.withColumn("w", F.col("w").bitwiseAND(F.lit((1 << BUCKET) - 1))).repartition("k1").distinct().join(places, "k1")
    found = scratch.save(found)
    scratch.drop(*parts)
    scratch.release()
    return found


def _earlier() -> Column:
    return (F.col("y.id") < F.col("x.id")) | ((F.col("y.id") == F.col("x.id")) & (F.col("y.ln") < F.col("x.ln")))


def _on_word(x: DataFrame, y: DataFrame, met: Column, how: str) -> DataFrame:
    return x.alias("x").join(y.alias("y"), (F.col("x.w") == F.col("y.w")) & met, how)


def _verified(pairs: DataFrame, sets: DataFrame, t: int, scratch: Scratch) -> DataFrame:
    """KEY of the classes of ``pairs`` (KEY, and another class as a struct o) that have a true match among them."""
    theirs = [f"o_{c}" for c in KEY]
    pairs = scratch.save(pairs.select(*KEY, *[F.col(f"o.{c}").alias(f"o_{c}") for c in KEY]))
    left = sets.where(_in_bitmap(pairs, "k1", scratch)).select(*KEY, F.col("s").alias("x"))
    right = sets.select(*[F.col(c).alias(f"o_{c}") for c in KEY], F.col("s").alias("y")).where(_in_bitmap(pairs, "o_k1", scratch))
    both = pairs.join(left, [*KEY]).join(right, theirs)
    return scratch.save(both.where((100 + t) * F.size(F.array_intersect("x", "y")) >= t * (F.size("x") + F.size("y"))).select(*KEY).distinct())


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(*[f"x.{c}" for c in KEY], F.struct(*[f"y.{c}" for c in KEY]).alias("o")).distinct()


def matched(lines: DataFrame, classes: DataFrame, t: int, scratch: Scratch) -> DataFrame | None:
    """KEY of the classes that match an earlier one; None if none has a candidate."""
    members = _candidates(classes, t, scratch)
    if members is None:
        return None
    ends = scratch.save(members.select(*KEY).distinct())
    near = lines.where(_in_bitmap(ends, "k1", scratch)).select(*KEY, "s").join(ends, [*KEY], "left_semi")
    sets = scratch.save(near.groupBy(*KEY).agg(F.first("s").alias("s")), dictionary=False)
    scratch.release()
    may = _may_match(t) & _earlier()
    size = members.count()
    sizes = scratch.save(members.groupBy("w").agg(F.count("*").alias("m")))
    chosen = F.min(F.struct(*KEY, *[c for c in members.columns if c not in (*KEY, "w")])).alias("p")
    # most classes match the first class of one of their lists, and need no other
    first = members.groupBy("w").agg(chosen).select("w", "p.*")
    best = _on_word(members, first, may, "inner").groupBy(*[f"x.{c}" for c in KEY]).agg(F.min(F.struct(*[f"y.{c}" for c in KEY])).alias("o"))
    done = _verified(best, sets, t, scratch)
    still = scratch.save(_on_word(members.join(done, [*KEY], "left_anti"), members, may, "left_semi"))
    for turn, salts in enumerate(ROUNDS):
        work = still.groupBy("w").agg(F.count("*").alias("c")).join(sizes, "w").agg(F.sum(F.col("c") * F.col("m"))).first()[0] or 0
        if work <= OPEN * size:
            break
        salt = F.pmod(F.xxhash64("k1", F.lit(turn)), F.lit(salts)).alias("salt")
        pivots = members.groupBy("w", salt).agg(chosen).select("w", "p.*")
        found = _verified(_pairs(_on_word(still, pivots, may, "inner")), sets, t, scratch)
        done = done.unionByName(found)
        still = scratch.save(still.join(found, [*KEY], "left_anti"))
    done = done.unionByName(_verified(_pairs(_on_word(still, members, may, "inner")), sets, t, scratch))
    done = scratch.save(done)
    scratch.drop(members, still, sets, ends, sizes)
    scratch.release()
    return done


def lines_to_remove(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, th (hash of the text) and ln of each line that goes; a null id is LAST."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line_dedup")
    t = round(threshold * 100)
    lines = scratch.save(split_lines(docs, id_col, text_col), dictionary=False)
    classes = scratch.save(line_classes(lines, rarity_table(lines, scratch), t))
    scratch.release()
    found = matched(lines, classes, t, scratch)
    cuts = classes.select("k1", "k2", F.struct("id", "ln").alias("cut"), "copies")
    if found is None:
        cuts = cuts.withColumn("all", F.lit(False))
    else:
        cuts = cuts.join(found.select(F.struct("id", "ln").alias("cut"), "k1").distinct().withColumn("all", F.lit(True)), ["cut", "k1"], "left").withColumn("all", F.coalesce("all", F.lit(False)))
    cuts = scratch.save(cuts.where("all or copies > 1").drop("copies"))
    own = lines.where(_in_bitmap(cuts, "k1", scratch)).select("id", "th", "ln", "k1", "k2")
    gone = own.join(cuts, ["k1", "k2"]).where(F.col("all") | (F.struct("id", "ln") > F.col("cut")))
    gone = scratch.save(gone.select("id", "th", "ln"))
    scratch.drop(lines, classes)
    scratch.release()
    return gone


def deduplicate(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The rows with their later matching lines removed; with ``counts`` also n_lines, n_removed and removed (line numbers).

    Every row comes back, null texts as null, texts that lose all lines as empty.
    Rows that repeat an id and its text are one document: none removes the other's
    lines.  Rows of one id with different texts stand at the same position, and
    neither is later than the other.  A null id comes after all others.  Other
    columns pass through.  An empty table stays empty.  Names beginning with ``_ld_`` are reserved.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    gone = lines_to_remove(docs, threshold=threshold, id_col=id_col, text_col=text_col, scratch=scratch)
    gone = gone.groupBy(F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th")).agg(F.sort_array(F.collect_set("ln")).alias("_ld_gone"))
    gone = scratch.save(gone)
    scratch.release()
    key = docs.withColumns({"_ld_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "_ld_th": F.xxhash64(text_col)})
    # texts that lose no line stay where they are; only the others meet their line numbers in a shuffle
    hit = F.coalesce(_in_bitmap(gone.select("_ld_th"), "_ld_th", scratch), F.lit(False))
    marked = key.withColumn("_ld_hit", hit)
    changed = marked.where("_ld_hit").join(gone, ["_ld_id", "_ld_th"], "left")
    same = marked.where("not _ld_hit").withColumn("_ld_gone", F.lit(None).cast("array<int>"))
    changed = settle(changed, _ld_lines=F.when(F.col("_ld_gone").isNotNull(), F.split(text_col, "\n")))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_ld_lines) - 1), _ld_gone), i -> get(_ld_lines, i)), '\n')")
    changed = changed.withColumn("_ld_text", F.when(F.col("_ld_gone").isNull(), F.col(text_col)).otherwise(kept))
    out = changed.drop("_ld_lines").unionByName(same.withColumn("_ld_text", F.col(text_col)))
    cols = [F.col("_ld_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).cast("long")
        cols += [n.alias("n_lines"), F.greatest(F.coalesce(F.size("_ld_gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_ld_gone", F.array().cast("array<int>")).alias("removed")]
    return out.select(*cols)
