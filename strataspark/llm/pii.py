"""Personal data: detection and keyed, type-consistent surrogates.  DataFrame functions only.

Every entity has a type and a canonical value (an address in lower case, the
digits of a number, each folded word of a name), and its surrogate is drawn from
a keyed hash of both, so that all mentions of one entity get the same
replacement, each in the mention's own format: separators, letter case, script,
country codes and a title's gender stay.  Surrogates are checked against each other and
against all real values; those that collide are drawn again until none does, so
that distinct entities stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .settle import settle

WOMEN, MEN, ANYONE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Госпожа", "Mr|Herr|Monsieur|Señor|Sr|Господин", "Dr|Prof"
TITLES = f"{WOMEN}|{MEN}|{ANYONE}"
TITLED = r" \p{Lu}[\p{L}'-]{1,40}+(?: \p{Lu}[\p{L}'-]{1,40}+)?"
#: (type, pattern); earlier ones win where several match a mention.  Java patterns without groups that capture.  Repeats are
#: bounded or possessive and begin at a boundary, so that a long run is scanned once and no match recurses deeply.
TYPES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,30}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])"),
    ("name_f", rf"\b(?:{WOMEN})\b\.?" + TITLED),
    ("name_m", rf"\b(?:{MEN})\b\.?" + TITLED),
    ("name", rf"\b(?:{ANYONE})\b\.?" + TITLED),
)
TITLE = rf"^(?:{TITLES})\.? "
#: What a text holds if it has a mention of the types named: a test that is far cheaper than their patterns.  In the order of TYPES.
SIGNS = (
    ("@", ("email",)),
    ("[0-9]", ("ip", "ssn", "phone", "iban", "card")),
    (f"(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}])(?:{TITLES})\\.? \\p{{Lu}}", ("name_f", "name_m", "name")),
)
SALTS = 16
#: Country calling codes of two digits; 1 and 7 have one, all others three.
CALLING = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Letters of made-up names: for 16 hex digits each, and the endings of given names by gender.
SYLLABLES = {"latin": ("bdfgklmnprstvzjh", "aeiouaeiouaeioua"), "cyrillic": ("бдфгклмнпрствзжх", "аеиоуаеиоуаеиоуа")}
ENDINGS = {"latin": {"given_f": "a", "given_m": "o", "given": "e", "family": "n"}, "cyrillic": {"given_f": "а", "given_m": "н", "given": "и", "family": "ов"}}


def kind_of(mention: Column) -> Column:
    """The first type whose pattern is the whole mention."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """An entity's value: what all formats of one have in common.  International numbers keep their plus."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    abroad = F.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    # a North American number is one entity with and without its country code
    national = F.when((kind == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(kind == "phone", abroad).otherwise(digits)
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(mention, TITLE, ""))).otherwise(national)
    )


def _last(value: Column) -> Column:
    return F.substring_index(value, " ", -1)


def pattern_of(text: Column) -> Column:
    """The patterns of the types that a text may mention, as one; null if it can mention none."""
    of = dict(TYPES)
    parts = F.concat_ws("|", *[F.when(text.rlike(sign), F.lit("|".join(f"(?:{of[k]})" for k in kinds))) for sign, kinds in SIGNS])
    return F.when(parts != "", parts)


def found(text: Column, pattern: Column) -> Column:
    """The titled and other mentions of a text: m, k (type)."""
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))


def with_mentions(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with _pii_e (the mentions m, k, v of each text, in order) and _pii_g (the gaps around them).

    A person is known by the words of the name, not by the title: a neutral title
    takes the gender that another mention of the family has in the text, and the
    full and family names of titled persons are found again without a title.
    """
    # each is settled, since a filter or a later column would scan the text once more
    own = settle(docs, _pii_p=pattern_of(F.col(text_col)))
    own = settle(own, _pii_e=found(F.col(text_col), F.col("_pii_p")))
    own = own.withColumn("_pii_e", F.when(F.size("_pii_e") > 0, F.transform("_pii_e", lambda e: F.struct(e.m.alias("m"), e.k.alias("k"), canonical(e.k, e.m).alias("v")))))
    bare = F.transform(F.filter("_pii_e", lambda e: e.k.startswith("name")), lambda e: F.regexp_replace(e.m, TITLE, ""))
    own = own.withColumn("_pii_n", F.array_distinct(F.concat(F.filter(bare, lambda n: F.contains(n, F.lit(" "))), F.transform(bare, _last))))
    # names hold letters, apostrophes and hyphens only, so they stand for themselves in a pattern; titled mentions come first
    again = F.concat("_pii_p", F.lit(r"|(?<![\p{L}\p{N}'-])(?:"), F.array_join("_pii_n", "|"), F.lit(r")(?![\p{L}\p{N}'-])"))
    pattern = F.when(F.size("_pii_n") > 0, again).otherwise(F.col("_pii_p"))
    more = F.transform(F.expr(f"regexp_extract_all(`{text_col}`, _pii_p, 0)"), lambda m: F.struct(m.alias("m"), F.coalesce(kind_of(m), F.lit("name")).alias("k")))
    more = F.transform(more, lambda e: F.struct(e.m.alias("m"), e.k.alias("k"), canonical(e.k, e.m).alias("v")))
    own = own.withColumn("_pii_p", F.when(F.size("_pii_e") > 0, pattern))
    own = own.withColumn("_pii_e", F.when(F.size("_pii_n") > 0, more).otherwise(F.col("_pii_e")))
    for k in ("name_f", "name_m"):
        own = own.withColumn(f"_pii_{k}", F.transform(F.filter("_pii_e", _of(k)), lambda e: _last(e.v)))

    def known(e):
        f, m = F.array_contains("_pii_name_f", _last(e.v)), F.array_contains("_pii_name_m", _last(e.v))
        kind = F.when((e.k == "name") & f & ~m, "name_f").when((e.k == "name") & m & ~f, "name_m").otherwise(e.k)
        return F.struct(e.m.alias("m"), kind.alias("k"), e.v.alias("v"))

    own = own.withColumn("_pii_e", F.transform("_pii_e", known))
    own = own.withColumn("_pii_g", F.when(F.size("_pii_e") > 0, F.expr(f"split(`{text_col}`, _pii_p, -1)")))
    return own.drop("_pii_n", "_pii_p", "_pii_name_f", "_pii_name_m")


def _of(kind: str):
    return lambda e: e.k == kind


def entities(e: Column) -> Column:
    """The (kind, value) whose surrogates a mention needs: a name's words, or the mention's own."""
    given = F.when(e.k == "name_f", "given_f").when(e.k == "name_m", "given_m").otherwise("given")
    family = F.struct(F.lit("family").alias("kind"), _last(e.v).alias("value"))
    both = F.array(F.struct(given.alias("kind"), F.substring_index(e.v, " ", 1).alias("value")), family)
    return F.when(~e.k.startswith("name"), F.array(F.struct(e.k.alias("kind"), e.v.alias("value")))).when(F.contains(e.v, F.lit(" ")), both).otherwise(F.array(family))


def _hex(key: str, kind: Column, value: Column, attempt: Column, part: int) -> Column:
    """64 hex digits from the key, the entity, the attempt and the number of the part."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.lit(part)), 256)


def _number(digest: Column, at: int, below: int | Column) -> Column:
    """A number below a limit, from 8 hex digits at a place (from 0)."""
    limit = F.lit(below) if isinstance(below, int) else below
    return F.pmod(F.conv(F.substring(digest, at * 8 + 1, 8), 16, 10).cast("long"), limit.cast("long"))


def _same_shape(value: Column, digest: Column, first: int = 0) -> Column:
    """Letters for letters and digits for digits, from position ``first`` on; all else stays."""
    def drawn(i):
        return F.conv(F.substring(digest, F.pmod(i * 2, F.lit(126)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")

    def one(c, i):
        return (
            F.when(i < first, c).when(c.rlike("[0-9]"), F.pmod(drawn(i), F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(drawn(i), F.lit(26)) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(drawn(i), F.lit(26)) + 1, F.lit(1))).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """The digit that makes ``digits`` followed by it pass the Luhn check."""
    def step(c, i):
        d = c.cast("int") * (F.lit(1) + F.pmod(F.length(digits) - i, F.lit(2)))
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), step), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _iban_check(country: Column, body: Column) -> Column:
    """The two digits that make country, digits and body a valid number: remainder 97, letters as 10 to 35."""
    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), lambda acc, c: step(acc, c).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _word(kind: Column, digest: Column, attempt: Column, script: str) -> Column:
    """A made-up word of a name: syllables drawn from the digest, more of them after collisions."""
    consonants, vowels = SYLLABLES[script]
    at = lambda letters, i: F.translate(F.substring(digest, i + 1, 1), "0123456789abcdef", letters)
    syllable = lambda i: F.concat(at(consonants, 2 * i), at(vowels, 2 * i + 1))
    out = F.concat(*[syllable(i) for i in range(4)], F.when(attempt >= 2, F.concat(syllable(4), syllable(5))).otherwise(""), F.when(attempt >= 4, F.concat(syllable(6), syllable(7))).otherwise(""))
    ending = F.lit(ENDINGS[script]["family"])
    for k in ("given_f", "given_m", "given"):
        ending = F.when(kind == k, ENDINGS[script][k]).otherwise(ending)
    return F.concat(out, ending)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The canonical value of an entity's replacement."""
    a, b = _hex(key, kind, value, attempt, 0), _hex(key, kind, value, attempt, 1)
    digest = F.concat(a, b)
    at = F.instr(value, "@")
    mail = F.concat(_same_shape(F.substring(value, F.lit(1), at - 1), digest), F.lit("@"), _same_shape(F.substring_index(F.substring_index(value, "@", -1), ".", 1), b), F.lit(".example.net"))
    octet = [(_number(a, i, 254) + 1).cast("string") for i in range(4)]
    card = F.substring(_same_shape(value, digest, 1), F.lit(1), F.length(value) - 1)
    body = F.substring(_same_shape(value, digest, 4), F.lit(5), F.length(value))
    country = F.substring(value, 1, 2)
    padded = lambda i, below, n: F.lpad((_number(a, i, below) + 1).cast("string"), n, "0")
    ssn = F.concat(padded(0, 665, 3), padded(1, 99, 2), padded(2, 9999, 4))  # areas, groups and serials that exist
    abroad = value.startswith("+")
    coded = F.when(F.substring(value, 2, 1).isin("1", "7"), _same_shape(value, digest, 2)).when(F.substring(value, 2, 2).isin(*CALLING), _same_shape(value, digest, 3)).otherwise(_same_shape(value, digest, 4))
    word = F.when(value.rlike(r"\p{IsCyrillic}"), _word(kind, a, attempt, "cyrillic")).otherwise(_word(kind, a, attempt, "latin"))
    return (
        F.when(kind == "email", mail).when(kind == "ip", F.concat_ws(".", *octet)).when(kind == "card", F.concat(card, _luhn(card)))
        .when(kind == "iban", F.concat(country, _iban_check(country, body), body)).when(kind == "ssn", ssn)
        .when(kind == "phone", F.when(abroad, coded).otherwise(_same_shape(value, digest, 1))).otherwise(word)
    )


def shown(kind: Column, mention: Column, canon: Column) -> Column:
    """A canonical surrogate in the format of a mention."""
    # the mention's digits are replaced in order, its separators and country code stay
    canon = F.when(kind == "phone", F.replace(canon, F.lit("+"), F.lit(""))).otherwise(canon)
    longer = (kind == "phone") & (F.length(F.regexp_replace(mention, "[^0-9]", "")) == F.length(canon) + 1)
    canon = F.when(longer, F.concat(F.lit("1"), canon)).otherwise(canon)
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    def count(c, i):
        return F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), "[^0-9A-Z]", ""))

    spread = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(canon, count(c, i), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(mention, TITLE, 0)
    cased = F.when(mention == F.upper(mention), F.upper(canon)).otherwise(F.initcap(canon))
    return F.when(kind.startswith("name"), F.concat(title, cased)).when(kind.isin("email", "ip"), canon).otherwise(spread)


def _mentions(own: DataFrame) -> DataFrame:
    """The entities of every row of ``with_mentions`` that has any, as (kind, value)."""
    return own.select(F.explode("_pii_e").alias("e")).select(F.explode(entities(F.col("e"))).alias("x")).select("x.kind", "x.value")


def redrawn(own: DataFrame, key: str, *, scratch: Scratch) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides; attempts at which all surrogates differ.

    An entity yields if its surrogate is a real value of the corpus, or that of
    an entity with an earlier attempt or, among equals, a smaller value.
    """
    seen = scratch.save(_mentions(own).distinct())
    now = scratch.save(seen.select("kind", "value", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("value"), F.lit(0), key).alias("new")))
    while True:
        # one surrogate may not stand for two entities, whatever their types of name are
        crowd = now.groupBy("new").agg(F.count("*").alias("m"), F.max(F.struct("attempt", "value", "kind")).alias("last")).where("m > 1")
        keep = now.join(crowd.select("new"), "new", "left_semi").groupBy("new").agg(F.min(F.struct("attempt", "value", "kind")).alias("k"))
        again = now.join(keep, "new").where(F.struct("attempt", "value", "kind") != F.col("k")).select("kind", "value")
        real = now.join(seen.select(F.col("value").alias("new")).distinct(), "new", "left_semi").select("kind", "value")
        again = scratch.save(again.unionByName(real).distinct().withColumn("again", F.lit(True)))
        if not again.limit(1).count():
            return now.where("attempt > 0").select("kind", "value", "attempt")
        more = now.join(again, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        before, now = now, scratch.save(more.select("kind", "value", "attempt", F.when(F.col("again"), surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("new")).alias("new")))
        scratch.drop(before, again)


def replace(docs: DataFrame, *, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """The rows with every detected entity replaced; with ``counts`` also the number of entities of each type.

    Every row comes back with all its columns; null texts stay null, texts
    without entities stay as they are.  Rows are treated alike however often they
    repeat, and ids play no part.  Names beginning with ``_pii_`` are reserved.
    The rows are written to the shared folder with their mentions.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    # the patterns go over a text once: what they find is written beside it, for the surrogates and for the replacement
    own = scratch.save(with_mentions(docs, text_col))
    late = scratch.save(redrawn(own, key, scratch=scratch))
    # texts are the gaps and mentions of one pattern; without a mention nothing else is computed
    if late.limit(1).count():
        needed = own.where(F.size("_pii_e") > 0).select(F.xxhash64(text_col).alias("_pii_h"), F.explode("_pii_e").alias("e"))
        needed = needed.select("_pii_h", F.explode(entities(F.col("e"))).alias("x")).select("_pii_h", "x.kind", "x.value").distinct()
        of = needed.join(late, ["kind", "value"])
        of = of.groupBy("_pii_h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("_pii_late"))
        # copies of one text are many rows of one hash: they are spread over salts
        of = of.withColumn("_pii_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumns({"_pii_h": F.xxhash64(text_col), "_pii_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}).join(of, ["_pii_h", "_pii_salt"], "left")
    else:
        own = own.withColumn("_pii_late", F.lit(None).cast("map<string,int>"))

    def new(e):
        def drawn(x):
            return surrogate(x.kind, x.value, F.coalesce(F.element_at("_pii_late", F.concat_ws("|", x.kind, x.value)), F.lit(0)), key)

        return F.struct(e.m.alias("m"), e.k.alias("k"), F.array_join(F.transform(entities(e), drawn), " ").alias("c"))

    own = own.withColumn("_pii_e", F.transform("_pii_e", new))
    own = own.withColumn("_pii_s", F.transform("_pii_e", lambda e: shown(e.k, e.m, e.c)))
    joined = F.concat(F.array_join(F.zip_with(F.slice("_pii_g", 1, F.size("_pii_s")), "_pii_s", lambda g, s: F.concat(g, s)), ""), F.element_at("_pii_g", -1))
    cols = [F.when(F.col("_pii_s").isNull(), F.col(text_col)).otherwise(joined).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        def of(k):
            return F.size(F.filter("_pii_e", lambda e: e.k == k))

        cols += [F.greatest(F.coalesce(of(k), F.lit(0)), F.lit(0)).cast("long").alias(f"n_{k}") for k, _ in TYPES]
    return own.select(*cols)
