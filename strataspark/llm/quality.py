"""Quality rules per document, and host-level verdicts from them.  DataFrame functions only.

The rules of a document are computed from its own text, without a shuffle.  Rule
failures are counted per host; a beta prior is fitted to the hosts by
beta-binomial moments (the spread that small counts alone would give is taken
off), each host's rate is shrunk towards it, and a host is rejected with all its
documents if its rate lies, by DEVIATIONS posterior deviations, above both the
prior's mean and MAX_HOST_RATE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .settle import settle

#: What separates words, and the characters counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A host is rejected if its shrunk rate of failing documents, less DEVIATIONS of its posterior, is over this and over the prior's mean.
MAX_HOST_RATE, DEVIATIONS = 0.5, 2.0
#: The prior's strength, in documents, is kept within these.
STRENGTH = (1.0, 1000.0)
#: Most rejected hosts that are broadcast; more are joined by a salted shuffle.
BROADCAST_HOSTS, SALTS = 100_000, 32
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _split_words(c: Column) -> Column:
    return F.filter(F.split(c, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def with_metrics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The given columns inside struct ``_row`` and, beside it, METRICS and base_failed.

    Null texts count as empty.  ``n_dup_lines`` counts lines with a word that equal
    an earlier line; ``n_repeat_words`` the words inside any 3-word window that is
    found twice or more in the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    a = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    a = settle(a, _w=_split_words(F.col("_t")), _l=F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    a = settle(a, _h=F.expr("CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"))
    a = a.select(
        "_row", "_h", F.size("_w").cast("long").alias("n_words"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"), (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # only texts that repeat a window pay for finding where
    a = settle(a, _s=F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> named_struct('h', x, 'i', i))) ELSE array() END"))
    at = "transform(filter(transform(_s, (x, k) -> named_struct('i', x.i, 'd', coalesce(get(_s, k - 1).h = x.h, false) OR coalesce(get(_s, k + 1).h = x.h, false))), x -> x.d), x -> x.i)"
    inside = F.array_distinct(F.flatten(F.transform(F.expr(at), lambda i: F.array(i, i + 1, i + 2))))
    c = settle(a.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "_s"), n_repeat_words=F.size(inside).cast("long")).drop("_s")
    return c.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(rows: DataFrame) -> DataFrame:
    """host, n, failed, the shrunk failure rate, its deviation and the prior's mean, from rows of (host, base_failed); a null host has none.

    Counts are pre-aggregated in every task, so that a host with a third of all
    rows costs no more than another.  With one host, or hosts all alike, the prior
    is as strong as it may get.
    """
    return _shrunk(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")))


def _shrunk(hosts: DataFrame) -> DataFrame:
    """Rates under the beta prior whose moments the hosts' counts have; only sums come to the driver."""
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    k, total, failed, squares, spread = hosts.agg(F.count("*"), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    if not k:
        return hosts.withColumns({"rate": F.lit(0.0), "deviation": F.lit(0.0), "prior": F.lit(0.0)})
    m = min(max(failed / total, 1e-3), 1 - 1e-3)
    # between-host correlation: what the weighted variance of the rates has beyond binomial noise
    over = (spread - failed * failed / total) / (m * (1 - m)) - (k - 1)
    room = total - squares / total - (k - 1)
    strength = min(max(room / over - 1, STRENGTH[0]), STRENGTH[1]) if over > 0 and room > 0 else STRENGTH[1]
    rate = (f + m * strength) / (n + strength)
    return hosts.withColumn("rate", rate).withColumn("deviation", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + strength + 1))).withColumn("prior", F.lit(m))


def _rejected(rates: DataFrame, max_rate: float) -> DataFrame:
    sure = F.col("rate") - DEVIATIONS * F.col("deviation")
    return rates.where(sure > F.greatest(F.lit(max_rate), F.col("prior"))).select("host", F.lit(True).alias("host_rejected"))


def _join_hosts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """``rows`` (with a column host) and host_rejected; a hot host is spread over salts where the list is long."""
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(rejected), "host", "left")
    else:
        salted = rejected.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("_salt", (F.rand(7) * SALTS).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")
    return out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, METRICS, base_failed, host_rejected and kept, a row for every row; the rules run once, and are written."""
    scratch = Scratch(docs.sparkSession, "quality")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    rows = with_metrics(own).select("_row.doc_id", "_row.host", *METRICS, "base_failed")
    rows = scratch.save(rows)
    rejected = scratch.save(_rejected(host_rates(rows), max_rate))
    out = _join_hosts(rows, rejected)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select("doc_id", *METRICS, "base_failed", "kept", "host_rejected")


def keep(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows that pass their own rules and their host's verdict, with all their columns.

    The rules run twice, once for the hosts and once for the rows: cheaper than
    writing or shuffling the texts.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    judged = with_metrics(docs.select(F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))).select("_row.host", "base_failed")
    counted = judged.where("host is not null").groupBy("host", "base_failed").agg(F.count("*").alias("k"))
    counted = scratch.save(counted)
    # as rows of (host, n, failed)
    hosts = counted.groupBy("host").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("base_failed"), F.col("k")).otherwise(0)).alias("failed"))
    rejected = scratch.save(_rejected(_shrunk(hosts), max_rate))
    own = with_metrics(docs, text_col=text_col).where(~F.col("base_failed")).select("_row", F.col(f"_row.{host_col}").cast("string").alias("host"))
    return _join_hosts(own, rejected).where(~F.col("host_rejected")).select("_row.*")
