"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters of other scripts and digits used as
letters become plain ones, and anything that is not a letter becomes a space.
The lexicon (words and word beginnings, with log-odds as weights) is learned from
a bounded sample of labelled rows, as is the logistic curve that turns a text's
matches, normalised by its length, into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes of Latin letters, then digits and signs written for letters.
FOLD = str.maketrans(
    "авеёікмнорстухԁɡѕјһԛԝαβεηικνορτυχ" + "0134578@$",
    "abeeikmhopctyxdgsjhqwabeniknoptux" + "oieastbas",
)
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Most labelled rows that the lexicon is learned from, its most terms, and the lengths of word beginnings.
SAMPLE, TERMS, STEMS = 20_000, 1_500, range(3, 9)
#: A term must be in so many toxic rows of the sample and have such log-odds.
LEAST, ODDS = 4, 1.5
#: A match inside an exception phrase does not count.  Phrases are a strong word with the word before or after it that at least
#: so many non-toxic rows of the sample hold and no toxic one, at most PHRASES of them.
HARMLESS, PHRASES = 3, 500
SCORES = "doc_id long, score double, n_matches long, weight double"


def fold(text: str) -> str:
    return " " + NOT_LETTERS.sub(" ", text.lower().translate(FOLD)).strip() + " "


def terms_of(folded: str) -> set[str]:
    """Whole words as ' word ', beginnings of words as ' stem'."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if k < len(w))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    curve: tuple[float, ...] = (0.0,)
    exceptions: tuple[str, ...] = ()
    centre: tuple[float, ...] = field(default=())
    spread: tuple[float, ...] = field(default=())


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.auto = ahocorasick.Automaton()
        for t, w in model.weights.items():
            self.auto.add_word(t, (len(t), w))
        for e in model.exceptions:
            t = fold(e)
            self.auto.add_word(t, (len(t), None))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def features(self, text: str) -> tuple[list[float], int, float]:
        """(features, matches, weight): the longest term at each word counts, outside exception phrases."""
        folded = fold(text)
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.auto.iter(folded) if self.any else ():
            at = end - size + 1
            if w is None:
                spared.append((at, end))
            elif at not in best or best[at][0] < size:
                best[at] = (size, w)
        if spared:
            best = {a: x for a, x in best.items() if not any(p <= a < q for p, q in spared)}
        words = max(1, folded.count(" ") - 1)
        total = sum(w for _, w in best.values())
        kinds = len({folded[a : a + s] for a, (s, _) in best.items()})
        most = max((w for _, w in best.values()), default=0.0)
        return [math.log1p(total), min(20.0, 100 * total / words), min(20.0, 100 * len(best) / words), math.log1p(kinds), most], len(best), total

    def phrases(self, text: str) -> set[str]:
        """Each word with a match, together with the word before and with the word after it."""
        folded = fold(text)
        at = sorted({end - size + 1 for end, (size, w) in self.auto.iter(folded) if w is not None}) if self.any else []
        if not at:
            return set()
        words, starts, place = folded.split(), {}, 0
        for i, w in enumerate(words):
            starts[place] = i  # of the space before the word
            place += len(w) + 1
        out = set()
        for a in at:
            i = starts.get(a)
            if i is not None:
                out.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
        return out

    def score(self, x: list[float]) -> float:
        m = self.model
        z = m.curve[0] + sum(c * (v - a) / s for c, v, a, s in zip(m.curve[1:], x, m.centre, m.spread))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _texts(stream: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = ()) -> Model:
    """A model from at most ``sample`` labelled rows, those whose ids hash lowest; null labels and texts are left out.

    Only the chosen ids (a proven bound) are broadcast.  What comes back to the
    driver is at most TERMS terms and, for each sampled row, a few numbers.
    Exception phrases are learned beside the ones given.  Without rows of both labels the model knows no terms and scores everything alike.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where("text is not null")

    def count(stream):
        pos, neg = Counter(), Counter()
        for part in _texts(stream):
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                (pos if y else neg).update(terms_of(fold(t)))
            if len(pos) + len(neg) > 400_000:
                yield table(pos, neg)
                pos, neg = Counter(), Counter()
        yield table(pos, neg)

    def table(pos, neg):
        keys = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["term", "pos", "neg"])

    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p or not q:
        return Model({}, (math.log((p + 0.5) / (q + 0.5)),), exceptions)
    found = rows.select("text", "y").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (q + 1))
    best = found.where(F.col("pos") >= LEAST).withColumn("w", odds).where(F.col("w") >= ODDS)
    best = best.orderBy((F.col("w") * F.sqrt("pos")).desc(), "term").limit(TERMS).collect()
    weights = {r.term: r.w for r in best}
    plain = spark.sparkContext.broadcast(Model(weights))

    def around(stream):
        m = Matcher(plain.value)
        for part in _texts(stream):
            pos, neg = Counter(), Counter()
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                (pos if y else neg).update(m.phrases(t))
            yield table(pos, neg)

    spared = rows.select("text", "y").mapInArrow(around, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    spared = spared.where((F.col("pos") == 0) & (F.col("neg") >= HARMLESS)).orderBy(F.desc("neg"), "term").limit(PHRASES).collect()
    exceptions = (*exceptions, *(r.term for r in spared))
    first = Model(weights, exceptions=exceptions)
    sent = spark.sparkContext.broadcast(first)

    def measure(stream):
        m = Matcher(sent.value)
        for part in _texts(stream):
            x = [m.features(t)[0] for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    got = rows.select("text", "y").mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float)
    y = np.array(got.column("y").to_pylist(), dtype=float)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / spread])
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1.0] * (z.shape[1] - 1))
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression
        h = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (h * (1 - h))[:, None]).T @ z + ridge, z.T @ (y - h) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(first.weights, tuple(b), exceptions, tuple(centre), tuple(spread))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES of every row; null and empty texts score as texts without matches.

    Row by row, no shuffle; repeated rows give repeated results.  The model is
    broadcast: at most TERMS terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream):
        m = Matcher(sent.value)
        for part in _texts(stream):
            out = [m.features(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.score(x) for x, _, _ in out], pa.float64()), pa.array([k for _, k, _ in out], pa.int64()), pa.array([float(w) for _, _, w in out], pa.float64())], names=["doc_id", "score", "n_matches", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORES)
