"""Benchmark decontamination with suffix arrays over the training text.

Each task cuts its documents into shards of a bounded number of words, builds a
suffix array of the shard (suffixes ordered by their first ``depth`` words, by
rank doubling), and binary-searches every suffix of the test items in it.  The
search gives, for each test suffix, the interval of training positions that
share its first words, hence the longest verbatim match and its locations.
There is no shuffle: the shards stay where the text was read, and a task that
is lost is simply run again.

The test items are broadcast in blocks of at most ``block_words`` words, a
fixed bound; more items only mean more passes over a shard, inside the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import BY_ALNUM, U, chunks, words

MATCHES = "doc_id long, n_words long, doc_start long, length long, item_id long, item_start long"


class SuffixArray:
    """Word positions of a shard, ordered by the next ``depth`` words; 0 marks the end of a document."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.depth, n = seq, depth, len(seq)
        order = np.argsort(seq)
        rank = self._ranks(seq[order], order)
        done = 1  # rank orders by the first `done` words
        while done < depth and n:
            shift = min(done, depth - done)
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - shift)] = rank[shift:] + 1
            key = rank * np.int64(n + 1) + ahead
            order = np.argsort(key)
            rank = self._ranks(key[order], order)
            done += shift
        self.order = order

    @staticmethod
    def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(ordered), np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def find(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query, the interval of the order whose suffixes begin with its first ``lengths`` words."""
        return self._bound(queries, lengths, False), self._bound(queries, lengths, True)

    def _bound(self, queries: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        n = len(self.seq)
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
        for _ in range(max(1, n.bit_length())):
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                break
            mid = (lo[busy] + hi[busy]) >> 1
            at = self.order[mid]
            less = np.zeros(len(busy), bool)  # the training suffix sorts before the query
            same = np.ones(len(busy), bool)
            for j in range(queries.shape[1]):
                live = np.flatnonzero(same & (j < lengths[busy]))
                if not len(live):
                    break
                here = at[live] + j
                a = np.where(here < n, self.seq[np.minimum(here, n - 1)], U(0))
                b = queries[busy[live], j]
                less[live] = a < b
                same[live] = a == b
            right = less | same if after else less
            lo[busy] = np.where(right, mid + 1, lo[busy])
            hi[busy] = np.where(right, hi[busy], mid)
        return lo

    def longest(self, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words of the longest prefix of each query, up to ``depth``, that occurs in the shard."""
        best = np.zeros(len(queries), np.int64)
        for m in range(1, queries.shape[1] + 1):
            live = np.flatnonzero((lengths >= m) & (best == m - 1))
            if not len(live):
                break
            lo, hi = self.find(queries[live], np.full(len(live), m))
            best[live[hi > lo]] = m
        return best


class Items:
    """The suffixes of a block of test items, one row per suffix."""

    def __init__(self, ids: np.ndarray, seq: np.ndarray, bounds: np.ndarray, window: int):
        n = np.diff(bounds)
        self.seq, self.bounds = seq, bounds
        many = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(ids)), many)
        edges = np.concatenate([[0], np.cumsum(many)])
        self.start = np.arange(int(edges[-1])) - np.repeat(edges[:-1], many)
        self.at = self.start + bounds[self.item]
        self.length = np.minimum(window, n[self.item])
        self.ids = ids
        if len(self.at):
            grid = self.at[:, None] + np.arange(window)
            self.rows = np.where(np.arange(window) < self.length[:, None], np.append(seq, U(0))[np.minimum(grid, len(seq))], U(0))
        else:
            self.rows = np.zeros((0, window), U)


def _search(seq: np.ndarray, doc: np.ndarray, word: np.ndarray, items: Iterable[Items], depth: int) -> list[tuple[np.ndarray, ...]]:
    """(document index, first word, words, item id, item's first word) of every maximal verbatim run in a shard."""
    array = SuffixArray(seq, depth)
    out = []
    for block in items:
        if not len(block.at):
            continue
        lo, hi = array.find(block.rows, block.length)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        many = (hi - lo)[found]
        q = np.repeat(found, many)
        at = array.order[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)]
        size = block.length[q].astype(np.int64)
        # windows one after another, of the same item and document, are one longer match
        key = np.lexsort((at, at - block.at[q]))
        q, at, size = q[key], at[key], size[key]
        joined = np.zeros(len(q), bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & (block.at[q[1:]] == block.at[q[:-1]] + 1) & (block.item[q[1:]] == block.item[q[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
        head = np.flatnonzero(~joined)
        last = np.append(head[1:], len(q)) - 1
        out.append((doc[at[head]], word[at[head]], at[last] + size[last] - at[head], block.ids[block.item[q[head]]], block.start[q[head]]))
    return out


def _blocks(items: list[tuple[int, str | None]], block_words: int) -> list[tuple[list[int], list[str]]]:
    """The items as they were read, in blocks of about ``block_words`` words."""
    out, ids, texts, n = [], [], [], 0
    for i, text in items:
        ids.append(i)
        texts.append(text or "")
        n += len(texts[-1]) // 2
        if n >= block_words:
            out.append((ids, texts))
            ids, texts, n = [], [], 0
    return out + [(ids, texts)] if ids else out


def _items(block: tuple[list[int], list[str]], window: int) -> Iterator[Items]:
    for a, b, data, offsets in chunks(pa.array(block[1], pa.string()), 1 << 40):
        seq, bounds = words(data, offsets, BY_ALNUM)
        yield Items(np.array(block[0][a:b], np.int64), seq, bounds, window)


#: Most text of the test items, in bytes, that one call sends to every task.
MAX_ITEM_BYTES = 256_000_000
VERDICTS = "doc_id long, n_words long, n_hit long, item_ids array<long>, longest long"
NO_ID = -(2**63)


def matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Maximal verbatim runs of ``window`` words or more that a document shares with a test item.

    Columns: MATCHES.  An item of fewer words than the window matches as a whole.
    A document without a match gives one row with null match columns; null and
    empty texts have no words.  Rows that share an id are searched one by one.
    Options: see ``_shards``.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    return _shards(_two(docs, id_col, text_col), MATCHES, 1, _match_rows, items, **options).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def verdicts(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document row: VERDICTS, with the words hit by any match, the matching items and the longest run.

    Null and empty texts have no words and no hits; a null id stays null.
    """
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    return _shards(_two(docs, id_col, text_col), VERDICTS, 1, _verdict_rows, items, **options).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remove(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows without any match, with all their columns, whatever these are called.

    Judged row by row, so a null or repeated id changes nothing.
    """
    text_col, item_col, item_text = options.pop("text_col", "text"), options.get("item_col", "item_id"), options.get("item_text_col", "text")
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    parts = -(-size // (MAX_ITEM_BYTES // 2)) or 1
    out = docs
    for part in range(parts):  # more items than one call sends are searched a share at a time, one after the other in each task
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(parts)) == part)
        out = _shards(out, docs.schema, docs.columns.index(text_col), None, own, **options)
    return out


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))


def _match_rows(ids, n, edges, cols):
    none = np.setdiff1d(np.arange(len(n)), cols[0])
    d = np.concatenate([cols[0], none])
    order = np.argsort(d, kind="stable")
    null = np.concatenate([np.zeros(len(cols[0]), bool), np.ones(len(none), bool)])[order]
    rest = [pa.array(np.concatenate([c, none])[order], pa.int64(), mask=null) for c in cols[1:]]
    return pa.RecordBatch.from_arrays([pa.array(ids[d[order]]), pa.array(n[d[order]]), *rest], names=["doc_id", "n_words", "doc_start", "length", "item_id", "item_start"])


def _verdict_rows(ids, n, edges, cols):
    hit = np.zeros(int(edges[-1]) + 1, np.int64)
    at = edges[:-1][cols[0]] + cols[1]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + cols[2], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    n_hit = covered[edges[1:]] - covered[edges[:-1]]
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, cols[0], cols[2])
    pairs = np.unique(np.stack([cols[0], cols[3]], 1), axis=0) if len(cols[0]) else np.zeros((0, 2), np.int64)
    cut = np.searchsorted(pairs[:, 0], np.arange(len(n) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(pairs[:, 1], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(n_hit), lists, pa.array(longest)], names=["doc_id", "n_words", "n_hit", "item_ids", "longest"])


def _shards(docs: DataFrame, schema, text_at: int, rows, items: DataFrame, *, window: int = 10, shard_words: int = 1_000_000, block_words: int = 4_000_000, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Search the shards of every task; ``rows`` makes a shard's result, without it the rows that have no hit pass.

    ``window``: words of a match; ``shard_words``: words after which a shard is
    closed (a document is never cut); ``block_words``: size of the blocks in which
    the test items are searched.  ``items`` is collected, after its size has been
    held against MAX_ITEM_BYTES; items of a null id or without words match nothing.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the test items hold {size} bytes; pass them in calls of at most {MAX_ITEM_BYTES}")
    # the texts are sent, not their indexes, which are some twenty times as large: a task holds those of one block at a time
    sent = spark.sparkContext.broadcast(_blocks([(r.i, r.t) for r in items.collect()], block_words))
    kept: list[Items] = []

    def indexes() -> Iterator[Items]:
        if len(sent.value) > 1:
            for block in sent.value:
                yield from _items(block, window)
            return
        if not kept:
            kept.extend(x for block in sent.value for x in _items(block, window))
        yield from kept

    def close(batches, seqs, counts):
        n = np.concatenate(counts)
        h = np.concatenate(seqs)
        h[h == 0] = U(1)
        edges = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)  # a 0 after every document: no match crosses its end
        seq = np.zeros(int(edges[-1]), U)
        doc = np.repeat(np.arange(len(n)), n + 1)
        word = np.arange(len(seq)) - edges[:-1][doc]
        seq[word < n[doc]] = h
        found = _search(seq, doc, word, indexes(), window)
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        if rows:
            yield rows(np.concatenate([b.column(0).to_numpy() for b in batches]), n, edges, cols)
            return
        clean = np.ones(len(n), bool)
        clean[cols[0]] = False
        at = 0
        for b in batches:
            yield b.filter(pa.array(clean[at : at + b.num_rows]))
            at += b.num_rows

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, seqs, counts, held = [], [], [], 0
        for batch in stream:
            for a, b, data, offsets in chunks(batch.column(text_at)):
                h, bounds = words(data, offsets, BY_ALNUM)
                batches.append(batch.slice(a, b - a))
                seqs.append(h)
                counts.append(np.diff(bounds))
                held += len(h)
                if held >= shard_words:
                    yield from close(batches, seqs, counts)
                    batches, seqs, counts, held = [], [], [], 0
        if batches:
            yield from close(batches, seqs, counts)

    return docs.mapInArrow(run, schema)


def sha_ids(ids: list[int]) -> str:
    """Lowercase hex digest of ids sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
