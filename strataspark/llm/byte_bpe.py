"""Byte-level BPE with the tiktoken library and a local rank file.

The rank file is read once by the driver and broadcast (it is a vocabulary, of a
fixed size).  Long texts are cut before encoding, only where a space follows a
character that is not white space: no match of the pre-split pattern spans such
a place, so the pieces encode to the same ids as the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters after which a long text is cut at the next safe place.
PIECE = 50_000
SAFE = re.compile(r"(?<=\S) (?=\S)")
_made: dict[str, object] = {}


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, from a local path or from any store that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file, made once per process."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _made:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``most`` characters, cut at safe places only."""
    at = 0
    while len(text) - at > most and (m := SAFE.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str, most: int = PIECE) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p in pieces(text, most):
        out += enc.encode_ordinary(p)
    return out


def _slices(stream: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row; null and empty texts have no ids.

    No special tokens: their strings are ordinary text.  Row by row, no shuffle;
    repeated rows give repeated results and other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_bytes(spark, ranks_path))

    def run(stream):
        enc = encoding(sent.value, pattern)
        for part in _slices(stream):
            ids = [encode_text(enc, t.as_py() or "") for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes (binary): the raw bytes of ``ids``, which need not be whole characters; null ids give no bytes."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(read_bytes(spark, ranks_path))

    def run(stream):
        enc = encoding(sent.value, pattern)
        for part in _slices(stream):
            raw = [enc.decode_bytes(x.as_py() or []) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGESTS of every row: the number of ids, and hashes of the ids and of the bytes decoded from them.

    Encodes and decodes as ``encode`` and ``decode`` do, in one pass, so that ids
    never leave the task.  Null and empty texts: no ids, the hashes of nothing.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_bytes(spark, ranks_path))

    def run(stream):
        enc = encoding(sent.value, pattern)
        shown = [str(i) for i in range(enc.max_token_value + 1)]
        for part in _slices(stream):
            n, a, b = [], [], []
            for t in part.column(1):
                ids = encode_text(enc, t.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _id_text(docs, id_col, text_col).mapInArrow(run, DIGESTS)
