"""Token ids in training order, as shards of fixed-stride binary records.

Every document is encoded and cut into sequences of ``length`` ids.  A sequence's
number (its place in the written table) goes through a keyed Feistel permutation
with cycle-walking to a global slot, so that the order is a pseudo-random
permutation that needs no global shuffle key table and can be computed for any
number alone.  Sequences are range-partitioned by slot; slot s is record
s mod ``records`` of shard s div ``records``, at byte (s mod records) * stride.
A reader resumes from a slot by one division.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encode_text, encoding, read_bytes
from .scratch import Scratch

ROUNDS = 6
#: Most shards that one task packs.
SHARDS_PER_TASK = 64
#: Bytes of a record before its ids: document id (8), place in the document (4), ids used (4); little endian.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("used", "<u4")])
SHARDS = "shard_id long, first_slot long, n_records long, stride long, doc_ids array<long>, payload_sha256 string, payload binary"


def round_keys(key: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{key}|{i}".encode()).digest()[:8], "little") for i in range(ROUNDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(x: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse): a balanced Feistel network over the next power of 4, walked until it lands below n."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, keys = np.uint64((1 << half) - 1), round_keys(key)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> np.uint64(half), v & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, ranks_path: str, pattern: str, *, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, at (place of the row in its task), doc_id, seq, used and ids (2 bytes each, padded with the first free id).

    Documents without ids have no sequences; a null id is written as -1.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_bytes(spark, ranks_path))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value, pattern)
        pad = enc.max_token_value + 1
        if pad >= 1 << 16:
            raise ValueError("records hold ids of 16 bits")
        part, at = TaskContext.get().partitionId(), 0
        for batch in stream:
            for a in range(0, batch.num_rows, 200):
                some = batch.slice(a, 200)
                ids_, seq, used, raw = [], [], [], []
                for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = np.array(encode_text(enc, t or ""), dtype="<u2")
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length]
                        ids_.append(i)
                        seq.append(s // length)
                        used.append(len(piece))
                        raw.append(piece.tobytes() if len(piece) == length else np.append(piece, np.full(length - len(piece), pad, "<u2")).astype("<u2").tobytes())
                n = len(ids_)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(ids_, pa.int64()), pa.array(seq, pa.int64()), pa.array(used, pa.int64()), pa.array(raw, pa.binary())], names=["part", "at", "doc_id", "seq", "used", "ids"])
                at += n

    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "part long, at long, doc_id long, seq long, used long, ids binary")


def shards(docs: DataFrame, ranks_path: str, pattern: str, *, key: str, length: int = 512, records: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SHARDS: one row for each shard, in slot order; all but the last hold ``records`` records.

    The encoded sequences are written once to the shared folder; numbers and
    slots are computed from what was written, so a task that runs again gives
    the same.  Counts per task (one row for each) are summed into offsets; they are
    collected, as many as there were input partitions.  Null and empty texts give
    no records, an empty table no shards; repeated rows are written as often as
    they come.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "binary_output")
    seqs = scratch.save(sequences(docs, ranks_path, pattern, length=length, id_col=id_col, text_col=text_col))
    counts = {r.part: r.n for r in seqs.groupBy("part").agg(F.count("*").alias("n")).collect()}
    order = sorted(counts)
    total = sum(counts.values())
    offsets = dict(zip(order, np.concatenate([[0], np.cumsum([counts[p] for p in order])]).tolist()))
    sent = spark.sparkContext.broadcast(offsets)
    stride = HEADER.itemsize + 2 * length

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            number = b.column(1).to_numpy() + np.array([sent.value[p] for p in b.column(0).to_pylist()], np.int64)
            slot = permute(number, total, key)
            head = np.zeros(b.num_rows, HEADER)
            head["doc_id"], head["seq"], head["used"] = b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy()
            raw = [h.tobytes() + x for h, x in zip(head, b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(slot // records), pa.array(slot), b.column(2), pa.array(raw, pa.binary())], names=["shard_id", "slot", "doc_id", "record"])

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slot, whole shards in one partition."""
        held: list[tuple[int, int, int, bytes]] = []

        def close():
            payload = b"".join(r[3] for r in held)
            row = [[held[0][0]], [held[0][1]], [len(held)], [stride], [[r[2] for r in held]], [hashlib.sha256(payload).hexdigest()], [payload]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard_id", "first_slot", "n_records", "stride", "doc_ids", "payload_sha256", "payload"])

        for b in stream:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != held[0][0]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    placed = seqs.mapInArrow(place, "shard_id long, slot long, doc_id long, record binary")
    n = max(1, math.ceil(total / records))
    # as many tasks as the session has, and more where one would hold over SHARDS_PER_TASK shards
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(n / SHARDS_PER_TASK))
    dealt = placed.repartitionByRange(parts, "shard_id").sortWithinPartitions("slot")
    return dealt.mapInArrow(pack, SHARDS)


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """Write every shard of ``shards`` to its own file in ``folder``; the index: shard_id, first_slot, n_records, stride, payload_sha256, file.

    ``folder`` is a URI or a path that all executors reach (pyarrow names the
    stores).  A file is written under another name and then moved, so a reader
    never sees half of one; a task that runs again finds its files in full and
    leaves them.  The index is returned, one row for each file.
    """
    from pyarrow import fs

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for b in stream:
            names = []
            for shard, payload in zip(b.column(0).to_pylist(), b.column(5).to_pylist()):
                name = f"{root}/shard-{shard:012d}.bin"
                there = store.get_file_info(name)
                if there.type != fs.FileType.File or there.size != len(payload):
                    part = f"{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(payload)
                    store.move(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(names, pa.string())], names=["shard_id", "first_slot", "n_records", "stride", "payload_sha256", "file"])

    own = made.select("shard_id", "first_slot", "n_records", "stride", "payload_sha256", "payload")
    index = own.mapInArrow(run, "shard_id long, first_slot long, n_records long, stride long, payload_sha256 string, file string")
    return Scratch(made.sparkSession, "shard_index").save(index)


def read_from(index: list[tuple[int, int, str]], folder: str, slot: int = 0) -> Iterator[tuple[int, int, int, list[int]]]:
    """(slot, document id, place, ids) in training order from ``slot`` on: one file after the other, each from its offset.

    ``index``: (first_slot, stride, file) of every shard.  A reader that stopped goes on with its next slot.
    """
    from pyarrow import fs

    store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    for first, stride, name in sorted(index):
        with store.open_input_file(name) as f:
            n = f.size() // stride
            if first + n <= slot:
                continue
            f.seek(max(0, slot - first) * stride)
            for at in range(max(first, slot), first + n):
                yield at, *read_record(f.read(stride), stride, 0, 0)


def read_record(payload: bytes, stride: int, slot: int, first_slot: int) -> tuple[int, int, list[int]]:
    """(document id, place in the document, ids) of a slot, read at its fixed offset."""
    at = (slot - first_slot) * stride
    head = np.frombuffer(payload, HEADER, 1, at)[0]
    ids = np.frombuffer(payload, "<u2", int(head["used"]), at + HEADER.itemsize)
    return int(head["doc_id"]), int(head["seq"]), ids.tolist()
