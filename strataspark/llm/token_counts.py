"""Token counts without token ids.

The library splits at white space, so a text's count is the sum over its
pre-tokens: the runs between ASCII white space.  Each task keeps the number of
pieces of every distinct pre-token it has met, asks the library once for those it
has not, and joins them to the frequencies of each document.  The memo is
bounded, and no ids are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_bytes

#: Distinct pre-tokens that a task remembers, and the longest of them in bytes; others are counted again.
MEMO, LONGEST = 500_000, 64
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS of every row: the text's UTF-8 bytes and the tokens that the ``tokenizers`` file gives it.

    No special tokens are added; the strings of special tokens inside a text
    count as the file says; no truncation or padding.  Null and empty texts count
    0.  Row by row, no shuffle; repeated rows give repeated results.  The
    tokenizer must split at white space (its pre-tokenizer drops it).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_bytes(spark, tokenizer_path))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(sent.value.decode())
        tok.no_truncation()
        tok.no_padding()
        memo: dict[bytes, int] = {}
        for batch in stream:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                own = [Counter(t.split()) for t in texts]  # bytes split at ASCII white space only
                if len(memo) > MEMO:
                    memo = {}
                new = list({w for c in own for w in c if w not in memo})
                memo |= zip(new, (len(e) for e in tok.encode_batch([w.decode() for w in new], add_special_tokens=False)))
                n = [sum([memo[w] * k for w, k in c.items()]) for c in own]
                for w in new:
                    if len(w) > LONGEST:
                        del memo[w]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)
