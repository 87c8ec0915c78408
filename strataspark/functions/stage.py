"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint, in spark.checkpoint.dir; a local folder only for a local master that names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` by hash of its key, about ``rows`` rows a task: a small table whose rows take long, which would be read by one task."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once even if a lambda refers to them.

    An array that a merged projection puts inside a lambda is computed for every
    element; nothing is merged across a generator.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_once.{n}").alias(n) for n in columns])


BITMAP_WORDS = 1 << 17


def in_bitmap(keys: DataFrame, key: str) -> Column:
    """A test that holds for all values of the long column ``key`` of ``keys``, and for few others: a bitmap of constant size, as a scalar."""
    place, bit = F.pmod(F.shiftright(key, 6), F.lit(BITMAP_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(key), F.lit(64)).cast("int"))
    bits = keys.groupBy(place.alias("i")).agg(F.bit_or(bit).alias("v"))
    full = keys.sparkSession.range(BITMAP_WORDS).join(bits, F.col("id") == F.col("i"), "left").select("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    whole = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x.v).alias("a")).scalar()
    return F.get(whole, place.cast("int")).bitwiseAND(bit) != 0
