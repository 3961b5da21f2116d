"""Shards by extendible hashing.

Every row has a bit string: 60 bits of the MD5 of its key, then 62 bits that tell repeated keys
apart.  A bucket is a prefix of bits.  Starting from the empty prefix, only buckets over the byte
limit are split on another bit, until each fits.  The directory maps prefixes to buckets.

Sizes are summed per prefix before anything is shuffled, some bits at a time and only for
cells that are still too large, so no key, however frequent, gathers its rows in one task.  Rows
find their bucket by an equi-join with the directory, which is broadcast only if Spark finds it small.

A row that is larger than the limit gets a bucket of its own (``oversized``).  A null key hashes
like the text ``null``; null or empty values take 0 bytes; an empty table gives no shards.  Repeated
rows and repeated keys are kept apart by the second part of the bits.  The input's columns are kept
aside under generated names, so extra columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.tables import store

KEY_BITS, ROW_BITS, STEP, SPARE = 60, 62, 8, 3


def key_bits(key: Column) -> Column:
    """60 bits of a key's MD5 as a string of 0 and 1."""

    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15)
    return F.lpad(F.conv(digits, 16, 2), KEY_BITS, "0")


def _row_bits() -> Column:
    number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
    return F.lpad(F.bin(number), ROW_BITS, "0")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Directory of rows with ``bits`` and ``size``: (length, cell, depth).

    A cell is a prefix of ``length`` bits; its shard is the shortest prefix, of ``depth`` bits, that fits.
    Cells whose every prefix is too large are looked at again with more bits.
    """

    total = sized.agg(F.sum("size")).head()[0] or 0
    found: DataFrame | None = None
    todo = sized.select("bits", "size")
    start, length = 0, min(KEY_BITS, max(STEP, math.ceil(math.log2(max(total, limit) / limit)) + SPARE))
    while True:
        cells = store(
            todo.groupBy(F.substring("bits", 1, length).alias("cell"))
            .agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows")))
        prefixes = cells.select(
            "cell", "n_bytes", "n_rows", F.explode(F.sequence(F.lit(start), F.lit(length))).alias("depth"))
        shard = F.expr("substring(cell, 1, depth)").alias("shard")
        fitting = (
            prefixes.groupBy("depth", shard)
            .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
            .where((F.col("n_bytes") <= limit) | (F.col("n_rows") == 1)
                   | (F.col("depth") == KEY_BITS + ROW_BITS))
            .select("depth", "shard"))
        placed = store(
            prefixes.select("cell", "depth", shard).join(fitting, ["depth", "shard"])
            .groupBy("cell").agg(F.min("depth").cast("int").alias("depth"))
            .select(F.lit(length).alias("length"), "cell", "depth"))
        found = placed if found is None else found.unionByName(placed)
        too_large = cells.join(placed, "cell", "left_anti").select("cell")
        if not too_large.head(1):
            return found
        todo = todo.join(too_large, F.substring("bits", 1, length) == F.col("cell"), "left_semi")
        start, length = length + 1, min(length + STEP, KEY_BITS + ROW_BITS)


def assign_shards(rows: DataFrame, key: Column, size: Column, limit: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row with shard, depth, n_bytes and oversized."""

    if limit < 1:
        raise ValueError("limit must be positive")
    kept = [F.col(name).alias(f"kept_{i}") for i, name in enumerate(keep)]
    sized = store(rows.select(
        *kept, F.concat(key_bits(key), _row_bits()).alias("bits"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    cells = store(directory(sized, limit))
    # Nearly always one length; keys repeated beyond the limit add more.
    lengths = [r["length"] for r in cells.select("length").distinct().collect()] or [0]
    probe = sized.withColumn("probe", F.explode(F.array(*[F.substring("bits", 1, n) for n in lengths])))
    return probe.join(cells, F.col("probe") == F.col("cell")).select(
        *[F.col(f"kept_{i}").alias(name) for i, name in enumerate(keep)],
        F.expr("substring(bits, 1, depth)").alias("shard"), "depth", F.col("size").alias("n_bytes"), (F.col("size") > limit).alias("oversized"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write rows with a ``shard`` column as one folder of Parquet per shard."""

    assigned.repartition("shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
