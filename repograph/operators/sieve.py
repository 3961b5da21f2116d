"""Rows that may have one of some keys, found without moving the others.

A sieve is a bitmap of hashed keys.  It is of bounded size, so it is sent to every task, and a row whose key is not in it
stays where it is read.  A sieve lets all rows of its keys pass and a small share of the others (a larger one beyond the
bound), so whoever joins what passed gets what a join of all rows would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.session import cut

# Words of 64 bits: 64 MB at most.
MOST_WORDS = 1 << 23
KEYS_A_WORD = 6
# Words of one row of the table that is sent.
SEGMENT = 1024


def key_hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def _bits(key: Column) -> Column:
    """Four bits of a word, by a hash of the hash."""

    mixed = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, F.shiftrightunsigned(mixed, 6 * n).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


class Sieve:
    """The sieve of the hashes in column ``h`` of a stored table."""

    def __init__(self, hashes: DataFrame, most_words: int = MOST_WORDS) -> None:
        spark = hashes.sparkSession
        self.words = max(1, min(most_words, hashes.count() // KEYS_A_WORD + 1))
        marks = hashes.select(F.pmod("h", F.lit(self.words)).alias("word"), _bits(F.col("h")).alias("bits"))
        # Words without a key are rows too, so the words of a segment are gapless.
        empty = spark.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        segment = F.floor(F.col("word") / SEGMENT).cast("long").alias("segment")
        found = marks.unionByName(empty).groupBy(segment, "word").agg(F.bit_or("bits").alias("bits"))
        held = found.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
        self.table = cut(held.select("segment", F.col("held.bits").alias("held")))

    def passed(self, rows: DataFrame, *key: str | Column) -> DataFrame:
        """The rows whose hashed key the sieve lets pass."""

        word = F.pmod("sieve_h", F.lit(self.words))
        at = F.floor(word / SEGMENT).cast("long")
        bits = _bits(F.col("sieve_h"))
        held = F.get(F.col("held"), (word % SEGMENT).cast("int"))
        hashed = rows.withColumn("sieve_h", key_hash(*key))
        return hashed.join(
            F.broadcast(self.table), (at == F.col("segment")) & (held.bitwiseAND(bits) == bits), "left_semi"
        ).drop("sieve_h")
