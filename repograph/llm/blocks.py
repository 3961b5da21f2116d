"""Comparing the members of groups block by block, without listing pairs.

The rows of a group are dealt to blocks of about ``size`` rows, and every two blocks that must be compared
make one task's table, so a large group is many small tables.  Only rows that are not ``settled`` with
each other need comparing: two settled rows never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

PAIR = ["block_a", "block_b"]


def block_pairs(rows: DataFrame, group: list[str], size: int, settled: str | None = None) -> DataFrame:
    """``rows`` (with ``id``), each once for every pair of blocks it takes part in; ``block`` is its own."""

    still = F.col(settled) if settled else F.lit(False)
    counts = rows.groupBy(*group).agg(
        F.ceil(F.count_if(~still) / size).cast("int").alias("n_open"),
        F.ceil(F.count_if(still) / size).cast("int").alias("n_still"))
    lot = F.xxhash64("id", F.lit("block"))
    placed = rows.join(counts, group).where("n_open > 0").withColumn(
        "block", F.when(still, F.col("n_open") + F.pmod(lot, F.col("n_still"))).otherwise(F.pmod(lot, F.col("n_open"))).cast("int"))
    # An open block meets all blocks, a settled one the open blocks.
    others = F.sequence(F.lit(0), F.when(still, F.col("n_open") - 1).otherwise(F.col("n_open") + F.col("n_still") - 1))
    return (
        placed.withColumn("other", F.explode(others))
        .withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
        .drop("other", "n_open", "n_still"))


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a table; the same rows twice if it is one block."""

    block = table["block"].to_numpy()
    a, b = table["block_a"][0].as_py(), table["block_b"][0].as_py()
    return np.flatnonzero(block == a), np.flatnonzero(block == b)


def stars(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """Links between rows x and y as edges (a, b) to the smallest id each row reaches by them."""

    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    x, y, root = rank[x], rank[y], np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    held = ids[order]
    some = held[root] != held
    return pa.table({"a": pa.array(held[some], pa.int64()), "b": pa.array(held[root][some], pa.int64())})


ROWS_PER_LOT = 1 << 15


def compare_in_lots(pairs: DataFrame, keys: list[str], compare, schema: str) -> DataFrame:
    """``compare`` on the rows of every key, many small keys in one task's table."""

    pairs = store(pairs)
    lots = 1 + pairs.count() // ROWS_PER_LOT
    lots = max(lots, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys]).combine_chunks()
        changed = np.zeros(max(table.num_rows - 1, 0), bool)
        for key in keys:
            values = table[key].to_numpy()
            changed |= values[1:] != values[:-1]
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), table.num_rows]
        return pa.concat_tables([
            compare(table.slice(a, b - a)) for a, b in zip(bounds, bounds[1:], strict=False) if b > a + 1
        ] or [compare(table.slice(0, 1))])

    lot = F.pmod(F.xxhash64(*keys), F.lit(lots))
    return pairs.groupBy(lot.alias("lot")).applyInArrow(arrays.tidy(run), schema)
