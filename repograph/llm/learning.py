"""Bounded samples of labelled rows and small linear models fitted on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.tables import store

FOLDS = 5
LOTS = 1024  # parts in which the rows of a label are cut first


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth, by the CRC of the id."""

    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def bounded_sample(labelled: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (id, label) of each label: those with the smallest hashes.

    Each label is cut twice: in ``LOTS`` lots by other bits of its ids, then over what the lots kept.  The first cut is
    applied before and after its shuffle and deals a label over all tasks, so the second reads at most
    ``LOTS * per_label`` rows of a label, whatever the number of rows and of tasks.
    """

    def smallest(rows: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).drop("place")

    rows = labelled.select("id", "label").distinct().withColumn("lot", F.pmod(F.hash("id"), F.lit(LOTS)))
    return store(smallest(smallest(rows, "label", "lot").drop("lot"), "label"))


def one_row_each(rows: DataFrame) -> DataFrame:
    """One (label, text) of each (id, label), whatever number of rows share the id: the text with the smallest hash.

    Every task passes on one row of each, so what is collected of a sample is bounded like its ids.
    """

    order = F.struct(F.col("text").isNull(), F.xxhash64("text"))
    return rows.groupBy("id", "label").agg(F.min_by("text", order).alias("text")).select("label", "text")


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
