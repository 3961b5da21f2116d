"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

Equal vectors are one class, represented by their smallest id.  In each of several tables a class falls
into the bucket of its signs against ``bits`` random hyperplanes; members of a bucket are compared by
exact cosine in double precision.  The number of bits follows the number of classes, so that buckets hold about
``BUCKET`` of them, and the number of tables follows the bits, so that two vectors at the threshold share no
bucket with a chance of ``MISS`` (vectors closer than that: far less).

Buckets are compared by blocks inside tasks.  A link is counted in the first table in which its ends
share a bucket, so that counts are exact; only sums of links and links to a block's smallest
vector leave a task, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
different lengths and rows without an id.  Rows with one id are one vertex; each row counts its
own links.  Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays, blocks
from repograph.llm.components import connected_components
from repograph.llm.tables import store

BUCKET, BLOCK, MISS, PAIRS = 256, 512, 1e-6, 1 << 16
MOST_BITS = 30


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables."""

    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(classes, 1) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-same)))


def _planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([width, 5]).standard_normal((width, bits * tables))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes with their length and a 128-bit hash; null where they cannot link."""

    for batch in batches:
        lists = batch.column("vector")
        held, marks, width = [], [], []
        for item in lists:
            values = item.values.to_numpy(zero_copy_only=False).astype(np.float64) if item.is_valid else np.empty(0)
            # Adding zero makes both zeros one.
            good = len(values) and np.isfinite(values).all() and values.any()
            data = (values + 0.0).tobytes() if good else b""
            held.append(data if good else None)
            marks.append(hashlib.blake2b(data, digest_size=16).digest())
            width.append(len(values))
        high, low = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(held, pa.binary()), pa.array(width, pa.int32()), pa.array(high), pa.array(low)],
            names=["id", "vector", "width", "high", "low"])


def _unit(column: pa.Array, width: int) -> np.ndarray:
    values = np.frombuffer(arrays.column_bytes(column)[0].tobytes(), np.float64).reshape(-1, width)
    # Scaling by the largest component first keeps squares finite.
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _code_type(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _codes(bits: int, tables: int):
    weights = 1 << np.arange(bits)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                for start in range(0, some.num_rows, 1 << 12):
                    part = some.slice(start, 1 << 12)
                    signs = _unit(part.column("vector"), width) @ _planes(width, bits, tables) >= 0
                    code = (signs.reshape(len(signs), tables, bits) * weights).sum(axis=2)
                    yield pa.RecordBatch.from_arrays([
                        *(part.column(c) for c in ("id", "vector", "width", "n")),
                        pa.array([c.tobytes() for c in code.astype(_code_type(bits))], pa.binary()),
                        pa.array(list(code.astype(np.int32)), pa.list_(pa.int32()))],
                        names=["id", "vector", "width", "n", "codes", "keys"])

    return arrays.tidy(sign)


LINKS = "id long, n_links long, b long"


def _compare(bits: int, threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        ids, counts = (table[c].to_numpy() for c in ("id", "n"))
        number, width = table["table"][0].as_py(), table["width"][0].as_py()
        vectors = _unit(table["vector"], width)
        codes = np.frombuffer(arrays.column_bytes(table["codes"])[0].tobytes(), _code_type(bits)).reshape(len(ids), -1)
        x, y = blocks.sides(table)
        i, j = np.nonzero(vectors[x] @ vectors[y].T >= threshold)
        i, j = x[i], y[j]
        one = i < j if table["block_a"][0] == table["block_b"][0] else i != j
        i, j = i[one], j[one]
        links = np.zeros(len(ids), np.int64)
        for start in range(0, len(i), PAIRS):
            a, b = i[start:start + PAIRS], j[start:start + PAIRS]
            new = ~(codes[a, :number] == codes[b, :number]).any(axis=1)
            np.add.at(links, a[new], counts[b[new]])
            np.add.at(links, b[new], counts[a[new]])
        edges = blocks.stars(ids, i, j)
        some = np.flatnonzero(links)
        return pa.table({
            "id": pa.concat_arrays([pa.array(ids[some]), edges["a"].combine_chunks()]),
            "n_links": pa.array(np.append(links[some], np.zeros(len(edges), np.int64))),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), edges["b"].combine_chunks()])})

    return arrays.tidy(compare)


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, id_column: str = "vec_id",
                 vector_column: str = "embedding") -> DataFrame:
    """(id column, n_links, component_id, kept) for each row."""

    if not 0 < threshold < 1:
        raise ValueError("the threshold must be between 0 and 1")
    rows = store(embeddings.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).mapInArrow(_read, "id long, vector binary, width int, high long, low long"))
    good = rows.where("id IS NOT NULL AND vector IS NOT NULL")
    classes = store(good.groupBy("high", "low").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("width").alias("width")))
    bits, tables = plan(classes.count(), threshold)
    coded = store(classes.select("id", "vector", "width", "n").mapInArrow(
        _codes(bits, tables), "id long, vector binary, width int, n long, codes binary, keys array<int>"))
    dealt = coded.select("id", "vector", "width", "n", "codes", F.posexplode("keys").alias("table", "key"))
    group = ["width", "table", "key"]
    found = store(
        blocks.block_pairs(dealt, group, BLOCK).groupBy(*group, *blocks.PAIR)
        .applyInArrow(_compare(bits, threshold), LINKS))
    links = found.where("b IS NULL").groupBy("id").agg(F.sum("n_links").alias("linked"))
    totals = classes.join(links, "id", "left").select(
        "high", "low", F.col("id").alias("first_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    members = store(good.select("id", "high", "low").join(totals, ["high", "low"]).select("id", "high", "low", "first_id", "n_links"))
    edges = found.where("b IS NOT NULL").select(F.col("id").alias("a"), "b").distinct().unionByName(
        members.select(F.col("id").alias("a"), F.col("first_id").alias("b")).where("a != b").distinct())
    labels = store(connected_components(edges))
    counted = members.select("id", "n_links").unionByName(
        rows.where("id IS NULL OR vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links")))
    return counted.join(labels, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias(id_column), "n_links", F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))
