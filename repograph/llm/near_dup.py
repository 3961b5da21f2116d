"""Near-duplicate texts by banded MinHash with odd sketches.

A text's set holds its distinct word shingles.  Texts with equal sets are one class (128-bit set
fingerprint).  Of each class, ``BANDS`` times ``ROWS`` MinHash values give band keys for candidates,
and folded into parity bits they give an odd sketch: the number of differing bits of two sketches
estimates their similarity, sharply where it is high.  A candidate is dropped if its sketches put it more
than ``MARGIN`` below the threshold (over five standard errors); all others are confirmed on the full sets.

A band bucket may hold a third of all texts, so its pairs are never listed.  First every member is
compared with the bucket's smallest member.  If members are then still in other components than
most of the bucket, their sketches are compared with all others, block by block inside tasks, which
leaves families of texts with likely links; in these the full sets are compared, again by blocks, but for
texts already in the family's main component.  Only links to a block's smallest text leave a task.  Every pair of a
bucket is thus compared or already connected, so components are those of the whole link graph over candidates.
Two texts at the threshold of 0.8 share no band with a chance of 1.3e-7.

Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased.  Fewer words than a shingle make
one shingle; null, empty and wordless texts have an empty set and link with nothing.  Rows with one id
are one vertex; rows without an id are kept and link with nothing.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays, blocks
from repograph.llm.components import connected_components
from repograph.llm.tables import store

BANDS, ROWS = 40, 5
SKETCH_BITS = 512
MARGIN = 0.2
SKETCH_BLOCK, TEXT_BLOCK, COLUMNS = 512, 256, 4096

_FACTORS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * arrays.U64(2) + arrays.U64(1)

SIGNATURE = "id long, n_shingles long, high long, low long, bands array<long>, sketch array<long>"


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, rows * width + 1, width), pa.int32()), pa.array(values.ravel().view(np.int64)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def sketches(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of nonempty sets."""

    n = len(first) - 1
    bands = np.zeros((n, BANDS), np.uint64)
    parity = np.zeros((n, SKETCH_BITS), np.uint8)
    rows = np.arange(n)
    for i, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(sets * factor, first[:-1])
        band = i // ROWS
        bands[:, band] = arrays.joined(bands[:, band] + arrays.U64(band + 1), least)
        bit = arrays.joined(np.full(n, i, np.uint64), least) % arrays.U64(SKETCH_BITS)
        parity[rows, bit.astype(np.int64)] ^= 1
    return bands, np.packbits(parity, axis=1).view(np.uint64)


def _signatures(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for start, stop, data, offsets in arrays.text_slices(batch.column("text")):
                sets, first = arrays.shingles(*arrays.word_hashes(data, offsets), size)
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                bands = np.zeros((stop - start, BANDS), np.uint64)
                sketch = np.zeros((stop - start, SKETCH_BITS // 64), np.uint64)
                if len(full):
                    bands[full], sketch[full] = sketches(sets, np.append(first[:-1][full], first[-1]))
                marks = [_sums(arrays.mix(sets ^ arrays.U64(c)), first).view(np.int64) for c in (11, 23)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array(counts), *map(pa.array, marks), _lists(bands), _lists(sketch)],
                    names=["id", "n_shingles", "high", "low", "bands", "sketch"])

    return arrays.tidy(sign)


def _estimate(a: str, b: str) -> Column:
    """Similarity that two odd sketches suggest."""

    differing = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # A share near one half says only that the sets differ much.
    share = F.least(2 * differing / F.lit(SKETCH_BITS), F.lit(0.999))
    return 1 + F.log(1 - share) * (SKETCH_BITS / (4 * BANDS * ROWS))


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out."""

    left = classes.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = classes.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(left, "a").join(right, "b").where(
        _estimate("sketch_a", "sketch_b") >= threshold - MARGIN).select("a", "b")


def _compare(size: int, numerator: int, denominator: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(c) for c in ("text_a", "text_b")]
            sides = [arrays.column_bytes(t) for t in texts]
            kept = []
            for start, stop in arrays.slices(sides[0][1] + sides[1][1]):
                held = []
                for data, at in sides:
                    sets, first = arrays.shingles(
                        *arrays.word_hashes(data[at[start]:at[stop]], at[start:stop + 1] - at[start]), size)
                    held.append((sets, first))
                owner = np.concatenate([arrays.row_numbers(f) for _, f in held])
                values = np.concatenate([s for s, _ in held])
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                same = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
                shared = np.bincount(owner[1:][same], minlength=stop - start)
                union = np.diff(held[0][1]) + np.diff(held[1][1]) - shared
                kept.append((denominator * shared >= numerator * union) & (shared > 0))
            mask = pa.array(np.concatenate(kept) if kept else np.empty(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    return arrays.tidy(compare)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs whose full sets reach the threshold; only texts that occur in pairs are moved twice."""

    pairs = store(pairs.distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # The ids can be a fixed share of all, so they are joined by a shuffle at every size.
    held = store(texts.join(ids.hint("shuffle_merge"), "id", "left_semi"))
    return store(
        pairs.join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_compare(size, numerator, denominator), "a long, b long").distinct())


def _likely_families(least: float):
    """Links that sketches suggest between members of different components."""

    most = SKETCH_BITS / 2 * (1 - math.exp((least - 1) * 4 * BANDS * ROWS / SKETCH_BITS))

    def compare(table: pa.Table) -> pa.Table:
        ids, labels = (table[c].to_numpy() for c in ("id", "label"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        x, y = blocks.sides(table)
        differing = np.zeros((len(x), len(y)), np.int64)
        for word in range(sketch.shape[1]):
            differing += np.bitwise_count(sketch[x, word][:, None] ^ sketch[y, word])
        i, j = np.nonzero((differing <= most) & (labels[x][:, None] != labels[y]))
        return blocks.stars(ids, x[i], y[j])

    return arrays.tidy(compare)


def _compare_blocks(size: int, numerator: int, denominator: int):
    def compare(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets, first = arrays.shingles(*arrays.word_hashes(*arrays.column_bytes(table["text"])), size)
        _, column, held_by = np.unique(sets, return_inverse=True, return_counts=True)
        # Shingles of one text are in no intersection.
        number = np.cumsum(held_by > 1) - 1
        shared = held_by[column] > 1
        row, column = arrays.row_numbers(first)[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        x, y = blocks.sides(table)
        common = np.zeros((len(x), len(y)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            marks = np.zeros((len(ids), COLUMNS), np.float32)
            marks[row[a:b], column[a:b] - start] = 1
            common += marks[x] @ marks[y].T
        counts = np.diff(first)
        union = counts[x][:, None] + counts[y] - common
        i, j = np.nonzero((denominator * common >= numerator * union) & (common > 0) & (ids[x][:, None] != ids[y]))
        return blocks.stars(ids, x[i], y[j])

    return arrays.tidy(compare)


def near_duplicates(
    documents: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id column, n_shingles, component_id, kept) for each row.

    Rows link if ``denominator`` * intersection >= ``numerator`` * union of their sets.  The component
    id is the smallest id that links reach; a row is kept if it is its own, or has no id.
    """

    threshold = numerator / denominator
    if not MARGIN < threshold <= 1:
        raise ValueError(f"the threshold must be over {MARGIN} and at most 1")
    if BANDS * math.log(1 - 0.8**ROWS) > -15 or threshold < 0.8:
        raise ValueError("the bands are made for thresholds of 0.8 and more")
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = store(texts.mapInArrow(_signatures(size), SIGNATURE))
    filled = signed.where("id IS NOT NULL AND n_shingles > 0")
    classes = store(filled.groupBy("high", "low").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("n")))
    copies = filled.join(
        classes.where("n > 1").select("high", "low", F.col("id").alias("first_id")), ["high", "low"]).select(
        F.col("id").alias("a"), F.col("first_id").alias("b")).where("a != b")
    keys = classes.select("id", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub < most")
    members = store(keys.join(hubs.select("band", "hub"), "band"))
    first = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(_likely(first, classes, threshold), texts, size, numerator, denominator)

    labels = connected_components(links)
    placed = members.join(labels, F.col("id") == F.col("node"), "left").select(
        "band", "hub", "id", F.coalesce("component", "id").alias("label"))
    groups = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    # The largest component of each bucket; only buckets with several others or more matter.
    largest = groups.groupBy("band").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("several")).where("several > 1")
    open_rows = placed.join(largest, "band").where("id != hub").select(
        "band", "id", "label", (F.col("label") == F.col("main")).alias("settled"))
    sketched = store(open_rows.join(classes.select("id", "sketch"), "id"))
    likely = store(blocks.compare_in_lots(
        blocks.block_pairs(sketched, ["band"], SKETCH_BLOCK, "settled"), ["band", *blocks.PAIR],
        _likely_families(threshold - MARGIN), "a long, b long").distinct())
    families = connected_components(likely).select(F.col("node").alias("id"), F.col("component").alias("family"))
    named = store(families.join(labels, F.col("id") == F.col("node"), "left").select(
        "id", "family", F.coalesce("component", "id").alias("label")))
    main = named.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"))
    held = named.join(main, "family").join(texts, "id").select(
        "id", "family", "text", (F.col("label") == F.col("main")).alias("settled"))
    more = store(
        blocks.block_pairs(store(held), ["family"], TEXT_BLOCK, "settled").groupBy("family", *blocks.PAIR)
        .applyInArrow(_compare_blocks(size, numerator, denominator), "a long, b long").distinct())
    labels = store(connected_components(links.unionByName(more).unionByName(copies)))
    return signed.join(labels, signed["id"] == labels["node"], "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))
