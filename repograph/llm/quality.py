"""Quality scores of texts by pairwise ranking.

A linear score is learnt from preference pairs, one good and one bad text each, by the logistic loss on
the difference of their features (Bradley-Terry).  The threshold is a quantile of the scores: the share
of bad labels, so that as many texts pass as labels are good.  The published score is a logistic curve
through ``CUT`` at the threshold, its slope fitted on the sample.

Features are shares of bytes and of trigrams of byte classes, repeated words and lines, word length
and text length, all over the whole text.

Every labelled text that is not held out is learnt from.  The texts are dealt by hash of the id to lots of about
``LOT``; each lot ranks its good texts above its bad ones, every text in pairs, and the weights are the mean over the
lots.  A class too rare for ``LEAST`` texts a lot is given to several lots.  Threshold and slope come from the scores of
all labelled texts.  Up to ``LOT`` labels are one lot, which the driver fits.

Null and empty texts have a score too.  Labels other than 0 and 1 and repeated labels: other values are
left out, each distinct (id, label) counts once.  Without both classes all scores are the share of good labels,
0.5 without labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.learning import adam, held_out, sigmoid
from repograph.llm.tables import store
from repograph.session import spread

LOT, LEAST, PAIRS, CUT = 3000, 200, 30_000, 0.3
SLOPES = np.geomspace(0.1, 10, 41)
# Sums over lots and rows are whole numbers of these parts, so that they do not depend on their order.
WEIGHT_PARTS, LOSS_PARTS = 2.0**32, 2.0**20

# lower, upper, digit, blank, line end, sentence marks, other marks, bytes over 7F
_KIND = np.full(256, 6, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[0x20, 0x09]], _KIND[[0x0A, 0x0D]], _KIND[[0x2E, 0x2C, 0x3B, 0x3A]] = 3, 4, 5
TRIGRAMS, BYTES, EXTRA = 512, 256, 6
FEATURES = TRIGRAMS + BYTES + EXTRA


def _distinct(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[fresh], minlength=rows)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, FEATURES), np.float32)
    owner = np.repeat(np.arange(rows), sizes)
    for a in range(0, rows, 256):
        b = min(rows, a + 256)
        held, own = data[offsets[a]:offsets[b]], owner[offsets[a]:offsets[b]] - a
        kind = _KIND[held]
        code = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
        inside = own[:-2] == own[2:]
        grams = np.bincount(own[:-2][inside] * TRIGRAMS + code[inside], minlength=(b - a) * TRIGRAMS)
        single = np.bincount(own * BYTES + held, minlength=(b - a) * BYTES)
        size = np.maximum(sizes[a:b], 1)[:, None]
        out[a:b, :TRIGRAMS] = np.sqrt(grams.reshape(b - a, TRIGRAMS) / size)
        out[a:b, TRIGRAMS:TRIGRAMS + BYTES] = np.sqrt(single.reshape(b - a, BYTES) / size)
    words, first = arrays.word_hashes(data, offsets)
    counts = np.diff(first)
    word_owner = arrays.row_numbers(first)
    again = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    lines = np.flatnonzero(data == 10)
    bounds = np.union1d(offsets, lines + 1)
    starts, stops = bounds[:-1], bounds[1:]
    line_owner = np.searchsorted(offsets, starts, side="right") - 1
    line_counts = np.bincount(line_owner, minlength=rows)
    line_hashes = arrays.string_hashes(data, starts, stops - (data[stops - 1] == 10))
    extra = out[:, TRIGRAMS + BYTES:]
    many = np.maximum(counts, 1)
    extra[:, 0] = np.bincount(word_owner[1:][again], minlength=rows) / many
    extra[:, 1] = _distinct(words, word_owner, rows) / many
    extra[:, 2] = _distinct(line_hashes, line_owner, rows) / np.maximum(line_counts, 1)
    extra[:, 3] = np.minimum(sizes / many, 100) / 10
    extra[:, 4] = np.log1p(counts) / 10
    extra[:, 5] = np.sqrt(extra[:, 0])
    return out


@dataclass
class Model:
    weights: np.ndarray
    threshold: float
    slope: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        # A raw score at the threshold is exactly the cut.
        raw = x.astype(np.float64) @ self.weights - self.threshold
        return np.where(raw >= 0, np.maximum(CUT, self._curve(raw)), np.minimum(np.nextafter(CUT, 0), self._curve(raw)))

    def _curve(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * raw + np.log(CUT / (1 - CUT)))


def rank(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights that put good rows above bad ones; every row stands in pairs."""

    bad_rows, good_rows = np.flatnonzero(~good), np.flatnonzero(good)
    x = x.astype(np.float64)
    scale = x.std(axis=0) + 0.02
    z = x / scale
    pick = np.random.default_rng(9)
    pairs = max(PAIRS, len(good_rows), len(bad_rows))
    a, b = (pick.permutation(np.resize(pick.permutation(rows), pairs)) for rows in (good_rows, bad_rows))

    def gradient(w: np.ndarray) -> np.ndarray:
        s = z @ w
        pull = sigmoid(s[b] - s[a]) / pairs
        each = np.bincount(b, pull, len(z)) - np.bincount(a, pull, len(z))
        return z.T @ each + 1e-4 * w

    return adam(gradient, np.zeros(FEATURES), 300, 0.05) / scale


def _losses(margin: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The logistic loss of each row for each slope."""

    return np.logaddexp(0, np.where(good, -1, 1) * (SLOPES[:, None] * margin + np.log(CUT / (1 - CUT))))


def _share(totals: tuple[int, int]) -> Model:
    return Model(np.zeros(FEATURES), 0.0, 1.0, totals[1] / sum(totals) if sum(totals) else 0.5)


def fit(x: np.ndarray, good: np.ndarray, totals: tuple[int, int]) -> Model:
    """``totals``: how many bad and good labels there are, with those that have no row."""

    if good.all() or not good.any():
        return _share(totals)
    w = rank(x, good)
    s = x.astype(np.float64) @ w
    weight = np.where(good, totals[1] / good.sum(), totals[0] / (~good).sum())
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    at = int(np.searchsorted(below, totals[0] / sum(totals) - 1e-12))
    threshold = float(s[order][at:at + 2].mean())
    loss = (_losses(s - threshold, good) * weight).sum(axis=1)
    return Model(w, threshold, float(SLOPES[int(np.argmin(loss))]))


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, rows)), np.float32).reshape(len(rows), FEATURES)


def _rank_lot(lot: pa.Table) -> pa.Table:
    """Parts of the weights of one lot, and a one under the number ``FEATURES``; nothing for a single class."""

    rows = sorted(zip(lot.column("label").to_pylist(), lot.column("x").to_pylist(), strict=True))
    good = np.array([label == 1 for label, _ in rows], bool)
    found = np.empty(0, np.int64)
    if good.any() and not good.all():
        parts = np.rint(rank(_matrix([x for _, x in rows]), good) * WEIGHT_PARTS)
        found = np.append(parts.astype(np.int64), 1)
    return pa.table({"place": pa.array(np.arange(len(found), dtype=np.int32)), "parts": pa.array(found)})


def _lot_weights(described: DataFrame, lots: int, counts: tuple[int, int]) -> np.ndarray | None:
    """The mean of the weights of all lots; none where no document has one of the labels."""

    copies = [min(lots, max(1, -(-lots * LEAST // count))) for count in counts]
    turn = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1]).otherwise(copies[0]) - 1))
    dealt = described.withColumn("turn", turn).select(
        F.pmod(F.col("hash") + F.col("turn"), F.lit(lots)).cast("int").alias("lot"), "label", "x")
    ranked = spread(dealt, "lot").groupBy("lot").applyInArrow(_rank_lot, "place int, parts long")
    # As many rows as features.
    parts = {r["place"]: r["parts"] for r in ranked.groupBy("place").agg(F.sum("parts").alias("parts")).collect()}
    if not parts:
        return None
    return np.array([parts[i] for i in range(FEATURES)]) / WEIGHT_PARTS / parts[FEATURES]


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; the same step leads back."""

    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _doubles(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _raw_keys(weights: np.ndarray):
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column("x").to_pylist()).astype(np.float64) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(_ordered(found + 0.0))], names=["label", "key"])

    return raw


def _threshold(keys: DataFrame, weight: dict[int, float], share: float) -> float:
    """The score that the given share of the weight does not exceed, halfway to the next one where it is met exactly.

    Sought 16 bits at a time, so a round brings at most 65,536 counts of each label.
    """

    total = sum(weight[r["label"]] * r["count"] for r in keys.groupBy("label").count().collect())
    least, under, prefix = share * total * (1 - 1e-12), 0.0, None
    for shift in (48, 32, 16, 0):
        held = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == prefix)
        steps: dict[int, float] = {}
        for r in held.groupBy(F.shiftright("key", shift).alias("digits"), "label").count().collect():
            steps[r["digits"]] = steps.get(r["digits"], 0.0) + weight[r["label"]] * r["count"]
        for prefix in sorted(steps):
            if under + steps[prefix] >= least:
                break
            under += steps[prefix]
    value = float(_doubles(np.array([prefix]))[0])
    if under + steps[prefix] > share * total * (1 + 1e-12):
        return value
    above = keys.where(F.col("key") > prefix).agg(F.min("key")).head()[0]
    return value if above is None else (value + float(_doubles(np.array([above]))[0])) / 2


def _slope(keys: DataFrame, weight: dict[int, float], threshold: float) -> float:
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.asarray(batch.column("label")) == 1
            margin = _doubles(np.asarray(batch.column("key"))) - threshold
            parts = np.rint(_losses(margin, good) * LOSS_PARTS).astype(np.int64)
            sums = np.concatenate([parts[:, ~good].sum(axis=1), parts[:, good].sum(axis=1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], len(SLOPES)).astype(np.int32)),
                 pa.array(np.tile(np.arange(len(SLOPES)), 2).astype(np.int32)), pa.array(sums)],
                names=["label", "slope", "parts"])

    found = keys.mapInArrow(losses, "label int, slope int, parts long").groupBy("label", "slope").agg(
        F.sum("parts").alias("parts")).collect()
    loss = np.zeros(len(SLOPES))
    for r in sorted(found, key=lambda r: (r["label"], r["slope"])):
        loss[r["slope"]] += weight[r["label"]] * r["parts"]
    return float(SLOPES[int(np.argmin(loss))])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features in place of texts, packed: most are zero."""

    for batch in batches:
        for start, stop, data, offsets in arrays.text_slices(batch.column("text")):
            packed = [zlib.compress(row.tobytes(), 1) for row in features(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name).slice(start, stop - start) for name in ("id", "missing", "hash")]
                + [pa.array(packed, pa.binary())],
                names=["id", "missing", "hash", "x"])


def learn(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality") -> Model:
    """Fit on all labelled rows that are not held out."""

    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    totals = (counts.get(0, 0), counts.get(1, 0))
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(
        F.col("id").isNotNull() & ~held_out(F.col("id")))
    if not all(totals):
        return _share(totals)
    # Packed features are shorter than their texts, so they are what meets the labels, at every size in the same way.
    # Of the texts of a repeated id the one with the smallest hash counts.
    kind = texts.schema["id"].dataType.simpleString()
    rows = (
        texts.select("id", F.col("text").isNull().alias("missing"), F.xxhash64("text").alias("hash"), "text")
        .mapInArrow(_describe, f"id {kind}, missing boolean, hash long, x binary")
        .join(known.hint("merge"), "id")
        .groupBy("id", "label").agg(F.min_by("x", F.struct("missing", "hash")).alias("x"))
        .select("label", F.xxhash64("id").alias("hash"), "x")
    )
    lots = -(-sum(totals) // LOT)
    if lots == 1:
        held = sorted((r["label"], bytes(r["x"])) for r in rows.collect())
        return fit(_matrix([x for _, x in held]), np.array([label == 1 for label, _ in held], bool), totals)
    rows = store(rows)
    weights = _lot_weights(rows, lots, totals)
    if weights is None:
        return _share(totals)
    keys = store(rows.mapInArrow(_raw_keys(weights), "label int, key long"))
    found = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    weight = {label: totals[label] / count for label, count in found.items()}
    threshold = _threshold(keys, weight, totals[0] / sum(totals))
    return Model(weights, threshold, _slope(keys, weight, threshold))


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.score(features(data, offsets))
                for _, _, data, offsets in arrays.text_slices(batch.column("text"))
            ]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))],
                names=["id", "score", "predicted"])

    return arrays.tidy(score)


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, score, predicted) for each row."""

    return documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    ).mapInArrow(_score(model), "id long, score double, predicted int").withColumnRenamed("id", id_column)
