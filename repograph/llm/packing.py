"""Best-fit packing of token sequences with exact complements.

Only lengths matter for a plan, and there are at most ``capacity`` of them, so the plan is made on the
table of length counts: sums of one, two and three lengths are indexed; from the longest length down, the gap
of a piece is looked up there and filled exactly, as many times as the counts allow; what has no exact
complement goes best-fit, longest first.  A plan is a list of patterns (how many pieces of which
lengths make a sequence) with counts.

Pieces learn their place without being gathered: each task numbers its pieces per length, the tasks'
counts are added up per length, and the number of a piece within its length selects pattern, sequence
and offset.  However many pieces share a length, no task holds them all.

A text's ids get an end id; null and empty texts are the end id alone.  Texts over the capacity are cut
from the end into full pieces, so that the first piece may be shorter.  Repeated rows are packed each.
Only the id and text columns are read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long")


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from repograph.llm.tokens import text_encoder

        encoder = text_encoder(path)
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            docs = batch.column("doc_id")
            for first, last, ids, bounds in encoder.slices(batch.column("text")):
                rows = []
                for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    held = np.append(ids[a:b], end_id).astype("<u4")
                    begin, n = 0, len(held)
                    while begin < n:
                        length = (n - begin - 1) % capacity + 1 if begin == 0 else capacity
                        rows.append((first + row, begin, length, zlib.crc32(held[begin:begin + length]), seen[length]))
                        seen[length] += 1
                        begin += length
                owner, begins, lengths, sums, numbers = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                pieces = np.arange(len(rows)) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays([
                    docs.take(pa.array(owner)), pa.array(pieces.astype(np.int32)), pa.array(begins), pa.array(lengths),
                    pa.array(sums), pa.array(np.full(len(rows), part)), pa.array(numbers)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    return arrays.tidy(cut)


class SumIndex:
    """Counts of the lengths that are left, and an index of the sums of two and of three of them.

    A single length is its own sum.  ``pairs[s]`` and ``triples[s]`` hold lengths that add up to ``s``, largest
    first, zeros where no lengths do.  They are filled once from the lengths that occur; an entry that the counts
    no longer bear out is looked for again when its sum is asked for.  Counts only fall, so an entry of zeros stays.
    Of several combinations the one with the largest first length is held.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.pairs = np.zeros((capacity + 1, 2), np.int64)
        self.triples = np.zeros((capacity + 1, 3), np.int64)
        lengths = np.flatnonzero(self.count)
        for largest in lengths[::-1].tolist():
            others = lengths[lengths <= min(largest, capacity - largest)]
            others = others[self.pairs[largest + others, 0] == 0]
            self.pairs[largest + others, 0], self.pairs[largest + others, 1] = largest, others
        summed = np.flatnonzero(self.pairs[:, 0])
        for largest in lengths[::-1].tolist():
            others = summed[summed <= capacity - largest]
            others = others[self.triples[largest + others, 0] == 0]
            self.triples[largest + others, 0], self.triples[largest + others, 1:] = largest, self.pairs[others]

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often a pattern can be taken."""

        return min(self.count[length] // n for length, n in Counter(pattern).items())

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for length in pattern:
            self.count[length] -= times

    def _pair(self, total: int, most: int) -> tuple[int, int]:
        """Two lengths that are left, of the given sum, the larger at most ``most``; zeros if there are none."""

        larger = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        fits = (self.count[larger] > 0) & (self.count[total - larger] > (larger * 2 == total))
        found = np.flatnonzero(fits)
        return (int(larger[found[-1]]), int(total - larger[found[-1]])) if len(found) else (0, 0)

    def _triple(self, total: int) -> tuple[int, int, int]:
        """Three lengths that are left, of the given sum; zeros if there are none."""

        for largest in np.flatnonzero(self.count[:max(total - 1, 0)])[::-1].tolist():
            if largest * 3 < total:
                break
            self.count[largest] -= 1
            pair = self._pair(total - largest, largest)
            self.count[largest] += 1
            if pair[0]:
                return (largest, *pair)
        return (0, 0, 0)

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly and are left."""

        if self.count[gap]:
            return (gap,)
        for sums, search in ((self.pairs, lambda s: self._pair(s, s - 1)), (self.triples, self._triple)):
            if sums[gap, 0] and not self.times(tuple(sums[gap].tolist())):
                sums[gap] = search(gap)
            if sums[gap, 0]:
                return tuple(sums[gap].tolist())
        return None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, copies), ...) with how many sequences have them."""

    stock = SumIndex(counts, capacity)
    patterns: list[tuple[Counter[int], int]] = []
    rest: dict[int, int] = {}
    for length in sorted(counts, reverse=True):
        while stock.count[length]:
            if length == capacity:
                pattern: tuple[int, ...] | None = (length,)
            else:
                stock.count[length] -= 1
                others = stock.complement(capacity - length)
                stock.count[length] += 1
                pattern = (length, *others) if others else None
            if pattern is None:
                rest[length] = int(stock.count[length])
                stock.count[length] = 0
                break
            times = int(stock.times(pattern))
            stock.take(pattern, times)
            patterns.append((Counter(pattern), times))

    open_bins: dict[int, list[tuple[Counter[int], int]]] = defaultdict(list)
    for length, left in sorted(rest.items(), reverse=True):
        while left:
            gap = min((g for g, bins in open_bins.items() if bins and g >= length), default=None)
            if gap is None:
                copies = capacity // length
                used = [(copies, left // copies), (left % copies, 1)]
                for n, times in used:
                    if n and times:
                        open_bins[capacity - n * length].append((Counter({length: n}), times))
                left = 0
                continue
            bins, times = open_bins[gap].pop()
            copies = min(gap // length, left)
            filled = min(times, left // copies)
            if filled < times:
                open_bins[gap].append((bins, times - filled))
            open_bins[gap - copies * length].append((bins + Counter({length: copies}), filled))
            left -= filled * copies
    patterns += [b for bins in open_bins.values() for b in bins]
    return [(tuple(sorted(p.items(), reverse=True)), n) for p, n in patterns]


def _slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first number, first sequence, copies in a sequence, offset), by first number."""

    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            slots[length].append((used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def _place(slots: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                size = int(length[rows[0]])
                held = slots[size]
                slot = held[np.searchsorted(held[:, 0], number[rows], side="right") - 1]
                done = number[rows] - slot[:, 0]
                sequence[rows] = slot[:, 1] + done // slot[:, 2]
                offset[rows] = slot[:, 3] + done % slot[:, 2] * size
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    return place


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""

    if capacity < 1:
        raise ValueError("capacity must be positive")
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = store(texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES))
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_patterns(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("first")).alias("number"))
    return numbered.mapInArrow(
        _place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
