"""Benchmark decontamination by rare seeds and local alignment.

Every item gives its word ``SEED``-grams.  How many texts hold each is counted over the whole corpus.  An
item's seeds are the grams that are rare in the corpus (held by at most ``RARE`` of the texts, or ``FEW``) or for
the item (held by at most twice its median), and in every run of ``WINDOW`` grams the rarest; so an item has
seeds even if a third of the corpus holds edited copies of it.  Grams that no text holds are none.  Where a
seed stands in a text, the words around are aligned with the item (Smith-Waterman: +1 for equal words,
-1 for others and for gaps).  The score is the alignment's share of the item's words; texts with a score
of ``MIN_SCORE`` over ``MIN_ALIGNED`` words or more are contaminated.

Items are read in blocks of about ``BLOCK_BYTES`` of text, so what a task holds of them is bounded; each block
is matched against all texts in place, without a shuffle of texts.

Words are lower-cased runs of letters and digits between blanks and punctuation (of ASCII and Unicode), so changes
of case and punctuation do not count as edits.  In scripts without blanks (Chinese, Japanese, Thai and others) each
character is a word.  Items of under ``MIN_WORDS`` words are too short for half an alignment to prove anything: they
are searched by their whole sequence of words and match where it stands unchanged, with a score of 1.  Items of
under ``LEAST_WORDS`` words, by default those without a gram, are left out, as are null ones; the parameter
``least_words`` sets that down to 1.  Null and empty texts match nothing.  Rows that share an id are
reported once per item; extra columns are not read; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

SEED, WINDOW, RARE, FEW = 3, 8, 0.001, 100
MIN_WORDS, MIN_ALIGNED, MIN_SCORE = 8, 6, 0.5
LEAST_WORDS = SEED
BLOCK_BYTES = 8 << 20
CELLS = 1 << 21


@dataclass
class Items:
    """A block of items as word hashes, and their grams with owners and places."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    def select(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.first, self.grams[keep], self.owners[keep], self.places[keep])


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the rows' words: hashes and positions of their first words."""

    if len(words) < SEED:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(len(words) - SEED + 1)
    at = at[at + SEED <= first[1:][arrays.row_numbers(first)[:len(at)]]]
    value = np.zeros(len(at), np.uint64)
    for i in range(SEED):
        value = arrays.joined(value, words[at + i])
    return value, at


def sequences(words: np.ndarray, first: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the sizes: the size, and hashes and positions of all runs of so many words of the rows."""

    left = first[1:][arrays.row_numbers(first)] - np.arange(len(words))
    value = np.zeros(len(words), np.uint64)
    for size in range(1, min(max(sizes, default=0), len(words)) + 1):
        value = arrays.joined(value[:len(words) - size + 1], words[size - 1:])
        if size in sizes:
            at = np.flatnonzero(left[:len(value)] >= size)
            yield size, value[at], at


def read_items(rows: list) -> Items:
    """Items of (item_id, text) rows, in order of their ids."""

    texts = pa.array([r["text"] for r in rows], pa.string())
    words, first = arrays.script_word_hashes(*arrays.column_bytes(texts))
    value, at = grams(words, first)
    owners = np.searchsorted(first, at, side="right") - 1
    return Items([r["item_id"] for r in rows], words, first, value, owners, at - first[owners])


class _Lookup:
    """Places of hashes in a sorted array; a table of 16-bit prints passes over most of the others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.prints = np.zeros(1 << 16, bool)
        self.prints[(self.keys & arrays.U64(0xFFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``values`` of known hashes and their places."""

        likely = np.flatnonzero(self.prints[(values & arrays.U64(0xFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, values[likely]), len(self.keys) - 1)
        real = self.keys[place] == values[likely] if len(self.keys) else np.zeros(len(likely), bool)
        return likely[real], place[real]


def _count(known: np.ndarray):
    lookup = _Lookup(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for start, stop, data, offsets in arrays.text_slices(batch.column("text")):
                words, first = arrays.script_word_hashes(data, offsets)
                value, at = grams(words, first)
                found, place = lookup.find(value)
                row = np.searchsorted(first, at[found], side="right") - 1
                total += np.bincount(np.unique(place * (stop - start) + row) // (stop - start), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": lookup.keys[used].view(np.int64), "n": total[used]})

    return arrays.tidy(count)


def pick_seeds(items: Items, held_by: np.ndarray, texts: int) -> np.ndarray:
    """Which grams are seeds, given how many texts hold each."""

    seeds = held_by <= max(RARE * texts, FEW)
    never = held_by.max(initial=0) + 1
    for start, stop in zip(*_runs(items.owners), strict=True):
        counts = held_by[start:stop]
        if counts.any():
            seeds[start:stop] |= counts <= 2 * np.median(counts[counts > 0])
        windows = np.lib.stride_tricks.sliding_window_view(
            np.where(counts > 0, counts, never), min(WINDOW, len(counts)))
        seeds[start + np.arange(len(windows)) + windows.argmin(axis=1)] = True
    return seeds & (held_by > 0)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(values, prepend=-1)) if len(values) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(values)) if len(starts) else starts


def align(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item row with its region row and the place where it ends.

    0 pads items and 1 pads regions; neither is equal to anything.
    """

    n, width = regions.shape
    steps = np.arange(width, dtype=np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, ends = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for column in range(items.shape[1]):
        word = items[:, column:column + 1]
        match = np.where((word == regions) & (word > 1), 1, -1)
        cell = np.maximum(np.maximum(above[:, :-1] + match, above[:, 1:] - 1), 0)
        cell = np.maximum.accumulate(cell + steps, axis=1) - steps
        above[:, 1:] = cell
        top = cell.argmax(axis=1)
        value = cell[np.arange(n), top]
        better = value > best
        best[better], ends[better] = value[better], top[better] + 1
    return best, ends


class _Whole:
    """Short items by the hash of all their words."""

    def __init__(self, items: Items, least_words: int):
        sizes = np.diff(items.first)
        self.items, self.known = items, {}
        for size, value, at in sequences(items.words, items.first, set(range(least_words, MIN_WORDS)) & {*sizes.tolist()}):
            owner = np.searchsorted(items.first, at, side="right") - 1
            whole = np.flatnonzero(sizes[owner] == size)
            whole = whole[np.argsort(value[whole], kind="stable")]
            lookup = _Lookup(value[whole])
            begin = np.searchsorted(value[whole], lookup.keys)
            self.known[size] = lookup, owner[whole], begin, np.diff(np.append(begin, len(whole)))

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, rows, items, end words) of the first place of each item in each row."""

        for size, value, at in sequences(words, first, set(self.known)):
            lookup, owners, begin, many = self.known[size]
            found, place = lookup.find(value)
            row = np.searchsorted(first, at[found], side="right") - 1
            once = np.unique(place * len(first) + row, return_index=True)[1]
            row, place, end = row[once], place[once], (at[found] - first[row] + size)[once]
            own = owners[arrays.ragged(begin[place], many[place])]
            if len(own):
                yield size, np.repeat(row, many[place]), own, np.repeat(end, many[place])


def _match(items: Items, least_words: int):
    short = _Whole(items, least_words)
    lookup = _Lookup(items.grams)
    order = np.argsort(items.grams, kind="stable")
    owners, places = items.owners[order], items.places[order]
    begin = np.searchsorted(items.grams[order], lookup.keys)
    many = np.diff(np.append(begin, len(order)))
    sizes = np.diff(items.first)
    slack = np.maximum(4, sizes // 4)

    def regions(words: np.ndarray, first: np.ndarray):
        """(row, item, region start) for the surroundings of every seed in a slice."""

        value, at = grams(words, first)
        found, place = lookup.find(value)
        hit = np.repeat(at[found], many[place])
        seed = arrays.ragged(begin[place], many[place])
        item = owners[seed]
        row = np.searchsorted(first, hit, side="right") - 1
        diagonal = (hit - first[row] - places[seed]) // slack[item]
        return np.unique(np.stack([row, item, diagonal], axis=1), axis=0).T if len(hit) else np.empty((3, 0), np.int64)

    def leaks(ids: pa.Array, own: np.ndarray, score: np.ndarray, aligned: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([items.ids[i] for i in own], pa.int64()), pa.array(score), pa.array(aligned), pa.array(end)],
            names=["doc_id", "item_id", "score", "aligned", "end_word"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for start, _, data, offsets in arrays.text_slices(batch.column("text")):
                words, first = arrays.script_word_hashes(data, offsets)
                for size, row, own, end in short.find(words, first):
                    yield leaks(ids.take(pa.array(start + row)), own, np.ones(len(own)), np.full(len(own), size), end)
                rows, item, diagonal = regions(words, first)
                ranked = np.argsort(sizes[item], kind="stable")
                rows, item, diagonal = rows[ranked], item[ranked], diagonal[ranked]
                done = 0
                while done < len(rows):
                    # Regions of like width are aligned together.
                    widths = sizes[item[done:]] + 3 * slack[item[done:]]
                    some = max(1, int(np.searchsorted(np.arange(1, len(widths) + 1) * widths, CELLS)))
                    part = slice(done, done + some)
                    done += some
                    row, own, left = rows[part], item[part], (diagonal[part] - 1) * slack[item[part]]
                    span = np.arange(int(widths[:some].max()))
                    where = left[:, None] + span
                    inside = (where >= 0) & (where < np.diff(first)[row][:, None]) & (span < widths[:some][:, None])
                    held = np.where(inside, words[np.where(inside, first[row][:, None] + where, 0)], 1)
                    span = np.arange(int(sizes[own].max()))
                    inside = span < sizes[own][:, None]
                    asked = np.where(inside, items.words[np.where(inside, items.first[own][:, None] + span, 0)], 0)
                    best, ends = align(asked, held)
                    score = best / sizes[own]
                    good = np.flatnonzero((score >= MIN_SCORE) & (best >= MIN_ALIGNED))
                    yield leaks(ids.take(pa.array(start + row[good])), own[good], score[good],
                                best[good].astype(np.int64), (left + ends)[good])

    return arrays.tidy(match)


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               item_column: str = "item_id", item_text_column: str = "text",
               least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, aligned, end_word) of the best alignment for each contaminated text and item."""

    if least_words < 1:
        raise ValueError("least_words must be at least 1")
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.lower(text_column).alias("text"))
    items = store(benchmark.select(
        F.col(item_column).cast("long").alias("item_id"), F.lower(item_text_column).alias("text")
    ).where("text IS NOT NULL").distinct())
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    n = texts.count()
    found = None
    for number in range(blocks):
        rows = items.where(block == number).orderBy("item_id", "text").collect()
        held = read_items(rows)
        long_enough = np.diff(held.first)[held.owners] >= MIN_WORDS
        held = held.select(long_enough)
        counts = dict(
            (r["gram"], r["n"]) for r in texts.mapInArrow(_count(held.grams), "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())
        held_by = np.array([counts.get(g, 0) for g in held.grams.view(np.int64).tolist()], np.int64)
        seeds = held.select(pick_seeds(held, held_by, n))
        matches = store(
            texts.mapInArrow(_match(seeds, least_words), "doc_id long, item_id long, score double, aligned long, end_word long")
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("score", "aligned", (-F.col("end_word")).alias("early"))).alias("best"))
            .select("doc_id", "item_id", "best.score", "best.aligned", (-F.col("best.early")).alias("end_word")))
        found = matches if found is None else found.unionByName(matches)
    return found
