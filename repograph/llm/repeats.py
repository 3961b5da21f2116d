"""Repeated passages by a depth-limited radix sort of suffixes at winnowed anchors.

Two texts share a string of ``length`` bytes exactly if two suffixes agree in their first ``length`` bytes, so
suffixes are ordered only that far, and only where an anchor says that a window may repeat.

* The windows that take part are those around anchors: in every window of ``length`` bytes the smallest hash
  of ``DIGIT`` bytes.  Equal windows have equal anchors, so nothing repeated is missed.
* Anchors are counted by digit, which is the anchor's hash modulo ``DIGITS``, and dealt to buckets by it.  A bucket
  groups them by hashes of (anchor, surrounding bytes) and keeps the groups with several documents.  An anchor
  whose whole surroundings stand in a smaller document is settled there and then; of the others only the smallest
  document of each group goes on.
* The suffixes that start up to ``length - DIGIT`` bytes before such an anchor are ordered by a radix sort, most
  significant digit (``PASS`` bytes) first and only through ``length`` bytes.  A group without a second document
  leaves after the pass that shows it; the groups left after the last pass are the repeated windows.

A digit with far more than its share of anchors (a line that a third of the texts hold) skips the
buckets: its windows are dealt by their hash, each with its bytes, and sorted in their tasks before
the shuffle and after it.  Within a task repeated surroundings are settled before anything is sent.
Buckets hold about ``BUCKET_BYTES``, partitions ``TASK_BYTES``; settled anchors go anywhere, slice by slice.

Texts are UTF-8 bytes; null is empty and matches never cross texts.  A null id counts as larger than all
others.  Rows with the same id are never compared with one another; repeated rows get the same
result.  Texts shorter than ``length`` keep all their bytes.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

DIGIT = 20
DIGITS = 1 << 12
PASS = 8
HEAVY = 4
BUCKET_BYTES = 8 << 20
TASK_BYTES = 4 * BUCKET_BYTES
HEAVY_ROWS = 1 << 12
LAST = np.iinfo(np.int64).max

SPANS = "doc long, row long, start int, stop int, open boolean, heavy boolean"


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Extreme of each run of ``width`` values."""

    out, done = values, 1
    while done * 2 <= width:
        out, done = best(out[:-done], out[done:]), done * 2
    rest = width - done
    return best(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and rows of the anchors of a slice, and its prefix sums last."""

    sums = arrays.prefix_sums(data)
    width = length - DIGIT + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), sums
    inverse = arrays.powers(len(sums))[1]
    grams = arrays.mix((sums[DIGIT:] - sums[:-DIGIT]) * inverse[:len(sums) - DIGIT])
    order = (grams >> arrays.U64(32)).astype(np.uint32)
    smallest = _sliding(order, width, np.minimum)
    for stop, size in zip(offsets[1:], np.diff(offsets), strict=True):
        # Windows that would run over the end of a text.
        smallest[max(stop - min(size, length - 1), 0):stop] = 0
    padded = np.zeros(len(smallest) + 2 * (width - 1), np.uint32)
    padded[width - 1:width - 1 + len(smallest)] = smallest
    at = np.flatnonzero((_sliding(padded, width, np.maximum) == order) & (order > 0))
    return at, grams[at], sums


def _digit(grams: np.ndarray) -> np.ndarray:
    return (arrays.mix(grams) % arrays.U64(DIGITS)).astype(np.int64)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _count_digits(length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIGITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in arrays.text_slices(batch.column("text")):
                total += np.bincount(_digit(anchors(data, offsets, length)[1]), minlength=DIGITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"digit": used, "n": total[used]})

    return arrays.tidy(count)


ENTRY = [("gram", np.uint64), ("around", np.uint64), ("doc", np.int64), ("row", np.int64), ("at", np.int32),
         ("before", np.uint16), ("after", np.uint16)]
DEALT = "bucket long, kind string, entries binary"


def _window_entry(length: int) -> list[tuple]:
    return [("window", np.dtype((np.void, length))), ("doc", np.int64), ("row", np.int64), ("start", np.int32)]


def _unpack(table: pa.Table, kind: str, columns: list[tuple]) -> list[np.ndarray]:
    """The entries of a kind in a bucket."""

    width = sum(np.dtype(k).itemsize for _, k in columns)
    out: list[list[np.ndarray]] = [[] for _ in columns]
    for name, blob in zip(table["kind"].to_pylist(), table["entries"].to_pylist(), strict=True):
        if name != kind:
            continue
        rows, at = len(blob) // width, 0
        for held, (_, number) in zip(out, columns, strict=True):
            held.append(np.frombuffer(blob, number, rows, at))
            at += rows * np.dtype(number).itemsize
    return [np.concatenate(h) if h else np.empty(0, k) for h, (_, k) in zip(out, columns, strict=True)]


def _deal_out(kind: str, key: np.ndarray, entry: list[np.ndarray], buckets: int) -> Iterator[tuple[int, str, bytes]]:
    """Entries packed by the bucket of their key."""

    bucket = (key % arrays.U64(buckets)).astype(np.int64)
    ranked = np.argsort(bucket, kind="stable")
    entry, bucket = [c[ranked] for c in entry], bucket[ranked]
    bounds = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        yield int(bucket[a]), kind, b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in entry)


def _one_lot(row: np.ndarray, part: np.ndarray) -> np.ndarray:
    """One key for all settled entries of a slice: they are not compared again, so that any bucket may hold them."""

    return np.repeat(arrays.mix(row[:1].astype(np.uint64)), np.count_nonzero(part))


def _dealt(rows: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(buckets, pa.int64()), "kind": pa.array(kinds, pa.string()),
        "entries": pa.array(blobs, pa.binary())})


def _smallest(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and document; each element's smallest document and group number, in that order."""

    order = np.lexsort((doc, *reversed(keys)))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    group = np.cumsum(fresh) - 1
    return order, doc[order][np.flatnonzero(fresh)][group] if len(order) else doc, group


def _deal_anchors(length: int, buckets: int, heavy: np.ndarray):
    heavy_digits = np.zeros(DIGITS, bool)
    heavy_digits[heavy] = True

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = _numbers(batch, "doc"), _numbers(batch, "row")
            for first, _, data, offsets in arrays.text_slices(batch.column("text")):
                at, gram, sums = anchors(data, offsets, length)
                if not len(at):
                    continue
                text = np.searchsorted(offsets, at, side="right") - 1
                start = np.maximum(at - (length - DIGIT), offsets[text])
                stop = np.minimum(at + length, offsets[text + 1])
                around = arrays.joined(
                    arrays.range_hashes(sums, start, stop), ((at - start) * 1024 + stop - start).astype(np.uint64))
                doc, row = docs[first + text], rows[first + text]
                entry = [gram, around, doc, row, (at - offsets[text]).astype(np.int32),
                         (at - start).astype(np.uint16), (stop - at).astype(np.uint16)]
                order, least, _ = _smallest([gram, around], doc)
                settled = np.zeros(len(at), bool)
                settled[order] = doc[order] > least
                heavy = heavy_digits[_digit(gram)]
                rows_out: list[tuple[int, str, bytes]] = []
                for kind, part, key in (
                        # Heavy digits are spread by what stands around them.
                        ("entry", ~heavy & ~settled, gram), ("heavy", heavy & ~settled, around),
                        ("settled", settled, None)):
                    lots = _one_lot(row, part) if key is None else key[part]
                    rows_out += _deal_out(kind, lots, [c[part] for c in entry], buckets)
                yield _dealt(rows_out)

    return arrays.tidy(deal)


def _span_table(parts: list[tuple]) -> pa.Table:
    """Rows from (doc, row, start, stop, open, heavy) parts; the last two are one value each."""

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
    columns = [np.concatenate([p[i] for p in parts]) for i in range(4)]
    columns += [np.repeat([p[i] for p in parts], [len(p[0]) for p in parts]) for i in (4, 5)]
    return pa.table({
        name: pa.array(c, k) for name, c, k in zip(
            ("doc", "row", "start", "stop", "open", "heavy"), columns, kinds, strict=True)})


def _sort_bucket(table: pa.Table) -> pa.Table:
    """One bucket of anchors: settled spans, and anchors (start only) that go on."""

    parts = []
    for kind in ("entry", "heavy"):
        gram, around, doc, row, at, before, after = _unpack(table, kind, ENTRY)
        order, least, _ = _smallest([gram, around], doc)
        gram, doc, row, at, before, after = (c[order] for c in (gram, doc, row, at, before, after))
        settled = doc > least
        on = ~settled
        if kind == "entry" and len(gram):
            # An anchor goes on if its digit also stands in a group of another document.
            fresh = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            several = np.minimum.reduceat(least, fresh) < np.maximum.reduceat(least, fresh)
            on &= np.repeat(several, np.diff([*fresh, len(gram)]))
        parts.append((doc[settled], row[settled], (at - before)[settled], (at + after)[settled], False, False))
        parts.append((doc[on], row[on], at[on], at[on], True, kind == "heavy"))
    _, _, doc, row, at, before, after = _unpack(table, "settled", ENTRY)
    parts.append((doc, row, at - before, at + after, False, False))
    return _span_table(parts)


AROUND = "bucket long, doc long, row long, at int, low int, high int, bytes binary, heavy boolean"


def _surroundings(length: int, buckets: int):
    """Open anchors with the bytes around them, padded so that the anchor stands at one place."""

    left, right = length - DIGIT, length

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, heavy = (_numbers(batch, n) for n in ("doc", "row", "heavy"))
            lists = batch.column("at")
            counts = np.diff(np.asarray(lists.offsets))
            places = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first_place = np.concatenate([[0], np.cumsum(counts)])
            for first, last, data, offsets in arrays.text_slices(batch.column("text")):
                owner = np.repeat(np.arange(last - first), counts[first:last])
                place = places[first_place[first]:first_place[last]]
                for a in range(0, len(place), 1 << 14):
                    text, at = owner[a:a + (1 << 14)], place[a:a + (1 << 14)]
                    low = np.minimum(at, left)
                    high = np.minimum(np.diff(offsets)[text] - at, right)
                    span = np.arange(-left, right)
                    inside = (span >= -low[:, None]) & (span < high[:, None])
                    where = np.where(inside, offsets[text][:, None] + at[:, None] + span, 0)
                    held = np.where(inside, data[where], 0).astype(np.uint8)
                    gram = arrays.range_hashes(
                        arrays.prefix_sums(held[:, left:left + DIGIT].ravel()),
                        np.arange(len(at)) * DIGIT, np.arange(1, len(at) + 1) * DIGIT)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((gram % arrays.U64(buckets)).astype(np.int64)), pa.array(docs[first + text]),
                        pa.array(rows[first + text]), pa.array(at.astype(np.int32)),
                        pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                        pa.array(list(map(bytes, held)), pa.binary()), pa.array(heavy[first + text])],
                        names=["bucket", "doc", "row", "at", "low", "high", "bytes", "heavy"])

    return arrays.tidy(cut_out)


def _later_windows(held: np.ndarray, doc: np.ndarray, rows: np.ndarray, first: int, length: int) -> np.ndarray:
    """Those of ``rows`` whose ``length`` bytes from column ``first`` on also stand in a row of a smaller document."""

    group = np.zeros(len(rows), np.int64)
    for begin in range(first, first + length, PASS):
        if not len(rows):
            return rows
        digit = np.zeros((len(rows), PASS), np.uint8)
        stop = min(begin + PASS, first + length)
        digit[:, :stop - begin] = held[rows, begin:stop]
        value = digit.view(">u8").ravel()
        order = np.lexsort((value, group))
        rows, group, value = rows[order], group[order], value[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        group, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        least = np.minimum.reduceat(doc[rows], heads)
        several = (least < np.maximum.reduceat(doc[rows], heads))[group]
        later = several & (doc[rows] > least[group])
        rows, group, later = rows[several], group[several], later[several]
    return rows[later] if len(rows) else rows


def _held(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return arrays.column_bytes(column)[0].reshape(-1, width)


def _sort_windows(length: int):
    def sort(table: pa.Table) -> pa.Table:
        """The radix sort on one bucket: the span of repeated windows around each anchor."""

        number = lambda name: table[name].combine_chunks().to_numpy(zero_copy_only=False)
        doc, row, at, low, high = (number(n) for n in ("doc", "row", "at", "low", "high"))
        held = _held(table["bytes"], 2 * length - DIGIT)
        far, near = np.full(len(doc), -1), np.full(len(doc), length)
        for j in range(length - DIGIT + 1):
            rows = np.flatnonzero((low >= j) & (high >= length - j))
            found = _later_windows(held, doc, rows, length - DIGIT - j, length)
            far[found] = np.maximum(far[found], j)
            near[found] = np.minimum(near[found], j)
        some = np.flatnonzero(far >= 0)
        return _span_table([(doc[some], row[some], (at - far)[some], (at - near + length)[some], False, False)])

    return arrays.tidy(sort)


def _deal_windows(length: int, buckets: int):
    """Windows around heavy anchors, dealt by their hash."""

    left = length - DIGIT

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, at, low, high = (_numbers(batch, n) for n in ("doc", "row", "at", "low", "high"))
            held = _held(batch.column("bytes"), 2 * length - DIGIT)
            for a in range(0, len(doc), HEAVY_ROWS):
                some = slice(a, a + HEAVY_ROWS)
                rows, places = np.nonzero(
                    (low[some, None] >= np.arange(left + 1)) & (high[some, None] >= length - np.arange(left + 1)))
                rows += a
                windows = held[rows[:, None], (left - places)[:, None] + np.arange(length)]
                begins = np.arange(len(rows)) * length
                key = arrays.range_hashes(arrays.prefix_sums(windows.ravel()), begins, begins + length)
                entry = [windows.view((np.void, length)).ravel(), doc[rows], row[rows],
                         (at[rows] - places).astype(np.int32)]
                settled = np.zeros(len(rows), bool)
                settled[_later_windows(windows, entry[1], np.arange(len(rows)), 0, length)] = True
                yield _dealt([
                    *_deal_out("settled", _one_lot(row[some], settled), [c[settled] for c in entry[1:]], buckets),
                    *_deal_out("entry", key[~settled], [c[~settled] for c in entry], buckets)])

    return arrays.tidy(deal)


def _sort_heavy(length: int):
    def sort(table: pa.Table) -> pa.Table:
        """The radix sort on one bucket of windows of heavy digits."""

        columns = _window_entry(length)
        window, doc, row, start = _unpack(table, "entry", columns)
        held = np.frombuffer(window.tobytes(), np.uint8).reshape(-1, length)
        found = _later_windows(held, doc, np.arange(len(doc)), 0, length)
        s_doc, s_row, s_start = _unpack(table, "settled", columns[1:])
        doc, row, start = (np.concatenate(p) for p in ((doc[found], s_doc), (row[found], s_row), (start[found], s_start)))
        return _span_table([(doc, row, start, start + length, False, False)])

    return arrays.tidy(sort)


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > stops[:-1]
    return starts[fresh], stops[np.append(np.flatnonzero(fresh)[1:] - 1, len(stops) - 1)]


def repeated_spans(documents: DataFrame, length: int = 50, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(doc, row, spans) for rows with bytes that a smaller document's string of ``length`` covers.

    ``doc`` is the id (the largest long for null), ``row`` a hash of the text, ``spans`` an array of
    (start, stop) that may overlap.
    """

    if length <= DIGIT:
        raise ValueError(f"length must be over {DIGIT}")
    spark = documents.sparkSession
    texts = documents.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(text_column).alias("row"), F.col(text_column).alias("text"))
    long_enough = texts.where(F.octet_length("text") >= length)
    digits = store(
        long_enough.select("text").mapInArrow(_count_digits(length), "digit long, n long")
        .groupBy("digit").agg(F.sum("n").alias("n")))
    total = digits.agg(F.sum("n")).head()[0] or 0
    heavy = [r["digit"] for r in digits.where(F.col("n") > HEAVY * max(total / DIGITS, 64)).collect()]
    width = sum(np.dtype(k).itemsize for _, k in ENTRY)
    buckets = max(total * width // BUCKET_BYTES, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = total * width // TASK_BYTES
    dealt = long_enough.mapInArrow(_deal_anchors(length, buckets, np.array(heavy, np.int64)), DEALT)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(parts, "bucket")
    first = store(
        dealt.groupBy("bucket").applyInArrow(arrays.tidy(_sort_bucket), SPANS))
    opened = first.where("open").groupBy("doc", "row", "heavy").agg(F.collect_set("start").alias("at"))
    around = store(
        opened.join(long_enough.dropDuplicates(["doc", "row"]), ["doc", "row"])
        .select("doc", "row", "at", "text", "heavy").mapInArrow(_surroundings(length, buckets), AROUND))
    second = around.where("NOT heavy").groupBy("bucket").applyInArrow(_sort_windows(length), SPANS)
    third = around.where("heavy").mapInArrow(_deal_windows(length, buckets), DEALT).groupBy(
        "bucket").applyInArrow(_sort_heavy(length), SPANS)
    spans = first.where("NOT open").unionByName(second).unionByName(third)
    return store(spans.groupBy("doc", "row").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))


MEASURES = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_texts(text_index: int, schema_names: list[str]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_index).cast(pa.large_binary())
            lists = batch.column("spans")
            kept, measures = [], []
            for text, spans in zip(texts, lists, strict=True):
                data = text.as_py() or b""
                runs: list[tuple[int, int]] = []
                if spans.is_valid and len(spans):
                    held = spans.values
                    starts, stops = (held.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    runs = list(zip(*(x.tolist() for x in _merge(starts, stops)), strict=True))
                parts, done = [], 0
                for start, stop in runs:
                    parts.append(data[done:start])
                    done = stop
                left = b"".join([*parts, data[done:]]) if runs else data
                # A cut can fall inside a character; its remaining bytes are no text.
                kept.append(None if not text.is_valid else left.decode("utf-8", "ignore"))
                measures.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            columns = batch.columns[:len(schema_names)]
            columns[text_index] = pa.array(kept, pa.string())
            parts = list(zip(*measures, strict=True)) or [(), (), (), ()]
            numbers = [pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, *numbers], names=[*schema_names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrays.tidy(apply)


def remove_repeats(documents: DataFrame, length: int = 50, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """``record``, a struct of the input's columns with the shortened text, and what was removed.

    ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs) count bytes of the input;
    ``kept_sha256`` is of the remaining bytes, which can end inside a character.
    """

    spans = repeated_spans(documents, length, id_column, text_column)
    columns = documents.columns
    names = [f"c{i}" for i in range(len(columns))]
    renamed = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    ids, texts = (F.col(names[columns.index(c)]) for c in (id_column, text_column))
    keyed = renamed.withColumns({
        "doc": F.coalesce(ids.cast("long"), F.lit(LAST)), "row": F.xxhash64(texts)})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
    cut = keyed.join(spans, ["doc", "row"], "left").select(*names, "spans").mapInArrow(
        _cut_texts(columns.index(text_column), names), f"{fields}, {MEASURES}")
    return cut.select(
        F.struct(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)]).alias("record"),
        "n_bytes", "n_removed", "n_spans", "kept_sha256")
