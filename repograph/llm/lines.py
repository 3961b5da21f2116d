"""Dropping lines that many documents share.

Two Bloom filters hold the hashes of lines seen once and of lines seen twice.  They lie in segments of a bounded
size, dealt by hash: slices of documents send the hashes of their lines to the segments, never the lines, and
learn which of them may be repeats.  Only those lines are shuffled; their texts are compared and counted.

A slice sends a hash once.  One that several of its documents hold is a repeat already and needs no answer, so a
line of a third of all documents makes as many entries as there are slices.

Rows with the same id are one document: a line counts once for them and is dropped from all or none.  Rows
without an id count for no line and stay as they are.  Null texts are empty; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

BLANK = b" \t\n\r\v\f"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SLICE_BYTES = 8 << 20
#: Lines of a segment; bits of a filter for each of them; bits that one sets.
SEGMENT_LINES = 1 << 18
BITS = 16
PROBES = 5


def _key(line: bytes, least: int) -> bytes | None:
    """A line's key, or nothing if it has under ``least`` code points."""

    key = line.strip(BLANK).translate(LOWER)
    if len(key) < least or (not key.isascii() and len(key.decode(errors="replace")) < least):
        return None
    return key


def _hash(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")


class Seen:
    """Filters of what was seen once and twice; nothing that was seen is missed."""

    def __init__(self, lines: int = SEGMENT_LINES):
        self.once, self.twice = np.zeros((2, max(64, lines * BITS)), bool)

    def _bits(self, hashes: np.ndarray) -> np.ndarray:
        x = arrays.mix(hashes)
        step = arrays.mix(x + arrays.BASE) | np.uint64(1)
        return (x + step * np.arange(PROBES, dtype=np.uint64)[:, None]) % np.uint64(len(self.once))

    def add(self, hashes: np.ndarray, several: np.ndarray) -> None:
        """Distinct hashes; those of ``several`` documents count as seen twice."""

        bits = self._bits(hashes)
        self.twice[bits[:, several | self.once[bits].all(axis=0)]] = True
        self.once[bits] = True

    def repeats(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self._bits(hashes)].all(axis=0)


def _sent(least: int, segments: int):
    """Entries of slices: a segment's distinct hashes and the rows that ask; at -1 repeats within the slice."""

    def run(batches):
        for batch in batches:
            ids, twins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "twin"))
            for start, _, data, offsets in arrays.text_slices(batch.column("text"), SLICE_BYTES):
                text, offsets = data.tobytes(), offsets.tolist()
                pairs, holders = {}, Counter()
                for row, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False), start):
                    keys = {_key(line, least) for line in text[a:b].split(b"\n")} - {None}
                    pairs |= {(h, ids[row]): row for h in map(_hash, keys)}
                    holders.update({h for h in map(_hash, keys)})
                if not pairs:
                    continue
                h = np.fromiter((x for x, _ in pairs), np.uint64, len(pairs))
                row = np.fromiter(pairs.values(), np.int64, len(pairs))
                several = np.fromiter((holders[x] > 1 for x, _ in pairs), bool, len(pairs))
                segment = np.where(several, -1, (h % np.uint64(segments)).astype(np.int64))
                shared = np.unique(h[several])
                h, row = np.append(h, shared), np.append(row, np.full(len(shared), -1))
                several = np.append(several, np.ones(len(shared), bool))
                segment = np.append(segment, (shared % np.uint64(segments)).astype(np.int64))
                order = np.argsort(segment, kind="stable")
                stops = np.append(np.flatnonzero(np.diff(segment[order])) + 1, len(order))
                blocks = []
                for a, b in zip(np.append(0, stops[:-1]), stops, strict=True):
                    own = order[a:b]
                    asks = row[own]
                    blocks.append((
                        int(segment[own[0]]), h[own].tobytes(), several[own].tobytes(), np.where(asks < 0, 0, ids[asks]).tobytes(),
                        np.where(asks < 0, 0, twins[asks]).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)],
                    ["segment", "hashes", "several", "ids", "twins"])

    return arrays.tidy(run)


SENT = "segment long, hashes binary, several binary, ids binary, twins binary"
FOUND = "doc_id long, twin long, h long"


def _rows(table: pa.Table | pa.RecordBatch):
    """(hashes, several, ids, twins) of each entry."""

    for entry in zip(*(table[c].to_pylist() for c in ("hashes", "several", "ids", "twins")), strict=True):
        yield tuple(np.frombuffer(x, t) for x, t in zip(entry, (np.uint64, bool, np.int64, np.int64), strict=True))


def _table(ids: list[np.ndarray], twins: list[np.ndarray], hashes: list[np.ndarray]) -> dict[str, pa.Array]:
    empty = [np.empty(0, np.int64)]
    return dict(zip(("doc_id", "twin", "h"), (pa.array(np.concatenate(x or empty).view(np.int64)) for x in (ids, twins, hashes)), strict=True))


def _answered(table: pa.Table) -> pa.Table:
    """The rows of a segment whose lines may be repeats."""

    seen = Seen()
    for hashes, several, _, _ in _rows(table):
        seen.add(hashes, several)
    found = [(ids[at], twins[at], hashes[at]) for hashes, several, ids, twins in _rows(table)
             for at in [~several & seen.repeats(hashes)]]
    return pa.table(_table(*map(list, zip(*found, strict=True))))


def _unpacked(batches):
    for batch in batches:
        found = [(ids, twins, hashes) for hashes, _, ids, twins in _rows(batch)]
        if found:
            yield pa.RecordBatch.from_pydict(_table(*map(list, zip(*found, strict=True))))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as ``record``, with ``doc_id`` and ``twin``, which tells texts of one id apart."""

    names = [f"c{i}" for i in range(len(docs.columns))]
    column = dict(zip(docs.columns, names, strict=True))
    record = F.struct(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
    return docs.toDF(*names).select(
        record.alias("record"), F.col(column["doc_id"]).alias("doc_id"),
        F.xxhash64(column["text"]).alias("twin"), F.col(column["text"]).alias("text"))


def suspects(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, twin, h): hashes of lines that several documents may hold; none that they do hold is missing.

    ``docs`` has doc_id, twin and text.
    """

    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    lines = docs.select(F.sum(F.least(ends, F.octet_length("text") / least))).head()[0] or 0
    sent = store(docs.where("doc_id IS NOT NULL").mapInArrow(_sent(least, 1 + int(lines / SEGMENT_LINES)), SENT))
    asked = sent.where("segment >= 0").groupBy("segment").applyInArrow(arrays.tidy(_answered), FOUND)
    return asked.unionByName(sent.where("segment < 0").mapInArrow(arrays.tidy(_unpacked), FOUND))


def _keys_of_suspects(least: int):
    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "twin", "text", "found"))
            rows = []
            for doc, twin, text, found in zip(*columns, strict=True):
                found = {h % 2**64 for h in found}
                keys = {_key(line, least) for line in (text or "").encode().split(b"\n")} - {None}
                rows += [(doc, twin, key.decode()) for key in keys if _hash(key) in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["doc_id", "twin", "key"])

    return arrays.tidy(run)


def _kept(least: int):
    def run(batches):
        for batch in batches:
            record, dropped = batch.column("record"), batch.column("dropped").to_pylist()
            at = record.type.get_field_index("text")
            texts, lines, gone, digests = [], [], [], []
            for text, keys in zip(record.field(at).to_pylist(), dropped, strict=True):
                held = (text or "").encode().split(b"\n")
                left = held
                if keys:
                    keys = {k.encode() for k in keys}
                    left = [line for line in held if _key(line, least) not in keys]
                rest = b"\n".join(left)
                texts.append(rest.decode() if len(left) < len(held) else text)
                lines.append(len(held))
                gone.append(len(held) - len(left))
                digests.append(hashlib.sha256(rest).hexdigest())
            fields = [record.field(i) for i in range(record.type.num_fields)]
            fields[at] = pa.array(texts, pa.string())
            record = pa.StructArray.from_arrays(fields, fields=[
                pa.field(record.type[i].name, f.type) for i, f in enumerate(fields)])
            yield pa.RecordBatch.from_arrays(
                [record, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
                ["record", "n_lines", "n_dropped", "kept_sha256"])

    return arrays.tidy(run)


def drop_repeated_lines(docs: DataFrame, documents: int = 3, least: int = 20) -> DataFrame:
    """(record, n_lines, n_dropped, kept_sha256) of every row; ``record`` is the row with the lines that stay.

    Lines are compared without blanks at both ends and with A-Z lower-cased.  Those of at least ``least`` code
    points that ``documents`` documents hold stay in the document with the largest id only.
    """

    docs = _keyed(docs)
    texts = docs.select("doc_id", "twin", "text")
    found = suspects(texts, least).groupBy("doc_id", "twin").agg(F.collect_set("h").alias("found"))
    lines = store(texts.join(found, ["doc_id", "twin"]).select("doc_id", "twin", "text", "found").mapInArrow(
        _keys_of_suspects(least), "doc_id long, twin long, key string"))
    # One document for each id, whatever the number of its rows.
    holders = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    shared = store(holders.where(F.col("n") >= documents).select("key", "keeper"))
    dropped = (
        lines.join(shared, "key").where("doc_id < keeper")
        .groupBy("doc_id", "twin").agg(F.collect_set("key").alias("dropped")))
    left = docs.join(store(dropped), ["doc_id", "twin"], "left").select("record", "dropped")
    kind = docs.schema["record"].dataType.simpleString()
    return left.mapInArrow(_kept(least), f"record {kind}, n_lines long, n_dropped long, kept_sha256 string")
