"""Phrase collocations from a weighted de Bruijn graph.

Nodes are pairs of words that follow each other in a piece of text, edges are triples (the longest grams)
between overlapping nodes, and an edge's weight is its number of occurrences.  Only triples are counted; one
starts at every word, and words near the end of a piece fill it up with ``END``.  So the flow out of a node is
its count, the fillings being the corrections for the ends of pieces, and the flow out of all nodes that begin
with a word is the word's count.  Languages do not mix: a word's identity includes its language.

Edges of at least ``min_count`` are compacted: where all flow through a node comes in by one edge and leaves
by one, both are parts of one path, whose weight is the count of every node inside it.

Texts that are null are empty, a null language is ``und``; repeated rows count again, whatever their ids, which
are not read.  No table needs a row.  Words of any length are allowed; a text is handled by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm import arrays
from repograph.llm.tables import store

SLICE_BYTES = 6 << 20
#: Bytes of text whose edges make one bucket.
BUCKET_BYTES = 12 << 20
#: Words with a larger share than one in so many may make hot nodes; at most so many are listed.
HOT_WORDS = 1 << 16
LOTS = 64
END = 0
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _MARK.copy()
_BETWEEN[[0x20, 0x09]] = True

Seeds = dict[tuple[bytes, bytes], int]


def identity(lang: bytes, word: bytes, bits: int, seeds: Seeds) -> int:
    """A number from 1 for a word of a language."""

    seed = seeds.get((lang, word), 0) if seeds else 0
    digest = hashlib.blake2b(b"%d:%b%b" % (len(lang), lang, word), digest_size=8, salt=b"%d" % seed).digest()
    return max(1, int.from_bytes(digest, "little") >> (64 - bits))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of about ``SLICE_BYTES``, across batches."""

    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        langs = pc.fill_null(batch.column("lang").cast(pa.large_binary()), b"und")
        _, offsets = arrays.column_bytes(texts)
        for start, stop in arrays.slices(offsets, SLICE_BYTES):
            new = int(offsets[stop] - offsets[start])
            if held and size + new > SLICE_BYTES:
                yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))
                held, size = [], 0
            held.append((langs.slice(start, stop - start), texts.slice(start, stop - start)))
            size += new
    if held:
        yield tuple(pa.concat_arrays(x) for x in zip(*held, strict=True))


def _words(langs: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Each word's place among the distinct (lang, word), the number of its piece, and those words."""

    data, offsets = arrays.column_bytes(texts)
    data = arrays.lowered(data)
    starts, stops, first = arrays.word_bounds(data, offsets, _BETWEEN)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    row = arrays.row_numbers(first)
    marks = np.searchsorted(np.flatnonzero(_MARK[data]), starts)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (marks[1:] != marks[:-1])
    del row, marks
    bounds = np.append(0, np.cumsum(stops - starts))
    said = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~_BETWEEN[data]])]
    ).dictionary_encode()
    tongues = langs.dictionary_encode()
    n = len(said.dictionary)
    codes = tongues.indices.to_numpy().astype(np.int64)[arrays.row_numbers(first)] * n + said.indices.to_numpy()
    distinct, codes = np.unique(codes, return_inverse=True)
    names, texts_of = tongues.dictionary.to_pylist(), said.dictionary.to_pylist()
    held = [(names[lang], texts_of[word]) for lang, word in zip(*(x.tolist() for x in divmod(distinct, n)), strict=True)]
    return codes, np.cumsum(fresh), held


def _counted(bits: int, seeds: Seeds):
    def run(batches):
        for langs, texts in _slices(batches):
            codes, _, held = _words(langs, texts)
            yield pa.RecordBatch.from_pydict({
                "h": pa.array([identity(*x, bits, seeds) for x in held], pa.uint64()).view(pa.int64()),
                "lang": pa.array([x[0] for x in held], pa.binary()).cast(pa.string()),
                "word": pa.array([x[1] for x in held], pa.binary()).cast(pa.string()),
                "n": pa.array(np.bincount(codes, minlength=len(held)), pa.int64())})

    return arrays.tidy(run)


def vocabulary(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, Seeds]:
    """(h, lang, word, n) with a distinct h for every word of a language, and the seeds that make them so."""

    seeds: Seeds = {}
    while True:
        found = store(
            docs.select("lang", "text").mapInArrow(_counted(bits, dict(seeds)), "h long, lang string, word string, n long")
            .groupBy("h", "lang", "word").agg(F.sum("n").alias("n")))
        # Words whose numbers clash: with 64 bits about one for 10^19 pairs of words, so they are few on any data.
        # All but the first of each get another seed.
        clash = found.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct("lang", "word")).alias("one")).where("m > 1")
        more = found.join(clash, "h").where(F.struct("lang", "word") != F.col("one")).select("lang", "word").collect()
        if not more:
            return found, seeds
        for lang, word in more:
            key = (lang.encode(), word.encode())
            seeds[key] = seeds.get(key, 0) + 1


def _node_lot(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return arrays.joined(h1.view(np.uint64), h2.view(np.uint64))


def _dealt(bits: int, seeds: Seeds, buckets: int, hot: np.ndarray):
    """Edges of slices in blocks, one for each bucket: a node's edges share it, those of hot nodes do not."""

    def run(batches):
        for langs, texts in _slices(batches):
            codes, piece, held = _words(langs, texts)
            if not len(codes):
                continue
            h = np.array([END, *[identity(*x, bits, seeds) for x in held]], np.uint64).view(np.int64)
            size = len(h)
            follow = np.zeros((2, len(codes)), np.int64)
            for step in (1, 2):
                same = piece[step:] == piece[:-step]
                follow[step - 1, :-step][same] = codes[step:][same] + 1
            nodes, node = np.unique((codes + 1) * size + follow[0], return_inverse=True)
            edges, counts = np.unique(node * size + follow[1], return_counts=True)
            node, third = divmod(edges, size)
            first, second = divmod(nodes[node], size)
            lot = _node_lot(h[first], h[second])
            warm = np.isin(h, hot)
            split = warm[first] & warm[second]
            lot[split] = arrays.joined(lot[split], h[third[split]].view(np.uint64))
            bucket = (lot % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            stops = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            blocks = []
            for start, stop in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True):
                own = order[start:stop]
                used, at = np.unique(np.concatenate([first[own], second[own], third[own]]), return_inverse=True)
                kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
                blocks.append((
                    int(bucket[start]), h[used].tobytes(), at.astype(kind).tobytes(), counts[own].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)],
                ["bucket", "words", "edges", "counts"])

    return arrays.tidy(run)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""

    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _merged(hot: np.ndarray, least: int):
    """Edges of a bucket with their weights; the flow out of its nodes; the flow of their first words."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for words, edges, counts in zip(*(table[c].to_pylist() for c in ("words", "edges", "counts")), strict=True):
            n = np.frombuffer(counts, np.uint32)
            kind = np.uint16 if len(edges) == 6 * len(n) else np.uint32
            parts.append((np.frombuffer(words, np.int64)[np.frombuffer(edges, kind).reshape(3, -1)], n.astype(np.int64)))
        (a, b, c), n = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        del parts
        order = np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        at = _runs(a, b, c)
        a, b, c, n = a[at], b[at], c[at], np.add.reduceat(n, at)
        often = (n >= least) & (c != END)
        node = _runs(a, b)
        x, y, flow = a[node], b[node], np.add.reduceat(n, node)
        # A hot node's flow comes from several buckets.
        some = ((flow >= least) | (np.isin(x, hot) & np.isin(y, hot))) & (y != END)
        word = _runs(a)
        none = np.zeros(max(len(some), len(word)), np.int64)
        made = ((3, a[often], b[often], c[often], n[often]), (2, x[some], y[some], none[:some.sum()], flow[some]),
                (1, a[word], none[:len(word)], none[:len(word)], np.add.reduceat(n, word)))
        columns = [np.concatenate([m[i] for m in made]) for i in range(1, 5)]
        kinds = np.repeat([3, 2, 1], [len(m[1]) for m in made])
        return pa.table([pa.array(kinds, pa.int32()), *columns], ["kind", "h1", "h2", "h3", "n"])

    return arrays.tidy(run)


def graph(docs: DataFrame, words: DataFrame, seeds: Seeds, least: int, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (h1, h2, h3, n), nodes (h1, h2, n) and words (h, n), each of at least ``least`` occurrences."""

    size, total = docs.select(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0, words.select(F.sum("n")).head()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    hot = words.where(F.col("n") * min(buckets, HOT_WORDS) > total).select("h").limit(HOT_WORDS).collect()
    hot = np.array([r[0] for r in hot], np.int64)
    found = store(
        docs.select("lang", "text").mapInArrow(
            _dealt(bits, seeds, buckets, hot), "bucket int, words binary, edges binary, counts binary")
        .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merged(hot, least), "kind int, h1 long, h2 long, h3 long, n long"), ["kind"])
    edges = found.where("kind = 3").select("h1", "h2", "h3", "n")
    nodes = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    flows = found.where("kind = 1").groupBy(F.col("h1").alias("h")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return edges, store(nodes), store(flows)


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, words): paths of edges through nodes that have no other flow; an edge without such nodes is one."""

    edges = store(edges.withColumn("id", F.monotonically_increasing_id()))
    comes = edges.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "n", F.col("id").alias("before"))
    leaves = edges.select("h1", "h2", "n", "id")
    links = nodes.join(comes, ["h1", "h2", "n"]).join(leaves, ["h1", "h2", "n"]).select("id", "before")
    # Every edge that follows another points to one before it; the pointers double their steps.
    at = store(edges.select("id").join(links, "id", "left").select(
        "id", F.coalesce("before", "id").alias("up"), F.col("before").isNotNull().cast("long").alias("place")))
    while True:
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        step = store(at.join(above, "up").select(
            "id", F.col("next").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")))
        at = step.drop("moved")
        if not step.where("moved").head(1):
            break
    parts = F.array_sort(F.collect_list(F.struct("place", "h1", "h2", "h3")))
    return store(
        edges.join(at, "id").groupBy("up").agg(F.first("n").alias("n"), parts.alias("parts"))
        .select("n", F.concat(
            F.array(F.col("parts")[0]["h1"], F.col("parts")[0]["h2"]),
            F.transform("parts", lambda p: p["h3"])).alias("words")))


def _score(a: str, left: Column, right: Column) -> Column:
    whole = [c.cast("decimal(38,0)") for c in (F.col(a), left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * whole[0] * whole[0], whole[1] * whole[2])


def candidates(paths: DataFrame, nodes: DataFrame, flows: DataFrame, least: int, cover: int) -> DataFrame:
    """(h1, h2, h3, a, l, r, score) of phrases of 2 and 3 words that no longer phrase covers."""

    last = F.size("words")
    ends = [
        nodes.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("n").alias(f"{side}_n")) for side in "xy"]
    ended = store(paths.select(
        "n", "words", F.col("words")[0].alias("x1"), F.col("words")[1].alias("x2"),
        F.element_at("words", -2).alias("y1"), F.element_at("words", -1).alias("y2"))
        .join(ends[0], ["x1", "x2"]).join(ends[1], ["y1", "y2"]))
    # The nodes inside a path have its weight and lie in its edges.
    triples = ended.select(F.posexplode(F.sequence(F.lit(1), last - 2)).alias("i", "j"), "n", "words", "x_n", "y_n").select(
        *[F.get("words", F.col("i") + k).alias(f"h{k + 1}") for k in range(3)], F.col("n").alias("a"),
        F.when(F.col("i") == 0, F.col("x_n")).otherwise(F.col("n")).alias("front"),
        F.when(F.col("i") == last - 3, F.col("y_n")).otherwise(F.col("n")).alias("back"))
    word = [flows.select(F.col("h").alias(f"h{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2, 3)]
    triples = triples.join(word[0], "h1").join(word[2], "h3")
    early, late = _score("a", F.col("n1"), F.col("back")), _score("a", F.col("front"), F.col("n3"))
    triples = triples.withColumns({"early": early, "late": late}).select(
        "h1", "h2", "h3", "a", F.when(F.col("late") < F.col("early"), F.col("front")).otherwise(F.col("n1")).alias("l"),
        F.when(F.col("late") < F.col("early"), F.col("n3")).otherwise(F.col("back")).alias("r"),
        F.least("early", "late").alias("score"))
    inside = paths.where(last > 3).select(F.explode(F.sequence(F.lit(1), last - 3)).alias("i"), "words").select(
        F.get("words", F.col("i")).alias("h1"), F.get("words", F.col("i") + 1).alias("h2"))
    longer = ended.select(F.explode(F.array(
        F.struct(F.col("x1").alias("h1"), F.col("x2").alias("h2"), "n"),
        F.struct(F.col("y1").alias("h1"), F.col("y2").alias("h2"), "n"))).alias("e")).select("e.*")
    longer = longer.groupBy("h1", "h2").agg(F.max("n").alias("longer"))
    pairs = (
        nodes.join(inside, ["h1", "h2"], "left_anti").join(longer, ["h1", "h2"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("n")))
        .select("h1", "h2", F.lit(None).cast("long").alias("h3"), F.col("n").alias("a"))
        .join(word[0], "h1").join(word[1], "h2"))
    pairs = pairs.select(
        "h1", "h2", "h3", "a", F.col("n1").alias("l"), F.col("n2").alias("r"), _score("a", F.col("n1"), F.col("n2")).alias("score"))
    return store(pairs.unionByName(triples))


def collocations(docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of every language.

    Phrases have 2 or 3 words and at least ``least`` occurrences; one goes if a longer phrase that holds it
    has ``cover`` hundredths of its occurrences.  The score is that of the worse of two cuts.
    """

    words, seeds = vocabulary(docs, bits)
    edges, nodes, flows = graph(docs, words, seeds, least, bits)
    found = candidates(compact(edges, nodes), nodes, flows, least, cover)
    names = words.where(F.col("n") >= least).select("h", "lang", "word")
    for k in (1, 2, 3):
        name = names.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"t{k}"), *["lang"][:k == 1])
        found = found.join(name, f"h{k}", "left" if k == 3 else "inner")
    found = found.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each lot of a language, then the best of these.
    found = found.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    for keys in (["lang", "lot"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
