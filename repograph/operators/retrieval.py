"""TF-IDF ranking of cards for a batch of questions, with metadata filters.

``docs`` has (document_id, content) and, when given, the corpus ``keys``; ``questions`` has
(question_id, question) and the same keys.  Each corpus has its own document frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repograph.functions import text
from repograph.session import cut

# Ranks compare rounded scores, so exact copies tie whatever the order of summation was.
RANK_DIGITS = 9
# Words that hold at least one in so many of all terms; so there are no more of them, and they are sent to all tasks.
HOT_TOKENS = 50_000
# Bytes of texts that are cut into words at once.
SLICE_BYTES = 4 << 20
# Weights of questions and best rows that a task holds at once, and documents, scores and products of weights
# that are worked on at once.
ASKED_ROWS, HELD_ROWS, SCORED_DOCS, CELLS = 1 << 20, 1 << 18, 512, 1 << 20


def _runs(words: Column) -> Column:
    """(token, amount) of each distinct word in a sorted array."""

    size = F.size(words)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(size))
    return F.when(
        size > 0,
        F.zip_with(
            starts, ends,
            lambda a, b: F.struct(F.get(words, a).alias("token"), (b - a).alias("amount")),
        ),
    )


def token_counts(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, total, token, amount) of every row, counted inside the row without a shuffle."""

    words = df.select(*keys, F.sort_array(text.token_bag(F.col(content))).alias("words"))
    return words.select(
        *keys, F.size("words").alias("total"), F.inline(_runs(F.col("words"))).alias("token", "amount")
    )


_WORD, _DIGIT, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_DIGIT[48:58] = True
_LOWER[65:91] += 32


def _cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of every word of :func:`text.token_bag`, and the distinct words."""

    word = _WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    filled = np.diff(offsets) > 0
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    # A word begins at the first byte of a run that is no digit.
    letters = np.append(np.flatnonzero(word & ~_DIGIT[data]), len(data))
    starts = letters[np.searchsorted(letters, starts)]
    starts, stops = starts[starts < stops], stops[starts < stops]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops] -= 1
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(np.append(0, np.cumsum(stops - starts))),
        pa.py_buffer(_LOWER[data[np.cumsum(inside[:-1], dtype=np.int8) > 0]])]).dictionary_encode()
    codes, row = found.indices.to_numpy().astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1
    names = found.dictionary.to_pylist()
    number = {name: i for i, name in enumerate(names)}
    many, parts = np.zeros(len(names), np.int64), []
    for i, name in enumerate(names):
        if "_" in name:
            own = [p for p in name.split("_") if p and p != name]
            many[i] = len(own)
            parts += [number.setdefault(p, len(number)) for p in own]
    if parts:
        first = np.cumsum(many) - many
        each = many[codes]
        ends = np.cumsum(each)
        at = np.arange(ends[-1]) + np.repeat(first[codes] - ends + each, each)
        row, codes = np.append(row, np.repeat(row, each)), np.append(codes, np.array(parts, np.int64)[at])
    return row, codes, pa.array(number, pa.string())


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of whole texts, counted, in slices of about ``SLICE_BYTES``."""

    for batch in batches:
        texts = pc.fill_null(batch.column("content").cast(pa.large_binary()), b"")
        _, at, held = texts.buffers()
        offsets = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
            stop = min(max(stop, start + 1), len(texts))
            row, codes, names = _cut_words(data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
            total = np.bincount(row, minlength=stop - start)
            pairs, amounts = np.unique(row * max(1, len(names)) + codes, return_counts=True)
            row, codes = divmod(pairs, max(1, len(names)))
            terms = pa.StructArray.from_arrays([names.take(pa.array(codes)), pa.array(amounts, pa.int32())], ["token", "amount"])
            lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(stop - start + 1)).astype(np.int32), terms)
            kept = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(total, pa.int32()), lists], [*batch.schema.names[:-1], "total", "terms"])
            start = stop


def document_terms(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, document_id, total, terms) of every document; a term is (token, amount)."""

    held = docs.select(*keys, "document_id", F.col("content").cast("string").alias("content"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    return held.mapInArrow(_term_rows, f"{kinds}, total int, terms array<struct<token:string,amount:int>>")


def inverse_frequencies(counts: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 of each token of a corpus."""

    found = counts.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("df"))
    sizes = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = found.join(sizes, keys) if keys else found.crossJoin(F.broadcast(sizes))
    return joined.select(
        *keys, "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )


def tfidf_scores(docs: DataFrame, questions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, question_id, document_id, score) of every pair with a positive cosine.

    The token counts are written once, as three passes read them, and so are the frequencies
    and query weights: while those are small the planner broadcasts them and the long token
    table is never shuffled; beyond that they are joined.
    """

    keys = keys or []
    counts = cut(token_counts(docs, keys + ["document_id"], "content"))
    idf = cut(inverse_frequencies(counts, docs, keys))
    asked = (
        token_counts(questions, keys + ["question_id"], "question")
        .join(idf, keys + ["token"])
        .select(*keys, "question_id", "token",
                (F.col("amount") / F.col("total") * F.col("idf")).alias("weight"))
    )
    norms = asked.groupBy(*keys, "question_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("question_norm")
    )
    asked = cut(asked.join(norms, keys + ["question_id"]))
    weighted = counts.join(idf, keys + ["token"]).select(
        *keys, "document_id", "token",
        (F.col("amount") / F.col("total") * F.col("idf")).alias("weight"),
    )
    dots = (
        weighted.join(asked.withColumnRenamed("weight", "asked"), keys + ["token"])
        .groupBy(*keys, "question_id", "document_id")
        .agg(
            F.sum(F.col("weight") * F.col("asked")).alias("dot"),
            F.first("question_norm").alias("question_norm"),
        )
    )
    doc_norms = weighted.groupBy(*keys, "document_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("doc_norm")
    )
    return dots.join(doc_norms, keys + ["document_id"]).select(
        *keys, "question_id", "document_id",
        (F.col("dot") / (F.col("question_norm") * F.col("doc_norm"))).alias("score"),
    ).where(F.col("score") > 0)


def top_ranked(scores: DataFrame, limit: Column | int, keys: list[str] | None = None) -> DataFrame:
    """The best rows per question, ties by document id."""

    order = Window.partitionBy(*(keys or []), "question_id").orderBy(
        F.desc(F.round("score", RANK_DIGITS)), "document_id"
    )
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each question, in the order of :func:`top_ranked`."""

    order = rows.assign(place=-rows["score"].round(RANK_DIGITS)).sort_values(["question", "place", "document_id"])
    return order.groupby("question", sort=False).head(k).drop(columns="place")


def _asked_terms(known: pa.Array):
    """The terms of whole documents that questions ask for, by the number of their word."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            rows = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
            flat = terms.flatten()
            place = pc.index_in(flat.field("token"), value_set=known)
            found = place.is_valid()
            ends = np.searchsorted(rows[found.to_numpy(zero_copy_only=False)], np.arange(len(batch) + 1))
            held = pa.StructArray.from_arrays(
                [place.filter(found), flat.field("amount").filter(found)], ["token", "amount"])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], batch.schema.names)

    return keep


def _score_documents(asked: pa.Table, k: int, numbered: bool = False):
    """Cosines of whole documents with all asked questions; each task passes on its k best.

    The questions' weights are kept as postings of each token, and documents are scored in slices of at most
    ``CELLS`` scores and about as many products, so memory follows the block's rows and never tokens x questions.
    ``numbered`` terms hold the numbers that :func:`_asked_terms` gives to the words of this ``asked``.
    """

    tokens, ids = (asked[c].combine_chunks().dictionary_encode() for c in ("token", "question_id"))
    known, questions = tokens.dictionary, ids.dictionary
    token_no = tokens.indices.to_numpy()
    order = np.argsort(token_no, kind="stable")
    begin = np.searchsorted(token_no[order], np.arange(len(known) + 1))
    many = np.diff(begin)
    question_no = ids.indices.to_numpy()[order]
    # A document's weight of a token is its share times the token's idf.
    weights = (asked["weight"].to_numpy() * asked["idf"].to_numpy())[order]
    n = len(questions)
    most = max(1, min(SCORED_DOCS, CELLS // n))

    def scored(rows: np.ndarray, place: np.ndarray, share: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
        """(document, question, score) of the likely best of so many documents, given by their terms."""

        each = many[place]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[place] - ends + each, each)
        scores = np.bincount(
            np.repeat(rows, each) * n + question_no[at], np.repeat(share, each) * weights[at], docs * n).reshape(docs, n)
        limit = max(docs - k, 0)
        least = np.partition(scores, limit, axis=0)[limit] - 10.0**-RANK_DIGITS
        doc, question = np.nonzero((scores > 0) & (scores >= least))
        return doc, question, scores[doc, question]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_DOCS):
                part = batch.slice(start, SCORED_DOCS)
                terms = part.column("terms")
                rows = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
                flat = terms.flatten()
                place = flat.field("token") if numbered else pc.index_in(flat.field("token"), value_set=known)
                found = place.is_valid().to_numpy(zero_copy_only=False)
                total, norm = (part.column(c).to_numpy() for c in ("total", "doc_norm"))
                amount = flat.field("amount").to_numpy()[found]
                rows, place = rows[found], place.drop_null().to_numpy()
                share = amount / total[rows] / norm[rows]
                names = part.column("document_id").to_numpy(zero_copy_only=False)
                first_term = np.searchsorted(rows, np.arange(len(part) + 1))
                products = np.append(0, np.cumsum(many[place]))[first_term]
                first = 0
                while first < len(part):
                    last = int(np.searchsorted(products, products[first] + CELLS, side="right")) - 1
                    last = min(max(last, first + 1), first + most, len(part))
                    own = slice(first_term[first], first_term[last])
                    doc, question, value = scored(rows[own] - first, place[own], share[own], last - first)
                    held.append(pd.DataFrame({"question": question, "document_id": names[first + doc], "score": value}))
                    first = last
                    if sum(map(len, held)) > 2 * HELD_ROWS:
                        held = [_best(pd.concat(held), k)]
        if held:
            best = _best(pd.concat(held), k)
            best.insert(0, "question_id", questions.take(pa.array(best.pop("question").to_numpy())).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return score


@dataclass
class RankIndex:
    """A stored corpus: documents with their terms and norms, and the frequencies of words; each corpus of ``keys`` has its own."""

    keys: list[str]
    rows: DataFrame
    frequencies: DataFrame
    norms: DataFrame


def _indexed(rows: DataFrame, keys: list[str]) -> RankIndex:
    """The index of term rows.  Norms add up where the terms lie for hot words; only the others meet their frequencies by a join."""

    name = [*keys, "document_id"]
    counts = rows.select(*name, "total", F.inline("terms").alias("token", "amount"))
    idf = cut(inverse_frequencies(counts.select(*keys, "token"), rows, keys))
    terms = idf.agg(F.sum("df")).head()[0] or 0
    hot = idf.where(F.col("df") * HOT_TOKENS >= terms).select(*keys, "token", F.col("idf").alias("hot"))
    split = counts.join(F.broadcast(hot), [*keys, "token"], "left")
    square = lambda idf_: F.pow(F.col("amount") / F.col("total") * F.col(idf_), 2)
    near = split.where("hot IS NOT NULL").groupBy(*name).agg(F.sum(square("hot")).alias("part"))
    far = split.where("hot IS NULL").join(idf, [*keys, "token"]).groupBy(*name).agg(F.sum(square("idf")).alias("part"))
    norms = near.unionByName(far).groupBy(*name).agg(F.sqrt(F.sum("part")).alias("doc_norm"))
    return RankIndex(keys, rows, idf, norms)


def build_index(docs: DataFrame, keys: list[str] | None = None) -> RankIndex:
    return _indexed(cut(document_terms(docs, keys or [])), keys or [])


def update_index(index: RankIndex, changed: DataFrame, removed: DataFrame | None = None) -> RankIndex:
    """The index of the next revision: only ``changed`` documents, new ones included, are cut into words.

    ``removed`` has (keys, document_id).  Frequencies and norms are summed anew from the stored terms, as every
    norm depends on the number of documents.
    """

    name = [*index.keys, "document_id"]
    gone = changed.select(*name) if removed is None else changed.select(*name).unionByName(removed.select(*name))
    kept = index.rows.join(gone, name, "left_anti")
    return _indexed(cut(kept.unionByName(document_terms(changed, index.keys))), index.keys)


#: Between a corpus and a word or question of it.
WITHIN = "\x1f"


def search_index(index: RankIndex, questions: DataFrame, k: int) -> DataFrame:
    """The k best documents of each question of its corpus.

    A document's words stay in one row, so all of its scores are complete in its task, and only
    the k best of each task and question are shuffled.  The weights of the questions' own words
    go to the tasks in blocks of about ``ASKED_ROWS`` rows, and of so many questions that their k best are about
    ``HELD_ROWS``; of several blocks, each is done before the driver reads the next.
    """

    keys = index.keys
    corpus = F.concat_ws(WITHIN, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]) if keys else F.lit("")
    within = (lambda c: F.concat(corpus, F.lit(WITHIN), F.col(c).cast("string"))) if keys else F.col
    asked = token_counts(questions, [*keys, "question_id"], "question").join(index.frequencies, [*keys, "token"]).select(
        *keys, "question_id", "token", "idf", (F.col("amount") / F.col("total") * F.col("idf")).alias("weight"))
    norms = asked.groupBy(*keys, "question_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    asked = cut(asked.join(norms, [*keys, "question_id"]).select(
        *keys, "question_id", within("question_id").alias("asked_by"), within("token").alias("token"), "idf",
        (F.col("weight") / F.col("norm")).alias("weight")))
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("asked_by").alias("questions")).head()
    blocks = 1 + max(size["rows"] // ASKED_ROWS, size["questions"] * k // HELD_ROWS)
    block = F.pmod(F.xxhash64("asked_by"), F.lit(blocks))
    def words(terms: DataFrame) -> DataFrame:
        return terms if not keys else terms.withColumn("terms", F.transform(
            "terms", lambda t: F.struct(F.concat(corpus, F.lit(WITHIN), t["token"]).alias("token"), t["amount"].alias("amount"))))

    name = [*keys, "document_id"]
    held = words(index.rows.select(*name, "total", "terms"))
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *held.schema.fields]}
    schema = f"question_id {kinds['asked_by']}, document_id {kinds['document_id']}, score double"
    read = lambda rows: rows.select(F.col("asked_by").alias("question_id"), "token", "idf", "weight").toArrow()
    columns = ["document_id", "total", "terms", "doc_norm"]
    found = None
    if blocks == 1:
        part = read(asked)
        if len(part):
            # Terms meet their norms by a shuffle, so only those that some question asks for go there, as numbers.
            known = part["token"].combine_chunks().dictionary_encode().dictionary
            form = ", ".join(f"`{c}` {kinds[c]}" for c in [*name, "total"]) + ", terms array<struct<token:int,amount:int>>"
            asked_of = held.mapInArrow(_asked_terms(known), form).where(F.size("terms") > 0)
            found = asked_of.join(index.norms, name).select(*columns).mapInArrow(_score_documents(part, k, True), schema)
    else:
        normed = cut(held.join(index.norms, name).select(*columns))
        for number in range(blocks):
            part = read(asked.where(block == number))
            if len(part):
                scored = cut(normed.mapInArrow(_score_documents(part, k), schema))
                found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = asked.select(F.col("asked_by").alias("question_id")).join(
            held.select("document_id"), F.lit(False)).withColumn("score", F.lit(0.0))
    best = top_ranked(found, k)
    if not keys:
        return best
    named = questions.select(*keys, "question_id", within("question_id").alias("asked_by")).distinct()
    return best.withColumnRenamed("question_id", "asked_by").join(named, "asked_by").select(
        *keys, "question_id", "document_id", "score", "rank")


def tfidf_top(docs: DataFrame, questions: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k best documents of each question, by an index that is built for the call."""

    return search_index(build_index(docs, keys), questions, k)


def tfidf_search(
    docs: DataFrame, questions: DataFrame, k: int = 10, keys: list[str] | None = None
) -> DataFrame:
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    return tfidf_top(docs, questions, k, keys)


def card_filter(
    cards: DataFrame,
    repository_id: str | None = None,
    revision_id: str | None = None,
    qualities: list[str] | None = None,
    kinds: list[str] | None = None,
    entry_points_only: bool = False,
    is_test: bool | None = None,
) -> DataFrame:
    """Metadata filters in front of ranking; they reach the scan of the card table."""

    kept = cards
    if repository_id is not None:
        kept = kept.where(F.col("repository_id") == repository_id)
    if revision_id is not None and revision_id != "current":
        kept = kept.where(F.col("revision_id") == revision_id)
    if qualities:
        kept = kept.where(F.col("relation_quality").isin(*qualities))
    if kinds:
        kept = kept.where(F.col("entity_kind").isin(*kinds))
    if entry_points_only:
        kept = kept.where(F.col("is_entry_point"))
    if is_test is not None:
        kept = kept.where(F.col("is_test") == is_test)
    return kept


def _chunks(cards: DataFrame, ranked: DataFrame) -> DataFrame:
    """Cards of ranked rows.  Content joins only here, for at most k rows per question."""

    # Written first, so the planner knows how few rows they are and leaves the contents in place.
    best = cut(ranked.select("question_id", "rank", "score", F.col("document_id").alias("source_id")))
    return best.join(cards, "source_id")


def rank_cards(cards: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    docs = cards.select(F.col("source_id").alias("document_id"), "content")
    return tfidf_top(docs, questions, k)


def retrieve(
    cards: DataFrame,
    questions: DataFrame,
    max_results: int = 8,
    tests: str = "last",
    **filters,
) -> DataFrame:
    """Ranked chunks per question.

    ``last`` puts a short tail of test cards behind the other cards, each list ranked on its
    own; ``mixed`` ranks all cards together; ``only`` ranks test cards.
    """

    if tests not in ("last", "mixed", "only"):
        raise ValueError("tests must be last, mixed or only")
    if not 1 <= max_results <= 50:
        raise ValueError("max_results must be between 1 and 50")
    allowed = card_filter(cards, **filters)
    if tests == "mixed":
        return _chunks(allowed, rank_cards(allowed, questions, max_results))
    if tests == "only":
        chosen = allowed.where("is_test")
        return _chunks(chosen, rank_cards(chosen, questions, max_results))
    first = rank_cards(allowed.where(~F.col("is_test")), questions, max_results)
    tail = rank_cards(allowed.where("is_test"), questions, max(1, max_results // 4))
    merged = merge_ranked(first, tail, "document_id")
    return _chunks(allowed, merged)


def merge_ranked(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two ranked lists per question as one: the first list in front, the first copy wins.

    Rows with a blank key are never taken for copies.
    """

    both = first.withColumn("list_no", F.lit(1)).unionByName(second.withColumn("list_no", F.lit(2)))
    kept = dedupe_ranked(both, key, ["list_no", "rank"])
    order = Window.partitionBy("question_id").orderBy("list_no", "rank")
    return kept.withColumn("rank", F.row_number().over(order)).drop("list_no")


def dedupe_ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row per question and key; rows with a blank key all stay."""

    blank = F.coalesce(F.col(key), F.lit("")) == ""
    columns = df.columns
    first = (
        df.where(~blank)
        .groupBy("question_id", key)
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
        .select("row.*")
    )
    return first.unionByName(df.where(blank))


def list_entry_points(cards: DataFrame, limit: int = 20) -> DataFrame:
    """Cards that start the system: at most ``limit`` distinct nodes per revision."""

    keys = ["repository_id", "revision_id"]
    rows = (
        cards.where(F.col("is_entry_point") & (F.coalesce("node_id", F.lit("")) != ""))
        .groupBy(*keys, "node_id")
        .agg(F.min(F.struct("source_id", "qualified_name", "path", "span", "entity_kind")).alias("c"))
        .select(*keys, "node_id", "c.*")
    )
    order = Window.partitionBy(*keys).orderBy("path", "node_id")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def retrieval_plan(mode: str, depth: str, question: str | None) -> dict:
    """Filters by which one view mode asks for its records."""

    asked = (question or "").strip()
    # The kinds that make up each depth.
    structure = {
        "package": ["REPOSITORY", "PACKAGE", "FILE"],
        "file": ["PACKAGE", "FILE"],
        "symbol": ["CLASS", "FUNCTION", "METHOD", "INTERFACE", "TYPE", "ROUTE", "ENTRYPOINT"],
    }
    plan = {"question": asked or "repository", "kinds": [], "strict_kinds": False,
            "query_by": "hybrid", "speed": "thinking", "tests": "last"}
    if mode == "compare":
        plan.update(question=asked or "repository change events", kinds=["CHANGE_EVENT"],
                    strict_kinds=True, tests="mixed")
    elif mode == "preserve":
        plan.update(question=asked or "saved system lens", kinds=["SYSTEM_LENS"],
                    strict_kinds=True, tests="mixed")
    elif mode == "repository" and not asked:
        plan.update(kinds=structure[depth], query_by="text", speed="fast")
    elif mode == "explore" and asked:
        plan.update(query_by="text")
    return plan
