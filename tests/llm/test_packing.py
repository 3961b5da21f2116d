import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repograph.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30)))
def test_plan_uses_every_piece_once(counts):
    used = defaultdict(int)
    total = 0
    for pattern, times in packing.plan_patterns(counts, 40):
        assert 0 < sum(length * n for length, n in pattern) <= 40 and times > 0
        total += times
        for length, n in pattern:
            used[length] += n * times
    assert dict(used) == counts
    held = sum(length * n for length, n in counts.items())
    assert total <= max(1, 2 * -(-held // 40))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 2)), st.lists(st.integers(1, 24), max_size=12))
def test_index_finds_a_complement_where_there_is_one(counts, gaps):
    index = packing.SumIndex(counts, 24)
    for gap in [*gaps, *range(1, 25)]:
        left = [length for length in range(1, 25) for _ in range(index.count[length])]
        exists = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(left, n))
        found = index.complement(gap)
        assert (found is not None) == exists
        if found:
            assert sum(found) == gap and index.times(found) > 0
            index.take(found, 1)


def least_sequences(pieces: list[int], capacity: int) -> int:
    """The fewest sequences, by trying all places."""

    best = len(pieces)

    def put(rest: list[int], bins: tuple[int, ...]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for gap in {b for b in bins if b >= rest[0]}:
            left = list(bins)
            left.remove(gap)
            put(rest[1:], (*left, gap - rest[0]))
        put(rest[1:], (*bins, capacity - rest[0]))

    put(sorted(pieces, reverse=True), ())
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_near_the_fewest_sequences(pieces):
    made = sum(n for _, n in packing.plan_patterns(dict(Counter(pieces)), 20))
    assert made <= least_sequences(pieces, 20) + 1


def test_exact_complements_leave_no_gap():
    patterns = packing.plan_patterns({7: 4, 3: 4, 6: 2, 2: 4, 1: 4, 5: 2, 10: 3}, 10)
    assert all(sum(length * n for length, n in p) == 10 for p, _ in patterns[:-1])


def test_many_random_lengths_are_nearly_full():
    pick = random.Random(5)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, int(pick.lognormvariate(6, 1)) + 1)] += 1
    sequences = sum(n for _, n in packing.plan_patterns(counts, 2048))
    assert sequences <= 1.001 * sum(a * b for a, b in counts.items()) / 2048 + 1


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        begin, piece = 0, 0
        while begin < len(ids):
            length = capacity if begin else (len(ids) - 1) % capacity + 1
            expected.append((doc, piece, begin, length, zlib.crc32(np.array(ids[begin:begin + length], "<u4").tobytes())))
            begin, piece = begin + length, piece + 1
    key = lambda r: (r[0] is None, *((r[0] or 0), *r[1:]))
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(expected, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def test_pieces_and_ids(spark):
    pick = random.Random(9)
    words = ["the", "naïve", "don't", "x1", "  two", "\n", " hard", " wide", "<|endoftext|>", "日本語", "é", "\t\t", "!!"]
    texts = [(i, " ".join(pick.choices(words, k=pick.choice([1, 3, 20, 90])))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, " "), (None, "no id"), (5, texts[5][1]), (5, texts[5][1]), (203, "x" * 30_000),
              (204, "long text " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, length long, part long")
    for capacity in (64, 2048):
        rows = packing.pack(df.repartition(5), PATH, capacity).collect()
        sequences = check(rows, texts, capacity)
        assert len(sequences) <= sum(r.length for r in rows) / capacity + 4


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_both_encoders_give_the_same_ids():
    tokenizer = Tokenizer.from_file(PATH)
    fast = tokens.fast_encoding(tokens.read_file(PATH))
    assert fast is not None
    pick = random.Random(1)
    letters = [*map(chr, range(9, 14)), *map(chr, range(32, 127)), "é", "ß", "ñ", "日", "́", "½", "'s", "'ll", "😀"]
    texts = ["".join(pick.choices(letters, k=pick.randint(1, 30))) for _ in range(20_000)]
    assert list(map(fast.encode_ordinary, texts)) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
