"""Words of the doubling kind, for which polynomial hashes modulo 2**64 collide whatever the base."""

import random

import numpy as np
import public_tokenizers
from tests.llm import test_near_dup, test_packing, test_repeats

from repograph.llm import arrays, decontamination, packing

HALVES = ["a", "b"]
for _ in range(11):
    HALVES = [HALVES[0] + HALVES[1], HALVES[1] + HALVES[0]]
ONE, OTHER = HALVES


def test_equal_hashes_mean_equal_strings():
    pick = random.Random(3)
    strings = ["", "a", "ab", "a\0", "a\0\0", "\0", "12345678", "123456789", ONE, OTHER, ONE[:64], OTHER[:64], ONE[:65], OTHER[:65]]
    strings += ["".join(pick.choices("ab", k=pick.randint(1, 90))) for _ in range(3000)]
    strings += strings[:500]
    data = "".join(strings).encode()
    ends = np.cumsum([len(s) for s in strings])
    found = arrays.string_hashes(np.frombuffer(data, np.uint8), np.append(0, ends[:-1]), ends)
    assert len(dict(zip(strings, found.tolist(), strict=True))) == len(set(strings)) == len(set(found.tolist()))
    assert all(a == b for a, b in zip(found[:500], found[-500:], strict=True))
    # The strings do collide where sums of powers are hashed.
    both = np.frombuffer((ONE + OTHER).encode(), np.uint8)
    sums = arrays.range_hashes(arrays.prefix_sums(both), np.array([0, 2048]), np.array([2048, 4096]))
    assert sums[0] == sums[1]


def test_packing_gives_each_text_its_own_ids(spark):
    texts = [(1, ONE), (2, OTHER), (3, f"x {OTHER} {ONE}")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    test_packing.check(packing.pack(df, test_packing.PATH, 2048).collect(), texts, 2048)
    assert test_packing.PATH == public_tokenizers.path("byte_bpe_50k.json")


def test_unlike_texts_are_no_near_duplicates(spark):
    rows = [(1, ONE), (2, OTHER), (3, f"{ONE} {ONE} c"), (4, f"{OTHER} {OTHER} c"), (5, ONE)]
    assert test_near_dup.result(spark, rows, 2) == test_near_dup.brute(rows, 2)
    assert [r[2] for r in test_near_dup.result(spark, rows, 2)] == [1, 2, 3, 4, 1]


def test_decontamination_tells_words_apart(spark):
    filling = [f"w{i}" for i in range(6)]
    items = spark.createDataFrame([(1, " ".join([*filling, ONE, "end", ONE]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([ONE] * 9)), (2, " ".join([OTHER] * 9))], "doc_id long, text string")
    found = decontamination.find_leaks(docs.union(spark.createDataFrame(
        [(3, " ".join([*filling, ONE, "end", ONE]))], docs.schema)), items).select("doc_id").collect()
    assert {r.doc_id for r in found} == {3}


def test_repeats_of_doubling_strings(spark):
    rows = [(i, t, "b", 1, "s") for i, t in enumerate([ONE[:300], OTHER[:300], f"{OTHER} {ONE}", ONE])]
    assert test_repeats.result(spark, rows) == test_repeats.brute([r[:2] for r in rows], 50)


def test_repeated_rows_without_an_id_make_no_more_spans(spark):
    from repograph.llm import repeats

    text = "a passage that many rows without an id repeat, word by word, to the end"
    df = spark.createDataFrame([(1, text)] + [(None, f"x {text} y")] * 60, "doc_id long, text string")
    spans = repeats.repeated_spans(df).collect()
    assert len(spans) == 1 and len(spans[0].spans) <= len(text)
