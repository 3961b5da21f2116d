import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repograph.llm import repeats


def brute(rows, length):
    """Every string of ``length`` bytes with the smallest id it starts in."""

    key = lambda d: repeats.LAST if d is None else d
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            first[s] = min(first.get(s, repeats.LAST), key(doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i:i + length]] < key(doc):
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows, length=50):
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, doc int, spans string")
    found = repeats.remove_repeats(df, length)
    return sorted((tuple(r) for r in found.select(
        "record.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def corpus(seed, n=120):
    pick = random.Random(seed)
    words = ["".join(pick.choices("abcdeéß", k=pick.randint(1, 5))) for _ in range(60)]
    sentence = lambda k: " ".join(pick.choices(words, k=k))
    line, passage = sentence(14), sentence(60)
    rows = []
    for doc in range(n):
        text = sentence(pick.choice([1, 5, 40, 150]))
        if doc % 3 == 0:
            text = f"{text}\n{line}\n{sentence(20)}"
        if doc % 7 == 0:
            text = f"{sentence(9)} {passage} {text}"
        if doc % 11 == 5:
            old = rows[pick.randrange(len(rows))][1].split(" ")
            old[pick.randrange(len(old))] = "edit"
            text = " ".join(old)
        if doc % 13 == 6:
            text = rows[pick.randrange(len(rows))][1]
        rows.append((doc, text))
    return rows


def padded(rows):
    return [(doc, text, "x", 1, "y") for doc, text in rows]


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert result(spark, padded(rows)) == brute(rows, 50)


def test_heavy_digits_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", 0.01)
    rows = corpus(2, 60)
    assert result(spark, padded(rows)) == brute(rows, 50)


def test_nulls_short_long_and_repeated_rows(spark):
    long_text = "".join(random.Random(3).choices("ab cd", k=1_200_000))
    rows = [(None, "x" * 80), (3, "x" * 70), (4, None), (5, ""), (6, "short"), (7, long_text),
            (7, long_text), (8, "é" * 40), (9, "aé" + "é" * 39), (9, "other text of the same id " * 4)]
    found = result(spark, padded(rows))
    small = [r for r in rows if r[1] != long_text]
    assert [r for r in found if r[0] != 7] == brute(small, 50)
    assert [r[:4] for r in found if r[0] == 7] == [(7, 1_200_000, 0, 0)] * 2


@pytest.mark.parametrize("task_bytes", [1, 1 << 30])
def test_partitions_follow_the_anchors(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(repeats, "TASK_BYTES", max(task_bytes, 1 << 13))
    rows = corpus(4, 60)
    assert result(spark, padded(rows)) == brute(rows, 50)


def test_windows_that_differ_in_any_pass():
    pick = random.Random(8)
    rows = [bytes(pick.choices(b"ab", k=20)) for _ in range(400)]
    rows += [bytes([*r[:i], 99, *r[i + 1:]]) for r, i in zip(rows, itertools.cycle(range(20)))]
    rows += rows[::7]
    doc = np.array([pick.randrange(50) for _ in rows])
    held = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 20)
    for first, length in ((0, 20), (3, 9), (2, 8), (5, 3)):
        least = {}
        for r, d in zip(rows, doc):
            key = r[first:first + length]
            least[key] = min(least.get(key, d), d)
        wanted = [i for i, r in enumerate(rows) if doc[i] > least[r[first:first + length]]]
        found = repeats._later_windows(held, doc, np.arange(len(rows)), first, length)
        assert sorted(found.tolist()) == wanted


def test_empty_table(spark):
    assert result(spark, []) == []


def test_text_stays_text(spark):
    df = spark.createDataFrame([(1, "é" * 40), (2, "aé" + "é" * 39)], "doc_id long, text string")
    texts = repeats.remove_repeats(df, 51).select(F.col("record.text")).collect()
    assert {t[0] for t in texts} <= {"é" * 40, "a", "aé", ""}
