import random
import re
from collections import Counter, defaultdict

import numpy as np

from repograph.llm import phrases

SCHEMA = "doc_id long, lang string, text string, phrase string, h1 long, n long"


def brute(rows, least, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        many = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in many.items():
            longer = [b for o, b in many.items() if len(o) > len(g) and any(o[i:i + len(g)] == g for i in range(len(o) - len(g) + 1))]
            if any(100 * b >= cover * a for b in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mine(spark, rows, **options):
    df = spark.createDataFrame([(i, lang, text, "x", 1, 2) for i, (lang, text) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


def corpus(seed, n):
    pick = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "é", "ŒUF", "word", "x y", "zz", "0"]
    set_phrases = ["one two three four five six seven eight", "red green blue", "a b a b a b", "ONE two", "the the the"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(pick.randint(0, 12)):
            parts.append(pick.choice(set_phrases) if pick.random() < 0.4 else " ".join(pick.choices(vocabulary, k=pick.randint(1, 7))))
            parts.append(pick.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "!?", "\v", "\f "]))
        rows.append((pick.choice(["en", "de", None, "und", "", "en"]), "".join(parts)))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " .\n"), *[("en", "same row again twice over")] * 12]


def test_all_phrases_as_counted_one_by_one(spark):
    rows = corpus(1, 120)
    assert mine(spark, rows) == brute(rows, 10, 50, 2000)
    assert mine(spark, rows, least=2, cover=90, top=7) == brute(rows, 2, 90, 7)


def test_many_buckets_hot_words_and_clashing_numbers(spark, monkeypatch):
    rows = corpus(2, 80)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 64)
    # Words in a few bits clash and get other seeds until all differ.
    assert mine(spark, rows, least=3, bits=8) == brute(rows, 3, 50, 2000)


def test_a_long_path_is_compacted(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [("en", " ".join(words))] * 4 + [("en", " ".join(words[100:103]) + " other")]
    df = spark.createDataFrame(rows, "lang string, text string")
    found, seeds = phrases.vocabulary(df)
    edges, nodes, _ = phrases.graph(df, found, seeds, 2)
    paths = phrases.compact(edges, nodes).collect()
    name = {r.h: r.word for r in found.collect()}
    assert sorted((r.n, [name[h] for h in r.words]) for r in paths) == sorted(
        [(4, words[:102]), (5, words[100:103]), (4, words[101:])])


def test_empty_tables(spark):
    assert mine(spark, []) == []
    assert mine(spark, [("en", None), ("en", "one"), (None, "...")]) == []


def test_pieces_do_not_run_over_slices_and_rows():
    import pyarrow as pa

    codes, piece, held = phrases._words(pa.array([b"en", b"en", b"de"]), pa.array([b"A b", b"", b"a,b"]))
    assert [held[c] for c in codes] == [(b"en", b"a"), (b"en", b"b"), (b"de", b"a"), (b"de", b"b")]
    assert np.diff(piece).tolist() == [0, 1, 1]
