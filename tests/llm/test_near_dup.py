import random
import re

from repograph.llm import near_dup


def brute(rows, size):
    """Components over all pairs of rows."""

    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
        sets.append(grams if len(words) >= size else {tuple(words)} if words else set())
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and a is not None and rows[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(a), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted(
        ((doc, len(s), None if doc is None else find(doc), doc is None or find(doc) == doc)
         for (doc, _), s in zip(rows, sets, strict=True)), key=repr)


def result(spark, rows, size):
    df = spark.createDataFrame(
        [(d, t, "b", 1, "x") for d, t in rows], "doc_id long, text string, band string, id int, component string")
    return sorted((tuple(r) for r in near_dup.near_duplicates(df, size).collect()), key=repr)


def edited(pick, words, share):
    return [pick.choice("abcdefgh") * 3 if pick.random() < share else w for w in words]


def corpus(seed, n):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choices("abcdef", k=pick.randint(1, 6))) for _ in range(300)]
    new = lambda: pick.choices(vocabulary, k=pick.choice([0, 1, 2, 3, 8, 40, 120]))
    base = pick.choices(vocabulary, k=150)
    texts = []
    for _ in range(n):
        kind = pick.random()
        if kind < 0.4 or not texts:
            texts.append(new())
        elif kind < 0.7:
            texts.append(edited(pick, base, pick.choice([0.01, 0.03, 0.06])))
        elif kind < 0.85:
            texts.append(list(pick.choice(texts)))
        else:
            texts.append(edited(pick, pick.choice(texts), 0.05))
    return [(i, " ".join(t).title() if i % 5 == 0 else "\n".join(t)) for i, t in enumerate(texts)]


def test_matches_all_pairs(spark):
    for size in (2, 5):
        rows = corpus(size, 260)
        assert result(spark, rows, size) == brute(rows, size)


def test_nulls_empty_ties_and_long(spark):
    long_text = "ab cd ef " * 200_000
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (2, "A B C"), (3, None), (4, ""), (5, " \n\t"), (6, None),
            (7, "one"), (8, "ONE"), (9, long_text), (10, long_text), (2, "A B C"), (11, "É"), (12, "é")]
    assert result(spark, rows, 2) == brute(rows, 2)


def test_rows_of_one_id_are_one_vertex(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "w x y z"), (3, "w x y z"), (9, "alone here")]
    assert [r[2] for r in result(spark, rows, 2)] == [1, 1, 1, 1, 9]


def test_empty_table(spark):
    assert result(spark, [], 2) == []
