import hashlib
import random
from collections import defaultdict

import numpy as np

from repograph.llm import lines

SCHEMA = "key string, doc_id long, text string, twin long, dropped array<string>"
BLANK = " \t\n\v\f\r"


def key_of(line, least=20):
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    return key if len(key) >= least else None


def brute(rows, documents=3, least=20):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and key_of(line, least):
                holders[key_of(line, least)].add(doc)
    shared = {k: max(d) for k, d in holders.items() if len(d) >= documents}
    out = []
    for doc, text in rows:
        held = (text or "").split("\n")
        left = [x for x in held if doc is None or shared.get(key_of(x, least), doc) == doc]
        out.append((doc, len(held), len(held) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def drop(spark, rows, **options):
    df = spark.createDataFrame([("k", d, t, 5, ["z"]) for d, t in rows], SCHEMA).repartition(3)
    found = lines.drop_repeated_lines(df, **options).collect()
    assert all(r.record.key == "k" and r.record.twin == 5 and r.record.dropped == ["z"] for r in found)
    for r in found:
        if r.n_dropped:
            assert hashlib.sha256(r.record.text.encode()).hexdigest() == r.kept_sha256
    return sorted(((r.record.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found), key=repr)


def corpus(seed, n):
    pick = random.Random(seed)
    known = [f"A line that comes again, number {i}" for i in range(30)] + [
        "é" * 19, "é" * 20, "x" * 19, "Y" * 20, "  padded line of some length\t", "padded line of SOME length", "", " " * 30]
    rows = []
    for i in range(n):
        held = [pick.choice(known) if pick.random() < 0.5 else f"a line of its own {pick.random()}" for _ in range(pick.randint(0, 6))]
        rows.append((i * 7, "\n".join(held)))
    rows += [(i, "the most common line of them all\nown line of document number %d" % i) for i in range(1000, 1100)]
    rows += [(None, "the most common line of them all"), (None, None), (3, None), (4, ""), (5, "\n\n"), (6, "z" * 300_000)]
    return rows


def test_as_judged_line_by_line(spark, monkeypatch):
    rows = corpus(1, 150)
    assert drop(spark, rows) == brute(rows)
    monkeypatch.setattr(lines, "SEGMENT_LINES", 16)  # many segments
    assert drop(spark, rows, documents=2, least=5) == brute(rows, 2, 5)


def test_rows_that_share_an_id_are_one_document(spark):
    line = "this is a line that is repeated"
    rows = [(1, line)] * 5 + [(1, f"{line}\nand more"), (2, line)]
    assert drop(spark, rows) == brute(rows) and all(r[2] == 0 for r in brute(rows))
    rows += [(3, line), (3, f"x\n{line}")]
    assert drop(spark, rows) == brute(rows) and sum(r[2] for r in brute(rows)) == 7


def test_empty_table(spark):
    assert drop(spark, []) == []


def test_filters_miss_nothing():
    pick = np.random.default_rng(3)
    seen, held = lines.Seen(4000), pick.integers(0, 2**63, 4000, dtype=np.uint64)
    seen.add(held[:2500], np.arange(2500) < 10)
    seen.add(held[2000:], np.zeros(2000, bool))
    found = seen.repeats(held)
    assert found[:10].all() and found[2000:2500].all()
    # Others are rarely suspected.
    assert found[10:2000].mean() < 0.01 and found[2500:].mean() < 0.01
