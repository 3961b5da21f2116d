import random
import re

import numpy as np
import pyarrow as pa

from repograph.llm import arrays, decontamination

PICK = random.Random(4)
WORDS = ["".join(PICK.choices("abcdefghi", k=PICK.randint(2, 7))) for _ in range(400)]
ITEMS = [(i, " ".join(PICK.choices(WORDS, k=PICK.randint(12, 40)))) for i in range(30)]


def text(k):
    return " ".join(PICK.choices(WORDS, k=k))


def corpus():
    rows = []
    for doc in range(200):
        kind = doc % 10
        item = ITEMS[doc % 30][1].split()
        if kind == 1:
            rows.append((doc, f"{text(60)} {' '.join(item)} {text(50)}"))
        elif kind == 2:
            for _ in range(len(item) // 8):
                item[PICK.randrange(len(item))] = "edited"
            rows.append((doc, f"{text(20)}\n{' '.join(item).upper()}!! {text(20)}"))
        elif kind == 3:
            del item[len(item) // 2:len(item) // 2 + 2]
            rows.append((doc, ", ".join(item)))
        else:
            rows.append((doc, text(PICK.choice([0, 3, 100]))))
    return rows


def words(s):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (s or "").lower())


def score(item, held):
    """Best local alignment, cell by cell."""

    above, best = [0] * (len(held) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(held):
            row.append(max(0, above[j] + (1 if a == b else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def brute(rows, items):
    out = {}
    for doc, held in rows:
        for item, asked in items:
            asked_words = words(asked)
            if len(asked_words) >= decontamination.MIN_WORDS:
                best = score(asked_words, words(held))
                if best >= decontamination.MIN_ALIGNED and best / len(asked_words) >= decontamination.MIN_SCORE:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def result(spark, rows, items):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, item_id int, score string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.aligned for r in decontamination.find_leaks(docs, asked).collect()}


def test_matches_all_alignments(spark, monkeypatch):
    rows = corpus()
    expected = brute(rows, ITEMS)
    assert len(expected) >= 55
    assert result(spark, rows, ITEMS) == expected
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1000)
    assert result(spark, rows, ITEMS) == expected


def test_a_passage_in_most_texts_is_still_found(spark):
    rows = [(i, f"{text(30)} {ITEMS[3][1]} {text(5)}") for i in range(80)] + [(100, text(40))]
    found = result(spark, rows, ITEMS)
    assert {d for d, item in found if item == 3} == set(range(80)) and (100, 3) not in found


def test_nulls_short_items_long_texts_and_repeats(spark):
    leak = ITEMS[5][1]
    rows = [(None, leak), (1, None), (2, ""), (3, leak), (3, leak), (4, "word " * 150_000 + leak), (5, "the end")]
    items = [*ITEMS, (50, None), (51, ""), (52, "the end"), (53, leak)]
    found = result(spark, rows, items)
    assert {k for k in found if k[1] in (5, 50, 51, 52, 53)} == {(d, i) for d in (None, 3, 4) for i in (5, 53)}


def test_empty_tables(spark):
    assert result(spark, [], ITEMS) == {} == result(spark, [(1, "a b c")], [])


def test_alignment_counts_gaps():
    a = np.array([[2, 3, 4, 5, 6, 0]], np.uint64)
    b = np.array([[9, 2, 3, 8, 4, 5, 6, 1]], np.uint64)
    best, end = decontamination.align(a, b)
    assert (best[0], end[0]) == (4, 7)


def leaks(spark, rows, items, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(docs, asked, **options).collect()
    return {(r.doc_id, r.item_id): (r.score, r.aligned, r.end_word) for r in found}


def test_scripts_without_blanks(spark):
    zh = "水在标准大气压下加热到一百度时会发生什么变化？请说明理由。"
    ja = "光合成とは、植物が光のエネルギーを使って糖を作る働きである。"
    th = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    edited = zh.replace("大气压", "气压").replace("理由", "原因")
    rows = [(1, f"前言很长。{zh}后记也很长。"), (2, f"これは序文です。{ja}終わり。"), (3, f"คำนำ {th} จบ"), (4, f"前言，{edited}完"),
            (5, "今天天气很好，我们一起去公园散步吧。"), (6, "今日は天気がいいから公園に行こう。"), (7, "วันนี้อากาศดีมาก")]
    found = leaks(spark, rows, [(1, zh), (2, ja), (3, th)])
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 1)}
    assert all(found[k][0] == 1.0 for k in ((1, 1), (2, 2), (3, 3))) and found[4, 1][0] < 1


def test_short_items_match_as_a_whole(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "What is the boiling point of water?"), (3, "谁写了红楼梦"), (4, "who wrote hamlet"), (5, "???")]
    rows = [(1, "so, who wrote “Hamlet” — who wrote Hamlet?"), (2, "who wrote the play Hamlet"), (3, "what is the boiling point of water"),
            (4, "问：“谁写了《红楼梦》？”"), (5, "who wrote"), (5, "hamlet"), (6, "what is the boiling point of milk"), (7, "???")]
    assert leaks(spark, rows, items) == {
        (1, 1): (1.0, 3, 4), (1, 4): (1.0, 3, 4), (3, 2): (1.0, 7, 7), (4, 3): (1.0, 6, 7)}
    assert leaks(spark, [(1, "The end."), (2, "the")], [(1, "end"), (2, "the end")], least_words=1) == {
        (1, 1): (1.0, 1, 2), (1, 2): (1.0, 2, 2)}


def test_words_of_all_scripts():
    text = "don’t «stop» naïve e\u0301 中文abc 한국어 문장 ราคา €5 ☺\ufe0f a_b 𠀀x"
    words, first = arrays.script_word_hashes(*arrays.column_bytes(pa.array([text, "", "–—", "文"])))
    split = ["don", "t", "stop", "naïve", "e\u0301", "中", "文", "abc", "한국어", "문장", *"ราคา", "€", "5", "☺", "a", "b", "𠀀", "x"]
    alone = [arrays.word_hashes(*arrays.column_bytes(pa.array([w])))[0][0] for w in [*split, "文"]]
    assert words.tolist() == [int(h) for h in alone] and np.diff(first).tolist() == [len(split), 0, 0, 1]


def test_repeated_items_are_read_once(spark, monkeypatch):
    read, seen = decontamination.read_items, []
    monkeypatch.setattr(decontamination, "read_items", lambda rows: seen.append(len(rows)) or read(rows))
    assert set(leaks(spark, [(1, ITEMS[0][1])], [ITEMS[0]] * 500 + [(99, ITEMS[0][1])])) == {(1, 0), (1, 99)}
    assert seen == [2]
