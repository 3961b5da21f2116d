import random

import numpy as np
from pyspark.sql import functions as F

from repograph.llm import language, quality
from repograph.llm.learning import held_out

STEMS = {"en": "the of and to in that with from this have thing", "de": "der die und das nicht mit auf für ist ein schön",
         "fr": "le la les des été avec pour dans une être où"}


def prose(pick, lang, n):
    return " ".join(w + pick.choice(["", "e", "n", "s"]) for w in pick.choices(STEMS[lang].split(), k=n))


def corpus(n=240):
    pick = random.Random(2)
    return [(i, prose(pick, lang := pick.choice(list(STEMS)), pick.randint(8, 60)), lang, "s") for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def test_held_out_languages(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    found = language.predict(df, language.learn(df)).select(
        "record.*", F.col("lang_pred").alias("found"), "score", held_out(F.col("record.doc_id")).alias("out")).collect()
    out = [r for r in found if r.out]
    assert len(found) == 240 and len(out) > 20
    assert sum(r.found == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in found) and {r.lang_pred for r in found} == {"s"}


def test_texts_without_letters_are_unknown(spark):
    model = language.learn(spark.createDataFrame(corpus(), SCHEMA))
    odd = [(1, None), (2, ""), (3, "12 !? \n"), (4, "日本語"), (None, "the thing"), (6, "é"), (7, "the of " * 200_000), (8, "½ €"), (6, "é")]
    rows = language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).select("record.doc_id", "lang_pred", "score")
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows.collect()}
    assert [found[i] for i in (1, 2, 3, 8)] == [("und", 0.0)] * 4
    assert found[None][0] == found[7][0] == "en" and "und" not in (found[4][0], found[6][0])


def test_few_or_no_languages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.predict(none, language.learn(none)).collect() == []
    texts = spark.createDataFrame([(1, "abc", None, "x"), (2, None, "en", "x")], SCHEMA)
    assert [r.lang_pred for r in language.predict(texts, language.learn(texts)).collect()] == ["und", "und"]
    one = spark.createDataFrame([(i, "abc", "en", "x") for i in range(9)] + [(10, "9", None, "x")], SCHEMA)
    assert {(r.record.doc_id > 9, r.lang_pred, r.score) for r in language.predict(one, language.learn(one)).collect()} == {
        (False, "en", 1.0), (True, "und", 0.0)}


def test_codewords_differ_widely():
    for n in (2, 3, 5, 6, 40):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (code.shape[1] + 1) // 2 * (0.5 if n > 5 else 1)
        assert (np.abs(code.sum(axis=0)) < n).all()


def quality_corpus():
    pick = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        text = prose(pick, "en", pick.randint(5, 80))
        good = pick.random() < 0.8
        if not good:
            words = text.split()
            text = pick.choice([" ".join(f"{w}***" for w in words), text.upper() + "!!", " ".join(w for w in words for _ in range(6))])
        docs.append((i, text, 1))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def scores(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    return quality.score(docs, quality.learn(docs, labels)).collect()


def test_held_out_quality(spark):
    docs, labels = quality_corpus()
    label = {d: q for d, q, _ in labels}
    rows = scores(spark, docs, labels)
    held = {r.doc_id for r in spark.range(300).toDF("doc_id").where(held_out(F.col("doc_id"))).collect()}
    out = [r for r in rows if r.doc_id in label and r.doc_id in held]
    assert len(rows) == 300 and len(out) > 20
    assert sum(r.predicted == label[r.doc_id] for r in out) >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_texts_and_labels(spark):
    docs, labels = quality_corpus()
    odd = [(1000, None, 1), (1001, "", 1), (1002, "\n\n", 1), (1003, "word " * 200_000, 1), (None, "a", 1), (1, docs[1][1], 1)]
    labels = [*labels, (5, 7, 0), (None, 1, 0), (6, None, 0), labels[0], (2000, 1, 0)]
    rows = scores(spark, [*docs, *odd], labels)
    assert len(rows) == 306 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


def test_quality_without_both_classes(spark):
    assert {r.score for r in scores(spark, [(1, "a", 1)], [])} == {0.5}
    assert {r.score for r in scores(spark, [(i, "a", 1) for i in range(9)], [(i, 1, 0) for i in range(9)])} == {1.0}
    assert scores(spark, [], []) == []


def test_raw_scores_at_the_threshold_pass():
    model = quality.Model(np.ones(quality.FEATURES), 1.0, 2.0)
    x = np.zeros((3, quality.FEATURES), np.float32)
    x[:, 0] = [1, np.nextafter(np.float32(1), np.float32(0)), 2]
    assert list(model.score(x) >= quality.CUT) == [True, False, True]


def test_samples_have_one_row_of_an_id(spark, monkeypatch):
    texts = [(d, t, lang) for d, t, lang, _ in corpus(40)]
    repeated = next(d for d in range(40) if not spark.range(d, d + 1).select(held_out(F.col("id"))).head()[0])
    texts += [(repeated, f"{texts[repeated][1]} {i}", texts[repeated][2]) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    learnt = docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, labels: seen.append(len(x)))
    monkeypatch.setattr(quality, "fit", lambda x, good, totals: seen.append(len(x)))
    language.learn(docs)
    quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    assert seen == [learnt, learnt]


def test_quality_learns_from_every_labelled_text_in_lots(spark, monkeypatch):
    docs, labels = quality_corpus()
    texts = spark.createDataFrame(docs, "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    learnt = {r.doc_id for r in marks.where(~held_out(F.col("doc_id"))).select("doc_id").collect()}
    monkeypatch.setattr(quality, "LOT", 40)
    monkeypatch.setattr(quality, "LEAST", 15)
    dealt = []
    deal = quality.spread
    monkeypatch.setattr(quality, "spread", lambda rows, *keys: (dealt.append(rows.collect()), deal(rows, *keys))[1])
    # No class may be cut to a number.
    model = quality.learn(texts, marks)
    assert {bytes(r.x) for r in dealt[0] if r.label == 1}.__len__() + {bytes(r.x) for r in dealt[0] if r.label == 0}.__len__() \
        == len({(q, t) for (d, q, _) in labels if d in learnt for (i, t, _) in [docs[d]]})
    lots = {lot: {r.label for r in dealt[0] if r.lot == lot} for lot in {r.lot for r in dealt[0]}}
    assert len(lots) == -(-len(learnt) // 40) and all(seen == {0, 1} for seen in lots.values())
    x = quality.features(*quality.arrays.column_bytes(quality.pa.array([docs[d][1] for d, _, _ in labels if d in learnt])))
    raw = x.astype(np.float64) @ model.weights
    good = np.array([q == 1 for d, q, _ in labels if d in learnt])
    at = np.sort(raw)[(~good).sum() - 1:][:2]
    assert abs(model.threshold - at.mean()) < 1e-6
    rows = quality.score(texts, model).collect()
    label = {d: q for d, q, _ in labels}
    out = [r for r in rows if r.doc_id in label and r.doc_id not in learnt]
    assert len(out) > 20 and sum(r.predicted == label[r.doc_id] for r in out) >= 0.9 * len(out)
    again = quality.learn(texts.repartition(5), marks.repartition(3))
    assert (again.weights == model.weights).all() and (again.threshold, again.slope) == (model.threshold, model.slope)


def test_a_rare_class_is_given_to_all_lots(spark, monkeypatch):
    docs, labels = quality_corpus()
    bad = [d for d, q, _ in labels if not q]
    few = [row for row in labels if row[1]] + [(d, 0, 0) for d in bad[:6]]
    monkeypatch.setattr(quality, "LOT", 30)
    rows = scores(spark, docs, few)
    assert len(rows) == 300 and len({r.score for r in rows}) > 100
    assert {r.score for r in scores(spark, docs, [row for row in labels if row[1]])} == {1.0}
