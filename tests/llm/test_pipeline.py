import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_packing import check

WORDS = {"en": "the of and to in that with from this have".split(), "de": "der die und das nicht mit auf für ist ein".split()}
PASSAGE = "this very passage of many words stands in several documents of the corpus and shall be kept only once in all"


def prose(pick, lang, n):
    stems = [w + e for w in WORDS[lang] for e in ("", "er", "ing" if lang == "en" else "ung", "s")]
    return " ".join(pick.choices(stems, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(3)
    out = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, prose(pick, "en" if i % 2 else "de", 60), "en" if i % 2 else "de", "s", 1, "extra") for i in range(60)]
    item = prose(pick, "en", 20)
    docs[7] = (7, f"{docs[7][1]} {item} {prose(pick, 'en', 10)}", "en", "s", 1, "x")
    docs += [(100, docs[4][1], "de", "s", 1, "x"), (101, docs[4][1] + " ende", None, "s", 1, "x"),
             (102, f"{prose(pick, 'en', 50)} {PASSAGE}", "en", None, 1, "x"), (103, f"{PASSAGE} {prose(pick, 'en', 50)}", "en", "s", 1, "x"),
             (104, None, "en", "s", 1, "x"), (105, "", "en", "s", 1, "x"), (106, "123 !!", "en", "s", 1, "x"),
             (107, prose(pick, "en", 3000), "en", "s", 1, "x"), (None, prose(pick, "en", 70), "en", "s", None, None)]
    docs += docs[10:12]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    spark.createDataFrame(docs, schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.store(stage(spark, docs, folder))
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    language, near, repeats, clean = kept
    assert set(language) == {*range(60), 100, 101, 102, 103, 107, None} and language[101].lang == "de"
    assert set(near) == set(language) - {100, 101}
    assert set(repeats) == set(near) and PASSAGE in repeats[102].text and "passage of many" not in repeats[103].text
    assert repeats[103].n_chars == len(repeats[103].text)
    assert set(clean) == set(repeats) - {7}
    assert docs.count() == len(clean)
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check(packed, [(r.doc_id, r.text) for r in clean.values()], 2048)
    assert sorted(map(tuple, pipeline.run(spark, folder).collect()), key=repr)[0][:5] == sorted(map(tuple, packed), key=repr)[0][:5]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    pick = random.Random(6)
    texts = [prose(pick, "en", 60) for _ in range(5)]
    item = prose(pick, "en", 20)
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, f"{texts[1]} more"), (9, f"{texts[2]} {item}"), (9, texts[3]),
            (None, texts[4]), (None, texts[4]), (None, prose(pick, "en", 50))]
    docs = spark.createDataFrame([(*r, "number") for r in rows], "doc_id long, text string, number string").repartition(3)
    near = pipeline.store(pipeline.keep_one_of_near_duplicates(spark, docs, str(tmp_path)))
    want = [rows[i] for i in (0, 1, 4, 5, 6, 8)]
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted(want, key=repr)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = pipeline.drop_contaminated(spark, near, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([r for r in want if item not in r[1]], key=repr)
