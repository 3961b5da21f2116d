import posixpath
import re
import unicodedata

from pyspark.sql import functions as F

from repograph.functions import envelope, ids, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_known_node_id(spark):
    logical = ids.node_logical_id(
        F.lit("evaluation-fixture"), F.lit("python"), F.lit("eval_app/api.py"), F.lit("FUNCTION"),
        F.lit("eval_app.api.handle_request"))
    assert one(spark, ids.node_id(logical)) == "node_20b86a1f77e991d7f9cf1f02"


def test_normalize_path_follows_posix_rules(spark):
    paths = ["a\\b/../c/./d", "/x", "C:/x", "../x", "a/../../b", "  ./ ", "a//b/", "", "a/..", "..", "a/b/../../c"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        "p", ids.normalize_path(F.col("p")).alias("n")).collect()
    for row in rows:
        raw = row.p.replace("\\", "/").strip()
        want = posixpath.normpath(raw) if raw else "."
        if raw.startswith("/") or re.match("^[A-Za-z]:/", raw) or want == ".." or want.startswith("../"):
            want = None
        assert row.n == want, row.p


def test_evidence_without_span_hashes_none(spark):
    import hashlib

    none = F.lit(None).cast("int")
    got = one(spark, ids.evidence_id(F.lit("a.py"), none, none, none, none, F.lit("h")))
    assert got == "evidence_" + hashlib.sha256(b"a.py:None:None:None:None:h").hexdigest()[:24]


def test_tokens_match_the_plain_loop(spark):
    samples = ["Ouréaux foo_bar _x A1 __ a__b 9z", "", "no_Parts_HERE x"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select(
        "s", text.tokens(F.col("s")).alias("t"), text.token_bag(F.col("s")).alias("b")).collect()
    for row in rows:
        want = []
        for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", row.s):
            low = word.lower()
            want += [low, *[p for p in low.split("_") if p and p != low]]
        assert row.t == want
        assert sorted(row.b) == sorted(want)


def test_excerpt_counts_bytes(spark):
    source = "aé b\ncd\nef"
    cases = {(1, 1, 1, 3): "é", (1, 3, 3, 1): " b\ncd\ne", (2, 0, 4, 1): None}
    for span, want in cases.items():
        row = F.struct(*[F.lit(v).alias(n) for v, n in zip(span, ("start_line", "start_column", "end_line", "end_column"))])
        assert one(spark, text.excerpt(F.lit(source), row)) == want


def test_module_names(spark):
    cases = {"a/b/__init__.py": "a.b", "__init__.py": "__init__", "x.py": "x", "a/b.c.py": "a.b.c"}
    for path, want in cases.items():
        assert one(spark, text.module_name(F.lit(path))) == want
    assert one(spark, text.relative_module(F.lit("a.b.c"), F.lit("x.y"), F.lit(2))) == "a.x.y"
    assert one(spark, text.relative_module(F.lit("a"), F.lit(None).cast("string"), F.lit(1))) == ""


def test_repository_identity(spark):
    same = ["git@github.com:Org/Repo.git", "ssh://git@GitHub.com:22/Org/Repo", "ssh://github.com/Org/Repo/"]
    found = {one(spark, ids.repository_identity(F.lit(o), F.lit(""))) for o in same}
    assert len(found) == 1 and found.pop().startswith("git:Repo:")
    assert one(spark, ids.repository_identity(F.lit("C:/x"), F.lit(""))) is None


def test_envelope_shrinks_only_its_summary(spark):
    proof = F.struct(
        F.lit("evidence_1").alias("id"), F.lit("a.py").alias("path"), F.lit(1).alias("start_line"),
        F.lit(0).alias("start_column"), F.lit(1).alias("end_line"), F.lit(9).alias("end_column"),
        F.lit("0" * 64).alias("excerpt_hash"), F.lit("why").alias("explanation"))
    build = lambda s: envelope.evidence_envelope(
        F.lit(s), F.lit("edge_1"), F.lit("exact"), F.lit("p"), F.lit("1"), proof)
    short = one(spark, build("fine"))
    assert '"summary":"fine"' in short
    long = one(spark, build('"' * 3000))
    assert len(long) <= 2000 and long.endswith('…"}') and len(long) > 1990
    assert one(spark, envelope.valid_envelope(F.lit(long), F.lit("byog")))
    assert not one(spark, envelope.valid_envelope(F.lit(long), F.lit("auto")))
    assert not one(spark, envelope.valid_envelope(F.lit("{no json"), F.lit("byog")))


def test_record_json_after_last_marker(spark):
    content = "x\nRecord JSON:\n{1}\nRecord JSON:\n {2} "
    assert one(spark, text.record_json(F.lit(content))) == "{2}"
    assert one(spark, text.record_json(F.lit("none"))) is None


def test_entity_name_is_bounded(spark):
    name = one(spark, text.entity_name(F.lit("q" * 400), F.lit("CLASS"), F.lit("p"), F.lit("node_1")))
    assert len(name) == 256 and name.endswith(" … [node_1]")
    assert unicodedata.normalize("NFC", name) == name
