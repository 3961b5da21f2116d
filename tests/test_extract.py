import pytest
from pyspark.sql import functions as F

from repograph.operators import extract, resolve, validate
from repograph.plans import index
from repograph.sources import files as sources

EVAL = {
    "eval_app/__init__.py": '"""Small authorization fixture used only by the evaluation harness."""\n',
    "eval_app/api.py": (
        "from eval_app.auth import authorize\n\n\ndef handle_request(user: str) -> str:\n"
        "    if not authorize(user):\n        return \"forbidden\"\n    return \"accepted\"\n"),
    "eval_app/auth.py": (
        "from eval_app.store import load_policy\n\n\ndef authorize(user: str) -> bool:\n"
        "    return load_policy(user)\n"),
    "eval_app/store.py": 'def load_policy(user: str) -> bool:\n    return user == "admin"\n',
    "tests/test_api.py": (
        "from eval_app.api import handle_request\n\n\ndef test_handle_request_rejects_guest() -> None:\n"
        '    assert handle_request("guest") == "forbidden"\n'),
}


def table(spark, repositories):
    rows = [
        (repo, "r1", path, body.encode(), len(body.encode()))
        for repo, tree in repositories.items() for path, body in tree.items()
    ]
    schema = "repository_id string, revision_id string, path string, content binary, size_bytes long"
    found = spark.createDataFrame(rows, schema).withColumn("content_hash", F.sha2("content", 256))
    return sources.tag_files(sources.kept_files(sources.classify_files(found)))


TREES = {
    "evaluation-fixture": EVAL,
    "kinds": {"nested.py": (
        "class Example:\n    def method(self):\n        def inner():\n            return 1\n        return inner()\n")},
    "scope": {
        "target.py": "def work():\n    return 1\n",
        "caller.py": (
            "def importing_scope():\n    from target import work\n    return work()\n\n"
            "def unrelated_scope():\n    return work()\n")},
    "relative": {
        "pkg/__init__.py": "", "pkg/service.py": "def work():\n    return 1\n",
        "pkg/api.py": "from . import service\n\ndef call():\n    return service.work()\n"},
    "broken": {"broken.py": "def broken(:\n"},
    "classes": {
        "base.py": "class Base:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return 1\n",
        "sub.py": "import base as b\n\nclass Sub(b.Base):\n    pass\n\ndef make():\n    return Sub()\n\ndef again():\n    return again()\n"},
    "starts": {
        "app/__main__.py": "def main():\n    pass\n\nif __name__ == '__main__':\n    main()\n",
        "app/cli.py": "def run():\n    pass\n", "web/index.js": "1", "worker.py": "x = 1\n",
        "pyproject.toml": '[project]\nname = "x"\n[project.scripts]\ntool = "app.cli:run"\n',
        "web/package.json": '{"main": "index.js", "scripts": {"start": "node --flag index.js"}}',
        "Dockerfile": "FROM x\n# c\nCMD [\"python\", \\\n \"worker.py\"]\n", "Procfile": "web: python worker.py\n"},
}


@pytest.fixture(scope="module")
def graph(spark):
    return index.index_files(table(spark, TREES))


@pytest.fixture(scope="module")
def relations(graph):
    name = lambda side: graph["nodes"].select(
        "repository_id", F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    rows = graph["edges"].join(name("source"), ["repository_id", "source_id"]).join(
        name("target"), ["repository_id", "target_id"]).collect()
    return {(r.repository_id, r.source, r.predicate, r.target) for r in rows}


def test_gold_edges(graph):
    ids = {r.id for r in graph["edges"].collect()}
    assert {"edge_09854ee9a3f80c9d805c034d", "edge_52414a8d414e6fbee4c6da78", "edge_490be58d04fa0ab0aba16695"} <= ids


def test_graph_is_valid(graph):
    assert validate.violations(graph["nodes"], graph["edges"]).collect() == []


def test_kinds_and_scopes(graph, relations):
    kinds = {(r.repository_id, r.display_name): r.kind for r in graph["nodes"].collect()}
    assert kinds["kinds", "method"] == "METHOD" and kinds["kinds", "inner"] == "FUNCTION"
    # A name is looked up in the scopes around a symbol, not in the symbol itself.
    assert not {r for r in relations if r[0] == "kinds" and r[2] == "CALLS"}
    assert not {r for r in relations if r[0] == "scope" and r[2] == "CALLS"}
    assert ("relative", "pkg.api", "IMPORTS", "pkg.service") in relations
    assert ("relative", "pkg.api.call", "CALLS", "pkg.service.work") in relations


def test_classes(relations):
    assert ("classes", "base.Base.run", "CALLS", "base.Base.step") in relations
    assert ("classes", "sub.Sub", "EXTENDS", "base.Base") in relations
    assert ("classes", "sub.make", "INSTANTIATES", "sub.Sub") in relations
    assert not {r for r in relations if r[0] == "classes" and r[1] == r[3]}


def test_diagnostics(graph):
    found = graph["diagnostics"].collect()
    assert [(r.repository_id, r.message) for r in found] == [("broken", "broken.py:1: syntax error")]


def test_entry_points(graph):
    found = {
        (r.path, r.qualified_name, r.reason, r.manifest_line)
        for r in graph["entry_points"].where("repository_id = 'starts'").collect()}
    assert found == {
        ("app/__main__.py", None, "python-main-module", None), ("app/__main__.py", None, "python-main-guard", 4),
        ("app/__main__.py", "app.__main__.main", "python-main-guard-call", 5),
        ("app/cli.py", "app.cli.run", "python-console-script", 4),
        ("web/index.js", None, "node-package-main", 1), ("web/index.js", None, "node-package-start", 1),
        ("worker.py", None, "container-cmd", 3), ("worker.py", None, "procfile-process", 1)}
    marked = {r.qualified_name: r.entry_reasons for r in graph["nodes"].where("is_entry_point").collect()}
    assert marked["worker"] == ["container-cmd", "procfile-process"]
    assert marked["app.cli.run"] == ["python-console-script"] and "app.cli" not in marked
    assert marked["web/index.js"] == ["node-package-main", "node-package-start"]


def test_cards(graph):
    cards = index.index_cards(graph)
    assert validate.card_violations(cards).collect() == []
    card = cards.where("qualified_name = 'eval_app.auth.authorize'").first()
    assert card.content == (
        "Entity: authorize\nQualified name: eval_app.auth.authorize\nKind: function\nLanguage: python\n"
        "Path: eval_app/auth.py\nLines: 4-5\nSignature: authorize(user: str) -> bool\n\nCode:\n"
        "def authorize(user: str) -> bool:\n    return load_policy(user)\n\nKnown exact relations:\n"
        + card.content.split("Known exact relations:\n")[1])
    assert "- outgoing CALLS: eval_app.store.load_policy" in card.content
    assert [r.predicate for r in card.relations] == ["CALLS"]


def test_same_graph_for_any_partitioning(spark, graph):
    want = {(r.id, tuple(e.id for e in r.evidence)) for r in graph["edges"].collect()}
    for parts in (1, 7):
        again = index.index_files(table(spark, TREES).repartition(parts))
        assert {(r.id, tuple(e.id for e in r.evidence)) for r in again["edges"].collect()} == want


def test_known_facts_are_not_parsed_again(spark, graph):
    again = index.index_files(table(spark, TREES), known=graph["said"])
    assert again["new"].count() == 0
    assert {r.id for r in again["edges"].collect()} == {r.id for r in graph["edges"].collect()}
    assert sorted(map(tuple, again["facts"].collect()), key=repr) == sorted(map(tuple, graph["facts"].collect()), key=repr)
    assert {r.message for r in again["diagnostics"].collect()} == {"broken.py:1: syntax error"}


def test_changed_files_do_not_keep_old_facts(spark, graph):
    trees = {
        "evaluation-fixture": {**EVAL, "eval_app/store.py": "def load_other(user: str) -> bool:\n    return True\n"},
        "fork": EVAL,
        "moved": {"scope/__init__.py": TREES["scope"]["target.py"], "target/__init__.py": TREES["scope"]["target.py"]},
    }
    again = index.index_files(table(spark, trees), known=graph["said"])
    parsed = {(r.module_key, r.fact) for r in again["new"].collect()}
    # The changed file, and a copy under a module name of its own; the same module in another repository or file is known.
    assert {m for m, _ in parsed} == {"eval_app.store", "scope"}
    names = lambda repo: {r.name for r in again["facts"].where((F.col("repository_id") == repo) & (F.col("path") == "eval_app/store.py")).collect() if r.name}
    assert "load_other" in names("evaluation-fixture") and "load_policy" not in names("evaluation-fixture")
    assert "load_policy" in names("fork")
    alone = index.index_files(table(spark, trees))
    for name in ("nodes", "edges", "facts"):
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, alone[name].collect()))


def test_manifests_that_are_not_read_are_listed(spark):
    found = index.index_files(table(spark, {"big": {"a.py": "x = 1\n", "Procfile": "web: a.py\n"}}).withColumn(
        "content", F.when(F.col("path") == "Procfile", F.rpad("content", 1_000_001, F.lit(b" "))).otherwise(F.col("content"))))
    assert [r.message for r in found["diagnostics"].collect()] == ["Procfile: manifest of 1000001 bytes is not read"]


def test_hot_names_are_dealt_over_lots(spark):
    """Where a third of all calls ask for one name, its rows have many keys and the targets stay the same."""

    hot = F.when(F.col("id") % 3 == 0, F.lit("util.size")).otherwise(F.concat(F.lit("m.f"), F.col("id").cast("string")))
    tried = spark.range(30_000).select(
        F.lit("r").alias("repository_id"), F.lit("v").alias("revision_id"), F.concat(F.lit("m"), "id").alias("path"),
        F.col("id").cast("int").alias("site"), F.lit(0).alias("turn"), hot.alias("candidate"))
    symbols = tried.select("repository_id", "revision_id", "candidate").distinct().withColumn(
        "t", F.struct(F.col("candidate").alias("target_path"), F.lit("FUNCTION").alias("target_kind")))
    heavy = resolve.heavy_names(tried)
    named = tried.where(F.xxhash64("repository_id", "revision_id", "candidate").isin(heavy)).select("candidate").distinct()
    assert [r.candidate for r in named.collect()] == ["util.size"]
    rows = lambda found: sorted((r.site, r.candidate, r.t.target_path) for r in found.collect())
    dealt = resolve.name_targets(tried, symbols, heavy)
    assert rows(dealt) == rows(resolve.name_targets(tried, symbols, [])) and dealt.count() == 30_000
    lot = F.pmod(F.hash("path", "site"), F.lit(resolve.NAME_LOTS))
    sizes = [r["count"] for r in tried.where("candidate = 'util.size'").groupBy(lot).count().collect()]
    assert len(sizes) == resolve.NAME_LOTS and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_files_of_few_bytes_are_parsed_by_all_cores(spark):
    files = spark.range(400).select(
        F.lit("r").alias("repository_id"), F.lit("r1").alias("revision_id"),
        F.concat(F.lit("a/m"), F.col("id"), F.lit(".py")).alias("path"),
        F.encode(F.concat(F.lit("def f"), F.col("id"), F.lit("():\n    pass\n")), "UTF-8").alias("content"),
        F.lit("python").alias("language"), F.lit(False).alias("is_test"))
    facts = extract.new_facts(files).withColumn("task", F.spark_partition_id())
    assert facts.agg(F.countDistinct("task")).first()[0] >= min(spark.sparkContext.defaultParallelism, 4)


def test_structure_is_told_without_resolving_names(spark, monkeypatch):
    from repograph.operators import resolve
    from repograph.plans import catalog_code

    def refuse(*_):
        raise AssertionError("names are resolved")

    source = "/root/testdata/sf0.001/./"
    with monkeypatch.context() as held:
        held.setattr(resolve, "resolve_names", refuse)
        held.setattr(resolve, "symbol_nodes", refuse)
        found = {tuple(r) for r in catalog_code.extracted_structure(spark, source).collect()}
    edges = catalog_code._indexed(spark, source)["edges"].where("predicate IN ('CONTAINS', 'DEFINES')")
    assert found == {tuple(r) for r in edges.groupBy("predicate").count().collect()} and len(found) == 2
