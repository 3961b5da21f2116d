import pytest
from pyspark.sql import functions as F

from repograph.operators import snapshots

SCHEMA = "repository_id string, source_id string, card_hash string, has_graph boolean, content string"


def cards(spark, named):
    return spark.createDataFrame([("r", f"s{i}", f"h{v}", i % 2 == 0, f"text {i} {v}") for i, v in named.items()], SCHEMA)


def held(spark, root, version=None):
    found = snapshots.read_snapshot(spark, root, version)
    return {} if found is None else {int(r.source_id[1:]): int(r.card_hash[1:]) for r in found.collect()}


def sets(spark, root, version):
    return {r.bucket: r.file_set for r in snapshots.manifest(spark, root, version).collect()}


def test_only_buckets_with_changes_are_written(spark, tmp_path):
    root, first = str(tmp_path / "cards"), {i: 0 for i in range(200)}
    assert snapshots.publish(spark, root, cards(spark, first), digits=1)[0] == 1
    assert held(spark, root) == first
    assert snapshots.publish(spark, root, cards(spark, first))[0] == 1  # nothing to do
    second = {**first, 7: 1, 500: 0}
    del second[3]
    version, plan = snapshots.publish(spark, root, cards(spark, second))
    assert version == 2 and held(spark, root) == second and held(spark, root, 1) == first
    touched = {r.bucket for r in plan.where("action <> 'unchanged'").collect()}
    old, new = sets(spark, root, 1), sets(spark, root, 2)
    assert len(touched) <= 3 and {b for b in new if old.get(b) != new[b]} == touched
    assert snapshots.damaged_buckets(spark, root, 1).count() == snapshots.damaged_buckets(spark, root, 2).count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    root, first = str(tmp_path / "cards"), {i: 0 for i in range(30)}
    snapshots.publish(spark, root, cards(spark, first), digits=1)
    one, other = {**first, 1: 1}, {**first, 2: 2}
    assert snapshots.publish(spark, root, cards(spark, one), base=1)[0] == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, root, cards(spark, other), base=1)
    assert snapshots.versions(spark, root) == [1, 2] and held(spark, root) == one
    # What the loser wrote is named by no version; planned again, it goes in.
    assert len(snapshots.unnamed_sets(spark, root, keep=2)) == 1
    assert snapshots.publish(spark, root, cards(spark, {**one, 2: 2}))[0] == 3
    assert held(spark, root) == {**one, 2: 2}
    assert len(snapshots.drop_versions(spark, root, keep=1, older_than_ms=0)) >= 1
    assert snapshots.versions(spark, root) == [3] and held(spark, root) == {**one, 2: 2}


def test_empty_stores_and_damage(spark, tmp_path):
    root = str(tmp_path / "cards")
    assert snapshots.read_snapshot(spark, root) is None and snapshots.versions(spark, root) == []
    assert snapshots.publish(spark, root, cards(spark, {1: 0}).limit(0), digits=1)[0] == 0
    assert held(spark, root) == {}
    snapshots.publish(spark, root, cards(spark, {1: 0, 2: 0}))
    assert snapshots.publish(spark, root, cards(spark, {1: 0, 2: 0}).limit(0))[0] == 2
    assert held(spark, root) == {} and held(spark, root, 1) == {1: 0, 2: 0}
    bad = snapshots.read_snapshot(spark, root, 1).limit(1).withColumn("card_hash", F.lit("h9")).collect()[0]
    name = sets(spark, root, 1)[bad.bucket]
    cards(spark, {5: 5}).write.mode("append").parquet(f"{root}/data/file_set={name}/bucket={bad.bucket}")
    assert [r.bucket for r in snapshots.damaged_buckets(spark, root, 1).collect()] == [bad.bucket]
