"""Published cards as a log of snapshots.

Cards are dealt to buckets by the hash of their identity.  Publishing writes the buckets that hold an added,
replaced or removed card and no others; the manifest of the new version names the file set of every bucket, those
of untouched buckets included.  A version is committed by one rename that fails where the version exists, so of
two writers that start from the same version one wins and the other has to plan again.  Until the rename nothing
that readers see has changed; what an interrupted publish wrote is never named by a manifest.

    root/data/file_set=<name>/bucket=<n>/     cards with card_hash and has_graph
    root/versions/<number>/                   bucket, file_set, n_cards, digest, digits
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.operators.publish import ID, publish_plan
from repograph.session import cut

MANIFEST = "bucket int, file_set string, n_cards long, digest long, digits int"
#: Hex digits of the hash that make a bucket, for a new store; a manifest has 16 to this power rows at most.
DIGITS = 2
MAX_DIGITS = 4


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def bucket_of(digits: int) -> Column:
    """The bucket of a card, from the first hex digits of its identity's hash."""

    name = F.md5(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ID]))
    return F.conv(F.substring(name, 1, digits), 16, 10).cast("int")


def _files(spark: SparkSession, path: str):
    """Hadoop's file context of a path, and the path."""

    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    where = where.getFileSystem(conf).makeQualified(where)
    return hadoop.FileContext.getFileContext(where.toUri(), conf), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, oldest first."""

    files, folder = _files(spark, f"{root}/versions")
    if not files.util().exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in files.util().listStatus(folder))


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/versions/{version}")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The cards of a version (the newest by default) with their bucket; None before the first.

    Only the folders that the manifest names are listed and read.
    """

    version = max(versions(spark, root), default=None) if version is None else version
    if version is None:
        return None
    named = manifest(spark, root, version).where("file_set IS NOT NULL").select("file_set", "bucket").collect()
    if not named:
        return None
    paths = [f"{root}/data/file_set={r.file_set}/bucket={r.bucket}" for r in named]
    return spark.read.option("basePath", f"{root}/data").parquet(*paths).drop("file_set")


def _commit(spark: SparkSession, root: str, version: int, rows: DataFrame) -> None:
    """Write the manifest aside and rename it to its version, which must not exist."""

    aside = f"{root}/pending/{uuid.uuid4().hex}"
    rows.coalesce(1).write.mode("errorifexists").parquet(aside)
    files, target = _files(spark, f"{root}/versions/{version}")
    files.mkdir(target.getParent(), None, True)
    source = _files(spark, aside)[1]
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(source, target, never)
    except Exception as error:
        if files.util().exists(target):
            raise Conflict(f"version {version} was committed by another writer") from error
        raise


def plan(spark: SparkSession, root: str, cards: DataFrame, version: int | None, digits: int) -> DataFrame:
    """The publish plan of all cards against a version, with their buckets."""

    hashes = cards.select(*ID, "card_hash", "has_graph")
    held = None if version is None else read_snapshot(spark, root, version)
    old = held.select(*hashes.columns) if held is not None else hashes.limit(0)
    return publish_plan(old, hashes).withColumn("bucket", bucket_of(digits))


def publish(
    spark: SparkSession, root: str, cards: DataFrame, digits: int = DIGITS, base: int | None = None
) -> tuple[int, DataFrame]:
    """Publish ``cards`` as the next version of the store: (version, plan).

    ``cards`` has repository_id, source_id, card_hash, has_graph and what else is published, one row for each
    card.  ``digits`` counts for the first version only.  ``base`` is the version that the caller saw last (the
    newest by default); :class:`Conflict` is raised if another one has followed it.  With no difference nothing
    is written and the version stays; 0 is that of an empty store.
    """

    known = versions(spark, root)
    base = max(known, default=None) if base is None else base
    if base is not None:
        old = cut(manifest(spark, root, base))
        digits = old.agg(F.max("digits")).head()[0]
    else:
        old = spark.createDataFrame([], MANIFEST)
        if not 1 <= digits <= MAX_DIGITS:
            raise ValueError(f"digits must be between 1 and {MAX_DIGITS}")
    planned = cut(plan(spark, root, cards, base, digits))
    touched = planned.where("action <> 'unchanged'").select("bucket").distinct()
    buckets = [r.bucket for r in touched.collect()]
    if not buckets:
        return base or 0, planned
    name = uuid.uuid4().hex
    # Buckets go to tasks by size, and large ones to several.
    fresh = cards.withColumn("bucket", bucket_of(digits)).where(F.col("bucket").isin(buckets)).hint("rebalance", "bucket")
    # Each writer has a folder of its own, so none cleans up another's.
    fresh.write.mode("errorifexists").partitionBy("bucket").parquet(f"{root}/data/file_set={name}")
    written = planned.where(F.col("bucket").isin(buckets) & (F.col("action") != "removed")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_cards"), _digest("new_hash").alias("digest"))
    rows = touched.join(written, "bucket", "left").select(
        "bucket", F.when(F.col("n_cards").isNotNull(), F.lit(name)).alias("file_set"),
        F.coalesce("n_cards", F.lit(0)).alias("n_cards"), F.coalesce("digest", F.lit(0)).alias("digest"),
        F.lit(digits).alias("digits"))
    kept = old.where(~F.col("bucket").isin(buckets))
    version = (base or 0) + 1
    _commit(spark, root, version, kept.unionByName(rows))
    return version, planned


def _digest(card_hash: str) -> Column:
    """A sum of the cards' hashes that does not depend on their order."""

    return F.bit_xor(F.xxhash64(*ID, card_hash))


def damaged_buckets(spark: SparkSession, root: str, version: int) -> DataFrame:
    """(bucket, named, found): buckets whose cards are not those of the manifest."""

    named = manifest(spark, root, version).select("bucket", F.col("n_cards").alias("named"), "digest")
    held = read_snapshot(spark, root, version)
    if held is None:
        return named.where("named > 0").select("bucket", "named", F.lit(0).cast("long").alias("found"))
    found = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("found"), _digest("card_hash").alias("seen"))
    both = named.join(found, "bucket", "full_outer")
    same = (F.coalesce("named", F.lit(0)) == F.coalesce("found", F.lit(0))) & (
        F.coalesce("digest", F.lit(0)) == F.coalesce("seen", F.lit(0)))
    return both.where(~same).select("bucket", "named", "found")


def unnamed_sets(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """File sets that none of the newest ``keep`` versions names: old ones, and those of publishes that failed or still run."""

    files, folder = _files(spark, f"{root}/data")
    if not files.util().exists(folder):
        return []
    held = {s.getPath().getName().partition("=")[2] for s in files.util().listStatus(folder) if s.isDirectory()}
    for version in versions(spark, root)[-keep:]:
        held -= {r[0] for r in manifest(spark, root, version).select("file_set").distinct().collect()}
    return sorted(held)


def drop_versions(spark: SparkSession, root: str, keep: int = 1, older_than_ms: int = 7 * 86_400_000) -> list[str]:
    """Delete old versions, then the file sets that nothing names and that are old enough to belong to no running publish."""

    for version in versions(spark, root)[:-keep]:
        files, folder = _files(spark, f"{root}/versions/{version}")
        files.delete(folder, True)
    gone = []
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for name in unnamed_sets(spark, root, keep):
        files, folder = _files(spark, f"{root}/data/file_set={name}")
        if now - files.getFileStatus(folder).getModificationTime() >= older_than_ms:
            files.delete(folder, True)
            gone.append(name)
    return gone
