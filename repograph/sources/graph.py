"""Graph tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from repograph import schemas
from repograph.operators.digest import graph_hash
from repograph.session import KEYS, cut


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Put revisions into the stored graph: tables partitioned by repository and revision.

    A revision that is written again replaces itself, also where it has no edges or no nodes any more.  Its
    integrity hash goes first and is written last, so a revision without one, or with one that differs, is not complete.
    """

    spark = nodes.sparkSession
    hashes = cut(graph_hash(nodes, edges))
    # One row for each revision of the call.
    for row in hashes.select(*KEYS).toLocalIterator():
        _delete_revision(spark, f"{root}/hashes", row)
    for name, table in (("nodes", nodes), ("edges", edges)):
        empty = hashes.select(*KEYS).join(table.select(*KEYS).distinct(), KEYS, "left_anti")
        for row in empty.toLocalIterator():
            _delete_revision(spark, f"{root}/{name}", row)
    for name, table in (("nodes", nodes), ("edges", edges), ("hashes", hashes)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *KEYS).parquet(f"{root}/{name}")


def _delete_revision(spark: SparkSession, table: str, row: Row) -> None:
    parts = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([table, *(parts.getPartitionPathString(k, row[k]) for k in KEYS)]))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_graph(
    spark: SparkSession, root: str, repository_id: str | None = None, revision_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); repository and revision prune partitions."""

    tables = []
    for name, schema in (("nodes", schemas.NODES), ("edges", schemas.EDGES)):
        table = spark.read.schema(schema).parquet(f"{root}/{name}")
        if repository_id is not None:
            table = table.where(F.col("repository_id") == repository_id)
        if revision_id is not None:
            table = table.where(F.col("revision_id") == revision_id)
        tables.append(table)
    return tables[0], tables[1]


def damaged_revisions(spark: SparkSession, root: str) -> DataFrame:
    """Stored revisions whose rows no longer give their integrity hash."""

    stored = spark.read.schema("graph_hash STRING, repository_id STRING, revision_id STRING").parquet(
        f"{root}/hashes").withColumnRenamed("graph_hash", "stored_hash")
    fresh = graph_hash(*read_graph(spark, root))
    return stored.join(fresh, KEYS, "full_outer").where(
        ~F.col("stored_hash").eqNullSafe(F.col("graph_hash"))).select(*KEYS)


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(keys, bytes): the canonical JSON size of each revision, for a size limit."""

    size = lambda df: df.select(
        *KEYS, F.octet_length(F.to_json(F.struct(*sorted(df.columns)))).alias("n"))
    return size(nodes).unionByName(size(edges)).groupBy(*KEYS).agg(F.sum("n").alias("bytes"))


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents, one JSON object per file."""

    docs = spark.read.option("multiLine", True).schema(schemas.GRAPH_JSON).json(path)
    node = docs.select("repository_id", F.explode("nodes").alias("n")).select(
        "repository_id", "n.*")
    extra = lambda name: F.get_json_object("attributes", f"$.{name}")
    flag = lambda name: F.coalesce(extra(name) == "true", F.lit(False))
    nodes = node.select(
        "repository_id", "revision_id", "id", "logical_id", "kind", "display_name", "qualified_name",
        "language", "path", "span", "signature", "content_hash", "parser", "parser_version",
        F.coalesce("is_generated", F.lit(False)).alias("is_generated"),
        extra("body_fingerprint").alias("body_fingerprint"), extra("docstring").alias("docstring"),
        flag("is_test").alias("is_test"), flag("is_entry_point").alias("is_entry_point"),
        F.from_json(extra("entry_reasons"), "ARRAY<STRING>").alias("entry_reasons"),
        F.col("attributes").alias("attributes_json"),
    )
    edges = docs.select("repository_id", F.explode("edges").alias("e")).select("repository_id", "e.*").select(
        "repository_id", "revision_id", "id", "logical_id", "source_id", "predicate", "target_id",
        "quality", "confidence", "owner_source_id", "extractor", "extractor_version",
        F.col("attributes").alias("attributes_json"), "evidence",
    )
    return nodes, edges
