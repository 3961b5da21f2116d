"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEYS = ["repository_id", "revision_id"]


def local_session(cpus: str | int = "*", app: str = "repograph", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""

    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; all its intermediate tables lie there."""

    return f"{work_dir(spark)}/repograph-{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, when no DataFrame needs them any more."""

    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over all cores, for work that is long for its bytes.

    The planner joins small shuffle partitions by their bytes, unless their number is asked for.
    """

    spark = df.sparkSession
    amount = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(amount, *keys)


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    The written table survives lost executors, and its file size is a checked size: the
    planner broadcasts the table only while it is below the broadcast threshold.  It stays until
    :func:`clear_run`.
    """

    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    # Hashes in hex digits, which most tables are full of, take half the room in this format.
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
