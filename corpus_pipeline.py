"""From raw documents to packed training sequences.

Each stage takes the documents its predecessor kept and is written as Parquet before the next one reads
them.  Empty and missing texts have no language and go in the first stage; later stages keep them if they
get them.  Every row is judged by itself: rows that share an id, and rows without one, are told apart by a number.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import decontamination, language, near_dup, packing, repeats
from repograph.llm.tables import store, table

ORACLE_SQL = None
SHINGLE = 5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language or with an ambiguous one; fill in missing languages."""

    found = language.predict(docs, language.learn(docs)).where(
        (F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return found.select(*[
        (F.coalesce("record.lang", "lang_pred") if c == "lang" else F.col(f"record.`{c}`")).alias(c) for c in docs.columns])


NUMBER = "number"


_copies: dict[str, list[str]] = {}


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with columns c0, c1, ..., so that none can clash, and a number each; stored, so that it lasts."""

    rows = store(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn(NUMBER, F.monotonically_increasing_id()))
    _copies.setdefault(docs.sparkSession.sparkContext.applicationId, []).extend(
        {path.rpartition("/")[0] for path in rows.inputFiles()})
    return rows


def _drop_copies(docs: DataFrame) -> None:
    """Delete the numbered rows of earlier stages, whose results are written by now, unless ``docs`` still reads them."""

    spark = docs.sparkSession
    read = {path.rpartition("/")[0] for path in docs.inputFiles()}
    held = _copies.pop(spark.sparkContext.applicationId, [])
    for path in held:
        if path in read:
            _copies.setdefault(spark.sparkContext.applicationId, []).append(path)
        else:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _column(docs: DataFrame, name: str) -> Column:
    return F.col(f"c{docs.columns.index(name)}")


def _without(rows: DataFrame, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """Numbered rows that are not among ``gone``, with the columns of ``docs``."""

    return rows.join(gone.toDF(NUMBER).distinct(), NUMBER, "left_anti").drop(NUMBER).toDF(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near duplicates: that with the smallest id, rows without one last.

    Different texts that share an id are vertices of their own; of rows repeated as a whole one stays.
    """

    rows = _numbered(docs)
    judged = near_dup.near_duplicates(
        rows.select(F.col(NUMBER).alias("doc_id"), _column(docs, "text").alias("text")), SHINGLE)
    several = judged.where("NOT kept").select("component_id").distinct()
    members = judged.join(several, "component_id").select("component_id", F.col("doc_id").alias(NUMBER))
    members = store(members.join(rows.select(NUMBER, _column(docs, "doc_id").alias("id")), NUMBER))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", NUMBER))[NUMBER].alias("keeper"))
    gone = members.join(first, "component_id").where(F.col(NUMBER) != F.col("keeper")).select(NUMBER)
    return _without(rows, gone, docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 50 bytes and more that a document with a smaller id has too."""

    _drop_copies(docs)
    cut = repeats.remove_repeats(docs).select("record.*")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one."""

    rows = _numbered(docs)
    texts = rows.select(F.col(NUMBER).alias("doc_id"), _column(docs, "text").alias("text"))
    leaks = decontamination.find_leaks(texts, table(spark, sf_dir, "benchmark"))
    return _without(rows, leaks.select("doc_id"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""

    _drop_copies(docs)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
