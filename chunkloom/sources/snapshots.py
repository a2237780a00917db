"""Snapshots: versions of files from tables, directories and binary files. A version's files are (bv, file_no, filename, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str, versions: int = 20) -> DataFrame:
    """The document corpus as a series of snapshots: document d is file d / versions of version d mod versions."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.pmod("doc_id", F.lit(versions)).cast("int").alias("bv"), F.floor(F.col("doc_id") / versions).cast("bigint").alias("file_no"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("filename"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, in a single version."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit(0).alias("bv"), F.col("page_id").alias("file_no"), F.col("url").alias("filename"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


def row_chunks(df: DataFrame, key: str, versions: int = 8) -> DataFrame:
    """Rows of any table as chunks: the fingerprint is that of the row's values."""
    from ..functions.fingerprints import fingerprint

    text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != key])
    return df.select(F.pmod(F.col(key), F.lit(versions)).cast("int").alias("bv"), F.floor(F.col(key) / versions).cast("bigint").alias("seq"), fingerprint(F.encode(text, "UTF-8")).alias("fp"), F.octet_length(text).alias("size"))


def directory_files(spark: SparkSession, path: str, bv: int) -> DataFrame:
    """A directory tree as one version: files in the order of their paths, names relative to it. Directory order, which differs between machines, plays no part."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    empty = [(x, bytearray()) for x in empty_files(spark, path)]  # the reader leaves these out
    found = found.unionByName(spark.createDataFrame(empty, "path string, content binary"))
    name = F.regexp_replace("path", "^[a-zA-Z0-9]+:/*(?=/)", "")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")
    relative = F.when(name.startswith(F.lit(root)), F.substring(name, F.lit(len(root) + 2), F.length(name))).otherwise(name)
    listed = found.select("path", relative.alias("filename"))
    order = listed.withColumn("file_no", (F.row_number().over(Window.orderBy("filename")) - 1).cast("bigint"))  # paths only
    return found.join(order, "path").select(F.lit(bv).alias("bv"), "file_no", "filename", "content")


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of files without bytes, by the driver's listing (which every file source makes)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listing, out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return out
