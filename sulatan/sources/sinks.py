"""Written results: detection log, archive by label, evaluation CSV, file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

IMAGE_GLOB = "*.{png,jpg,jpeg}"


def append_detection_log(rows: DataFrame, path: str) -> None:
    """Append log rows as Parquet."""
    rows.write.mode("append").parquet(path)


def append_detection_log_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Append log rows to a database table; each task writes in batches."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize="10000", **options).mode("append").save()


#: folders that archive keys are dealt into (many more for a large archive); an append reads only those its keys fall into
ARCHIVE_BUCKETS = 16


def write_archive(entries: DataFrame, path: str, key: tuple[str, ...] = ("session_id", "crop_name"), buckets: int = ARCHIVE_BUCKETS) -> None:
    """Append archive entries under one folder per bucket of keys and label; repeating a run adds nothing.

    Rows already present and repeats in the input are written once; rows that
    share a name but differ elsewhere are all kept. Only the buckets that the
    new keys fall into are read again, so an append costs what it brings, not
    what the archive holds. An archive keeps the ``buckets`` it began with.
    Rows are dealt to the tasks by bucket, label and key in ranges of even
    size, so a frequent label is written by many.
    """
    spark = entries.sparkSession
    bucketed = entries.distinct().withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        touched = [r["bucket"] for r in bucketed.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        held = spark.read.schema(_archive_schema(bucketed.schema)).parquet(path).filter(F.col("bucket").isin(touched))
        bucketed = bucketed.subtract(held.select(bucketed.columns))
    bucketed.repartitionByRange("bucket", "label", F.xxhash64(*key)).write.mode("append").partitionBy("bucket", "label").parquet(path)


def _archive_schema(schema: StructType) -> StructType:
    """Labels are text even if all look like numbers."""
    return StructType([StructField(f.name, StringType() if f.name == "label" else f.dataType) for f in schema])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive entries; labels stay text even if they look like numbers."""
    return spark.read.schema(_archive_schema(spark.read.parquet(path).schema)).parquet(path).drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


EVAL_COLUMNS = ("file", "input_type", "status", "confidence", "text")


def eval_log_rows(df: DataFrame) -> DataFrame:
    """Evaluation rows as text cells; a missing status reads ``Failed``."""
    return df.select("file", "input_type", F.coalesce("status", F.lit("Failed")).alias("status"),
                     F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"),
                     F.coalesce("text", F.lit("")).alias("text"))


#: rows of one CSV file; cells may hold line breaks, so a file is read by one task
EVAL_FILE_ROWS = 100_000


def write_eval_csv(df: DataFrame, path: str, file_rows: int = EVAL_FILE_ROWS) -> None:
    """CSV with every cell quoted, quotes doubled, and a header, in files of ``file_rows``."""
    (eval_log_rows(df).write.mode("append").option("maxRecordsPerFile", file_rows).option("quoteAll", True).option("escape", '"')
     .option("emptyValue", "").option("header", True).csv(path))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in EVAL_COLUMNS)
    return (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
            .option("emptyValue", "").csv(path).fillna(""))


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    """One text record per report."""
    reports.select(column).write.mode("append").text(path)


def labelled_files(spark: SparkSession, root: str, glob: str = IMAGE_GLOB) -> DataFrame:
    """Image files below ``root``: folder = true label, name before ``_<n>_`` = predicted class.

    Only paths are used, so no file content is read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(root).select("path"))
    return files.select(
        "path", F.regexp_replace(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "^label=", "").alias("label"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.regexp_extract("path", r"/([A-Za-z-]+(?:_(?:Cross|Dot(?:_Above|_Below)?))?)[^/]*$", 1).alias("predicted"))
