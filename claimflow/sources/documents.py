"""Document sources and landing.

Text documents are read whole (one file -> one row) with Spark's text
source; ``_metadata`` provides the object key, size and modification time,
so listing a landing area never opens the files' content.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 16 * 1024 * 1024
#: Shares of small files that a task of a scan gets at most.
SHARES = 8
DOCUMENT_SCHEMA = "input_key string, name string, text string, size long, modified timestamp"


def _accents() -> tuple[str, str]:
    """Every letter of the basic plane that is an ASCII letter with marks, and that letter."""
    pairs = []
    for code in range(0x80, 0x10000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if ord(c) < 128)
        if len(plain) == 1 and plain.isalnum():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _accents()


def _relative_key(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    # _metadata.file_path is a URI (file:/..., s3a://...); keep what follows the root.
    return F.regexp_replace(path, r"^.*?" + _escape(root) + "/", "")


def _escape(s: str) -> str:
    import re
    return re.escape(s)


def read_documents(spark: SparkSession, root: str, glob: str = "*.txt", recursive: bool = True,
                   prefix: str | None = None) -> DataFrame:
    """Whole-text scan of ``root``: ``input_key, name, text, size,
    modified``. ``prefix`` (a folder below ``root``, e.g. ``policies/``) is
    what is listed and read then; keys stay relative to ``root``. A missing
    prefix has no documents. Unreadable files are skipped
    (``ignoreCorruptFiles``); :func:`unreadable_documents` names them."""
    where = f"{root.rstrip('/')}/{prefix.strip('/')}" if prefix else root
    try:
        r = (spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).load(where))
    except AnalysisException as e:
        if prefix and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], DOCUMENT_SCHEMA)
        raise
    key = _relative_key(F.col("_metadata.file_path"), root)
    return r.select(
        key.alias("input_key"),
        F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.txt$", "").alias("name"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def export_documents(docs: DataFrame, root: str, id_col: str, body_col: str) -> None:
    """Write each document's bytes (binary ``body_col``) and a line feed to a
    file of its own below ``root``, named ``{id_col}={id}``.

    In a local (or mounted) folder the tasks write the files themselves, a
    folder for each task: Hadoop's local file system starts a process for
    every file to set its mode, and a partitioned write moves a folder for each
    document besides. Elsewhere it is a partitioned write that each task
    commits. Rows of one id in a task share a file; a repeated task writes the
    same files again.
    """
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        (docs.select(id_col, F.col(body_col).cast("string").alias("value")).write.partitionBy(id_col)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root))
        return
    local = where.toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, last, out = f"{local}/part={TaskContext.get().partitionId():06d}", None, None
        for batch in batches:
            if batch.num_rows:
                os.makedirs(folder, exist_ok=True)
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = f"{folder}/{id_col}={name}.txt"
                if name != last:
                    if out:
                        out.close()
                    out, last = open(name, "wb"), name
                out.write((body.as_py() or b"") + b"\n")
        if out:
            out.close()
        yield from ()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(body_col).alias("body")).sortWithinPartitions("id")
    rows.mapInArrow(write, "id string").write.format("noop").mode("overwrite").save()


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """``files`` in so many fewer partitions as small files leave room in ``spark.sql.files.maxPartitionBytes``."""
    run = files._jdf.queryExecution()
    n, spark = run.toRdd().getNumPartitions(), files.sparkSession
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(run.optimizedPlan().stats().sizeInBytes()))
    wanted = max(-(-n // SHARES), -(-size // most), 4 * spark.sparkContext.defaultParallelism)
    return files.coalesce(wanted) if wanted < n else files


def scan_documents(spark: SparkSession, root: str, glob: str = "*.txt", prefix: str | None = None) -> DataFrame:
    """S1-S3 in one pass, readable and unreadable files together:
    ``input_key, name, text, size, modified, reason``.

    Files are listed once and dealt to tasks by their listed sizes, many small
    ones to a task (``spark.sql.files.maxPartitionBytes``, with
    ``openCostInBytes`` for each file), so tasks are even however the files
    differ; where files are so small that a task would have little to read, it
    gets up to ``SHARES`` such shares. A file that is no UTF-8 text has a ``reason`` and no text: rows
    with a null reason are the documents, the others the quarantine. A missing
    prefix has no documents, and a file of no bytes is none: Spark does not
    list it.
    """
    where = f"{root.rstrip('/')}/{prefix.strip('/')}" if prefix else root
    try:
        r = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(where))
    except AnalysisException as e:
        if prefix and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], DOCUMENT_SCHEMA + ", reason string")
        raise
    r = _fewer_tasks(r)
    key = _relative_key(F.col("path"), root)
    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    return r.select(
        key.alias("input_key"), F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.txt$", "").alias("name"),
        F.when(readable, text).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.when(~readable, F.lit("not UTF-8 text")).alias("reason"))


def unreadable_documents(spark: SparkSession, root: str, read: DataFrame, glob: str = "*.txt") -> DataFrame:
    """Quarantine rows (``key, reason``): objects that the listing has and ``read`` has not."""
    listed = list_objects(spark, root, glob).select("key")
    return listed.join(read.select(F.col("input_key").alias("key")), "key", "left_anti").withColumn(
        "reason", F.lit("unreadable file"))


def list_objects(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Key, size and modification time of every object; the content
    column of the binary source is never read."""
    r = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", True).load(root))
    return r.select(_relative_key(F.col("path"), root).alias("key"), F.col("length").alias("size"),
                    F.col("modificationTime").alias("last_modified"))


def objects_per_area(listing: DataFrame) -> DataFrame:
    """Objects and bytes per top-level landing area."""
    return (listing.withColumn("area", F.element_at(F.split("key", "/"), 1))
            .groupBy("area").agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes")))


def safe_filename(name) -> Column:
    """Filename made safe for a key: letters with accents lose them, other
    characters beyond ASCII go; ``/`` and white space runs become ``_``;
    characters outside ``[A-Za-z0-9_.-]`` are dropped, leading and trailing
    ``.``/``_`` stripped."""
    n = F.col(name) if isinstance(name, str) else name
    n = F.regexp_replace(F.translate(n, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    n = F.regexp_replace(n, "/", " ")
    n = F.regexp_replace(F.trim(F.regexp_replace(n, r"\s+", " ")), " ", "_")
    n = F.regexp_replace(n, r"[^A-Za-z0-9_.-]", "")
    return F.regexp_replace(n, r"^[._]+|[._]+$", "")


def land_documents(df: DataFrame, name_col: str, size_col: str, ts_col: str,
                   max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Upload guards and key normalisation. Adds ``accepted``, ``reason``
    and ``input_key = documents/{yyyyMMdd_HHmmss}_{safe name}`` (null when
    rejected). Split accepted/quarantine with ``where('accepted')``."""
    name = F.col(name_col)
    safe = safe_filename(name)
    reason = (F.when(name.isNull() | (name == ""), F.lit("No file selected"))
               .when(F.col(size_col) > max_bytes, F.lit("File too large"))
               .when(safe == "", F.lit("Invalid file name")))
    key = F.concat(F.lit("documents/"), F.date_format(ts_col, "yyyyMMdd_HHmmss"), F.lit("_"), safe)
    return (df.withColumn("reason", reason)
              .withColumn("accepted", F.col("reason").isNull())
              .withColumn("input_key", F.when(F.col("accepted"), key)))
