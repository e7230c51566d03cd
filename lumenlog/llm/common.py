"""Shared plumbing of the training-data operators: table access, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which share every folder."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or, on a local master, one of our own where
    that is unset. On a cluster there is no such folder to fall back to."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lumenlog-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session is gone at interpreter exit; scratch tables then stay with the checkpoint folder
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lumenlog/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for t in tables:
        if path := getattr(t, "scratch", None):
            drop_path(t.sparkSession, path)


def text_of(column: str = "text"):
    """The whole text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a plain scan may be wrapped in: nodes that neither make rows nor drop their place in a file.
_KEEP_ROWS = {"Project", "Filter", "SubqueryAlias"}


def _is_scan(docs: DataFrame) -> bool:
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in _KEEP_ROWS and node.children().size() == 1:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" or node.nodeName().startswith("Relation")


#: Type of the ids of `identified`.
ROW_ID = "struct<file:bigint,place:bigint>"


def identified(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name` (file long, place long) that no two rows share and that is the same at every read.

    A row is known by its Parquet file and its place in it, which don't depend on how files are split into tasks, as
    monotonically_increasing_id does: splits follow the number of cores, which changes when executors come or go.
    Whatever isn't a plain scan of Parquet files is written to the shared folder once and read from there.
    """

    def by_place(scan: DataFrame) -> DataFrame:
        at = scan.metadataColumn("_metadata")
        return scan.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")))

    if _is_scan(docs):
        try:
            return by_place(docs)
        except AnalysisException:  # files of a format without places
            pass
    copy = written(docs, "rows")
    out = by_place(copy)
    out.scratch = copy.scratch
    return out


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within it, Python workers get at most `rows` rows at a time, for actions that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
