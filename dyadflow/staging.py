"""Written intermediate tables in the folder all executors share.

Used where lineage must be cut (iterations) or where a value that depends on the physical layout
(a range-partition number) has to be frozen before it is read twice. A lost executor then re-reads
files instead of replaying the loop.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which every executor can reach; ``local_session`` sets one."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # a local master started elsewhere, as by a test driver: one process, one machine
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="dyadflow-")
    return _LOCAL_DIRS[app]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dyadflow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: pruning and size statistics survive,
    which a plain checkpoint would lose. ``partition_by`` gives each value its own folder."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _PATHS[staged] = path
    return staged


def narrowed(staged: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a staged table, which ``release`` still removes."""
    out = staged.select(*columns)
    _PATHS[out] = _PATHS[staged]
    return out


def release(*staged: DataFrame) -> None:
    """Remove staged tables once all that was made from them is written itself."""
    for df in staged:
        path = _PATHS.pop(df, None)
        if path is not None:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
