"""Session settings the jobs rely on, and tables kept in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot customer, item or order is split at run time, also where that costs a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when their query ends, not when the driver next frees memory.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_local_folder: dict[str, str] = {}
_staged: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, named by the cluster in spark.checkpoint.dir.

    Only a session whose executors are threads of the driver may run without that
    setting; it gets a scratch folder that goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        application = spark.sparkContext.applicationId
        if application not in _local_folder:
            _local_folder[application] = tempfile.mkdtemp(prefix="tillroll-")
            atexit.register(shutil.rmtree, _local_folder[application], ignore_errors=True)
        folder = _local_folder[application]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete every table that this application staged; results still to be read from them go too."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def drop(*tables: DataFrame) -> None:
    """Delete tables that stage returned, once neither they nor a result from them will be read."""
    for df in tables:
        path = _staged.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Used where a result is read several times: the lineage ends here, a lost
    executor costs nothing already staged, and the reader prunes columns.
    drop() deletes the table when it is superseded.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _staged[table] = path
    return table
