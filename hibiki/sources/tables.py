"""Reading tables, spreading narrow work and cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* of a data folder; Parquet, a file or a folder of files."""
    if spark.conf.get("spark.sql.unionOutputPartitioning", None) != "false":
        safe_unions(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def safe_unions(spark: SparkSession) -> None:
    """Keep Spark 4.1 from taking a union of equally partitioned inputs as partitioned itself.

    Adaptive execution may coalesce the inputs differently afterwards; an aggregate over the union without an
    exchange of its own then gives a key twice.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or only where that is unset, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith(("local[", "local-")) or spark.sparkContext.master == "local":
        folder = tempfile.mkdtemp(prefix="hibiki-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        return f"file://{folder}"
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write *df* once to the shared folder and read it back: a cut of the lineage that survives the loss of executors.

    What was written is removed by release(), at the latest when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hibiki-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*paths: str) -> int:
    """Remove intermediates of this process, all of them by default: results that still read them must have been written."""
    gone = 0
    for path in paths or list(_written):
        spark = _written.pop(path, None)
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before: the folder is left to whoever owns it
            continue
    return gone


atexit.register(release)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition before narrow heavy work, only if the input has fewer partitions than the cluster has slots."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(2 * want, *keys)
