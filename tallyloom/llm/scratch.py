"""Places that every executor can see, for lineage cuts and written files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and the master is local (tests) is a temporary one made."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose tables are written. It does so once the driver's garbage is collected, which a small driver heap
    may put off until the disks hold the shuffles of many steps."""
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing will read any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def replaced(old: DataFrame, df: DataFrame, name: str) -> DataFrame:
    """df, which may read old, written; old is dropped."""
    out = written(df, name)
    dropped(old)
    return out
