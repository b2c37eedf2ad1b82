"""What the package needs of a session: its modules on executors, and scratch tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="gridquarry-")) / "gridquarry.zip"
    with zipfile.ZipFile(path, "w") as out:
        for module in package.rglob("*.py"):
            out.write(module, module.relative_to(package.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. If it is unset, a session in local mode gets a temporary
    one; on a cluster, whose machines share no such folder, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridquarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in a new folder of the shared one, which is removed when the driver's JVM exits."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    _forget(spark, folder)
    return f"{folder}/{name}"


def _forget(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM remove a path when it exits; the path must exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _forget(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Remove the files of a table that stage gave and that nothing reads any more. The JVM is asked to collect what it no longer
    refers to, whereupon Spark also removes the shuffle files that made the table."""
    if df is None:
        return
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    jvm.System.gc()
