"""Tables that jobs write between their stages, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset (one machine), a temporary one, which then is the checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_dir(spark: SparkSession) -> str:
    """A folder's path that nobody else has, for sweep() to delete."""
    path = f"{shared_dir(spark)}/folioflow/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def trim_driver(spark: SparkSession) -> str | None:
    """Have the driver's JVM return to the system the native memory that it has freed, and its report.

    Of what native code frees the C library keeps a part, and more the longer a session lasts.
    None where the JVM doesn't have this command.
    """
    with contextlib.suppress(Py4JError):
        jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
        named, kinds, given = jvm.java.lang.Class.forName, new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(beans, given)
    return None


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, and the folder, for delete()."""
    path = new_dir(df.sparkSession)
    df.write.parquet(f"{path}/{name}")
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}"), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later jobs start from the
    files, so a lost executor costs no earlier stage. sweep() deletes them."""
    return write_table(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this application has written so far and say how many there
    were. For when the results that were made of them have been stored: a DataFrame that
    still reads one of them can't be computed again."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it isn't installed: code in tasks is found by its module's name."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}-package", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()
