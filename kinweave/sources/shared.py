"""Tables written in the folder that the driver and all executors share, so that lineage is cut and lost executors cost nothing.

All tables of a session lie in one subfolder. A function that is done with one calls remove(); what a lazy result still reads
stays until clean() is called or the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: With it an action's shuffles go when it is done; without, they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, as in tests, a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def session_folder(spark: SparkSession) -> str:
    """The session's own folder for tables, made once; deleted when the driver's process ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/kinweave-{uuid.uuid4().hex}"
        atexit.register(_last, spark)
    return _FOLDERS[app]


def _last(spark: SparkSession) -> None:
    """At the end of the process, when the JVM may be gone already: then the folder stays."""
    with contextlib.suppress(Exception):
        clean(spark)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, shuffles_go: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again. shuffles_go: those that made it are removed when it is written."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true" if shuffles_go else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes tables that written() returned and that nothing will read any more."""
    for t in tables:
        _delete(t.sparkSession, t._kinweave_path)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of the session; results that still read them can no longer be worked out."""
    context = spark.sparkContext
    folder = _FOLDERS.pop(context.applicationId, None) if context._jsc is not None else None
    if folder:
        _delete(spark, folder)
