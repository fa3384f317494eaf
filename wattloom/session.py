"""Session settings and lineage cuts."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "wattloom") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "12g")
         .config("spark.sql.shuffle.partitions", str(partitions)))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of the application below the shared one (`spark.checkpoint.dir`); in local mode without one, a temporary folder that goes when Python ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return _LOCAL[sc.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """New folder path for a written table, below the application's folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that the application wrote to cut lineages. Results that were not saved can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHARED: dict[tuple, str] = {}


def shared(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several plans of a session derive from the same inputs, written once. It is made anew when an input was written since, or when its copy is gone."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def changed(path: str) -> int:
        p = hadoop.Path(path)
        return p.getFileSystem(conf).getFileStatus(p).getModificationTime()
    key = (spark.sparkContext.applicationId, name, *((i, changed(i)) for i in inputs))
    copy = hadoop.Path(_SHARED[key]) if key in _SHARED else None
    if copy is None or not copy.getFileSystem(conf).exists(copy):
        path = scratch(spark, name)
        make().write.parquet(path)
        _SHARED[key] = path
    return spark.read.parquet(_SHARED[key])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to a table in the shared folder and read them back.

    The copy survives the loss of executors, later plans prune its columns, and its size is known, so the planner
    broadcasts it only below the session's threshold."""
    spark = df.sparkSession
    path = scratch(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
