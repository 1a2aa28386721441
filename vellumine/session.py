"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "vellumine", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # few rows can be much work here (texts, word pairs): small tables keep all cores busy
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "65536")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only in a local session, as in tests.

    A cluster without that setting is an error: a folder of one machine would silently lose what other executors write.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[[^\]]*\])?", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            base = "file://" + tempfile.mkdtemp(prefix="vellumine-")
        root = f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"
        _ROOTS[app] = root
        atexit.register(_remove, spark, root)
    return _ROOTS[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder belongs to the cluster's own cleaning
        pass


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
