"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the plans count on; all can be changed on a live session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let a skewed join be split even if that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    # the JVM never compiles methods beyond 8000 bytes, and the attribute struct makes such methods;
    # beyond the limit Spark splits them
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "spanloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # small data: spread it over the cores all the same
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named is not None:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_FOLDERS:
        folder = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_FOLDERS[sc.applicationId] = folder
    return _LOCAL_FOLDERS[sc.applicationId]


_LOCAL_FOLDERS: dict[str, str] = {}


def cut_lineage(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with ``options`` of the Parquet writer, and read it back.

    Used between the rounds of an iterative operator and for frames that many
    queries read: a lost executor costs a re-read and not a replay, the plan of
    every later query starts at a table, and the table is columnar, so queries
    prune it.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
