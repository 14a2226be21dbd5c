"""Session settings and the shared folder used to cut lineage or stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.requireAllClusterKeysForDistribution": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def by_all_keys(df: DataFrame) -> DataFrame:
    """Make windows and aggregates on (key, chunk) shuffle on both, also above a join on the key.

    Spark takes rows hashed by the key alone as good enough, and then one task has a whole key.  The
    setting belongs to the session, which may be the caller's own, so every helper that relies on it sets it.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    return df


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name storage every executor can reach, so a
    missing value is an error there; only a local session gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to storage shared by all executors")
        folder = tempfile.mkdtemp(prefix="tracewright-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a staged table."""
    return f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again.

    Like a checkpoint it survives the loss of executors.  Its plan starts anew, with known sizes and
    without the constraints that a loop would pile up from round to round.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
