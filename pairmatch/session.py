"""Session helpers: one place for the configuration every job in the library assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins from runtime sizes, coalesces small shuffle partitions and splits
# skewed join partitions. Joins on (arg_id, key_point_id) keep hashing on both keys (Spark's
# default): partitioning such a join by arg_id alone would put all gold rows of a hot argument
# into one task on the side of a left join that AQE cannot split.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a side below this size is broadcast, by estimate or by measured size; beyond it never
    "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pairmatch", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library defaults.

    On a cluster pass ``master=None`` and let the launcher decide; ``shuffle_partitions``
    should then be sized so one shuffle partition stays around 128-256 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a home.

    The folder named by ``spark.checkpoint.dir`` (a shared file system on a cluster) wins.
    Only a local-mode session without one (tests, laptops) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) "
            "so checkpoints survive the loss of an executor")
    base = os.environ.get("TMPDIR", tempfile.gettempdir())
    path = tempfile.mkdtemp(prefix="pairmatch-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return path


_SCRATCH: list[str] = []     # folders that this process made and has not dropped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the reliable checkpoint folder (shared on a cluster)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def scratch_table(path: str) -> str:
    """The catalog name of a table kept in a scratch folder."""
    return path.rsplit("/", 1)[1].replace("-", "_")


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this process, and the catalog entries of tables in them; returns
    how many. Frames are lazy and read these folders when they run, so this is for the end of a job,
    when its results are written; only folders made by ``scratch_path`` here are touched."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    dropped = 0
    while _SCRATCH:
        path = _SCRATCH.pop()
        spark.sql(f"DROP TABLE IF EXISTS `{scratch_table(path)}`")
        p = hadoop.Path(path)
        dropped += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return dropped
