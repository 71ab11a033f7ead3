"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGING = "plumbgauge.staging.dir"
_STAGED: dict[str, list[str]] = {}


def build_session(master: str | None = None, app_name: str = "plumbgauge", **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, ANSI, AQE with skew-join splitting."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``, or else the session's own setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGING, None)
    if not folder:
        raise RuntimeError(f"set spark.checkpoint.dir, or {STAGING} in the session, to a folder all executors share")
    return folder


def has_staging(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGING, None))


def stage_locally(spark: SparkSession) -> None:
    """For tests, benchmarks and trials on one machine: give a local session without a staging folder one of its own."""
    if has_staging(spark):
        return
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder of this machine is not visible to the executors")
    spark.conf.set(STAGING, tempfile.mkdtemp(prefix="plumbgauge-"))


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared staging folder and read it back.

    Cuts the lineage and survives the loss of executors. Columnar, so a later pass reads
    only the columns it needs. The files stay until :func:`release` or the end of :func:`staged`.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written once for what passes over it several times; as it is in a session without a staging folder."""
    return materialise(df, label) if has_staging(df.sparkSession) else df


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables this application has staged, but for the first ``keep``; results not yet written elsewhere are lost."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(paths) > keep:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Staged tables made inside are deleted at the end: write the results before."""
    before = len(_STAGED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def spread(scan: DataFrame) -> DataFrame:
    """Give a file scan with fewer splits than cores one partition per core.

    Worth it before heavy row work on a small file. A large table has more splits than cores and
    is returned as it is. ``scan`` must be a plain scan: its partitions are known without running.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
