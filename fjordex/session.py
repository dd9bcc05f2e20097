"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fjordex")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where that setting is absent, a session on one machine (tests, a laptop) gets
    a temporary folder as its checkpoint directory; on a cluster, whose executors
    would not see it, this is a RuntimeError. The folder is removed when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="fjordex-")
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/fjordex-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is already gone
        pass


_spaces: list[str] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Tables written inside the block are deleted at its end, so results must be taken or stored inside it.

    For sessions that live long; without one, written tables go when the application ends.
    """
    path = f"{scratch_dir(spark)}/space-{uuid.uuid4().hex[:12]}"
    _spaces.append(path)
    try:
        yield path
    finally:
        _spaces.remove(path)
        _remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_spaces[-1] if _spaces else scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, spread over them; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; tables that lie elsewhere are left alone."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if f"/fjordex-{t.sparkSession.sparkContext.applicationId}/" in path:
                _remove(t.sparkSession, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder.

    Unlike an executor-local checkpoint it survives the loss of executors, and
    its exact row count and size are known to the next plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
