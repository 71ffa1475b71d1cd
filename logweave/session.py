"""Session helpers for tests, the benchmark and scripts.

Library functions never create sessions; they work on the caller's.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["local_session", "shared_dir", "Scratch"]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "logweave") -> SparkSession:
    """A local session configured like the tests expect (UTC, AQE, no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    ``spark.checkpoint.dir`` of the session or its context, else the context's
    checkpoint folder.  A local session that names neither gets a temporary folder of its
    own, removed when the process ends; on a cluster that is an error, because
    executors could not see one another's files."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    path = path or sc.getCheckpointDir()
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = own = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _LOCAL_DIRS[sc.applicationId]


class Scratch:
    """Intermediate tables of one call, in a folder of its own under ``shared_dir``.

    ``save`` writes a DataFrame there and reads it back, which cuts the lineage: a
    lost executor costs the tasks that ran on it, not the plan behind the table.
    ``drop`` deletes a table that no later plan reads, ``close`` all of them; what a
    returned (lazy) DataFrame still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/logweave-{label}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM has gone before the process; nothing left to ask
            pass

    def _delete(self, path: str) -> None:
        target = self._path(path)
        target.getFileSystem(self._conf).delete(target, True)


_LOCAL_DIRS: dict[str, str] = {}
