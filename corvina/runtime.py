"""Session, table loading and the durable cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def session(app: str = "corvina", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings that the operators count on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if not os.environ.get("MASTER"):
        b = b.master(f"local[{cores}]")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; columns are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the session names none and the master is local (tests on one machine) a temporary folder is made, and removed at
    exit. On a cluster each machine would write a folder of its own, so there a missing setting is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="corvina-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive the loss of executors, are compressed, and
    carry the sizes by which Spark decides whether a side may be broadcast."""

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get(_FACTOR, "1.0") == "1.0":  # the size by which Spark judges is that of compressed files
            spark.conf.set(_FACTOR, "4.0")
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._drop_quietly, self.base)

    def _drop_quietly(self, path: str) -> None:
        try:
            self.drop(path)
        except Exception:  # the session is gone; the cluster clears its scratch folder
            pass

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written once and read back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corvina_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame | str) -> None:
        """Remove a table that nothing reads any more."""
        path = df if isinstance(df, str) else df._corvina_path  # type: ignore[attr-defined]
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
