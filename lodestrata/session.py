"""Session, tables and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lodestrata", cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass your own to every function."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that queries run
    wherever the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Only where that is unset (tests, a laptop) a local temporary folder takes its place,
    and only on a local master.
    """
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, so that a long session does not fill the shared
    folder; write or collect a result before that. Scopes nest."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scopes.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted with the innermost `scratch` scope, or by
    Hadoop when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage with a
    table that outlives any executor, and lets later passes reread it."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
