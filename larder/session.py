"""Session factory, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def make_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; an existing one is returned unchanged."""
    b = SparkSession.builder.master(master).appName("larder")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="larder-")) / "larder.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a single machine; on a cluster that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_written: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and return the written table, whose lineage is the files.

    Lazy results go on reading the files, so they stay until release() or the end of the program.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/larder-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def release() -> None:
    """Remove what materialise() wrote; results that read it can't be computed again."""
    while _written:
        spark, at = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its folder is its owner's
            return


atexit.register(release)
