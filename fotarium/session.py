"""Session defaults, table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "fotarium", **conf: str) -> SparkSession:
    """The active session, or a new one with this engine's defaults."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can
    import it wherever they start."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="fotarium-code-")) / "fotarium.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table of a data folder; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir, or, where that is unset
    (tests, local runs), a temporary folder that is set for the rest of the session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="fotarium-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the columns of these exact names (the first of each), whatever others there are, also ones
    that differ in case alone or occur twice."""
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it comes in fewer partitions than there are (a few small files): for
    work that costs far more than moving the rows. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    This cuts the lineage with a table that outlives executors; unlike checkpoint() it runs
    the plan once and stays columnar, so later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fotarium/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables written by materialize(). Results that still read them must have run."""
    for path, owner in list(_written.items()):
        if spark is None or owner is spark:
            try:
                jvm = owner.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # the session is gone: only a local folder can still be removed
                if path.startswith("file://") and os.path.isdir(path[7:]):
                    import shutil

                    shutil.rmtree(path[7:], ignore_errors=True)
            _written.pop(path, None)


atexit.register(release)
