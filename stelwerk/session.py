"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans are written for. Partition counts are left to adaptive execution, which merges small ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts cost far more than their bytes: a scan is cut into more parts than Spark's 128 MB would give.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "stelwerk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``conf`` overrides them (use ``**{"spark.x": "y"}``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_stelwerk_shipped", False):
        return
    package, at = Path(__file__).parent, tempfile.mkdtemp(prefix="stelwerk-ship-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)  # the driver serves the archive as long as it runs
    shutil.copytree(package, Path(at, "in", package.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(at, package.name)), "zip", Path(at, "in")))
    context._stelwerk_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``. Where none is set, a session on one machine (tests) gets a
    temporary one; on a cluster that would be another folder on each machine, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        at = tempfile.mkdtemp(prefix="stelwerk-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stelwerk/{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*partition_by).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
